"""Queries of labels, rules over texts and the steps around the merge, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearby.functions import classify as C
from nearby.functions import labels
from nearby.functions import text as X
from nearby.functions import vocab as V
from nearby.operators import listings as L
from nearby.operators import places, spatial
from nearby.plans.fixtures import view
from nearby.plans.queries_places import VERDICTS, verdicts
from nearby.plans.queries_search import ITEMS, LIVE, ROUTES, SEGMENTS, items_and_places, listings, live, now, query



@query("drop_finished", "select id from v_listings where case when repeats then not coalesce(until_at::date < date '1996-01-01', false) else greatest(coalesce(end_at::date, start_at::date), start_at::date) >= date '1996-01-01' end", "v_listings")
def _(s, d):
    return L.drop_finished(listings(s, d), F.lit("1996-01-01").cast("date")).select("id")


@query("drop_unlinkable", "select id from v_listings where o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0", "v_listings")
def _(s, d):
    url = F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 5 != 0, "http://x")
    return L.drop_unlinkable(listings(s, d).withColumn("url", url)).select("id")


@query("campus_public", """select o_orderkey, title from (select o_orderkey, case cast(o_orderkey % 5 as int) when 0 then 'Jazz concert' when 1 then 'Soccer vs. Bard' when 2 then 'Soccer at Bard' when 3 then 'Registration' else 'Something' end as title, o_orderkey % 2 as c from v_listings) where c = 0 or title in ('Jazz concert', 'Soccer vs. Bard')""", "v_listings")
def _(s, d):
    n = F.col("o_orderkey") % 5
    df = listings(s, d).withColumn("title", F.when(n == 0, "Jazz concert").when(n == 1, "Soccer vs. Bard").when(n == 2, "Soccer at Bard").when(n == 3, "Registration").otherwise("Something")).withColumn("source", (F.col("o_orderkey") % 2).cast("string"))
    return L.drop_noise(df, s.createDataFrame([("1",)], "source string")).select("o_orderkey", "title")


@query("derived_cadence", "select id, case cast(o_orderkey % 6 as int) when 0 then 'daily' when 1 then 'fortnightly' when 2 then 'monthly' when 3 then 'weekly' when 4 then 'bookable' else case when repeats then 'occasional' end end as cadence from v_listings", "v_listings")
def _(s, d):
    said = F.get(F.array(*map(F.lit, ("Every day, through Sep 2", "Every other Tuesday", "Every third Monday of the month", "Every Tuesday & Thursday", "Bookable — 9 upcoming dates", None))), (F.col("o_orderkey") % 6).cast("int"))
    return L.derive(listings(s, d).drop("cadence").withColumn("recurrence", said)).select("id", "cadence")


@query("price_worklist", """with p as (select *, 'http://pay.example/' || (o_orderkey % 400) as url from v_listings), c as (select * from p where price_min is null and start_at::date >= date '1996-01-01'), w as (select venue_key, count(*) as weight from c group by 1),
t as (select url, max(weight) as weight, min(start_at) as start_at from c join w using (venue_key) where (o_orderkey % 400) % 4 <> 0 group by url) select url, weight from t order by weight desc, start_at, url limit 50""", "v_listings")
def _(s, d):
    df = listings(s, d).withColumn("url", F.concat(F.lit("http://pay.example/"), (F.col("o_orderkey") % 400).cast("string")))
    cache = s.range(400).select(F.concat(F.lit("http://pay.example/"), F.col("id").cast("string")).alias("url"), F.when(F.col("id") % 4 == 0, F.lit("1995-12-20")).otherwise("1990-01-01").cast("date").alias("checked"))
    return L.price_worklist(df, cache, F.lit("1996-01-01").cast("date"), 50).select("url", "weight")


@query("picture_targets", f"with v as ({VERDICTS}), p as (select id, url, concat('site', cast(c_custkey % 300 as varchar(20)), '.example.com') as domain from v_places where url is not null and brand is null and kind in ('museum', 'park')) select domain || '/visit' as page, arg_min(url, id) as url from p where domain not in (select domain from v where verdict in ('suspect', 'parked')) group by 1", "v_places")
def _(s, d):
    return L.picture_targets(view(s, d, "v_places"), verdicts(s, d), ("museum", "park"))


@query("directory_summary", "select count(*) as total, count(*) filter (where c_custkey % 4 = 1) as with_events, count(*) filter (where c_custkey % 4 = 0) as quiet, count(brand) as branded from v_places", "v_places")
def _(s, d):
    p = view(s, d, "v_places")
    return L.directory_summary(p.withColumn("events", (F.col("c_custkey") % 4 == 1).cast("int")).withColumn("event_info", F.when(F.col("c_custkey") % 4 == 0, "none")))


@query("geocode_reasons", "select reason, count(*) as n from (select case when city is null then 'no location' when city in ('Town 1', 'Town 2') then 'found' else 'not found' end as reason from v_places) group by 1", "v_places")
def _(s, d):
    asked = view(s, d, "v_places").select("id", F.array_compact(F.array("city")).alias("variants"))
    known = s.createDataFrame([("Town 1", 1.0, 2.0), ("Town 2", 1.0, 2.0)], "query string, lat double, lon double")
    return L.reasons(places.geocode(asked, known))


@query("busiest_sources", "with n as (select source, count(*) as n from v_occurrences group by 1) select source, n, round(n / (sum(n) over ()), 4) as share from n order by n desc, source limit 10", "v_occurrences")
def _(s, d):
    return L.busiest(view(s, d, "v_occurrences"))


@query("apply_items", f"with i as ({ITEMS}), p as (select id, concat('Q', cast(c_custkey - c_custkey % 2 as varchar(20))) as qid from v_places) select id, label as wiki_title, 'https://commons.wikimedia.org/wiki/Special:FilePath/' || replace(image, ' ', '_') || '?width=640' as wiki_image from p left join i using (qid)", "v_places")
def _(s, d):
    items, _ = items_and_places(s, d)
    p = view(s, d, "v_places")
    matches = p.select("id", F.concat(F.lit("Q"), (F.col("c_custkey") - F.col("c_custkey") % 2).cast("string")).alias("qid"))
    return places.apply_items(p, matches, items).select("id", "wiki_title", "wiki_image")


@query("thin_route", f"with {SEGMENTS}, r as (select *, row_number() over (partition by route_id, floor(cum0 / 8) order by seq) as k from seg) select route_id, seq, round(cum0, 5) as along from r where k = 1")
def _(s, d):
    view(s, d, "supplier").createOrReplaceTempView("supplier")
    return spatial.thin_route(s.sql(ROUTES), 8.0).select("route_id", "seq", F.round("along", 5).alias("along"))


@query("when_labels", f"with {LIVE} select id, case when day = date '1995-06-17' then 'Today' when day = date '1995-06-18' then 'Tomorrow' else strftime(day, '%a, %b %-d') end || ', ' || case when ongoing then 'on now, through ' || strftime(end_at, '%b %-d') when end_at::date > next_at::date then '12 AM, through ' || strftime(end_at, '%b %-d') when all_day then 'all day' else '12 AM' end as label from live where not (repeats and end_at is not null)", "v_listings")
def _(s, d):
    c, today = F.col, F.to_date(now())
    df = live(s, d).where("not (repeats and end_at is not null)")
    return df.select("id", labels.when_label(c("day"), c("next_at"), c("end_at"), c("ongoing"), c("underway"), c("all_day"), today).alias("label"))


@query("day_headings", f"with {LIVE} select day::varchar as day, case when day = date '1995-06-17' then 'Today' when day = date '1995-06-18' then 'Tomorrow' when day < date '1995-06-24' then strftime(day, '%A') else strftime(day, '%A, %b %-d') end as heading, count(*) as n from live group by day", "v_listings")
def _(s, d):
    return live(s, d).groupBy("day").agg(F.count("*").alias("n")).select("day", labels.day_heading(F.col("day"), F.to_date(now())).alias("heading"), "n")


@query("price_labels", "select id, case when price_min is null then 'See listing' when price_min = 0 then 'Free' when price_min = floor(price_min) then '$' || price_min::bigint else '$' || printf('%.2f', price_min) end as label from v_listings", "v_listings")
def _(s, d):
    return listings(s, d).select("id", C.price_label(F.col("price_min"), F.lit(None).cast("double")).alias("label"))


@query("drive_types", "select id, case kind when 'museum' then 'museum' when 'historic site' then case when c_custkey % 3 = 0 then 'memorial' when c_custkey % 3 = 1 then 'church' else 'building' end when 'antique shop' then 'antiques' when 'park' then case when c_custkey % 3 = 1 then 'park' when c_custkey % 3 = 0 then 'memorial' else 'big-park' end else kind end as type from v_places", "v_places")
def _(s, d):
    n = F.col("c_custkey") % 3
    name = F.when((n == 1), "Old Chapel").otherwise(F.col("name"))
    tag, designation = F.when(n == 0, "historic=memorial"), F.when(n == 2, "State Park")
    p = view(s, d, "v_places").withColumn("designation", F.when(F.col("kind") == "park", designation))
    return p.select("id", labels.drive_type(F.col("kind"), name, tag, F.col("designation")).alias("type"))


@query("cuisine_counts", "select cuisine, count(*) as n from (select unnest(case cast(c_custkey % 4 as int) when 0 then ['pizza', 'japanese'] when 1 then ['mexican'] when 2 then ['none'] else ['none'] end) as cuisine from v_places) group by 1", "v_places")
def _(s, d):
    n = F.col("c_custkey") % 4
    tag = F.when(n == 0, "Pizza; sushi").when(n == 1, "tacos,burrito").when(n == 2, "unheard_of")
    groups = C.cuisines(tag)
    return view(s, d, "v_places").select(F.explode(F.when(F.size(groups) > 0, groups).otherwise(F.array(F.lit("none")))).alias("cuisine")).groupBy("cuisine").agg(F.count("*").alias("n"))


@query("unmapped_cuisines", "select 'unheard_' || (c_custkey % 9) as token, count(*) as n from v_places where c_custkey % 2 = 0 group by 1", "v_places")
def _(s, d):
    value = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Pizza; Unheard "), (F.col("c_custkey") % 9).cast("string"))).otherwise("thai")
    return places.unmapped_cuisines(view(s, d, "v_places").select(F.create_map(F.lit("cuisine"), value).alias("tags")))


@query("osm_places", "select concat('osm-node-', c_custkey) as id, name, case when kind = 'antique shop' then 'antique shop' else kind end as kind, lat, lon from v_places where kind <> 'park' and not (kind = 'historic site' and c_custkey % 2 = 1)", "v_places")
def _(s, d):
    k, n = F.col("kind"), F.col("c_custkey") % 2
    tags = F.map_filter(F.create_map(F.lit("name"), F.col("name"), F.lit("tourism"), F.when(k == "museum", "museum"), F.lit("historic"), F.when(k == "historic site", "fort"), F.lit("shop"), F.when(k == "antique shop", "antiques"), F.lit("amenity"), F.when(k == "restaurant", "restaurant"), F.lit("cuisine"), F.when(k == "restaurant", "thai"), F.lit("wikipedia"), F.when(n == 0, "en:x")), lambda _, v: v.isNotNull())
    e = view(s, d, "v_places").select(F.lit("node").alias("type"), F.col("c_custkey").alias("id"), "lat", "lon", F.lit(None).cast("struct<lat:double,lon:double>").alias("center"), tags.alias("tags"))
    return places.osm_places(e).select("id", "name", "kind", "lat", "lon")


WHOLE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '\\(.*?\\)', '', 'g'), '\\b(session|part|day|week|no\\.?|#)\\s*\\d+\\b', '', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


@query("title_tokens", f"select doc_id, list_sort(list_distinct(list_filter(string_split({WHOLE}, ' '), lambda w: length(w) > 2 and not list_contains(['the', 'a', 'an', 'at', 'in', 'on', 'of', 'and', 'for', 'to', 'with', 'annual', 'presents', 'featuring'], w)))) as tokens from documents")
def _(s, d):
    return view(s, d, "documents").select("doc_id", F.sort_array(X.title_tokens(F.col("text"))).alias("tokens"))


@query("stop_labels", """select id, case when m < 60 then m || ' min' when m % 60 = 0 then (m // 60) || ' h' else (m // 60) || ' h ' || (m % 60) || ' min' end as duration, case when k % 25 < 1 then 'On the way' else '+' || (k % 25) || ' min' end || ' · ' || case when k % 30 = 0 then 'beside you' when k % 30 < 10 then (k % 30) || '.0 mi' else (k % 30) || ' mi' end as facts from (select id, c_custkey as k, c_custkey % 200 as m from v_places)""", "v_places")
def _(s, d):
    k = F.col("c_custkey")
    return view(s, d, "v_places").select("id", labels.duration_label(k % 200).alias("duration"), labels.facts_label((k % 25).cast("double"), (k % 30).cast("double")).alias("facts"))


@query("place_names", """select id, case when c_custkey % 3 = 0 then name else coalesce(city, name) end as place, case when c_custkey % 2 = 0 then 'The Sound of Music: A Night in ' || upper(substr(kind, 1, 1)) || substr(kind, 2, strpos(kind || ' ', ' ') - 2) else 'the Sound of music' end as headline from v_places""", "v_places")
def _(s, d):
    venue = F.when(F.col("c_custkey") % 3 == 0, F.col("name")).otherwise(F.lit("12 Main Street"))
    shout = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("THE SOUND OF MUSIC: A NIGHT IN "), F.upper(F.substring_index("kind", " ", 1)))).otherwise("the Sound of music")
    return view(s, d, "v_places").select("id", X.place_name(venue, F.col("city"), F.col("name")).alias("place"), X.headline(shout).alias("headline"))


@query("stable_ids", "select o_orderkey, venue_key || '-' || substr(sha1(o_orderkey::varchar || strftime(start_at, '%Y-%m-%d')), 1, 8) as id from v_listings", "v_listings")
def _(s, d):
    return listings(s, d).select("o_orderkey", X.stable_id(F.col("venue_key"), F.col("o_orderkey").cast("string"), F.date_format("start_at", "yyyy-MM-dd")).alias("id"))


@query("type_aliases", "select id, case cast(o_orderkey % 4 as int) when 0 then 'play,concert' when 1 then 'talk' when 2 then 'meetup,club,film' else 'museum exhibit' end as types from v_listings", "v_listings")
def _(s, d):
    old = F.array(F.lit("theater"), F.lit("music"), F.lit("show")), F.array(F.lit("science")), F.array(F.lit("community"), F.lit("meetup"), F.lit("film")), F.array(F.lit("museum"), F.lit("exhibit"))
    n = F.col("o_orderkey") % 4
    return listings(s, d).select("id", F.array_join(C.type_aliases(F.when(n == 0, old[0]).when(n == 1, old[1]).when(n == 2, old[2]).otherwise(old[3])), ",").alias("types"))


@query("drop_reasons", "select reason, count(*) as n from (select case when o_orderkey % 4 = 0 and o_orderkey % 10 <> 0 then 'noise' when case when repeats then coalesce(until_at::date < date '1996-01-01', false) else greatest(coalesce(end_at::date, start_at::date), start_at::date) < date '1996-01-01' end then 'finished' when o_orderkey % 3 = 0 then 'no link' else 'kept' end as reason from v_listings) group by 1", "v_listings")
def _(s, d):
    k = F.col("o_orderkey")
    ls = listings(s, d).withColumn("id", F.when(k % 10 == 0, F.concat(F.lit("manual-"), k.cast("string"))).otherwise(F.col("id"))).withColumn("title", F.when(k % 4 == 0, "Board Meeting").otherwise("Film"))
    return L.reasons(L.fates(ls.withColumn("url", F.when(k % 3 != 0, "https://x")), F.lit("1996-01-01").cast("date")))


#: Texts with words that rules look for, by key. DuckDB's word borders know ASCII letters alone, so its SQL puts one for each other letter.
SPICED = "select doc_id, case cast(doc_id % 5 as int) when 0 then 'Outdoor hike and picnic. ' when 1 then 'Paint your own mug, dinner and drinks inside the theater. ' when 2 then 'Live music, trivia and kids crafts for families. ' when 3 then 'Yoga class and a science talk. ' else '' end || coalesce(text, '') as t from documents"
told = lambda p: "regexp_matches(t, '" + p.replace("'", "''") + "', 'i')"


@query("text_rules", f"""with x as (select doc_id, regexp_replace(t, '[^\\x00-\\x7F]', 'q', 'g') as t from ({SPICED})) select doc_id, {told(V.ACTIVITY_HINTS)} as hint, {told(V.FOOD_WORDS)} as food, case when {told(V.OUTDOOR)} and not {told(V.INDOOR)} then 'outdoor' when {told(V.INDOOR)} and not {told(V.OUTDOOR)} then 'indoor' else 'unknown' end as setting,
coalesce(nullif(array_to_string(list_filter([{', '.join(f"case when {told(p)} then '{n}' end" for n, p in V.LEGACY_CATEGORIES)}], lambda c: c is not null)[1:4], ','), ''), 'community') as categories from x""")
def _(s, d):
    view(s, d, "documents").createOrReplaceTempView("documents")
    return s.sql(SPICED).select("doc_id", C.text_reading(F.col("t")).alias("r")).select("doc_id", "r.hint", "r.food", "r.setting", F.array_join("r.categories", ",").alias("categories"))


@query("curated_listings", "select id from (select case when o_orderkey % 10 = 0 then 'manual-' || o_orderkey else id end as id, case cast(o_orderkey % 4 as int) when 0 then 'Board Meeting' else title end as title from v_listings) where id like 'manual-%' or title <> 'Board Meeting'", "v_listings")
def _(s, d):
    ls = listings(s, d).withColumn("id", F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("manual-"), F.col("o_orderkey").cast("string"))).otherwise(F.col("id")))
    return L.drop_noise(ls.withColumn("title", F.when(F.col("o_orderkey") % 4 == 0, "Board Meeting").otherwise(F.col("title")))).select("id")


@query("refreshed_listings")
def _(s, d):
    df = listings(s, d).withColumn("source", F.col("venue_key")).withColumn("url", F.lit("https://x.example/")).withColumn("venue", F.col("venue_key")).drop("types", "type_1", "type_2")
    rich = X.richness({"price": F.col("price_min"), "end": F.col("end_at")})
    return L.finalize(df, F.lit("1996-01-01").cast("date"), rich, F.col("o_orderkey")).select("id", "title", "venue_key", "type", "cadence", "recurrence", "start_at", "until_at")


