"""Queries of the directory, hours, drives, feeds, pages and gates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearby.functions import classify as C
from nearby.functions import text as X
from nearby.operators import drive, hours, places, quality, spatial, web
from nearby.plans.fixtures import view
from nearby.plans.queries_search import LAT0, LON0, NOW, SEGMENTS, haversine, listings, query, segments
from nearby.sources import ical, jsonld

#: Weekly intervals of the six texts of v_places, by hand.
HOURS = """h(k, dow, from_min, to_min, always) as (select 0, d, 660, 1320, false from range(0, 7) t(d) union all select 1, d, 1020, 1320, false from range(1, 4) t(d) union all select 1, d, 1020, 1500, false from range(4, 6) t(d)
  union all select 2, d, 0, 1440, true from range(0, 7) t(d) union all select 4, d, 600, 1560, false from range(0, 7) t(d)),
iv as (select id, dow::int as dow, from_min, to_min, always from v_places join h on c_custkey % 6 = k)"""


@query("hours_intervals", f"with {HOURS} select id, dow, from_min, to_min, always from iv", "v_places")
def _(s, d):
    return hours.hours_intervals(view(s, d, "v_places")).select("id", "dow", "from_min", "to_min", "always")


#: Friday 00:30, so that Thursday's late hours count.
@query("minutes_open", f"""with {HOURS}, m as (select id, case when always then 1e9 else to_min - 30 end as l from iv where dow = 4 and 30 >= from_min and 30 < to_min union all select id, case when always then 1e9 else to_min - 1470 end from iv where dow = 3 and 1470 >= from_min and 1470 < to_min)
select p.id, case when c_custkey % 6 in (3, 5) then null else coalesce((select max(l) from m where m.id = p.id), 0)::double end as minutes_left from v_places p""", "v_places")
def _(s, d):
    p = view(s, d, "v_places")
    out = hours.minutes_open(p, hours.hours_intervals(p), F.lit("2024-01-19 00:30:00").cast("timestamp_ntz"))
    return out.select("id", F.when(F.col("minutes_left") == float("inf"), 1e9).otherwise(F.col("minutes_left")).alias("minutes_left"))


@query("open_now_places", f"""with {HOURS} select p.id from v_places p where kind <> 'x' and id in (select id from iv where dow = 2 and 1200 >= from_min and 1200 < to_min)""", "v_places")
def _(s, d):
    from nearby.operators import search

    p = view(s, d, "v_places")
    out = hours.minutes_open(p, hours.hours_intervals(p), F.lit("2024-01-17 20:00:00").cast("timestamp_ntz"))
    return search.search_places(out, search.PlaceQuery(open_now=True)).select("id")


@query("attach_events", """with l as (select * from v_listings where venue_key not like '% 3'), c as (select case when o_orderkey % 17 = 0 then concat(venue_key, ' Museum') else venue_key end as vk, count(*) as events from l group by 1), h as (select name, min(id) as id from v_places where name not like '% 5' group by name)
select p.id, coalesce(c.events, 0)::bigint as events, false as from_feed from v_places p left join h on p.id = h.id left join c on h.name = c.vk where p.name not like '% 5'
union all select concat('venue-', trim(regexp_replace(lower(vk), '[^a-z0-9]+', '-', 'g'), '-')), events, true from c where vk not in (select name from h) and (events >= 2 or vk like '% Museum')""", "v_listings", "v_places")
def _(s, d):
    ls = listings(s, d).where("venue_key not like '% 3'").withColumn("venue_key", F.when(F.col("o_orderkey") % 17 == 0, F.concat("venue_key", F.lit(" Museum"))).otherwise(F.col("venue_key")))
    return places.attach_events(view(s, d, "v_places").where("name not like '% 5'"), ls).select("id", "events", "from_feed")


@query("place_or_fallback", """with h as (select name, min(id) as pid from v_places where name not like '% 5' group by name) select venue_key, any_value(pid) is not null as found, coalesce(any_value(pid), concat('venue-', trim(regexp_replace(lower(venue_key), '[^a-z0-9]+', '-', 'g'), '-'))) as place_id, count(*) as events from v_listings left join h on venue_key = name group by venue_key""", "v_listings", "v_places")
def _(s, d):
    return places.place_or_fallback(listings(s, d), view(s, d, "v_places").where("name not like '% 5'")).select("venue_key", "found", "place_id", "events")


#: A name is exactly a brand's on some rows.
BRANDED = "select id, case when c_custkey % 10 = 3 then upper(concat('brand', cast(c_custkey % 9 as varchar(20)))) else name end as name, brand, kind, lat, lon, opening_hours, url, city, c_custkey from v_places"


def branded(s, d):
    view(s, d, "v_places").createOrReplaceTempView("v_places")
    return s.sql(BRANDED)


@query("mark_chains", f"with p as ({BRANDED}), b as (select lower(brand) as k, max(brand) as bn from p where brand is not null group by 1) select id, coalesce(brand, bn) as chain from p left join b on lower(name) = k", "v_places")
def _(s, d):
    return places.mark_chains(branded(s, d)).select("id", "chain")


@query("chain_counts", f"with p as ({BRANDED}), b as (select lower(brand) as k, max(brand) as bn from p where brand is not null group by 1), c as (select coalesce(brand, bn) as chain from p left join b on lower(name) = k) select chain, count(*) as n from c where chain is not null group by 1", "v_places")
def _(s, d):
    return places.chain_counts(branded(s, d))


VERDICTS = "select concat('site', cast(c_custkey as varchar(20)), '.example.com') as domain, case cast(c_custkey % 7 as int) when 0 then 'suspect' when 1 then 'parked' when 2 then 'none' when 3 then 'none' else 'listings' end as verdict, date '2024-01-01' - cast(c_custkey % 90 as int) as checked, case when c_custkey % 8 = 2 then null else 'abc' end as sig from customer"


def verdicts(s, d):
    view(s, d, "customer").createOrReplaceTempView("customer")
    return s.sql(VERDICTS)


@query("apply_audit", f"with v as ({VERDICTS}), p as (select *, concat('site', cast(c_custkey % 300 as varchar(20)), '.example.com') as domain from v_places where url is not null) select id, case when verdict in ('suspect', 'parked') then null else url end as url, case when verdict = 'none' and c_custkey % 3 = 0 then 'none' end as event_info, case when verdict = 'none' and c_custkey % 3 = 0 then checked::varchar end as event_checked from p left join v using (domain)", "v_places")
def _(s, d):
    p = view(s, d, "v_places").where("url is not null").withColumn("events", F.col("c_custkey") % 3)
    return places.apply_audit(p, verdicts(s, d)).select("id", "url", "event_info", "event_checked")


@query("stale_answers", f"with v as ({VERDICTS}), p as (select distinct concat('site', cast(c_custkey % 300 as varchar(20)), '.example.com') as domain from v_places where url is not null) select domain, verdict from p left join v using (domain) where checked is null or date '2024-01-15' - checked >= case verdict when 'none' then 30 when 'listings' then 60 when 'suspect' then 7 else 0 end", "v_places")
def _(s, d):
    subjects = view(s, d, "v_places").select(X.domain_of(F.col("url")).alias("domain")).where("domain is not null").distinct()
    return places.stale(subjects, verdicts(s, d), {"none": 30, "listings": 60, "suspect": 7}, F.lit("2024-01-15").cast("date"))


PICTURES = "select concat('site', cast(c_custkey % 300 as varchar(20)), '.example.com/visit') as page, concat('https://img.example/', cast((c_custkey % 300) % 90 as varchar(20)), '.jpg') as image from customer group by c_custkey % 300"


@query("apply_pictures", f"with i as ({PICTURES}), p as (select id, concat('site', cast(c_custkey % 300 as varchar(20)), '.example.com/visit') as page from v_places where url is not null), j as (select id, image from p left join i using (page)), n as (select image, count(*) as n from j group by 1) select id, case when n <= 6 then j.image end as image from j left join n on j.image = n.image", "v_places")
def _(s, d):
    view(s, d, "customer").createOrReplaceTempView("customer")
    return places.apply_pictures(view(s, d, "v_places").where("url is not null"), s.sql(PICTURES), 6).select("id", "image")


@query("best_picture", "select id, case when kind = 'restaurant' then coalesce(brand, city) else coalesce(city, brand) end as picture from v_places", "v_places")
def _(s, d):
    return view(s, d, "v_places").select("id", places.best_picture(F.col("kind"), F.col("brand"), F.col("city")).alias("picture"))


@query("place_summary", "with k as (select kind, count(*) as n, count(*) filter (where c_custkey % 3 = 0) as e from v_places group by 1) select sum(n)::bigint as total, count(*) as kinds, sum(e)::bigint as with_events, string_agg(kind, ',' order by n desc, kind) as top_kinds from k", "v_places")
def _(s, d):
    return places.place_summary(view(s, d, "v_places").withColumn("events", F.when(F.col("c_custkey") % 3 == 0, 2)))


@query("food_summary", "select count(*) as n, round(100.0 * count(*) filter (where c_custkey % 4 = 0) / count(*), 1) as with_cuisine, round(100.0 * count(opening_hours) / count(*), 1) as with_hours, round(100.0 * count(brand) / count(*), 1) as branded from v_places where kind = 'restaurant'", "v_places")
def _(s, d):
    cuisine = F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("pizza"))).otherwise(F.array().cast("array<string>"))
    return places.food_summary(view(s, d, "v_places").withColumn("cuisine", cuisine))


@query("place_domains", f"with v as ({VERDICTS}), p as (select id, name, concat('site', cast(c_custkey % 300 as varchar(20)), '.example.com') as domain from v_places where url is not null), r as (select *, row_number() over (partition by domain order by id) as k from p where domain not in (select domain from v where verdict = 'listings')) select domain, count(*) as n, string_agg(name, '; ' order by id) filter (where k <= 4) as names from r group by domain", "v_places")
def _(s, d):
    return places.place_domains(view(s, d, "v_places"), verdicts(s, d).where("verdict = 'listings'"))


NODES = "select concat('http://www.pay.example/e/', cast(o_orderkey % 500 as varchar(20)), '/') as page_url, concat('https://pay.example/e/', cast((o_orderkey * 7) % 500 as varchar(20)), '?utm=1') as node_url, case when o_orderkey % 4 > 0 then floor(o_totalprice / 10) / 1e2 end as price_min from orders"


@query("backfill_prices", f"""with n as (select 'pay.example/e/' || (o_orderkey % 500) as page, 'pay.example/e/' || ((o_orderkey * 7) % 500) as node, floor(o_totalprice / 10) / 1e2 as p from orders where o_orderkey % 4 > 0),
o as (select page, min(p) as own from n where node = page group by 1), s as (select page, min(p) as sole from n group by 1 having count(*) = 1), b as (select node as page, min(p) as sibling from n where node <> page group by 1)
select id, coalesce(price_min, own, sole, sibling) as price_min from (select *, 'pay.example/e/' || (o_orderkey % 500) as page from v_listings) left join o using (page) left join s using (page) left join b using (page)""", "v_listings")
def _(s, d):
    ls = listings(s, d).withColumn("url", F.concat(F.lit("https://www.pay.example/e/"), (F.col("o_orderkey") % 500).cast("string"), F.lit("/?x=2")))
    view(s, d, "orders").createOrReplaceTempView("orders")
    return places.backfill_prices(ls, s.sql(NODES)).select("id", "price_min")


@query("geocode", """with g as (select distinct name || ', Town ' || (c_custkey % 23) as q from v_places where brand is not null), t as (select distinct 'Town ' || k as q from range(0, 10) t(k)), a as (select id, kind, case when city is null then name else name || ', ' || city end as q0, city as q1 from v_places)
select a.id, case when g.q is not null then 0 when t.q is not null then 1 end as precision, case when g.q is not null or t.q is not null then 'found' when kind in ('museum', 'park') then 'source venue' else 'not found' end as reason, case when g.q is not null or t.q is not null then 1.0 when kind in ('museum', 'park') then 40.0 end as lat from a left join g on q0 = g.q left join t on q1 = t.q""", "v_places")
def _(s, d):
    return geocoded(s, d).select("id", "precision", "reason", "lat")


def geocoded(s, d):
    p = view(s, d, "v_places")
    asked = p.select("id", F.col("kind").alias("source_id"), X.query_variants(F.col("name"), F.lit(None).cast("string"), F.col("city")).alias("variants"))
    known = p.where("brand is not null").select(F.concat_ws(", ", "name", F.concat(F.lit("Town "), (F.col("c_custkey") % 23).cast("string"))).alias("query"))
    known = known.union(s.range(10).select(F.concat(F.lit("Town "), F.col("id").cast("string")))).distinct()
    registry = p.where("kind in ('museum', 'park')").select(F.col("kind").alias("source_id")).distinct()
    point = lambda lat, lon: (F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
    return places.geocode(asked, known.select("query", *point(1.0, 2.0)), registry.select("source_id", *point(40.0, -70.0)))


#: Fix by fix: a car's state as one row that the next fix changes.
TRACK = f"""/* recursive */ f as (select *, epoch(fix_at) as at_, row_number() over (partition by car order by fix_at, event_id) as n from v_fixes where lat is not null),
st as (select car, event_id, n, at_, lat, lon, 0.0::double as step, 0.0::double as odometer, coalesce(gps_speed * 2.23694, 0)::double as speed, case when gps_heading is not null and gps_speed * 2.23694 > 5 then gps_heading end as heading, lat as hlat, lon as hlon from f where n = 1
  union all select car, event_id, n, at_, lat, lon, step, odometer + step, case when gps_speed is null and at_ > at0 then step / ((at_ - at0) / 3600) else now_speed end, case when own then gps_heading when turned then bear else heading end, case when own or turned then lat else hlat end, case when own or turned then lon else hlon end
  from (select f.car, f.event_id, f.n, f.at_, f.lat, f.lon, f.gps_speed, f.gps_heading, st.at_ as at0, st.odometer, st.heading, st.hlat, st.hlon, {haversine('st.lat', 'st.lon', 'f.lat', 'f.lon')} as step, coalesce(f.gps_speed * 2.23694, st.speed) as now_speed, f.gps_heading is not null and coalesce(f.gps_speed * 2.23694, st.speed) > 5 as own,
    {haversine('st.hlat', 'st.hlon', 'f.lat', 'f.lon')} > 0.02 as turned, fmod(degrees(atan2((f.lon - st.hlon) * 69.172 * cos(radians(st.hlat)), (f.lat - st.hlat) * 69.172)) + 360, 360) as bear from st join f on f.car = st.car and f.n = st.n + 1))"""


@query("track", f"with {TRACK} select car, event_id, round(step, 5) as step, round(odometer, 4) as odometer, round(speed, 4) as speed, round(heading, 4) as heading from st", "v_fixes")
def _(s, d):
    return drive.track(view(s, d, "v_fixes")).select("car", "event_id", *(F.round(c, n).alias(c) for c, n in (("step", 5), ("odometer", 4), ("speed", 4), ("heading", 4))))


ALERTS = """al as (select car, event_id, n, at_, case when 5.0 - step <= 0.2 or step <= 0.4 then 0 else 1 end as run, 5.0 - step <= 0.2 as arrived, null::double as last_, case when 5.0 - step <= 0.2 then 'arrived' end as alert from st where n = 1
  union all select car, event_id, n, at_, case when here or due then x else r end, arrived or here, case when due then at_ else last_ end, case when here and not arrived then 'arrived' when due then 'off route' end
  from (select *, not here and r >= 3 and (last_ is null or at_ - last_ > 60) as due, case when here then run else 0 end as x from (select st.car, st.event_id, st.n, st.at_, al.run, al.arrived, al.last_, 5.0 - st.step <= 0.2 as here, case when st.step > 0.4 then al.run + 1 else 0 end as r from al join st on st.car = al.car and st.n = al.n + 1)))"""


@query("route_alerts", f"with {TRACK}, {ALERTS} select car, event_id, alert from al where alert is not null", "v_fixes")
def _(s, d):
    t = drive.track(view(s, d, "v_fixes")).withColumn("off", F.col("step")).withColumn("left", F.lit(5.0) - F.col("step"))
    return drive.route_alerts(t).select("car", "event_id", "alert")


LEGS = "select id, 600.0 + (c_custkey % 700) as t, 500.0 + (c_custkey % 900) as o from v_places where c_custkey % 11 <> 0"


@query("detour_minutes", f"with l as ({LEGS}) select p.id, case when l.id is null then -1 else greatest(0.0, round((t + o - 1300.0) / 60, 6)) end as detour from v_places p left join l using (id)", "v_places")
def _(s, d):
    p = view(s, d, "v_places")
    p.createOrReplaceTempView("v_places")
    legs = s.sql(f"with l as ({LEGS}) select 'here' as origin, id as target, cast(t as double) as seconds from l union all select id, 'goal', cast(o as double) from l union all select 'here', 'goal', 1300.0d")
    out = drive.detour_minutes(p.select(F.lit(1).alias("car"), "id", F.lit("here").alias("here"), F.lit("goal").alias("goal")), legs)
    return out.select("id", F.when(F.col("detour") == float("inf"), -1).otherwise(F.round("detour", 6)).alias("detour"))


CARS = "select c_custkey as car, lat, lon, cast(c_custkey % 360 as double) as heading, cast((c_custkey * 31) % 120 as double) as speed from v_places where c_custkey % 20 = 0"


@query("ahead_by_heading", f"""with c as ({CARS}), m as (select c.car, p.id, least(25.0, greatest(4.0, case when speed = 0 then 30.0 else speed end * 0.25)) as reach, (p.lon - c.lon) * 69.172 * cos(radians(c.lat)) as x, (p.lat - c.lat) * 69.172 as y, sin(radians(heading)) as hx, cos(radians(heading)) as hy from v_places p join c on abs(p.lat - c.lat) < 0.42),
n as (select car, id, reach, x * hx + y * hy as ahead, abs(x * hy - y * hx) as off_ from m) select car, id, round(ahead, 5) as ahead, round(off_, 5) as off from n where ahead >= 0.5 and ahead <= reach and off_ <= 7.0 + 0.15 * ahead""", "v_places")
def _(s, d):
    p = view(s, d, "v_places")
    p.createOrReplaceTempView("v_places")
    return drive.ahead_by_heading(s.sql(CARS), p, digits=5)


ON_ROUTE = f"""{SEGMENTS}, m as (select p.id, g.*, (p.lon - g.lon0) * 69.172 * cos(radians(g.lat0)) as px, (p.lat - g.lat0) * 69.172 as py, (g.lon1 - g.lon0) * 69.172 * cos(radians(g.lat0)) as sx, (g.lat1 - g.lat0) * 69.172 as sy from v_places p join seg g on true),
t as (select *, case when sx * sx + sy * sy > 0 then greatest(0.0, least(1.0, (px * sx + py * sy) / (sx * sx + sy * sy))) else 0.0 end as t from m),
o as (select id, route_id, sqrt(pow(px - t * sx, 2) + pow(py - t * sy, 2)) as off_, cum0 + t * (cum1 - cum0) as along from t),
k as (select *, row_number() over (partition by id, route_id order by off_, along) as k from o where off_ <= 10)"""


@query("ahead_on_route", f"with {ON_ROUTE}, r as (select route_id, max(cum1) / 3 as here, route_id * 5.0 as speed from seg group by 1) select route_id as car, id, round(along - here, 4) as ahead from k join r using (route_id) where k = 1 and along - here >= 0.5 and along - here <= least(25.0, greatest(4.0, case when speed = 0 then 30.0 else speed end * 0.25)) and off_ <= 7.0", "v_places")
def _(s, d):
    seg = segments(s, d)
    cars = seg.groupBy("route_id").agg((F.max("cum1") / 3).alias("along")).select(F.col("route_id").alias("car"), "route_id", "along", (F.col("route_id") * 5.0).alias("speed"))
    return drive.ahead_on_route(cars, spatial.locate_on_route(view(s, d, "v_places"), seg)).select("car", "id", F.round("ahead", 4).alias("ahead"))


SCORED = "select id, kind as drive_type, brand as chain, url, city as description, c_custkey % 9 = 0 as liked, c_custkey % 7 = 0 as on_now, cast(c_custkey % 25 as double) as detour, case when c_custkey % 3 = 0 then null else cast(c_custkey % 60 as double) end as minutes_left, kind = 'restaurant' as food, cast(c_custkey % 20 as double) / 2 as ahead, c_custkey % 4 as car from v_places"


@query("rank_ahead", f"""with p as ({SCORED}), s as (select *, case drive_type when 'museum' then 3.0 when 'park' then 0.0 when 'restaurant' then 2.0 * 1.5 else 1.0 end as base from p),
b as (select * exclude (base), case when base <= 0 and liked then 1.0 else base end as base from s), v as (select *, base + (coalesce(description, '') <> '')::int * 0.5 + (url is not null)::int * 0.3 + liked::int * 3.0 + on_now::int * 2.0 as score from b where base > 0 and chain is null),
w as (select *, score - 0.15 * detour as value from v where detour <= 20 and (minutes_left is null or minutes_left >= case when food then 20 else 30 end)),
r as (select *, row_number() over (partition by car order by value desc, ahead, id) as rank from w) select car, id, round(value, 6) as value, rank::int as rank from r where rank <= 16""", "v_places")
def _(s, d):
    view(s, d, "v_places").createOrReplaceTempView("v_places")
    scored = drive.interest(s.sql(SCORED), {"museum": 3.0, "park": 0.0, "restaurant": 2.0}, {"restaurant": 1.5}, keep_chains=False)
    return drive.rank_ahead(drive.worth_stopping(scored)).select("car", "id", F.round("value", 6).alias("value"), "rank")


@query("shortlist", f"""with c as (select id, c_custkey % 4 as car, score / 1000 as score, cast(c_custkey % 20 as double) / 2 as ahead, cast((c_custkey * 13) % 70 as double) / 10 as off from v_places), g as (select *, off * 2 * 1.3 / 35 * 60 as guess from c)
select car, id, round(guess, 6) as guess, rank::int as rank from (select *, row_number() over (partition by car order by score - guess * 0.15 desc, ahead, id) as rank from g) where rank <= 40""", "v_places")
def _(s, d):
    k = F.col("c_custkey")
    c = view(s, d, "v_places").select("id", (k % 4).alias("car"), (F.col("score") / 1000).alias("score"), ((k % 20).cast("double") / 2).alias("ahead"), (((k * 13) % 70).cast("double") / 10).alias("off"))
    return drive.shortlist(c).select("car", "id", F.round("guess", 6).alias("guess"), "rank")


@query("candidate_pool", """with e as (select lower(case when o_orderkey % 2 = 0 then venue_key else venue_key || ' annex' end) as v, id, start_at from v_listings), f as (select v, arg_min(id, (start_at, id)) as eid from e group by v), h as (select lower(name) as n, max(id) as host from v_places group by 1)
select p.id, f.eid as event_id from v_places p left join h on p.id = h.host left join f on h.n = f.v union all select eid, eid from f where v not in (select n from h)""", "v_listings", "v_places")
def _(s, d):
    e = listings(s, d).withColumn("venue_key", F.when(F.col("o_orderkey") % 2 == 0, F.col("venue_key")).otherwise(F.concat("venue_key", F.lit(" annex"))))
    return drive.candidate_pool(view(s, d, "v_places"), e).select("id", "event_id")


@query("town_lines", f"with {SEGMENTS}, s as (select route_id, cum0 as at_, 'T' || (seq % 3) as town from seg), l as (select *, lag(town) over w as b, lag(at_) over w as a0 from s window w as (partition by route_id order by at_)) select route_id, round((at_ + a0) / 2, 5) as at, town from l where b <> town and at_ - a0 <= 20")
def _(s, d):
    samples = segments(s, d).select("route_id", F.col("cum0").alias("at"), F.concat(F.lit("T"), (F.col("seq") % 3).cast("string")).alias("town"))
    return drive.town_lines(samples, 20.0).select("route_id", F.round("at", 5).alias("at"), "town")


BROKEN = "select case when o_orderkey % 100 = 0 then 'l-dup' else id end as id, case when o_orderkey % 31 = 0 then '' else title end as title, start_at, case when o_orderkey % 37 = 0 then start_at - interval '1' day else end_at end as end_at, case when o_orderkey % 41 = 0 then null else lat end as lat, lon, case when o_orderkey % 43 = 0 then 'kids' else audience end as audience, setting, case when o_orderkey % 47 = 0 then -1.0e0 else price_min end as price_min, repeats, case when o_orderkey % 16 = 0 then null else cadence end as cadence from v_listings"


@query("check_listings", f"""with b as ({BROKEN}), r as (select id, rule, detail from b, lateral (values (case when title = '' then 'no title' end, null), (case when lat is null then 'no coordinates' end, null), (case when {haversine(str(LAT0), str(LON0), 'lat', 'lon')} > 60 then 'outside the radius' end, round({haversine(str(LAT0), str(LON0), 'lat', 'lon')}, 1)::varchar), (case when audience = 'kids' then 'unknown audience' end, audience),
  (case when price_min < 0 then 'negative price' end, price_min::varchar), (case when end_at < start_at then 'ends before it starts' end, end_at::varchar), (case when repeats and cadence is null then 'repeats without cadence' end, null), (case when date_diff('day', date '1995-06-17', start_at::date) > 730 then 'far ahead' end, start_at::date::varchar)) x(rule, detail))
select id, case when rule = 'far ahead' then 'warning' else 'error' end as severity, rule, detail from r where rule is not null union all select id, 'error', 'duplicate id', count(*)::varchar from b group by id having count(*) > 1""", "v_listings")
def _(s, d):
    listings(s, d).createOrReplaceTempView("v_listings")
    return quality.check_listings(s.sql(BROKEN), F.lit("1995-06-17").cast("date"), LAT0, LON0, 60)


#: Places that break each rule of the gate now and then.
ODD_PLACES = """select case when c_custkey % 50 = 0 then 'dup' else id end as id, case when c_custkey % 21 <> 0 then name end as name, case when c_custkey % 17 = 0 then 'nowhere' else kind end as kind, case when c_custkey % 33 <> 0 then lat end as lat, lon, case c_custkey % 19 when 0 then 'http://img.example/a' when 1 then 'https://img.example/a' end as image,
  case c_custkey % 13 when 0 then 'quiet' when 1 then 'none' end as event_info, case when c_custkey % 13 = 1 then c_custkey % 2 else 3 end as events, case c_custkey % 11 when 0 then 6.0e0 when 1 then 4.0e0 when 2 then 4.5e0 end as stars, case when c_custkey % 11 = 1 then 0 else 3 end as count, c_custkey from v_places"""


@query("check_places", f"""with b as ({ODD_PLACES}), r as (select id, rule, detail from b, lateral (values (case when name is null then 'no name' end, null), (case when lat is null then 'no coordinates' end, null), (case when lat is not null and kind = 'nowhere' then 'unknown kind' end, kind), (case when lat is not null and image like 'http:%' then 'image not by https' end, image),
  (case when lat is not null and event_info = 'quiet' then 'unknown event info' end, event_info), (case when lat is not null and event_info = 'none' and events > 0 then 'none with events' end, events::varchar), (case when lat is not null and stars > 5 then 'stars out of range' end, stars::varchar), (case when lat is not null and stars is not null and count = 0 then 'rating without a count or source' end, null),
  (case when lat is not null and c_custkey % 7 = 0 then 'unknown cuisine' end, 'moon'), (case when lat is not null and not exists (select 1 from v_regions r where {haversine('b.lat', 'b.lon', 'r.lat', 'r.lon')} - r.radius_miles <= 1) then 'outside every region' end, null)) x(rule, detail))
select id, 'error' as severity, rule, detail from r where rule is not null union all select id, 'error', 'duplicate id', count(*)::varchar from b group by id having count(*) > 1""", "v_places", "v_regions")
def _(s, d):
    view(s, d, "v_places").createOrReplaceTempView("v_places")
    cuisine = F.when(F.col("c_custkey") % 7 == 0, F.array(F.lit("pizza"), F.lit("moon")))
    p = s.sql(ODD_PLACES).withColumn("cuisine", cuisine).withColumn("sources", F.array(F.lit("a")))
    return quality.check_places(p.drop("c_custkey"), view(s, d, "v_regions"))


@query("check_audit", f"with v as ({VERDICTS}) select domain as id, 'error' as severity, 'none without a signature' as rule, null::varchar as detail from v where verdict = 'none' and sig is null")
def _(s, d):
    return quality.check_audit(verdicts(s, d))


@query("check_regions", "select id, 'error' as severity, 'radius out of range' as rule, null::varchar as detail from (select id, radius_miles * 6 as r from v_regions) where r > 200", "v_regions")
def _(s, d):
    return quality.check_regions(view(s, d, "v_regions").withColumn("radius_miles", F.col("radius_miles") * 6))


@query("listing_summary", "select count(*) as total, count(price_min) as priced, count(*) filter (where price_min = 0) as free, count(*) filter (where repeats) as repeating, count(*) filter (where audience = 'family') as family, count(*) filter (where audience = 'seniors') as seniors, count(*) filter (where audience = 'adults') as adults, count(*) filter (where setting = 'outdoor') as outdoor, count(*) filter (where has_food) as food, 5::bigint as types from v_listings", "v_listings")
def _(s, d):
    return quality.listing_summary(listings(s, d))


def feeds(s, d):
    """Calendar bodies of events, in pages of bounded size for each source: folded and escaped titles, times in UTC."""
    crlf, e = "\r\n", view(s, d, "v_occurrences")
    lines = F.concat(F.lit("BEGIN:VEVENT\r\nUID:"), F.col("event_id").cast("string"), F.lit("\r\nDTSTART:"), F.date_format("start_at", "yyyyMMdd'T'HHmmss'Z'"), F.lit("\r\nSUMMARY:"), "title", F.lit("\\, ses\r\n sion\r\nCATEGORIES:a\\,b,c\r\nEND:VEVENT\r\n"))
    body = F.concat(F.lit(f"BEGIN:VCALENDAR{crlf}"), F.array_join(F.collect_list(lines), ""), F.lit(f"END:VCALENDAR{crlf}"))
    return e.groupBy(F.col("source").alias("source_id"), F.floor(F.col("event_id") / 64).alias("page")).agg(body.alias("body")).withColumn("status", F.lit(200))


@query("ical_events", "select source as source_id, event_id::varchar as uid, title || ', session' as title, date_trunc('second', start_at) as start_at, 'a,b|c' as categories from v_occurrences", "v_occurrences")
def _(s, d):
    return ical.ical_events(feeds(s, d)).select("source_id", "uid", "title", F.col("start_at").cast("timestamp_ntz").alias("start_at"), F.array_join("categories", "|").alias("categories"))


@query("future_events", "select event_id::varchar as uid from v_occurrences where date_trunc('second', start_at) >= timestamp '2024-01-15 09:00:00'", "v_occurrences")
def _(s, d):
    return ical.future_only(ical.ical_events(feeds(s, d)), F.lit("2024-01-15 12:00:00").cast("timestamp"), 3).select("uid")


@query("feed_status", """with e as (select source as source_id, count(*) as n, count(*) filter (where date_trunc('second', start_at) >= timestamp '2024-01-20') as f from v_occurrences group by 1), g as (select *, source_id::int % 7 as k from e)
select source_id, case when k = 0 then 'disabled' when k = 1 then 'blocked' when k = 2 then 'empty' when f = 0 then 'stale' else 'ok' end as status, case when k in (1, 2) then 0 else n end as n_events from g""", "v_occurrences")
def _(s, d):
    f = feeds(s, d).withColumn("k", F.col("source_id").cast("int") % 7)
    f = f.withColumn("body", F.when(F.col("k") == 1, "<html>checking</html>").when(F.col("k") == 2, "BEGIN:VCALENDAR\r\nEND:VCALENDAR").otherwise(F.col("body")))
    events, registry = ical.ical_events(f), f.select("source_id", (F.col("k") != 0).alias("enabled")).distinct()
    return ical.feed_status(registry, f, events, F.lit("2024-01-20").cast("timestamp")).select("source_id", "status", "n_events")


def ld_pages(s, d):
    """Pages with an event inside up to 11 lists in a row."""
    k = (F.col("page_id") % 12).cast("int")
    block = F.concat(F.lit('<script type="application/ld+json">'), F.repeat(F.lit("["), k), F.lit('{"@graph":[{"@type":"MusicEvent","name":"Show '), F.col("page_id").cast("string"), F.lit('","startDate":"2026-10-01","doorTime":"11:00:00","duration":"PT1800S","location":{"name":"Hall","address":"1 Main St, Beacon, NY 12508","geo":{"latitude":41.5,"longitude":-73.9}},"url":"'), F.col("url"), F.lit('","offers":[{"price":"'), (F.col("page_id") % 30).cast("string"), F.lit('"},{"price":"99.5"}]},{"@type":["Thing","Place"],"name":"x"}]}'), F.repeat(F.lit("]"), k), F.lit("</script>"))
    return view(s, d, "pages").withColumn("html", F.when(F.col("page_id") % 3 == 0, F.concat("html", block)).otherwise(F.col("html")))


@query("jsonld_events", "select page_id, 'Show ' || page_id as name, '2026-10-01' as day, timestamp '2026-10-01 11:00:00' as start_at, timestamp '2026-10-01 11:30:00' as end_at, url, least((page_id % 30)::double, 99.5) as price_min, 99.5::double as price_max, 'Hall|1 Main St|Beacon|NY' as place from pages where page_id % 3 = 0")
def _(s, d):
    e = jsonld.jsonld_events(ld_pages(s, d))
    return e.select("page_id", "name", "day", "start_at", "end_at", "url", "price_min", "price_max", F.concat_ws("|", "location.venue", "location.address", "location.city", "location.state").alias("place"))


@query("canon_urls", "select page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') || rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') as canon, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') as domain from pages")
def _(s, d):
    return view(s, d, "pages").select("page_id", X.canon_url(F.col("url")).alias("canon"), X.domain_of(F.col("url")).alias("domain"))


@query("page_pictures", "select page_id, 'https://img.example/a' || (page_id % 7) || '.jpg' as image from pages where page_id % 5 in (1, 2, 3)")
def _(s, d):
    n = (F.col("page_id") % 7).cast("string")
    good = F.concat(F.lit('<meta name="twitter:image" content="/other.jpg"><meta property="og:image" content="http://img.example/a'), n, F.lit('.jpg">'))
    # A logo ends the search, whatever other keys say; so does a picture stated to be small.
    logo = F.concat(F.lit('<meta property="og:image:secure_url" content="https://img.example/logo.png">'), good)
    meta = F.when(F.col("page_id") % 5 == 0, logo).when(F.col("page_id") % 5 == 4, F.concat(good, F.lit('<meta property="og:image:width" content="120">'))).otherwise(good)
    p = view(s, d, "pages")
    return web.page_pictures(p.withColumn("html", F.concat(F.lit("<head>"), meta, F.regexp_replace("html", "(?is)^.*?<head>", ""))))


@query("picture_report", f"with i as ({PICTURES}), p as (select distinct concat('site', cast(c_custkey % 300 as varchar(20)), '.example.com/visit') as page, c_custkey % 300 as k from v_places where url is not null) select case when k % 8 = 0 then 'unread' when k % 3 = 0 then 'none' else 'picture' end as verdict, case when k % 8 <> 0 and k % 3 = 0 then 'logo' end as why, count(*) as n from p group by 1, 2", "v_places")
def _(s, d):
    key = F.regexp_extract("page", r"^site(\d+)", 1).cast("int")
    asked = view(s, d, "v_places").where("url is not null").select(X.page_key(F.col("url")).alias("page")).distinct()
    answers = asked.where(key % 8 != 0).select("page", F.when(key % 3 == 0, "none").otherwise("picture").alias("verdict"), F.lit("logo").alias("why"))
    return web.picture_report(asked, answers)


@query("event_types")
def _(s, d):
    p = view(s, d, "documents")
    r = C.event_reading(F.substring_index("text", ".", 1), F.col("text"), F.lit(None).cast("string"))
    return p.select("doc_id", r.alias("r")).select("doc_id", F.array_join("r.types", ",").alias("types"), "r.setting", "r.food")


@query("clean_text")
def _(s, d):
    return view(s, d, "pages").select("page_id", X.clean_text(F.col("html"), 180).alias("text"))


@query("norm_titles", "select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '\\(.*?\\)', '', 'g'), '\\b(session|part|day|week|no\\.?|#)\\s*\\d+\\b', '', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) as norm from documents")
def _(s, d):
    return view(s, d, "documents").select("doc_id", X.norm_title(F.col("text")).alias("norm"))
