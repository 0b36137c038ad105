"""Queries of service records, showtimes and calendar texts, over payloads built from the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearby.functions import site_marks as M
from nearby.operators import audit, quality, web
from nearby.plans.fixtures import view
from nearby.plans.queries_search import NOW, listings, query
from nearby.sources import ical, jsonld, shapes, sinks
from nearby.streaming import refresh


#: Listings in one record of a service, about, and venues that listings are dealt over.
RECORD, VENUES = 64, 200


def payloads(s, d, item, wrap, span=RECORD * VENUES):
    """Records of a service: the JSON of a venue's listings inside ``wrap``, in pages of at most ``span`` listings whatever the venue's size."""
    ls = listings(s, d).select("venue_key", F.floor(F.col("o_orderkey") / span).alias("page"), item.alias("j"))
    body = F.array_join(F.sort_array(F.collect_list("j")), ",")
    return ls.groupBy(F.col("venue_key").alias("source_id"), "page").agg(F.concat(F.lit(wrap[0]), body, F.lit(wrap[1])).alias("payload")).drop("page")


def obj(**fields):
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def key():
    return F.col("o_orderkey").cast("string")


@query("shape_collection", "select venue_key as source_id, o_orderkey::varchar as uid, title, start_at, end_at from v_listings", "v_listings")
def _(s, d):
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    r = payloads(s, d, obj(id=key(), title=F.col("title"), startDate=ms("start_at"), endDate=ms("end_at")), ('{"items":[', "]}"))
    return ntz(shapes.shape(r, "collection").select("source_id", "uid", "title", "start_at", "end_at"))


def ntz(df):
    """Instants as clocks of UTC."""
    return df.select(*(F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes))


@query("shape_calendar_plugin", "select distinct venue_key as source_id, concat('wpfc-', o_orderkey, '-7-', strftime(start_at, '%Y-%m-%d')) as uid, title || ' & co' as title from v_listings", "v_listings")
def _(s, d):
    item = obj(post_id=key(), event_id=F.lit("7"), title=F.concat(F.lit(" "), F.col("title"), F.lit(" &amp; co ")), start=F.date_format("start_at", "yyyy-MM-dd HH:mm:ss"))
    twice = F.concat(item, F.lit(","), item)
    return shapes.shape(payloads(s, d, twice, ("[", "]")), "calendar plugin").select("source_id", "uid", "title")


@query("shape_events_rest", "select venue_key as source_id, concat('tribe-', o_orderkey) as uid, start_at as start_at, 'Hall, 1 Main St, Beacon, NY' as address from v_listings", "v_listings")
def _(s, d):
    venue = F.struct(F.lit("Hall").alias("venue"), F.lit("1 Main St").alias("address"), F.lit("Beacon").alias("city"), F.lit("NY").alias("state"))
    item = obj(id=key(), title=F.col("title"), timezone=F.lit("Etc/UTC"), start_date=F.date_format("start_at", "yyyy-MM-dd HH:mm:ss"), venue=venue)
    return ntz(shapes.shape(payloads(s, d, item, ('{"events":[', '],"total_pages":1}')), "events rest").select("source_id", "uid", "start_at", "address"))


@query("shape_ticketing", "select o_orderkey::varchar as uid, case when o_orderkey % 40 = 0 then 'musical,play' else 'concert' end as types, case when price_min > 0 then price_min end as price_min, 'Beacon, NY' as city from v_listings where o_orderkey % 60 <> 0", "v_listings")
def _(s, d):
    named = lambda x: F.struct(F.lit(x).alias("name"))
    kinds = F.when(F.col("o_orderkey") % 40 == 0, F.struct(named("Musical").alias("subGenre"), named("Theatre").alias("genre"), named("Arts & Theatre").alias("segment"))).otherwise(F.struct(named("x").alias("subGenre"), named("y").alias("genre"), named("Music").alias("segment")))
    venue = F.struct(F.struct(F.lit("Beacon").alias("name")).alias("city"), F.struct(F.when(F.col("o_orderkey") % 60 == 0, "CA").otherwise("NY").alias("stateCode")).alias("state"))
    item = obj(id=key(), name=F.col("title"), dates=F.struct(F.struct(F.date_format("start_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("dateTime")).alias("start")), classifications=F.array(kinds), priceRanges=F.when(F.col("price_min").isNotNull(), F.array(F.struct(F.col("price_min").alias("min"), F.col("price_min").alias("max")))), _embedded=F.struct(F.array(venue).alias("venues")))
    out = shapes.shape(payloads(s, d, item, ('{"_embedded":{"events":[', "]}}")), "ticketing")
    return out.select("uid", F.array_join("types", ",").alias("types"), "price_min", "city")


@query("shape_rsvp", "select o_orderkey::varchar as uid, start_at, case when o_orderkey % 100 > 60 then 'Bookable — runs most days' when o_orderkey % 100 > 3 then 'Bookable — ' || (o_orderkey % 100) || ' upcoming dates' end as recurrence, case when o_orderkey % 40 = 0 then 0.0::double else 12.5::double end as price_min from v_listings", "v_listings")
def _(s, d):
    avail = F.struct((F.col("o_orderkey") % 40 == 0).alias("is_free"), F.struct(F.lit(12.5).alias("major_value")).alias("minimum_ticket_price"))
    item = obj(id=key(), name=F.col("title"), timezone=F.lit("Etc/UTC"), start_date=F.date_format("start_at", "yyyy-MM-dd"), start_time=F.date_format("start_at", "HH:mm"), num_children=F.col("o_orderkey") % 100, ticket_availability=avail)
    return ntz(shapes.shape(payloads(s, d, item, ('{"events":[', "]}")), "rsvp").select("uid", "start_at", "recurrence", "price_min"))


@query("shape_groups", "select concat('Event:', o_orderkey) as uid, venue_key as venue, case when o_orderkey % 40 = 0 then 'Every second Tuesday of the month' else 'Every other Monday & Friday' end as recurrence from v_listings", "v_listings")
def _(s, d):
    series = F.when(F.col("o_orderkey") % 40 == 0, "S:m").otherwise("S:w")
    ref = lambda c: F.struct(c.alias("__ref"))
    node = obj(title=F.col("title"), dateTime=F.date_format("start_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), venue=ref(F.lit("V:1")), series=ref(series))
    entry = F.concat(F.lit('"Event:'), key(), F.lit('":'), node)
    fixed = '"S:m":{"monthlyRecurrence":{"monthlyDayOfWeek":"TUESDAY","monthlyWeekOfMonth":2}},"S:w":{"weeklyRecurrence":{"weeklyDaysOfWeek":["MONDAY","FRIDAY"],"weeklyInterval":2}},'
    r = payloads(s, d, entry, ("{" + fixed, "}"), RECORD)  # each node carries the keys of its whole record, so records are small
    venue = F.concat(F.lit('{"V:1":'), F.to_json(F.struct(F.col("source_id").alias("name"))), F.lit(","), F.substring(F.col("payload"), F.lit(2), F.length("payload")))
    return shapes.shape(r.withColumn("payload", venue), "groups").select("uid", "venue", "recurrence")


@query("shape_library", "select o_orderkey::varchar as uid, case when o_orderkey % 40 = 0 then timestamp '2024-07-01 22:30:00' else timestamp '2024-07-01 04:00:00' end as start_at, o_orderkey % 40 <> 0 as all_day, 'Room 1, Howland, Beacon' as address, 0.0::double as price_min from v_listings", "v_listings")
def _(s, d):
    item = obj(id=key(), title=F.col("title"), start=F.when(F.col("o_orderkey") % 40 == 0, "6:30 PM").otherwise("All Day"), location=F.lit("Room 1 "))
    return ntz(shapes.shape(payloads(s, d, item, ('{"day":"2024-07-01","publisher":"Howland","town":"Beacon","events":[', "]}")), "library").select("uid", "start_at", "all_day", "address", "price_min"))


@query("shape_concerts", "select concat('https://c.example/', o_orderkey) as uid, lat, lon from v_listings where o_orderkey % 40 = 0", "v_listings")
def _(s, d):
    geo = F.struct(F.when(F.col("o_orderkey") % 40 == 0, F.col("lat")).alias("latitude"), F.col("lon").alias("longitude"))
    item = F.concat(F.lit('{"@type":"MusicEvent",'), F.substring(obj(name=F.col("title"), url=F.concat(F.lit("https://c.example/"), key()), startDate=F.date_format("start_at", "yyyy-MM-dd'T'HH:mm:ss"), location=F.struct(F.lit("Hall").alias("name"), geo.alias("geo"))), F.lit(2), F.lit(2_147_483_647)))
    return shapes.shape(payloads(s, d, item, ("[", "]")), "concerts").select("uid", "lat", "lon")


@query("first_seen", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by start_at, o_orderkey) as k from v_listings) where k = 1", "v_listings")
def _(s, d):
    return shapes.first_seen(listings(s, d), "o_custkey", F.asc("start_at"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("union_tiers", "select id, title, null as verdict from v_listings union all select id, null, verdict from v_decisions", "v_listings", "v_decisions")
def _(s, d):
    return shapes.union_tiers(listings(s, d).select("id", "title"), view(s, d, "v_decisions")).select("id", "title", "verdict")


@query("schedule_items", "select page_id, 'Film & ' || page_id as title, timestamp '2024-03-01 19:00:00' + to_days(k::int) as starts from pages, range(0, 2) t(k)")
def _(s, d):
    n = F.col("page_id").cast("string")
    html = F.concat(F.lit("<ul><li class='list-group-item schedule-item'><h3 class='schedule-title'><a href=\"/f\">Film &amp; <b>"), n, F.lit("</b></a></h3><i data-showtime='2024-03-01T14:00:00-05:00'></i><i data-showtime='2024-03-02T14:00:00-05:00'></i></li></ul>"))
    p = view(s, d, "pages").withColumn("html", F.concat("html", html))
    return ntz(shapes.schedule_items(p).select("page_id", "title", "starts"))


@query("headed_screenings", """select page_id, 'Film ' || page_id as title, (date '2024-08-30' + k::int)::varchar as day, case when isodow(date '2024-08-30' + k::int) in (6, 7) then '13:15,16:00,19:30' else '16:00,19:30' end as clocks from pages, range(0, 6) t(k)""")
def _(s, d):
    programme = F.concat(F.lit("<h2>Fri thru Wed 8/30 - 9/4</h2><p>Film "), F.col("page_id").cast("string"), F.lit("</p><p>4:00 7:30</p><p>Sat & Sun 1:15 10:00</p><p>Fri & Sat 5:00</p><p>Coming soon</p><p>Other</p><p>5:00</p>"))
    p = view(s, d, "pages").withColumn("html", F.concat(programme, "html"))
    return shapes.headed_screenings(p, F.lit("2024-08-01").cast("date"))


@query("ics_round_trip", "select id, title, case when end_at is not null and start_at < timestamp '1995-06-17 12:00:00' and end_at > timestamp '1995-06-17 12:00:00' then timestamp '1995-06-17 00:00:00' else start_at end as start_at, case when end_at is not null and start_at < timestamp '1995-06-17 12:00:00' and end_at > timestamp '1995-06-17 12:00:00' then timestamp '1995-06-17 02:00:00' else start_at + interval 2 hour end as end_at, venue_key as location from v_listings", "v_listings")
def _(s, d):
    ls = listings(s, d).withColumn("venue", F.col("venue_key")).withColumn("address", F.substring("venue_key", 1, 4)).withColumn("description", F.repeat(F.lit("A long, winding; text\\ "), 9))
    out = sinks.ics_export(ls, F.lit(NOW).cast("timestamp"), F.lit(NOW).cast("timestamp"))
    events = ical.ical_events(out.select(F.col("id").alias("source_id"), F.col("ics").alias("body")))
    return ntz(events.select(F.col("source_id").alias("id"), "title", "start_at", "end_at", "location"))


@query("drop_noise", "select o_orderkey from v_listings where not (regexp_matches(case cast(o_orderkey % 4 as int) when 0 then 'Board Meeting' when 1 then 'Library closed' when 2 then 'Snow Day' else title end, '(?i)board meeting|closed|snow day'))", "v_listings")
def _(s, d):
    from nearby.functions.classify import is_noise

    n = F.col("o_orderkey") % 4
    ls = listings(s, d).withColumn("title", F.when(n == 0, "Board Meeting").when(n == 1, "Library closed").when(n == 2, "Snow Day").otherwise(F.col("title")))
    return ls.where(~is_noise(F.col("title"))).select("o_orderkey")


def site_pages(s, d):
    return view(s, d, "v_site_pages")


#: An audit by DuckDB: pages are measured, links listed one by one, and the ladder climbed.
TEXT = "regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({0}, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>', ' ', 'gsi'), '<[^>]+>', ' ', 'g'), '&quot;', '\"'), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\\s{{2,}}', ' ', 'g')"
HOST, PATH = "lower(regexp_extract({0}, '^[A-Za-z]+://([^/?#]*)', 1))", "regexp_extract({0}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
quoted = lambda p: "'" + p.replace("'", "''") + "'"
says = lambda c, p: f"regexp_matches({c}, {quoted(p)}, 'i')"
times = lambda c, p: f"len(regexp_extract_all({c}, {quoted(p)}, 0, 'i'))"
ANCHORS = quoted(M.ANCHOR.replace("(?is)", ""))
LINKS = f"""a0 as (select page_id, url, unnest(regexp_extract_all(html, {ANCHORS}, 1, 'is')) as href, unnest(regexp_extract_all(html, {ANCHORS}, 2, 'is')) as label, generate_subscripts(regexp_extract_all(html, {ANCHORS}, 1, 'is'), 1) as i from v_site_pages where html is not null),
a1 as (select page_id, url, i, regexp_replace(case when href like 'http%' then href else regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || href end, '#.*$', '') as href, trim({TEXT.format("label")}) as label from a0 where not regexp_matches(lower(trim(href)), '^(#|mailto:|tel:|javascript:)')),
a2 as (select *, {HOST.format("href")} = {HOST.format("url")} as same, {PATH.format("href")} || ' ' || label as hay, {PATH.format("href")} || ' ' || regexp_extract(href, '[?]([^#]*)', 1) || ' ' || label as far, regexp_replace({HOST.format("href")}, '^www[.]', '') as bare from a1),
k1 as (select *, case when {says("hay", M.EVENT_LINK)} then 1 when {says("hay", M.DEAL_LINK)} then 2 end as kind from a2 where same and rtrim(href, '/') <> rtrim(url, '/')),
k2 as (select *, row_number() over (partition by page_id, href order by i) as nth from k1 where kind is not null),
k3 as (select *, row_number() over (partition by page_id order by kind, i) as r from k2 where nth = 1),
signed as (select page_id, count(*) as n_links, substr(sha1(string_agg(p, chr(10) order by p)), 1, 16) as sig from (select distinct page_id, lower(rtrim({PATH.format("href")}, '/')) as p from k3 where r <= 40) group by 1),
offsite as (select page_id, href, min(i) as i from a2 where not same and href like 'http%' and bare <> regexp_replace({HOST.format("url")}, '^www[.]', '') and not regexp_matches(bare, {quoted("^(.*[.])?(" + "|".join(h.replace(".", "[.]") for h in M.SKIP_HOSTS) + ")$")}) and {says("far", M.OFFSITE_CALENDAR)} group by 1, 2),
linked as (select page_id, arg_min(href, i) as linked from offsite group by 1)"""
DOMAIN = "regexp_replace(" + HOST.format("url") + ", '^www[.]', '')"
AUDIT = f"""{LINKS}, t as (select *, {DOMAIN} as domain, coalesce({TEXT.format("html")}, '') as txt, lower({PATH.format("url")}) as path from v_site_pages),
m as (select t.*, {says("path", M.EVENT_LINK)} or {says("txt", M.EVENT_WORDS)} as eventish, {says("path", M.DEAL_LINK)} or {says("txt", M.DEAL_WORDS)} as dealish, {says("path", M.CALENDAR_PATH)} as cal, {times("txt", M.DATED)} + {times("txt", M.RECURRING)} as d0, {times("txt", M.CLOCK)} as d1,
  coalesce({says("html", M.JSONLD_EVENT)}, false) as jsonld, {times("txt", M.SUSPECT)} as spam, {times("txt", M.FOREIGN_SCRIPT)} / greatest(length(txt), 1)::double as foreign_, {says("substr(txt, 1, 4000)", M.PARKED)} as parked, coalesce(n_links, 0) as n_links,
  coalesce(sig, substr(sha1(''), 1, 16)) as sig, linked, [{", ".join(f"case when {says('html', p)} then '{n} embed' end" for n, p in M.PLATFORMS)}] as embeds from t left join signed using (page_id) left join linked using (page_id)),
s as (select *, d0 + case when eventish then d1 else 0 end as dates, (length(path), page_id) as place, html is not null as answered from m),
f as (select * from (select *, row_number() over (partition by domain order by html is null, place) as k from s) where k = 1),
g as (select domain, count(*) as pages, arg_min(url, place) filter (where answered and jsonld) as ju, arg_min(url, place) filter (where answered and eventish and dates >= case when cal then 2 else 3 end) as lu, bool_or(answered and dealish and dates >= 2) as deals, bool_or(answered and (cal or eventish) and length(txt) < 1200 and dates = 0) as thin, arg_min(cal, place) filter (where answered and (cal or eventish) and length(txt) < 1200 and dates = 0) as thin_cal from s group by 1),
named as (select distinct f.domain from f join v_site_names n on n.domain = f.domain where {says("lower(substr(txt, 1, 2000))", "(^|[^a-z0-9_])elsewhere($|[^a-z0-9_])")} and {says("lower(substr(txt, 1, 2000))", "(^|[^a-z0-9_])cinema($|[^a-z0-9_])")} and n.name = 'Elsewhere Cinema'
  or {says("lower(substr(txt, 1, 2000))", "(^|[^a-z0-9_])grand($|[^a-z0-9_])")} and {says("lower(substr(txt, 1, 2000))", "(^|[^a-z0-9_])lyceum($|[^a-z0-9_])")} and n.name = 'The Grand Lyceum Hall'),
feed as (select domain, arg_min(url, (-n_future, url)) as feed, max(n_future) as n_future from v_site_feeds where n_future > 0 group by 1),
h as (select f.*, g.* exclude (domain), feed, n_future, f.domain in (select domain from named) as named, f.spam >= 3 as spammed, f.foreign_ > 0.15 and not (length(regexp_extract(f.domain, '([^.]*)$', 1)) = 2 and regexp_extract(f.domain, '([^.]*)$', 1) <> 'us') as foreign2,
  list_filter(list_concat(embeds, [case when linked is not null then 'linked calendar' end, case when ju is not null then 'schema.org events' end, case when lu is not null then 'dated listings' end, case when deals then 'dated specials' end]), lambda x: x is not null) as found from f join g using (domain) left join feed using (domain)),
v as (select *, case when not answered then case when status in (401, 403, 405, 406, 429, 451) then 'blocked' else 'unreachable' end when parked then 'parked' when length(txt) < 400 and n_links = 0 then 'unreadable' when (spammed or foreign2) and not named then 'suspect'
  when len(found) = 0 and feed is not null then 'feed' when len(found) = 0 and thin then 'unreadable' when len(found) = 0 then 'none' when found = ['dated specials'] then 'specials' else 'listings' end as verdict from h),
verdicts as (select domain, pages, verdict, case when verdict = 'suspect' then 'off-topic content' when verdict = 'feed' then 'ical feed' when verdict in ('none', 'specials', 'listings') then array_to_string(found, ',') else '' end as found,
  case when verdict in ('none', 'specials', 'listings', 'feed') or verdict = 'unreadable' and (length(txt) >= 400 or n_links > 0) then sig end as sig,
  case when verdict = 'feed' then feed when verdict in ('listings', 'specials') then coalesce(case when len(list_filter(embeds, lambda x: x is not null)) > 0 then url end, linked, ju, lu, url) when verdict in ('parked', 'suspect', 'unreadable') then url end as url, spammed and verdict in ('none', 'specials', 'listings') as spammed from v)"""
SITES = ("v_site_pages", "v_site_names", "v_site_feeds")


def verdicts_of(s, d):
    return audit.audit_domains(site_pages(s, d), view(s, d, "v_site_names"), view(s, d, "v_site_feeds"))


@query("audit_domains", f"with {AUDIT} select * from verdicts", *SITES)
def _(s, d):
    return verdicts_of(s, d).withColumn("found", F.array_join("found", ",")).drop("note")


@query("audit_notes", f"""with {AUDIT} select domain, case verdict when 'blocked' then 'HTTP ' || status || ' to a declared reader' when 'unreachable' then 'no answer' || coalesce(' (' || status || ')', '') when 'parked' then 'a page of the server or registrar' when 'suspect' then 'what it shows isn''t the venue''s' when 'feed' then n_future || ' events ahead in its feed'
  when 'unreadable' then case when not (length(txt) < 400 and n_links = 0) and coalesce(thin_cal, false) then 'its events page is ' else '' end || 'drawn in the browser, nothing to read' when 'none' then pages || ' pages without dates or a calendar' end as note from v""", *SITES)
def _(s, d):
    return verdicts_of(s, d).select("domain", "note")


@query("audit_progress", f"with {AUDIT}, dm as (select distinct domain from v_site_names where length(domain) % 3 > 0 union select 'unread' || k || '.example' from range(0, 7) t(k)) select count(*) filter (where v.domain is not null) as done, count(*) filter (where v.domain is null) as to_go, (select count(*) from verdicts) as on_file from dm left join verdicts v on v.domain = dm.domain", *SITES)
def _(s, d):
    known = view(s, d, "v_site_names").select("domain").where(F.length("domain") % 3 > 0)
    return audit.audit_progress(verdicts_of(s, d), known.union(s.range(7).select(F.concat(F.lit("unread"), F.col("id").cast("string"), F.lit(".example")))))


@query("audit_leads", f"with {AUDIT}, nm as (select domain, string_agg(name, '; ' order by name) as names from (select distinct domain, name from v_site_names) group by 1) select domain, 'feed' as lead, url as detail from verdicts where verdict = 'feed' union all select domain, 'spammed', null from verdicts where spammed union all select domain, 'bad', names from verdicts left join nm using (domain) where verdict in ('suspect', 'parked')", *SITES)
def _(s, d):
    return audit.audit_leads(verdicts_of(s, d), view(s, d, "v_site_names"))


@query("audit_report", f"with {AUDIT} select verdict, count(*) as n, sum(pages)::bigint as pages, count(*) filter (where spammed) as spammed, case verdict when 'none' then 365 when 'specials' then 240 when 'listings' then 180 when 'feed' then 180 when 'suspect' then 365 when 'unreadable' then 120 when 'blocked' then 120 when 'parked' then 180 else 45 end as recheck_days from verdicts group by verdict", *SITES)
def _(s, d):
    return audit.audit_report(verdicts_of(s, d))


SIGNATURES = f"{LINKS}, front as (select {DOMAIN} as domain, page_id, row_number() over (partition by {DOMAIN} order by length({PATH.format('url')}), page_id) as k from v_site_pages where html is not null), sigs as (select domain, coalesce(sig, substr(sha1(''), 1, 16)) as sig from front left join signed using (page_id) where k = 1)"


@query("site_signature", f"with {SIGNATURES} select domain, sig from sigs", "v_site_pages")
def _(s, d):
    return audit.site_signature(site_pages(s, d))


@query("changed_sites", f"with {SIGNATURES} select domain, sig from sigs where length(domain) % 2 = 0", "v_site_pages")
def _(s, d):
    sig = audit.site_signature(site_pages(s, d))
    return audit.changed_sites(sig, sig.select("domain", F.lit("none").alias("verdict"), F.when(F.length("domain") % 2 == 0, "old").otherwise(F.col("sig")).alias("sig")))


@query("page_links", f"with {LINKS} select page_id, count(*) as n, count(*) filter (where same) as own, count(*) filter (where {says('hay', M.EVENT_LINK)}) as events, count(*) filter (where not {says('hay', M.EVENT_LINK)} and {says('hay', M.DEAL_LINK)}) as deals from a2 group by 1", "v_site_pages")
def _(s, d):
    k = F.col("kind")
    return web.links(site_pages(s, d)).groupBy("page_id").agg(F.count("*").alias("n"), F.count_if("same_site").alias("own"), F.count_if(k == "event").alias("events"), F.count_if(k == "deal").alias("deals"))


@query("offsite_calendars", f"with {LINKS} select page_id, href from offsite", "v_site_pages")
def _(s, d):
    return audit.offsite_calendars(site_pages(s, d))


@query("calendar_platforms", f"""with p as (select *, {DOMAIN} as domain from v_site_pages where html is not null), u as (select domain, 'google' as platform, page_id, 'https://calendar.google.com/calendar/ical/a' || page_id || '%40group.example/public/basic.ics' as feed from p where page_id % 20 = 6
  union all select domain, 'tockify', page_id, 'https://tockify.com/api/feeds/ics/tock' || page_id from p where page_id % 20 = 14 union all select domain, 'libcal', page_id, 'https://hall.libcal.com/calendar?cid=-1&t=d&d=0000-00-00&cal=-1&ical=1' from p where page_id % 20 = 14 union all select domain, 'jsonld', page_id, null from p where page_id % 20 = 8)
select domain, platform, min(page_id) as page_id, arg_min(feed, page_id) as feed from u group by 1, 2""", "v_site_pages")
def _(s, d):
    return web.calendar_platforms(site_pages(s, d))


@query("dataset_meta", "select source, count(*) as n from v_occurrences group by 1", "v_occurrences")
def _(s, d):
    return quality.dataset_meta(view(s, d, "v_occurrences"))


@query("listing_findings_by_rule", "select 'error' as severity, 'unknown audience' as rule, count(*) as n from v_listings where audience = 'seniors' union all select 'error', 'until without repeats', count(*) from v_listings where until_at is not null", "v_listings")
def _(s, d):
    found = quality.check_listings(listings(s, d).withColumn("audience", F.when(F.col("audience") == "seniors", "old").otherwise(F.col("audience"))).drop("cadence", "repeats", "types").withColumn("cadence", F.lit("x")).withColumn("repeats", F.lit(False)), F.lit("2002-01-01").cast("date"), 41.5, -73.9, 500)
    return found.groupBy("severity", "rule").agg(F.count("*").alias("n"))


@query("embedded_json", "select page_id, 'n' || page_id as name, page_id % 5 as k from pages")
def _(s, d):
    n = F.col("page_id").cast("string")
    script = F.concat(F.lit('<script>window.__SERVER_DATA__ = {"name":"n'), n, F.lit('","odd":"}; {","k":'), (F.col("page_id") % 5).cast("string"), F.lit("};</script><script>var x = {};</script>"))
    out = jsonld.embedded_json(view(s, d, "pages").withColumn("html", F.concat("html", script)), "__SERVER_DATA__")
    return out.select("page_id", F.try_variant_get("payload", "$.name", "string").alias("name"), F.try_variant_get("payload", "$.k", "bigint").alias("k"))


@query("best_feed", "select domain, arg_min(path, (-n, pos)) as path, max(n) as n_future from (select concat('d', c_custkey % 50) as domain, concat('/feed', c_custkey % 7) as path, c_custkey as pos, c_custkey % 13 as n from customer) group by 1")
def _(s, d):
    c = view(s, d, "customer")
    k = F.col("c_custkey")
    return web.best_feed(c.select(F.concat(F.lit("d"), (k % 50).cast("string")).alias("domain"), F.concat(F.lit("/feed"), (k % 7).cast("string")).alias("path"), k.alias("path_pos"), (k % 13).alias("n_future")))


@query("venue_domains", "select concat('site', c_custkey % 300, '.example.com') as domain, min(id) as id from v_places where url is not null group by 1", "v_places")
def _(s, d):
    return web.venue_domains(view(s, d, "v_places"))


@query("directory_round_trip", "select id, kind = 'restaurant' as is_food, brand from v_places", "v_places")
def _(s, d):
    from uuid import uuid4

    from nearby.plans.session import shared_dir

    p = view(s, d, "v_places").select("id", "name", "kind", "lat", "lon", "brand", "city")
    folder = f"{shared_dir(s).rstrip('/')}/directory-{uuid4().hex}"
    sinks.write_places(p, folder)
    out = sinks.read_items(s, folder, "id string, name string, kind string, lat double, lon double, brand string, city string, is_food boolean").select("id", "is_food", "brand").checkpoint()
    fs, path = refresh.folders(s, folder)
    fs.delete(path(folder), True)
    return out
