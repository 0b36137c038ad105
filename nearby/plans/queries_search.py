"""Queries of search, recurrence, spatial joins and resolution over the derived views, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearby.functions import vocab as V
from nearby.functions import text as X
from nearby.operators import recur, resolve, search, spatial
from nearby.plans.fixtures import view, with_views

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "1995-06-17 12:00:00"
LAT0, LON0 = 41.5048, -73.9696
Plan = Callable[[SparkSession, str], DataFrame]


def query(name: str, sql: str | None = None, *views: str) -> Callable[[Plan], Plan]:
    def add(f: Plan) -> Plan:
        Q[name] = lambda s, d: plain_dates(f(s, d))
        if sql:
            text = with_views(sql, *views) if views else sql
            SQL[name] = text.replace("with v_", "with recursive v_", 1) if RECURSIVE in text else text
        return f

    return add


#: Marks SQL whose later views refer to themselves.
RECURSIVE = "/* recursive */"


def plain_dates(df: DataFrame) -> DataFrame:
    """Days as text, which all readers of results agree on."""
    return df.select(*(F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes))


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def haversine(a: str, b: str, c: str, d: str, radius: float = 3958.8) -> str:
    h = f"sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"2 * {radius} * asin(case when {h} > 1 then 1.0 else {h} end)"


def listings(s: SparkSession, d: str) -> DataFrame:
    df = view(s, d, "v_listings")
    for c in ("start_at", "end_at", "until_at"):
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df.withColumn("types", F.array_compact(F.array("type_1", "type_2")))


#: The next occurrence and liveness, by looking at every occurrence.
LIVE = f"""live0 as (select *, timestamp '{NOW}' as now, case cadence when 'daily' then 1 when 'weekday' then 1 when 'weekly' then 7 when 'fortnightly' then 14 end as step from v_listings),
live1 as (select *, case when not repeats or start_at >= now or cadence in ('occasional', 'bookable') then start_at
    when cadence = 'monthly' then (select min(start_at + to_months(k::int)) from range(0, 200) t(k) where start_at + to_months(k::int) >= now)
    else start_at + to_days((greatest(0, ceil(epoch(now - start_at) / 86400.0 / step)) * step)::int) end as n0 from live0),
live2 as (select *, case when repeats and start_at < now and cadence = 'weekday' then n0 + to_days(case isodow(n0) when 6 then 2 when 7 then 1 else 0 end) else n0 end as next_at from live1),
live3 as (select *, coalesce(end_at is not null and next_at::date < now::date and end_at::date >= now::date, false) as ongoing, end_at is null and strftime(start_at, '%H:%M') = '00:00' as all_day from live2),
live as (select *, case when ongoing then now::date else next_at::date end as day, {haversine(str(LAT0), str(LON0), "lat", "lon")} as miles,
    case when all_day then next_at::date::timestamp + interval 86399 second else next_at end as when_key from live3
  where not coalesce(next_at > until_at, false) and case when end_at is not null and not repeats then end_at >= now when ongoing then true when all_day then next_at::date >= now::date else next_at >= now end)"""


def live(s: SparkSession, d: str, skips: DataFrame | None = None) -> DataFrame:
    return spatial.with_distance(recur.live_listings(listings(s, d), now(), skips), LAT0, LON0)


@query("within_radius", f"select id, round(m, 6) as miles from (select id, {haversine(str(LAT0), str(LON0), 'lat', 'lon')} as m from v_places) where m <= 25", "v_places")
def _(s, d):
    return spatial.with_distance(spatial.within_radius(view(s, d, "v_places"), LAT0, LON0, 25), LAT0, LON0).select("id", F.round("miles", 6).alias("miles"))


@query("coverage", f"""select id, region, round(gap, 6) as gap from (select p.id, r.id as region, g as gap, row_number() over (partition by p.id order by g, r.id) as k
  from v_places p join v_regions r on true, lateral (select {haversine('p.lat', 'p.lon', 'r.lat', 'r.lon')} - r.radius_miles as g) where g <= 1.0) where k = 1""", "v_places", "v_regions")
def _(s, d):
    return spatial.coverage(view(s, d, "v_places"), view(s, d, "v_regions"), 1.0).select("id", "region", F.round("gap", 6).alias("gap"))


@query("region_totals", f"""select r.id as region, count(p.id) filter (where p.kind <> 'restaurant') as to_visit, count(p.id) filter (where p.kind = 'restaurant') as to_eat
  from v_regions r left join v_places p on {haversine('p.lat', 'p.lon', 'r.lat', 'r.lon')} <= r.radius_miles group by r.id""", "v_places", "v_regions")
def _(s, d):
    return spatial.region_totals(view(s, d, "v_places"), view(s, d, "v_regions"), F.col("kind") == "restaurant")


@query("nearest_town", """select id, town from (select p.id, t.name as town, row_number() over (partition by p.id order by dd - 0.25 * t.town_rank, t.name) as k
  from v_places p join v_towns t on abs(p.lat - t.lat) < 0.2 and abs(p.lon - t.lon) < 0.3, lateral (select pow((p.lat - t.lat) * 69.0, 2) + pow((p.lon - t.lon) * 51.5, 2) as dd) where dd <= 144.0) where k = 1""", "v_places", "v_towns")
def _(s, d):
    return spatial.nearest_town(view(s, d, "v_places"), view(s, d, "v_towns"))


ROUTES = "select s_nationkey as route_id, s_suppkey as seq, 41.5 + (cast((s_suppkey * 6007) % 2000 as double) - 1000) / 4000 as lat, -73.9 + (cast((s_suppkey * 3571) % 2000 as double) - 1000) / 4000 as lon from supplier"
SEGMENTS = f"""route as ({ROUTES}),
seg0 as (select *, lead(lat) over w as lat1, lead(lon) over w as lon1 from route window w as (partition by route_id order by seq)),
seg1 as (select *, sqrt(pow((lon1 - lon) * 69.172 * cos(radians(lat)), 2) + pow((lat1 - lat) * 69.172, 2)) as len from seg0 where lat1 is not null),
seg as (select route_id, seq, lat as lat0, lon as lon0, lat1, lon1, sum(len) over (partition by route_id order by seq) - len as cum0, sum(len) over (partition by route_id order by seq) as cum1 from seg1)"""


def segments(s, d):
    view(s, d, "supplier").createOrReplaceTempView("supplier")
    return spatial.route_segments(s.sql(ROUTES))


@query("route_segments", f"with {SEGMENTS} select route_id, seq, round(cum0, 5) as cum0, round(cum1, 5) as cum1 from seg")
def _(s, d):
    return segments(s, d).select("route_id", "seq", F.round("cum0", 5).alias("cum0"), F.round("cum1", 5).alias("cum1"))


@query("locate_on_route", f"""with {SEGMENTS},
m as (select p.id, g.*, (p.lon - g.lon0) * 69.172 * cos(radians(g.lat0)) as px, (p.lat - g.lat0) * 69.172 as py, (g.lon1 - g.lon0) * 69.172 * cos(radians(g.lat0)) as sx, (g.lat1 - g.lat0) * 69.172 as sy from v_places p join seg g on true),
t as (select *, case when sx * sx + sy * sy > 0 then greatest(0.0, least(1.0, (px * sx + py * sy) / (sx * sx + sy * sy))) else 0.0 end as t from m),
o as (select id, route_id, sqrt(pow(px - t * sx, 2) + pow(py - t * sy, 2)) as off_, cum0 + t * (cum1 - cum0) as along from t),
k as (select *, row_number() over (partition by id, route_id order by off_, along) as k from o where off_ <= 3)
select id, route_id, round(along, 4) as along, round(off_, 4) as off from k where k = 1""", "v_places")
def _(s, d):
    return spatial.locate_on_route(view(s, d, "v_places"), segments(s, d), 3.0).select("id", "route_id", F.round("along", 4).alias("along"), F.round("off", 4).alias("off"))


MARKS = "select route_id, cast(k as double) * 2.5 as along from (select distinct s_nationkey as route_id from supplier) x, range(0, 20) t(k)"


@query("point_at", f"""with {SEGMENTS}, marks as (select r.route_id, k * 2.5 as along from (select distinct route_id from seg) r, range(0, 20) t(k)),
e as (select *, max(cum1) over (partition by route_id) as stop from seg),
h as (select m.route_id, m.along, lat0 + f * (lat1 - lat0) as lat, lon0 + f * (lon1 - lon0) as lon, row_number() over (partition by m.route_id, m.along order by seq) as k
  from marks m join e on m.route_id = e.route_id and m.along >= cum0 and (m.along < cum1 or m.along = cum1 and cum1 = stop), lateral (select case when cum1 > cum0 then (m.along - cum0) / (cum1 - cum0) else 0 end as f))
select route_id, along, round(lat, 5) as lat, round(lon, 5) as lon from h where k = 1""")
def _(s, d):
    seg = segments(s, d)
    marks = seg.select("route_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(19)))).select("route_id", (F.col("k") * 2.5).alias("along"))
    return spatial.point_at(seg, marks).select("route_id", "along", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


@query("live_listings", f"with {LIVE} select id, next_at, day::varchar as day, ongoing, all_day from live", "v_listings")
def _(s, d):
    return live(s, d).select("id", "next_at", "day", "ongoing", "all_day")


@query("next_occurrence", f"with {LIVE} select id, next_at from live2", "v_listings")
def _(s, d):
    c = F.col
    return listings(s, d).select("id", recur.next_occurrence(c("start_at"), c("repeats"), c("cadence"), now()).alias("next_at"))


DAYS = ("1995-06-10", "1995-07-20")


@query("expand_occurrences", f"""with x as (select *, case cadence when 'daily' then 1 when 'weekday' then 1 when 'weekly' then 7 when 'fortnightly' then 14 end as step from v_listings),
o as (select id, start_at as at_ from x where not repeats or cadence in ('occasional', 'bookable')
  union all select id, start_at + to_days((k * step)::int) from x, range(0, 3000) t(k) where repeats and step is not null and start_at + to_days((k * step)::int) < date '{DAYS[1]}' + 1
    and not (cadence = 'weekday' and isodow(start_at + to_days((k * step)::int)) in (6, 7)) and (until_at is null or (start_at + to_days((k * step)::int))::date <= until_at::date)
  union all select id, start_at + to_months(k::int) from x, range(0, 100) t(k) where repeats and cadence = 'monthly' and (until_at is null or (start_at + to_months(k::int))::date <= until_at::date))
select id, at_ as occurs_at from o where at_::date between date '{DAYS[0]}' and date '{DAYS[1]}'""", "v_listings")
def _(s, d):
    a, b = (F.lit(x).cast("date") for x in DAYS)
    return recur.expand_occurrences(listings(s, d), a, b).select("id", "occurs_at")


#: Months are counted from the first date (31 May, 30 June, 31 July), not from the occurrence that is waved off.
@query("skipped_days", f"""with {LIVE}, w as (select id, list(day) as waved from (select id, next_at::date as day from live where repeats union all select id, (next_at + interval 1 day)::date from live where repeats) group by id),
z as (select l.*, waved from live2 l left join w using (id)),
n as (select id, case when waved is null or not list_contains(waved, next_at::date) then next_at when cadence in ('occasional', 'bookable') then null
  when cadence = 'monthly' then (select min(x) from (select start_at + to_months(k::int) as x from (select date_diff('month', start_at, case when start_at >= now then start_at else n0 end) as k0), range(1, 601) t(k) where k > k0 and k <= k0 + 400) where not list_contains(waved, x::date))
  else (select min(x) from (select case when cadence = 'weekday' then y + to_days(case isodow(y) when 6 then 2 when 7 then 1 else 0 end) else y end as x from (select case when start_at >= now then start_at else n0 end + to_days((k * step)::int) as y from range(1, 401) t(k))) where not list_contains(waved, x::date)) end as next_at from z)
select l.id, n.next_at from live l join n using (id) where l.repeats and n.next_at is not null and (l.until_at is null or n.next_at <= l.until_at)""", "v_listings")
def _(s, d):
    first = live(s, d).where("repeats")
    day = F.to_date("next_at")
    skips = first.select("id", F.explode(F.array(day, F.date_add(day, 1))).alias("day"))
    return live(s, d, skips).where("repeats").join(first.select("id"), "id", "left_semi").select("id", "next_at")


CADENCE = """d as (select distinct source, title, day from v_occurrences), g as (select *, datediff('day', lag(day) over (partition by source, title order by day), day) as gap,
  datediff('day', lag(day) over (partition by source, title, isodow(day) order by day), day) as wgap, isodow(day) - 1 as wd from d),
w as (select source, title, wd, count(*) as n, max(wgap) as most, min(day) as d0, max(day) as d1, min(gap) as g0, max(gap) as g1 from g group by 1, 2, 3),
x as (select source, title, sum(n)::bigint as n_days, min(d0) as first_day, max(d1) as last_day, min(g0) as g0, max(g1) as g1, bool_and(n >= 2 and coalesce(most <= 21, false)) as weekly, list(wd order by wd) as wds from w group by 1, 2),
names as (select *, list_transform(wds, lambda i: (['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'])[i + 1]) as nm from x),
c as (select source, title, n_days, first_day, last_day, case when n_days < 3 then null when last_day - first_day + 1 >= 4 and n_days >= (last_day - first_day + 1) * 0.8 then 'Every day'
  when weekly and wds = [0, 1, 2, 3, 4] then 'Every weekday' when weekly and len(wds) = 1 and g0 = 14 and g1 = 14 then 'Every other ' || nm[1]
  when weekly and len(wds) <= 3 then 'Every ' || case len(nm) when 1 then nm[1] when 2 then nm[1] || ' & ' || nm[2] else nm[1] || ', ' || nm[2] || ' & ' || nm[3] end
  when g0 >= 26 and g1 <= 32 then 'Every month' when g0 >= 12 and g1 <= 16 then 'Every other week' end as pattern from names)"""


@query("infer_cadence", f"with {CADENCE} select source, title, pattern, n_days, first_day::varchar as first_day, last_day::varchar as last_day from c", "v_occurrences")
def _(s, d):
    return recur.infer_cadence(view(s, d, "v_occurrences"), ["source", "title"])


@query("collapse_repeats", """with o as (select *, 41.5 + cast(cast(source as int) % 50 as double) / 100 as lat from v_occurrences), k as (select source, title, round(lat, 2) as kl, count(*) as n from o group by 1, 2, 3)
select o.source, o.title, min(event_id) as event_id, min(start_at) as start_at, max(start_at) as until_at, true as repeats from o join k on o.source = k.source and o.title = k.title and n >= 5 group by o.source, o.title
union all select o.source, o.title, event_id, start_at, null, false from o join k on o.source = k.source and o.title = k.title and n < 5""", "v_occurrences")
def _(s, d):
    o = view(s, d, "v_occurrences").withColumn("lat", 41.5 + F.col("source").cast("int") % 50 / 100)
    return recur.collapse_repeats(o, 5, "event_id").select("source", "title", "event_id", F.col("start_at").cast("timestamp_ntz").alias("start_at"), F.col("until_at").cast("timestamp_ntz").alias("until_at"), "repeats")


@query("recurrence_texts", f"with {CADENCE}, o as (select source, title, count(*) as n, max(start_at) as last_ from v_occurrences group by 1, 2 having count(*) >= 5) select source, title, coalesce(pattern, n || ' dates') || ', through ' || strftime(last_, '%b %-d') as recurrence from o join c using (source, title)", "v_occurrences")
def _(s, d):
    o = view(s, d, "v_occurrences").withColumn("lat", 41.5 + F.col("source").cast("int") % 50 / 100)
    return recur.collapse_repeats(o, 5, "event_id").where("repeats").select("source", "title", "recurrence")


BASE = "select l.* from live l anti join (select id from v_decisions) x using (id) anti join v_muted m using (venue_key)"
WEEK = search.Query(radius=60, horizon=30, price_cap=150.0, seniors=False)
PASS = "audience <> 'seniors' and (price_min is null or price_min <= 150) and miles <= 60 and datediff('day', now::date, day) between 0 and 30"


@query("search_listings", f"with {LIVE}, b as ({BASE}) select id, title, day::varchar as day, next_at, round(miles, 6) as miles, price_min from b where {PASS}", "v_listings", "v_decisions", "v_muted")
def _(s, d):
    found = search.search_listings(live(s, d), WEEK, now(), view(s, d, "v_decisions"), view(s, d, "v_muted"))
    return found.select("id", "title", "day", "next_at", F.round("miles", 6).alias("miles"), "price_min")


@query("search_weekend", f"with {LIVE}, b as ({BASE}) select id, day::varchar as day from b where not repeats and day <= date '1995-06-18' and coalesce(end_at::date, day) >= date '1995-06-17'", "v_listings", "v_decisions", "v_muted")
def _(s, d):
    q = search.Query(repeats="once", horizon="weekend")
    return search.search_listings(live(s, d), q, now(), view(s, d, "v_decisions"), view(s, d, "v_muted")).select("id", "day")


@query("search_text_outdoor", f"with {LIVE} select id from live where setting = 'outdoor' and has_food and signup_required and contains(lower(concat_ws(' ', title, venue_key)), 'rod')", "v_listings")
def _(s, d):
    return search.search_listings(live(s, d), search.Query(outdoor=True, food=True, signup=True, text="Rod"), now()).select("id")


@query("search_interested", f"with {LIVE}, b as ({BASE}) select id from b where venue_key in (select name from v_places where brand = 'brand3')", "v_listings", "v_decisions", "v_muted", "v_places")
def _(s, d):
    liked = view(s, d, "v_places").where("brand = 'brand3'").select(F.col("name").alias("venue_key")).distinct()
    return search.search_listings(live(s, d), search.Query(interested=True), now(), view(s, d, "v_decisions"), view(s, d, "v_muted"), liked).select("id")


@query("open_venue_query", f"with {LIVE} select id, venue_key from live where venue_key = 'BUILDING 7' and id not in (select id from v_decisions where verdict = 'saved')", "v_listings", "v_decisions")
def _(s, d):
    return search.search_listings(live(s, d), search.Query.open("BUILDING 7"), now(), view(s, d, "v_decisions"), view(s, d, "v_muted")).select("id", "venue_key")


@query("type_facets", f"with {LIVE}, b as ({BASE}) select type, count(*) as n from (select unnest([type_1, type_2]) as type from b where {PASS}) where type is not null group by type", "v_listings", "v_decisions", "v_muted")
def _(s, d):
    return search.type_facets(search.search_listings(live(s, d), WEEK, now(), view(s, d, "v_decisions"), view(s, d, "v_muted")))


@query("type_filter", f"with {LIVE} select id from live where (type_1 in ('concert', 'film') or type_2 = 'film') and coalesce(type_2, '') <> 'class'", "v_listings")
def _(s, d):
    return search.type_filter(live(s, d), ["concert", "film"], ["class"]).select("id")


for by, keys in (("soonest", "day, when_key, miles, id"), ("nearest", "miles, when_key, id"), ("cheapest", "price_min nulls last, when_key, id")):
    @query(f"page_{by}", f"with {LIVE} select id, row_number() over (order by {keys}) as pos from live qualify pos between 41 and 80", "v_listings")
    def _(s, d, by=by):
        from pyspark.sql import Window

        top = search.sort_listings(live(s, d), by).limit(80)
        return top.withColumn("pos", F.row_number().over(Window.orderBy(*search.order_keys(by)))).where("pos > 40").select("id", "pos")


@query("day_plan", f"with {LIVE} select id, day::varchar as day, count(*) over (partition by day) as day_count, row_number() over (partition by day order by when_key, miles, id) as day_pos from live", "v_listings")
def _(s, d):
    return search.day_plan(live(s, d)).select("id", "day", "day_count", "day_pos")


@query("saved_listings", f"with {LIVE} select id from live where id in (select id from v_decisions where verdict = 'saved')", "v_listings", "v_decisions")
def _(s, d):
    return search.saved(live(s, d), view(s, d, "v_decisions")).select("id")


@query("programme", f"with {LIVE} select id, venue_key, row_number() over (partition by venue_key order by next_at, id) as pos from live where id not in (select id from v_decisions where verdict = 'hidden') qualify pos <= 5", "v_listings", "v_decisions")
def _(s, d):
    return search.programme(live(s, d), view(s, d, "v_decisions")).select("id", "venue_key", "pos")


@query("place_facets", "select kind, case kind when 'museum' then 'Museums' when 'historic site' then 'Historic sites' when 'antique shop' then 'Antique shops' when 'restaurant' then 'Restaurants & bars' else 'Parks & nature' end as label, count(*) as n, case kind when 'museum' then 1 when 'historic site' then 5 when 'park' then 7 when 'antique shop' then 22 else 26 end as pos from v_places group by kind", "v_places")
def _(s, d):
    return search.place_facets(view(s, d, "v_places"))


@query("search_places", "select id from v_places where kind <> 'restaurant' and kind <> 'cafe' and (contains(lower(name), 'town 1') or contains(lower(city), 'town 1') or contains(lower(case kind when 'museum' then 'Museums' when 'historic site' then 'Historic sites' when 'antique shop' then 'Antique shops' else 'Parks & nature' end), 'town 1'))", "v_places")
def _(s, d):
    # among places to visit neither hours nor brands are asked
    p = view(s, d, "v_places").withColumn("minutes_left", F.lit(None).cast("double"))
    return search.search_places(p, search.PlaceQuery(scope="visit", independents=True, open_now=True, text="Town 1")).select("id")


PRESETS = f"""/* recursive */ named as (select trim(regexp_replace(regexp_replace(case when c_custkey % 2 = 0 then city || ' (TN)' else city end, '\\s*\\([^)]*\\)', '', 'g'), '\\s+', ' ', 'g')) as town, lat, lon from v_places where city is not null),
t as (select town, count(*) as n, avg(lat) as lat, avg(lon) as lon, row_number() over (order by count(*) desc, town) as r from named group by town),
first_ as (select list({{'town': id, 'n': null::bigint, 'lat': lat, 'lon': lon}} order by id) as acc from (select id, lat::double as lat, lon::double as lon from v_regions order by id limit 3)),
g as (select 0::bigint as r, (select acc from first_)::struct(town varchar, n bigint, lat double, lon double)[] as acc union all
  select g.r + 1, case when len(acc) < 8 and len(list_filter(acc, lambda y: y.town = t.town or {haversine('t.lat', 't.lon', 'y.lat', 'y.lon')} < 1.5)) = 0 then list_append(acc, {{'town': t.town, 'n': t.n, 'lat': t.lat, 'lon': t.lon}}) else acc end from g join t on t.r = g.r + 1),
f as (select acc from g order by r desc limit 1), p as (select x.town as town, x.n as n, x.lat as lat, x.lon as lon, pos::int as pos from (select unnest(acc) as x, generate_subscripts(acc, 1) as pos from f))"""


def presets(s, d, origin=None):
    p = view(s, d, "v_places").withColumn("city", F.when(F.col("c_custkey") % 2 == 0, F.concat("city", F.lit(" (TN)"))).otherwise(F.col("city")))
    regions = view(s, d, "v_regions").select(F.col("id").alias("name"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return search.preset_towns(p, regions, origin, apart=1.5).select("town", "n", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "pos")


@query("preset_towns", f"with {PRESETS} select town, n, round(lat, 6) as lat, round(lon, 6) as lon, pos from p", "v_places", "v_regions")
def _(s, d):
    return presets(s, d)


NEAR_FIRST = PRESETS.replace("list({'town': id, 'n': null::bigint, 'lat': lat, 'lon': lon} order by id)", f"list({{'town': id, 'n': null::bigint, 'lat': lat, 'lon': lon}} order by {haversine(str(LAT0), str(LON0), 'lat', 'lon')}, id)").replace("from v_regions order by id limit 3", f"from v_regions order by {haversine(str(LAT0), str(LON0), 'lat', 'lon')}, id limit 3")


@query("preset_towns_near", f"with {NEAR_FIRST} select town, n, round(lat, 6) as lat, round(lon, 6) as lon, (row_number() over (order by {haversine(str(LAT0), str(LON0), 'lat', 'lon')}, pos))::int as pos from p", "v_places", "v_regions")
def _(s, d):
    return presets(s, d, (LAT0, LON0))


for by, keys in (("distance", "miles nulls last, name, id"), ("name", "name, id"), ("events", "events desc nulls last, miles nulls last, name, id")):
    @query(f"places_by_{by}", f"with p as (select id, name, c_custkey % 9 as events, {haversine(str(LAT0), str(LON0), 'lat', 'lon')} as miles from v_places) select id, row_number() over (order by {keys}) as pos from p qualify pos between 41 and 80", "v_places")
    def _(s, d, by=by):
        from pyspark.sql import Window

        p = spatial.with_distance(view(s, d, "v_places"), LAT0, LON0).withColumn("events", F.col("c_custkey") % 9)
        top = search.sort_places(p, by).limit(80)
        return top.withColumn("pos", F.row_number().over(Window.orderBy(*search.place_keys(by)))).where("pos > 40").select("id", "pos")


@query("liked_places", "select id from v_places where name in (select venue_key from v_muted)", "v_places", "v_muted")
def _(s, d):
    p = spatial.with_distance(view(s, d, "v_places"), LAT0, LON0)
    return search.liked_places(p, view(s, d, "v_muted").select(F.col("venue_key").alias("name"))).select("id")


@query("cuisine_facets", """select cuisine, count(*) as n, case cuisine when 'unheard' then 0 else 1 end = 1 as known from (select unnest(case cast(c_custkey % 4 as int) when 0 then ['pizza', 'japanese'] when 1 then ['mexican'] when 2 then ['unheard'] else [] end) as cuisine from v_places) group by 1
  union all select null, count(*), null from v_places where c_custkey % 4 < 3""", "v_places")
def _(s, d):
    n = F.col("c_custkey") % 4
    c = F.when(n == 0, F.array(F.lit("pizza"), F.lit("japanese"))).when(n == 1, F.array(F.lit("mexican"))).when(n == 2, F.array(F.lit("unheard"))).otherwise(F.array().cast("array<string>"))
    out = search.cuisine_facets(view(s, d, "v_places").withColumn("cuisine", c))
    return out.select("cuisine", "n", F.when(F.col("cuisine").isNotNull(), F.col("pos") <= len(V.CUISINES)).alias("known"))


RICH = "(case when price_min is not null then 6 else 0 end + case when end_at is not null then 1 else 0 end + case when setting <> 'unknown' then 1 else 0 end)"


def rich():
    c = F.col
    return X.richness({"price": c("price_min"), "end": c("end_at"), "setting": c("setting")})


@query("unique_ids", f"with x as (select *, concat('l-', cast(o_custkey as varchar)) as uid from v_listings) select uid as id, o_orderkey from (select *, row_number() over (partition by uid order by {RICH} desc, o_orderkey) as k from x) where k = 1", "v_listings")
def _(s, d):
    df = listings(s, d).withColumn("id", F.concat(F.lit("l-"), F.col("o_custkey").cast("string")))
    return resolve.unique_ids(df, rich(), F.col("o_orderkey")).select("id", "o_orderkey")


FILLED = "(case when brand is not null then 1 else 0 end + case when opening_hours is not null then 1 else 0 end + case when url is not null then 1 else 0 end)"
FIELDS = ["brand", "opening_hours", "url"]


@query("dedupe_places", f"select id from (select id, row_number() over (partition by lower(name), round(lat, 2), round(lon, 2) order by {FILLED} desc, c_custkey) as k from v_places) where k = 1", "v_places")
def _(s, d):
    return resolve.dedupe_places(view(s, d, "v_places"), FIELDS, F.col("c_custkey")).select("id")


@query("collapse_places", f"select id from (select id, row_number() over (partition by lower(name), kind, city order by {FILLED} desc, {haversine(str(LAT0), str(LON0), 'lat', 'lon')}, c_custkey) as k from v_places) where k = 1", "v_places")
def _(s, d):
    p = spatial.with_distance(view(s, d, "v_places"), LAT0, LON0)
    return resolve.collapse_places(p, FIELDS, F.col("miles"), F.col("c_custkey")).select("id")


SPELLED = "select id, o_orderkey, case cast(o_orderkey % 5 as int) when 0 then concat(venue_key, '!') when 1 then lower(venue_key) when 2 then replace(venue_key, ' ', '-') else venue_key end as venue_key from v_listings"


@query("canonical_venues", f"""with s as ({SPELLED}), n as (select *, trim(regexp_replace(lower(venue_key), '[^a-z0-9]+', ' ', 'g')) as slug from s),
c as (select slug, venue_key, count(*) as n from n group by 1, 2), b as (select slug, venue_key as best, row_number() over (partition by slug order by n desc, length(regexp_replace(venue_key, '[A-Za-z0-9 ]', '', 'g')) desc, length(regexp_replace(venue_key, '[^A-Z]', '', 'g')) desc, venue_key) as k from c)
select id, best as venue_key from n join b using (slug) where k = 1""", "v_listings")
def _(s, d):
    listings(s, d).createOrReplaceTempView("v_listings")
    return resolve.canonical_venues(s.sql(SPELLED)).select("id", "venue_key")


@query("venue_kinds", """with t as (select venue_key, unnest([type_1, type_2]) as ty from v_listings), v as (select venue_key, case ty when 'concert' then 'music venue' when 'film' then 'cinema' end as kind, count(*) as n from t where ty in ('concert', 'film') group by 1, 2),
m as (select venue_key, kind, n, sum(n) over (partition by venue_key) as total, row_number() over (partition by venue_key order by n desc, kind desc) as k from v) select venue_key, kind as place_kind from m where k = 1 and n >= 2 and n >= 0.5 * total""", "v_listings")
def _(s, d):
    return resolve.venue_kinds(listings(s, d))


#: All orders, and a second report of some, renamed and moved a little.
TWO = """select id, title, lat, lon, start_at, end_at, o_orderkey from v_listings
  union all select concat('m-', cast(o_orderkey as varchar(20))), concat(title, ' (Session #', cast(o_orderkey % 9 as varchar(20)), ')'), lat + 0.003, lon - 0.003, start_at, null, o_orderkey from v_listings where o_orderkey % 12 = 0"""


def two(s, d):
    listings(s, d).createOrReplaceTempView("v_listings")
    return s.sql(TWO)


NORM = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\(.*?\\)', '', 'g'), '\\b(session|part|day|week|no\\.?|#)\\s*\\d+\\b', '', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
STOP = "['the', 'a', 'an', 'at', 'in', 'on', 'of', 'and', 'for', 'to', 'with', 'annual', 'presents', 'featuring']"
PAIRS = f"""two as ({TWO}), sp as (select *, start_at::date as d0, greatest(coalesce(end_at::date, start_at::date), start_at::date) as d1, {NORM.format('title')} as nt from two),
tok as (select *, list_distinct(list_filter(string_split(nt, ' '), lambda w: length(w) > 2 and not list_contains({STOP}, w))) as tk from sp),
dy as (select tok.*, unnest(generate_series(d0, d1, interval 1 day))::date as dd from tok),
pairs as (select distinct a.id as a, b.id as b from dy a join dy b on a.dd = b.dd and a.id < b.id and abs(a.lat - b.lat) < 0.04 and abs(a.lon - b.lon) < 0.06
  where (a.d0 = b.d0 or a.d0 < a.d1 or b.d0 < b.d1) and {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} < 2.0
    and (a.nt = b.nt or (a.nt <> '' and b.nt <> '' and (contains(a.nt, b.nt) or contains(b.nt, a.nt))) or (len(a.tk) > 0 and len(b.tk) > 0 and len(list_intersect(a.tk, b.tk)) / (len(list_distinct(list_concat(a.tk, b.tk))))::double >= 0.6)))"""


@query("duplicate_pairs", f"with {PAIRS} select a, b from pairs", "v_listings")
def _(s, d):
    return resolve.duplicate_pairs(two(s, d))


CLUSTERS = f"""/* recursive */ {PAIRS}, both_ as (select a as n, b as m from pairs union select b, a from pairs),
reach as (select n, n as c from both_ union select b.n, r.c from both_ b join reach r on b.m = r.n where r.c < b.n or r.c <> b.n),
comp as (select n, min(c) as cluster from reach group by n)"""


@query("clusters", f"with {CLUSTERS} select t.id, coalesce(c.cluster, t.id) as cluster from two t left join comp c on t.id = c.n", "v_listings")
def _(s, d):
    return resolve.clusters(two(s, d)).select("id", "cluster")


@query("fold_duplicates", f"""with {CLUSTERS}, x as (select t.*, coalesce(c.cluster, t.id) as cluster, case when end_at is not null then 1 else 0 end as rich from two t left join comp c on t.id = c.n),
e as (select cluster, id, row_number() over (partition by cluster order by o_orderkey, id) as k, count(*) over (partition by cluster) as members from x),
b as (select cluster, title, row_number() over (partition by cluster order by rich desc, o_orderkey, id) as k from x)
select e.id, b.title, e.members from e join b on e.cluster = b.cluster and e.k = 1 and b.k = 1""", "v_listings")
def _(s, d):
    return resolve.fold_duplicates(two(s, d), X.richness({"end": F.col("end_at")}), F.col("o_orderkey")).select("id", "title", "members")




@query("merge_listings", f"""with {CLUSTERS}, x as (select t.*, coalesce(c.cluster, t.id) as cluster, case when end_at is not null then 1 else 0 end as rich, t.id like 'l-%' as held from two t left join comp c on t.id = c.n),
r as (select *, row_number() over (partition by cluster order by rich desc, held desc, o_orderkey, id) as k from x),
h as (select cluster, arg_min(id, (o_orderkey, id)) filter (where held) as hid, arg_min(id, (o_orderkey, id)) as eid, arg_min(end_at, k) filter (where not held and end_at is not null) as new_end from r group by cluster)
select coalesce(hid, eid) as id, r.title, case when r.held then coalesce(r.end_at, new_end) else r.end_at end as end_at from r join h using (cluster) where k = 1""", "v_listings")
def _(s, d):
    t = two(s, d)
    held, new = t.where("id like 'l-%'"), t.where("id like 'm-%'")
    return resolve.merge_listings(held, new, X.richness({"end": F.col("end_at")}), F.col("o_orderkey"), ["end_at"]).select("id", "title", "end_at")



ITEMS = "select concat('Q', cast(c_custkey as varchar(20))) as qid, case when c_custkey % 6 = 0 then concat(name, ', New York') else concat('Olana ', cast(c_custkey % 40 as varchar(20)), ' House') end as label, lat + 0.004 as lat, lon as lon, case when c_custkey % 10 = 0 then 'village in a county' else 'a building' end as description, concat('Pic ', id, '.jpg') as image from v_places"
NAMED = "select id, concat('Olana ', cast(c_custkey % 40 as varchar(20))) as name, lat, lon, case when c_custkey % 3 = 0 then brand end as brand from v_places"


def items_and_places(s, d):
    view(s, d, "v_places").createOrReplaceTempView("v_places")
    return s.sql(ITEMS), s.sql(NAMED)


@query("match_items", f"""with i as ({ITEMS}), p as ({NAMED}), m as (select p.id, i.qid, {haversine('p.lat', 'p.lon', 'i.lat', 'i.lon')} as dd from p join i on abs(p.lat - i.lat) < 0.035 and abs(p.lon - i.lon) < 0.05
  where p.brand is null and not regexp_matches(i.label, ', New York$') and i.description <> 'village in a county')
select id, qid from (select *, row_number() over (partition by id order by dd, qid) as k from m where dd <= 2.0) where k = 1""", "v_places")
def _(s, d):
    items, places = items_and_places(s, d)
    return resolve.match_items(places, items)


RESULTS = "select id, concat('svc', cast(k as varchar(20))) as service, k as pos, case when c_custkey % 4 = 0 then 'Village Pizza' when c_custkey % 7 = k then 'Elsewhere' else name end as name, lat + k * 0.0006 as lat, lon, 3.0 + (c_custkey % 20) / 10.0 as stars, c_custkey % 50 as count from v_places, (select 0 as k union all select 1 union all select 2) z"


@query("match_ratings", f"""with r as ({RESULTS}) select r.id, service, cast(stars as double) as stars, r.count from r join v_places p on r.id = p.id where {haversine('p.lat', 'p.lon', 'r.lat', 'r.lon', 6371000.0)} <= 150 and r.name = p.name""", "v_places")
def _(s, d):
    view(s, d, "v_places").createOrReplaceTempView("v_places")
    return resolve.match_ratings(view(s, d, "v_places"), s.sql(RESULTS)).select("id", "service", F.col("stars").cast("double").alias("stars"), "count")


@query("combine_ratings", f"with r as ({RESULTS}) select id, round(sum(cast(stars as double) * count) / sum(count), 2) as stars, sum(count)::bigint as count, array_to_string(list_sort(list_distinct(list(service))), ',') as sources from r group by id having sum(count) > 0", "v_places")
def _(s, d):
    view(s, d, "v_places").createOrReplaceTempView("v_places")
    return resolve.combine_ratings(s.sql(RESULTS).withColumn("stars", F.col("stars").cast("double"))).select("id", "stars", "count", F.array_join("sources", ",").alias("sources"))
