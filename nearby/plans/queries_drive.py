"""Queries of cars on routes, towns along them, decks of stops, interest and what is on, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from nearby.operators import drive, spatial
from nearby.plans.fixtures import view
from nearby.plans.queries_search import NOW, SEGMENTS, listings, query, segments

#: Positions of a car on each route: four on each piece of it, in order, off it a little and now and then by miles.
DRIVES = f"""{SEGMENTS}, fx as (select route_id as car, route_id, seq * 4 + k as event_id, lat0 + (lat1 - lat0) * k / 4.0 + ((seq * 37 + k * 11) % 9 - 4) / 2000.0 + case when (seq + k) % 13 = 0 then 0.05 when (seq + k) % 29 = 0 then 0.9 else 0 end as lat,
  lon0 + (lon1 - lon0) * k / 4.0 + ((seq * 53 + k * 7) % 9 - 4) / 2000.0 as lon from seg, range(0, 4) t(k))"""


def drives(s, d):
    seg = segments(s, d)
    k, n = F.col("k"), F.col("seq")
    wide = F.when((n + k) % 13 == 0, 0.05).when((n + k) % 29 == 0, 0.9).otherwise(0.0)
    f = seg.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    lat = F.col("lat0") + (F.col("lat1") - F.col("lat0")) * k / 4.0 + ((n * 37 + k * 11) % 9 - 4) / 2000.0 + wide
    lon = F.col("lon0") + (F.col("lon1") - F.col("lon0")) * k / 4.0 + ((n * 53 + k * 7) % 9 - 4) / 2000.0
    at = F.timestamp_seconds(n * 4 + k)
    return f.select(F.col("route_id").alias("car"), "route_id", at.alias("fix_at"), (n * 4 + k).alias("event_id"), lat.alias("lat"), lon.alias("lon")), seg


#: A car's places one after another: near the last one if something is within a mile there, else the nearest of all.
FOLLOW = f"""{DRIVES}, fm as (select x.car, x.event_id, g.*, (x.lon - g.lon0) * 69.172 * cos(radians(g.lat0)) as px, (x.lat - g.lat0) * 69.172 as py, (g.lon1 - g.lon0) * 69.172 * cos(radians(g.lat0)) as sx, (g.lat1 - g.lat0) * 69.172 as sy from fx x join seg g on x.route_id = g.route_id),
ft as (select *, case when sx * sx + sy * sy > 0 then greatest(0.0, least(1.0, (px * sx + py * sy) / (sx * sx + sy * sy))) else 0.0 end as t from fm),
fh as (select car, event_id, row_number() over (partition by car order by event_id) as n, list({{'off_': sqrt(pow(px - t * sx, 2) + pow(py - t * sy, 2)), 'seq': seq, 'along': cum0 + t * (cum1 - cum0), 'cum0': cum0, 'cum1': cum1}}) as hits from ft group by car, event_id),
fo as (select car, event_id, n, list_sort(hits)[1] as b from fh where n = 1
  union all select fh.car, fh.event_id, fh.n, coalesce(list_sort(list_filter(fh.hits, lambda h: h.off_ <= 1 and h.cum1 >= fo.b.along - 3 and h.cum0 <= fo.b.along + 15))[1], list_sort(fh.hits)[1]) from fo join fh on fh.car = fo.car and fh.n = fo.n + 1)"""


@query("follow_route", f"with recursive {FOLLOW} select car, event_id, round(b.along, 4) as along, round(b.off_, 4) as off from fo")
def _(s, d):
    fixes, seg = drives(s, d)
    return drive.follow_route(fixes, seg).select("car", "event_id", F.round("along", 4).alias("along"), F.round("off", 4).alias("off"))


#: Alerts on a followed route; fixes are a second apart, so a minute is sixty of them.
FOLLOW_ALERTS = f"""{FOLLOW}, fe as (select route_id, max(cum1) as length from seg group by 1), fp as (select fo.car, event_id, n, b.off_, length - b.along as left_ from fo join fe on car = route_id),
fa as (select car, event_id, n, case when left_ <= 0.2 or off_ <= 0.4 then 0 else 1 end as run, left_ <= 0.2 as arrived, null::bigint as last_, case when left_ <= 0.2 then 'arrived' end as alert from fp where n = 1
  union all select car, event_id, n, case when here or due then x else r end, arrived or here, case when due then event_id else last_ end, case when here and not arrived then 'arrived' when due then 'off route' end
  from (select *, not here and r >= 3 and (last_ is null or event_id - last_ > 60) as due, case when here then run else 0 end as x from (select fp.car, fp.event_id, fp.n, fa.run, fa.arrived, fa.last_, fp.left_ <= 0.2 as here, case when fp.off_ > 0.4 then fa.run + 1 else 0 end as r from fa join fp on fp.car = fa.car and fp.n = fa.n + 1)))"""


@query("route_progress", f"with recursive {FOLLOW_ALERTS} select car, event_id, alert from fa where alert is not null")
def _(s, d):
    fixes, seg = drives(s, d)
    return drive.route_alerts(drive.progress(drive.follow_route(fixes, seg), seg)).select("car", "event_id", "alert")


#: Samples every half mile and the nearest town of each.
SAMPLED = f"""{SEGMENTS}, en as (select *, max(cum1) over (partition by route_id) as stop from seg),
mk as (select route_id, unnest(generate_series(0, floor(length / 0.5)::bigint)) * 0.5 as at_ from (select route_id, max(cum1) as length from seg group by 1)),
sp as (select m.route_id, m.at_, lat0 + f * (lat1 - lat0) as lat, lon0 + f * (lon1 - lon0) as lon, row_number() over (partition by m.route_id, m.at_ order by seq) as k
  from mk m join en e on m.route_id = e.route_id and m.at_ >= cum0 and (m.at_ < cum1 or m.at_ = cum1 and cum1 = stop), lateral (select case when cum1 > cum0 then (m.at_ - cum0) / (cum1 - cum0) else 0 end as f)),
tw as (select route_id, at_, town from (select p.route_id, p.at_, t.name as town, row_number() over (partition by p.route_id, p.at_ order by dd - 0.25 * t.town_rank, t.name) as k2
  from sp p join v_towns t on p.k = 1 and abs(p.lat - t.lat) < 0.2 and abs(p.lon - t.lon) < 0.3, lateral (select pow((p.lat - t.lat) * 69.0, 2) + pow((p.lon - t.lon) * 51.5, 2) as dd) where dd <= 4.0 * 36) where k2 = 1),
sm as (select p.route_id, p.at_, town from sp p left join tw using (route_id, at_) where p.k = 1)"""


def sampled(s, d):
    """Towns of samples; those that end in 3 are left out, as if no one had answered."""
    towns = spatial.sampled_towns(segments(s, d), view(s, d, "v_towns"))
    return towns.withColumn("town", F.when(~F.coalesce(F.col("town").endswith("3"), F.lit(False)), F.col("town")))


UNANSWERED = "an as (select route_id, at_, case when town not like '%3' then town end as town from sm)"


@query("sampled_towns", f"with {SAMPLED}, {UNANSWERED} select route_id, at_ as at, town from an", "v_towns")
def _(s, d):
    return sampled(s, d).select("route_id", F.col("at").cast("double").alias("at"), "town")


@query("sampled_town_lines", f"with {SAMPLED}, {UNANSWERED}, ln as (select route_id, at_, town, lag(town) over w as b, lag(at_) over w as a0 from an where town is not null window w as (partition by route_id order by at_)) select route_id, ((at_ + a0) / 2)::double as at, town from ln where b <> town and at_ - a0 <= 2", "v_towns")
def _(s, d):
    return drive.town_lines(sampled(s, d)).select("route_id", "at", "town")


@query("current_town", f"with {SAMPLED}, {UNANSWERED}, ps as (select route_id, k * 3.7 as along from (select distinct route_id from seg) r, range(0, 60) t(k)), j as (select p.route_id, p.along, arg_max(town, at_) as town from ps p left join (select * from an where town is not null) a on a.route_id = p.route_id and a.at_ <= p.along + 0.05 group by 1, 2) select route_id, along::double as along, town from j", "v_towns")
def _(s, d):
    p = segments(s, d).select("route_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(59)))).select("route_id", (F.col("k") * 3.7).alias("along"))
    return spatial.current_town(p, sampled(s, d)).select("route_id", "along", "town")


#: A car's deck fix by fix: what is passed leaves, then one candidate asks in.
DECK = """/* recursive */ dk as (select car, event_id, row_number() over (partition by car order by fix_at, event_id) as n from v_fixes),
dc as (select car, n, n * 0.8::double as odo, concat('s', event_id % 40) as id, (event_id * 37 % 100) / 10.0::double as v, 1.0::double + (event_id * 13 % 120) / 10.0::double as ahead from dk),
st as (select distinct car, 0::bigint as n, [{'v': 0.0::double, 'id': '', 'm': 0.0::double}][2:] as held, ['x'][2:] as gone, null::varchar as out_, null::varchar as in_ from dk
  union all select car, n, case when in_ is null then kept when out_ is null then list_append(kept, {'v': v, 'id': id, 'm': odo + ahead}) else list_append(list_filter(kept, lambda h: h.id <> out_), {'v': v, 'id': id, 'm': odo + ahead}) end, gone, out_, in_
  from (select *, case when len(list_filter(kept, lambda h: h.id = id0)) > 0 then null when len(kept) < 3 then id0 when w is not null and v > w.v + 1 then id0 end as in_, case when len(list_filter(kept, lambda h: h.id = id0)) = 0 and len(kept) >= 3 and w is not null and v > w.v + 1 then w.id end as out_
    from (select *, list_sort(list_filter(kept, lambda h: h.m - odo > 7))[1] as w, id as id0
      from (select dc.car, dc.n, dc.odo, dc.id, dc.v, dc.ahead, list_filter(st.held, lambda h: h.m > dc.odo) as kept, list_transform(list_filter(st.held, lambda h: h.m <= dc.odo), lambda h: h.id) as gone from st join dc on dc.car = st.car and dc.n = st.n + 1))))"""


@query("deck_moves", f"with {DECK} select car, n as tick, unnest(gone) as id, 'passed' as move from st union all select car, n, out_, 'out' from st where out_ is not null union all select car, n, in_, 'in' from st where in_ is not null", "v_fixes")
def _(s, d):
    k = F.col("event_id")
    f = view(s, d, "v_fixes").select("car", "event_id", F.row_number().over(Window.partitionBy("car").orderBy("fix_at", "event_id")).cast("long").alias("tick"))
    c = f.select("car", "tick", F.concat(F.lit("s"), (k % 40).cast("string")).alias("id"), ((k * 37 % 100) / 10.0).alias("value"), (1.0 + (k * 13 % 120) / 10.0).alias("ahead"))
    return drive.deck_moves(c, f.select("car", "tick", (F.col("tick") * 0.8).alias("odometer")), k=3)


#: Events around noon of all lengths, with and without a stated end.
TODAY = f"select id, o_orderkey, lat, lon, case when o_orderkey % 10 = 0 then 'kids' else audience end as audience, o_orderkey % 9 = 0 as repeats, case when o_orderkey % 5 = 0 then 30 end as duration_min, timestamp '{NOW[:10]} 00:00:00' + to_days((o_orderkey % 5 - 2)::int) + to_hours((o_orderkey % 24)::int) as start_at, case cast(o_orderkey % 4 as int) when 0 then 3 when 1 then 60 when 2 then 200 end as hours from v_listings"


@query("on_now", f"with x as ({TODAY}), y as (select *, case when hours is not null then start_at + to_hours(hours) end as end_at, timestamp '{NOW}' as now from x), z as (select *, coalesce(end_at, start_at + to_minutes(coalesce(duration_min, 120))) as e from y where not repeats and audience <> 'kids' and not (end_at is null and strftime(start_at, '%H:%M') = '00:00')) select id from z where epoch(e - start_at) <= 43200 and start_at <= now + interval 1 hour and e >= now + interval 15 minute or epoch(e - start_at) > 43200 and epoch(e - start_at) <= 345600 and start_at <= now and e >= now", "v_listings")
def _(s, d):
    k = F.col("o_orderkey")
    day = F.date_add(F.lit(NOW[:10]).cast("date"), (k % 5 - 2).cast("int"))
    start = (day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (k % 24).cast("int")))
    hours = F.when(k % 4 == 0, 3).when(k % 4 == 1, 60).when(k % 4 == 2, 200)
    ls = listings(s, d).select("id", "lat", "lon", F.when(k % 10 == 0, "kids").otherwise(F.col("audience")).alias("audience"), (k % 9 == 0).alias("repeats"), F.when(k % 5 == 0, 30).alias("duration_min"), start.alias("start_at"), hours.alias("hours"))
    ls = ls.withColumn("end_at", F.when(F.col("hours").isNotNull(), F.col("start_at") + F.make_dt_interval(F.lit(0), F.col("hours"))))
    return drive.on_now(ls, F.lit(NOW).cast("timestamp_ntz")).select("id")


#: Places with menus, liked ones and chains, for hungry readers and others.
TASTES = "select id, name, kind, brand, url, c_custkey % 9 = 0 as liked, c_custkey % 11 as m from v_places"
MENU = "case when m % 4 = 0 then ['pizza', 'thai'] when m % 4 = 1 then ['pizza'] when m % 4 = 2 then ['thai', 'indian'] end"


@query("interest", f"""with p as ({TASTES}), q as (select *, coalesce({MENU}, ['none']) as menu, kind = 'restaurant' as food, hungry from p, (values (true), (false)) h(hungry) where name not in (select venue_key from v_muted) and coalesce(brand, '') not in ('brand1', 'brand2')),
b as (select *, case when food and not hungry then 0.0 when kind = 'museum' then 3.0 when kind = 'park' then 0.0 when kind = 'restaurant' then 2.0 * 1.5 else 1.0 end as base0 from q where not (food and len(list_filter(menu, lambda x: x not in ('pizza', 'none'))) = 0)),
c as (select *, case when base0 <= 0 and liked then 1.0 else base0 end as base from b)
select id, hungry, round(base + (url is not null)::int * 0.3 + liked::int * 3.0 + case when food and list_contains(menu, 'thai') then 2.0 else 0 end, 6) as score from c where base > 0""", "v_places", "v_muted")
def _(s, d):
    m = F.col("m")
    p = view(s, d, "v_places").select("id", "name", F.col("kind").alias("drive_type"), F.col("brand").alias("chain"), "url", (F.col("c_custkey") % 9 == 0).alias("liked"), (F.col("c_custkey") % 11).alias("m"))
    of = lambda *x: F.array(*map(F.lit, x))
    p = p.withColumn("cuisine", F.when(m % 4 == 0, of("pizza", "thai")).when(m % 4 == 1, of("pizza")).when(m % 4 == 2, of("thai", "indian")))
    muted = view(s, d, "v_muted").select(F.col("venue_key").alias("name"))
    score = lambda hungry: drive.interest(p, {"museum": 3.0, "park": 0.0, "restaurant": 2.0}, {"restaurant": 1.5}, chains_off=("brand1", "brand2"), cuisines={"thai": 2.0}, cuisines_off=("pizza", "none"), hungry=hungry, muted=muted).withColumn("hungry", F.lit(hungry))
    return score(True).unionByName(score(False)).select("id", "hungry", F.round("score", 6).alias("score"))
