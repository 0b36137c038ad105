"""Stops along a drive: positions, interest, what lies ahead, detours, ranking."""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearby.functions import geo
from nearby.functions import vocab as V
from nearby.operators import spatial

#: Miles from the last trusted fix before a bearing is trusted; miles an hour above which a stated heading is; metres a second to miles an hour.
LEAST_MOVE, LEAST_SPEED, MPS_TO_MPH = 0.02, 5.0, 2.23694
#: Miles off a route that count as off it, fixes in a row, seconds between two alerts, miles left at arrival.
OFF_ROUTE, OFF_FIXES, ALERT_SECONDS, ARRIVED = 0.4, 3, 60.0, 0.2
MOST_AHEAD, SHORTLIST = 16, 40
#: Miles an hour that an unknown speed counts as, hours looked ahead, miles at least and at most.
CRUISE, LOOK_HOURS, LOOK_LEAST, LOOK_MOST = 30.0, 0.25, 4.0, 25.0

TRACKED = "car long, fix_at timestamp, event_id long, lat double, lon double, step double, odometer double, speed double, heading double"
ALERTED = "car long, fix_at timestamp, event_id long, alert string"


def miles(a: float, b: float, c: float, d: float) -> float:
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * geo.MILES_RADIUS * math.asin(min(1.0, math.sqrt(h)))


def course(a: float, b: float, c: float, d: float) -> float:
    east, north = (d - b) * geo.MILES_PER_DEGREE * math.cos(math.radians(a)), (c - a) * geo.MILES_PER_DEGREE
    return math.degrees(math.atan2(east, north)) % 360


#: What is kept of a car between fixes: its last fix, the fix from which the next bearing is taken, and sums.
Kept = tuple
NEW_TRACK: Kept = (None, None, None, 0.0, 0.0, None, None, None)
NEW_ALERTS: Kept = (0, False, None)


def stated(x: object) -> float | None:
    return None if x is None or x != x else float(x)


def track_step(kept: Kept, row) -> tuple[Kept, tuple]:
    """The next state of a car, and (step, odometer, speed, heading) at its fix."""
    at, lat0, lon0, odometer, speed, heading, from_lat, from_lon = kept
    gps_heading, gps_speed, now = stated(row.gps_heading), stated(row.gps_speed), row.fix_at.timestamp()
    if gps_speed is not None and gps_speed >= 0:
        speed = gps_speed * MPS_TO_MPH
    if gps_heading is not None and speed > LEAST_SPEED:
        heading, from_lat, from_lon = gps_heading, row.lat, row.lon
    elif from_lat is not None and miles(from_lat, from_lon, row.lat, row.lon) > LEAST_MOVE:
        heading, from_lat, from_lon = course(from_lat, from_lon, row.lat, row.lon), row.lat, row.lon
    if from_lat is None:
        from_lat, from_lon = row.lat, row.lon
    step = 0.0
    if lat0 is not None:
        step = miles(lat0, lon0, row.lat, row.lon)
        odometer += step
        if gps_speed is None and now > at:
            speed = step / ((now - at) / 3600)
    return (now, row.lat, row.lon, odometer, speed, heading, from_lat, from_lon), (step, odometer, speed, heading)


def alert_step(kept: Kept, row) -> tuple[Kept, str | None]:
    """The next state of a car on a route, and what to say at its fix, if anything."""
    run, arrived, last = kept
    if row.left <= ARRIVED:
        return (run, True, last), None if arrived else "arrived"
    run, now = run + 1 if row.off > OFF_ROUTE else 0, row.fix_at.timestamp()
    if run >= OFF_FIXES and (last is None or now - last > ALERT_SECONDS):
        return (0, arrived, now), "off route"
    return (run, arrived, last), None


def along(df: DataFrame, order: str, new: Kept, step: Callable, out: Callable, schema: str, sort: tuple = ("fix_at", "event_id")) -> DataFrame:
    """``step`` over each car's rows in time order (``sort``).

    A fix depends on all before it, so a car's rows pass through one task; they stream through it in sorted batches
    and only a car's state is held, whatever its number of fixes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        car, kept = object(), new
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                if row.car != car:
                    car, kept = row.car, new
                kept, made = step(kept, row)
                rows += out(row, made)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return df.withColumnRenamed(order, "event_id").repartition("car").sortWithinPartitions("car", *sort).mapInPandas(run, schema).withColumnRenamed("event_id", order)


def tracked_row(row, made: tuple) -> list[tuple]:
    return [(row.car, row.fix_at, row.event_id, row.lat, row.lon, *made)]


def alert_row(row, said: str | None) -> list[tuple]:
    return [(row.car, row.fix_at, row.event_id, said)] if said else []


def with_gps(fixes: DataFrame) -> DataFrame:
    """Fixes with the device's own heading (degrees) and speed (metres a second), null where it states none."""
    return fixes.withColumns({c: F.lit(None).cast("double") for c in ("gps_heading", "gps_speed") if c not in fixes.columns})


def track(fixes: DataFrame, order: str = "event_id") -> DataFrame:
    """car, fix_at, order, lat, lon, step, odometer, speed, heading of positions (car, fix_at, lat, lon, order, gps_heading, gps_speed).

    ``step`` is the distance from the car's fix before. The speed is the device's, else that of the step. The heading is
    the device's own above ``LEAST_SPEED``, else the bearing from the last fix that gave one, once the car is
    ``LEAST_MOVE`` miles from it; null before the first. Fixes without a position are no fixes.
    """
    f = with_gps(fixes).where("lat is not null and lon is not null")
    f = f.select("car", F.col("fix_at").cast("timestamp").alias("fix_at"), order, "lat", "lon", F.col("gps_heading").cast("double"), F.col("gps_speed").cast("double"))
    return along(f, order, NEW_TRACK, track_step, tracked_row, TRACKED)


def route_alerts(located: DataFrame, order: str = "event_id") -> DataFrame:
    """Alerts of located fixes (car, fix_at, order, off, left): the first arrival, and ``OFF_FIXES`` fixes in a row off the route. After
    such an alert the count starts anew and the next comes more than ``ALERT_SECONDS`` later; fixes at the goal don't count."""
    f = located.where("off is not null and left is not null").select("car", F.col("fix_at").cast("timestamp").alias("fix_at"), order, "off", "left")
    return along(f, order, NEW_ALERTS, alert_step, alert_row, ALERTED)


#: What a favourite cuisine and the other extras of a place count.
LOVED, LIKED, ON_NOW, DESCRIBED, LINKED = 2.0, 3.0, 2.0, 0.5, 0.3


def interest(
    df: DataFrame, weights: dict[str, float], levels: dict[str, float], default: float = 1.0, keep_chains: bool = True, chains_off: tuple[str, ...] = (), cuisines: dict[str, float] | None = None,
    hungry: bool = True, food_types: tuple[str, ...] = V.FOOD_KINDS, liked_rescues: bool = True, cuisines_off: tuple[str, ...] = (), muted: DataFrame | None = None,
) -> DataFrame:
    """``df`` with ``score``: weight of its type times the reader's level, and extras for what is known and on. A score of 0 goes.

    Chains go altogether or those of ``chains_off``; places of a name in ``muted`` (name) go. Types of food are nothing to a reader
    who isn't ``hungry``. Food whose whole menu is in ``cuisines_off`` goes (a menu that isn't stated is "none"); of the rest it gets the
    best of the reader's ``cuisines`` on top. A ``liked`` place of a type that counts nothing counts as 1 (``liked_rescues``).
    """
    of = lambda m, k: F.create_map(*(F.lit(x) for pair in m.items() for x in pair))[k] if m else F.lit(None).cast("double")
    food = F.coalesce(F.col("drive_type").isin(*food_types), F.lit(False)) if food_types else F.lit(False)
    base = F.coalesce(of(weights, F.col("drive_type")), F.lit(default)) * F.coalesce(of(levels, F.col("drive_type")), F.lit(1.0))
    base = base if hungry else F.when(food, 0.0).otherwise(base)
    extra = lambda name, n: F.when(F.coalesce(F.col(name).cast("string"), F.lit("")) != "", n).otherwise(0.0) if name in df.columns else F.lit(0.0)
    true = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)
    flag = lambda name, n: F.when(true(name), n).otherwise(0.0)
    stated = F.col("cuisine") if "cuisine" in df.columns else F.array().cast("array<string>")
    menu = F.when(F.coalesce(F.size(stated), F.lit(0)) > 0, stated).otherwise(F.array(F.lit("none")))
    liked = F.coalesce(F.array_max(F.transform(menu, lambda x: F.coalesce(of(cuisines, x), F.lit(0.0)))), F.lit(0.0)) if cuisines else F.lit(0.0)
    if liked_rescues:
        base = F.when((base <= 0) & true("liked"), 1.0).otherwise(base)
    score = F.when(base > 0, base + extra("description", DESCRIBED) + extra("url", LINKED) + flag("liked", LIKED) + flag("loved", LOVED) + flag("on_now", ON_NOW) + F.when(food, liked).otherwise(0.0)).otherwise(0.0)
    out = df if muted is None else df.join(muted.select("name").distinct(), "name", "left_anti")
    if cuisines_off:
        out = out.where(~(food & F.forall(menu, lambda x: x.isin(*cuisines_off))))
    out = out.withColumn("score", score).where("score > 0")
    if not keep_chains:
        return out.where("chain is null")
    return out.where(F.col("chain").isNull() | ~F.col("chain").isin(*chains_off)) if chains_off else out


def look_ahead(speed: Column) -> Column:
    """Miles looked ahead: a quarter of an hour at the car's speed, within reason. No speed counts as ``CRUISE``."""
    return F.least(F.lit(LOOK_MOST), F.greatest(F.lit(LOOK_LEAST), F.coalesce(F.nullif(speed.cast("double"), F.lit(0.0)), F.lit(CRUISE)) * LOOK_HOURS))


def ahead_on_route(positions: DataFrame, located: DataFrame, detour: float = 20.0) -> DataFrame:
    """car, id, ahead, off of places (id, route_id, along, off) ahead of cars (car, route_id, along, speed) on their route.

    Mileage is cut into pieces as long as the farthest look, so a car meets the places of its piece and the next alone.
    """
    piece = lambda c: F.floor(c / LOOK_MOST)
    here = F.col("along")
    p = positions.select("car", F.col("route_id").alias("_route"), here.alias("here"), look_ahead(F.col("speed")).alias("reach"), F.explode(F.array(piece(here), piece(here) + 1)).alias("_piece"))
    places = located.where(F.col("off") <= min(10.0, 0.35 * detour)).select("id", "route_id", "along", "off", piece(F.col("along")).alias("piece"))
    met = places.join(p, (F.col("route_id") == F.col("_route")) & (F.col("piece") == F.col("_piece"))).withColumn("ahead", F.col("along") - F.col("here"))
    return met.where((F.col("ahead") >= 0.5) & (F.col("ahead") <= F.col("reach"))).select("car", "id", "ahead", "off")


#: Cars or places that stand in one array.
CHUNK = 512


def dealt(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys`` and ``told``, an array of up to about ``CHUNK`` values (as structs, which may hold nulls): of a key with more several rows."""
    parts = df.groupBy(*keys).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64(value), F.col("_parts")).alias("_part")
    return df.join(parts, keys).groupBy(*keys, part).agg(F.collect_list(F.struct(value)).alias("told")).drop("_part")


def ahead_by_heading(positions: DataFrame, places: DataFrame, detour: float = 20.0, size: float = 0.125, digits: int | None = None) -> DataFrame:
    """car, id, ahead, off (to ``digits`` decimals) of places in the cone before cars (car, lat, lon, heading, speed).

    A car goes to the cells of the box around its cone. Cars that stand and look alike are one, and so are places in one spot: pairs
    of those are found first, then told to all their cars and places, which meet as arrays: rows for each of them are made last and
    are neither joined nor shuffled.
    """
    ways = ["heading", "speed", "c_lat", "c_lon"]
    cars = positions.where("heading is not null and lat is not null and lon is not null").select("car", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), F.col("heading").cast("double").alias("heading"), F.coalesce(F.col("speed").cast("double"), F.lit(0.0)).alias("speed"))
    reach, least = look_ahead(F.col("speed")), min(10.0, 0.35 * detour)
    wide = least + 0.15 * reach
    hx, hy = geo.heading_vector(F.col("heading"))
    # the corners of a box around the cone, in miles along and across, then in degrees
    ends = lambda along, across: (F.least(F.lit(0.0), along * reach) - F.abs(across) * wide - 1e-6, F.greatest(F.lit(0.0), along * reach) + F.abs(across) * wide + 1e-6)
    (west, east), (south, north) = ends(hx, hy), ends(hy, hx)
    degree = F.greatest(F.lit(1e-6), geo.MILES_PER_DEGREE * F.cos(F.radians("c_lat")))
    lon = lambda x: F.col("c_lon") + F.greatest(F.lit(-180.0), F.least(F.lit(180.0), x / degree))
    lat = lambda y: F.col("c_lat") + y / geo.MILES_PER_DEGREE
    c = cars.select(*ways).distinct().select(*ways, reach.alias("reach"), F.explode(geo.box_cells(lat(south), lat(north), lon(west), lon(east), size)).alias("c")).select(*ways, "reach", "c.cx", "c.cy")
    p = places.where("lat is not null and lon is not null").select("lat", "lon").distinct().select("lat", "lon", *spatial.own_cell(size))
    x, y = geo.planar_xy(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
    met = p.join(c, ["cx", "cy"]).select(*ways, "lat", "lon", "reach", (x * hx + y * hy).alias("ahead"), F.abs(x * hy - y * hx).alias("off"))
    met = met.where((F.col("ahead") >= 0.5) & (F.col("ahead") <= F.col("reach")) & (F.col("off") <= least + 0.15 * F.col("ahead")))
    told = [F.col(n) if digits is None else F.round(n, digits).alias(n) for n in ("ahead", "off")]
    met = met.select(*ways, "lat", "lon", *told)
    met = met.join(dealt(cars, ways, "car").withColumnRenamed("told", "cars"), ways).select("lat", "lon", "ahead", "off", "cars")
    met = met.join(dealt(places.where("lat is not null and lon is not null").select("lat", "lon", "id"), ["lat", "lon"], "id"), ["lat", "lon"])
    return met.select("ahead", "off", "told", F.explode("cars").alias("c")).select("c.car", "ahead", "off", F.explode("told").alias("p")).select("car", "p.id", "ahead", "off")


def shortlist(candidates: DataFrame, k: int = SHORTLIST) -> DataFrame:
    """The ``k`` candidates of each car (car, id, score, ahead, off) whose detours are worth looking up, with ``guess`` (minutes out and
    back at local speed) and ``rank``: most score less the guess first, then nearness, then id."""
    guess = F.col("off") * 2 * 1.3 / 35 * 60
    d = candidates.withColumn("guess", guess).withColumn("_worth", F.col("score") - guess * 0.15)
    w = Window.partitionBy("car").orderBy(F.desc("_worth"), F.asc("ahead"), F.asc("id"))
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_worth")


def detour_minutes(candidates: DataFrame, legs: DataFrame) -> DataFrame:
    """``candidates`` (car, id, here, goal) with the minutes that a stop adds: to it and on, less the direct way, 0 at least; infinite without a leg.

    ``legs`` (origin, target, seconds) is looked up three times by equal keys.
    """
    leg = lambda n: legs.select(F.col("origin").alias(f"{n}_o"), F.col("target").alias(f"{n}_t"), F.col("seconds").alias(n))
    j = candidates.join(leg("to"), (F.col("here") == F.col("to_o")) & (F.col("id") == F.col("to_t")), "left")
    j = j.join(leg("on"), (F.col("id") == F.col("on_o")) & (F.col("goal") == F.col("on_t")), "left")
    j = j.join(leg("direct"), (F.col("here") == F.col("direct_o")) & (F.col("goal") == F.col("direct_t")), "left")
    minutes = (F.col("to") + F.col("on") - F.col("direct")) / 60
    extra = F.when(minutes.isNotNull(), F.greatest(F.lit(0.0), minutes))
    return j.select(*candidates.columns, F.coalesce(extra, F.lit(float("inf"))).alias("detour"))


def worth_stopping(df: DataFrame, most: float = 20.0) -> DataFrame:
    """Candidates (score, detour, minutes_left, food) within the detour that will be open long enough; unknown hours pass. Adds value."""
    need = F.when(F.col("food"), 20).otherwise(30)
    open_ = F.col("minutes_left").isNull() | (F.col("minutes_left") >= need)
    return df.where((F.col("detour") <= most) & open_).withColumn("value", F.col("score") - 0.15 * F.col("detour"))


def rank_ahead(df: DataFrame, k: int = MOST_AHEAD) -> DataFrame:
    """The best ``k`` candidates of each car: value first, then nearness, then id."""
    w = Window.partitionBy("car").orderBy(F.desc("value"), F.asc("ahead"), F.asc("id"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Hours that an event without a stated end lasts, about.
USUAL_HOURS = 2.0


def on_now(listings: DataFrame, now: Column, hidden: DataFrame | None = None) -> DataFrame:
    """One-off events that are on: those of up to 12 hours that begin within the hour or have 15 minutes left, and longer ones of up to
    four days between 10 and 18 o'clock.

    Without a stated end an event lasts ``duration_min`` minutes, if that is a column and stated, else ``USUAL_HOURS``; one that begins at
    midnight and states no end says only that it is some time that day and is left out, like series, events without a
    point, those for kids alone and those ``hidden`` (id).
    """
    start = F.unix_seconds(F.col("start_at").cast("timestamp"))
    usual = F.coalesce(F.col("duration_min").cast("double") * 60, F.lit(USUAL_HOURS * 3600)) if "duration_min" in listings.columns else F.lit(USUAL_HOURS * 3600)
    end, at = F.coalesce(F.unix_seconds(F.col("end_at").cast("timestamp")).cast("double"), start + usual), F.unix_seconds(now.cast("timestamp"))
    vague = F.col("end_at").isNull() & (F.date_format("start_at", "HH:mm") == "00:00")
    kids = F.coalesce(F.col("audience") == "kids", F.lit(False)) if "audience" in listings.columns else F.lit(False)
    once = ~F.coalesce("repeats", F.lit(False)) & F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~kids & ~vague & (end > start)
    short = (end - start <= 12 * 3600) & (start <= at + 3600) & (end >= at + 900)
    long = (end - start > 12 * 3600) & (end - start <= 4 * 86400) & (start <= at) & (end >= at) & F.hour(now).between(10, 17)
    out = listings.where(once & (short | long))
    return out if hidden is None else out.join(hidden.select("id").distinct(), "id", "left_anti")


def candidate_pool(places: DataFrame, events: DataFrame) -> DataFrame:
    """Places with the event on at them (by lower-cased name; the last place of a name), and events without a place as candidates."""
    e = events.groupBy(F.lower("venue_key").alias("v")).agg(F.min(F.struct("start_at", "id", "title", "lat", "lon")).alias("e"))
    hosts = places.groupBy(F.lower("name").alias("n")).agg(F.max("id").alias("host"))
    at = hosts.join(e, F.col("n") == F.col("v")).select("host", F.col("e.id").alias("event_id"), F.col("e.title").alias("event_title"))
    mine = places.join(at, F.col("id") == F.col("host"), "left").select("id", "name", "lat", "lon", "event_id", "event_title")
    alone = e.join(hosts, F.col("v") == F.col("n"), "left_anti").select(F.col("e.id").alias("id"), F.col("e.title").alias("name"), F.col("e.lat").alias("lat"), F.col("e.lon").alias("lon"), F.col("e.id").alias("event_id"), F.col("e.title").alias("event_title"))
    return mine.unionByName(alone)


MOVES = "car long, tick long, id string, move string"
#: A car's deck without stops at the start.
NEW_DECK: Kept = ((), 0.0)
#: Positions of a tick go before its candidates, better candidates before others.
DECK_ORDER, DECK_ASCENDING = ["tick", "kind", "value", "id"], [True, True, False, True]


def deck_step(k: int, margin: float, far: float) -> Callable:
    """The next deck of a car and its moves (id, move) at a row of ``deck_events``.

    A position passes the stops whose place the odometer has reached; they leave the deck. A candidate enters while there
    are fewer than ``k``; a full deck takes it only for its weakest stop still more than ``far`` miles ahead, if better by more
    than ``margin``.
    """

    def step(kept: Kept, row) -> tuple[Kept, list[tuple[str, str]]]:
        held, odometer = kept
        if row.kind == 0:
            odometer = max(odometer, row.odometer)
            passed = sorted(h[0] for h in held if h[2] <= odometer)
            return (tuple(h for h in held if h[2] > odometer), odometer), [(i, "passed") for i in passed]
        if row.ahead <= 0 or any(h[0] == row.id for h in held):
            return kept, []
        new = (row.id, row.value, odometer + row.ahead)
        if len(held) < k:
            return ((*held, new), odometer), [(row.id, "in")]
        weakest = min(((h[1], h[0]) for h in held if h[2] - odometer > far), default=None)
        if weakest is None or row.value <= weakest[0] + margin:
            return kept, []
        return (tuple(h for h in held if h[0] != weakest[1]) + (new,), odometer), [(weakest[1], "out"), (row.id, "in")]

    return step


def deck_events(candidates: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """car, tick, kind, odometer, id, value, ahead: positions (kind 0) and candidates (1) as rows of one table."""
    none = lambda t: F.lit(None).cast(t)
    c = candidates.select("car", F.col("tick").cast("long").alias("tick"), F.lit(1).alias("kind"), none("double").alias("odometer"), "id", F.col("value").cast("double").alias("value"), F.col("ahead").cast("double").alias("ahead")).where("value is not null and ahead is not null")
    if positions is None:
        return c
    p = positions.select("car", F.col("tick").cast("long").alias("tick"), F.lit(0).alias("kind"), F.col("odometer").cast("double").alias("odometer"), none("string").alias("id"), none("double").alias("value"), none("double").alias("ahead"))
    return p.where("odometer is not null").union(c)


def deck_moves(candidates: DataFrame, positions: DataFrame | None = None, k: int = MOST_AHEAD, margin: float = 1.0, far: float = 7.0) -> DataFrame:
    """car, tick, id, move (in, out, passed): what enters and leaves each car's deck of at most ``k`` stops, see ``deck_step``."""
    e = deck_events(candidates, positions).withColumn("_row", F.lit(0))
    out = lambda row, moves: [(row.car, row.tick, *m) for m in moves]
    return along(e, "_row", NEW_DECK, deck_step(k, margin, far), out, MOVES, ("tick", "kind", F.desc("value"), "id"))


#: Miles of a route whose samples are one window.
STRETCH_MILES = 500.0


def town_lines(samples: DataFrame, most: float = 2.0) -> DataFrame:
    """route_id, at, town: where adjacent samples (route_id, at, town) up to ``most`` miles apart change town. Samples without a town are none.

    Neighbours are found by stretches of the route, then across them, so a long route is many tasks.
    """
    s = samples.where("town is not null").select("route_id", "at", "town", F.floor(F.col("at") / STRETCH_MILES).alias("b"))
    own, by_stretch = Window.partitionBy("route_id", "b").orderBy("at"), Window.partitionBy("route_id").orderBy("b")
    tails = s.groupBy("route_id", "b").agg(F.max(F.struct("at", "town")).alias("t")).select("route_id", "b", F.lag("t").over(by_stretch).alias("tail"))
    s = s.withColumn("before", F.lag(F.struct("at", "town")).over(own)).join(tails, ["route_id", "b"]).withColumn("before", F.coalesce("before", "tail"))
    changed = (F.col("town") != F.col("before.town")) & (F.col("at") - F.col("before.at") <= most)
    return s.where(changed).select("route_id", ((F.col("at") + F.col("before.at")) / 2).alias("at"), "town")


#: Miles behind and ahead of its last place that a car is sought first, and miles off the route within which that counts.
BEHIND, AHEAD, NEAR_ROUTE = 3.0, 15.0, 1.0
FOLLOWED = "car long, fix_at timestamp, event_id long, route_id long, along double, off double"
#: Shares of a route's cars; each has the route's segments beside it.
SHARES = 16


def near_place(pieces: tuple, lat: float, lon: float, hint: float) -> tuple[float, float] | None:
    """off and along of the nearest segment, the first of equals, within ``NEAR_ROUTE`` and of the miles around ``hint``.

    ``pieces`` are the columns of a route's segments in order: lat0, lon0, cosine of lat0, miles east and north of its end, cum0, cum1.
    """
    lat0, lon0, cosine, east, north, cum0, cum1 = pieces
    best = None
    for i in range(bisect_left(cum1, hint - BEHIND - spatial.SLACK), len(cum1)):
        if cum0[i] > hint + AHEAD + spatial.SLACK:
            break
        if cum1[i] < hint - BEHIND or cum0[i] > hint + AHEAD:
            continue
        turn, sx, sy = lon - lon0[i], east[i], north[i]
        turn = turn - 360.0 if turn > 180.0 else turn + 360.0 if turn < -180.0 else turn
        px, py, l2 = turn * geo.MILES_PER_DEGREE * cosine[i], (lat - lat0[i]) * geo.MILES_PER_DEGREE, sx * sx + sy * sy
        t = max(0.0, min(1.0, (px * sx + py * sy) / l2)) if l2 > 0 else 0.0
        dx, dy = px - t * sx, py - t * sy
        off = math.sqrt(dx * dx + dy * dy)
        if off <= NEAR_ROUTE and (best is None or off < best[0]):
            best = (off, cum0[i] + t * (cum1[i] - cum0[i]))
    return best


def nearest_place(pieces: tuple, lat: float, lon: float) -> tuple[float, float] | None:
    """off and along of the nearest of all segments, the first of equals; ``pieces`` as in ``near_place``, as numpy columns."""
    lat0, lon0, cosine, east, north, cum0, cum1 = pieces
    turn = lon - lon0
    turn = np.where(turn > 180.0, turn - 360.0, np.where(turn < -180.0, turn + 360.0, turn))
    px, py, l2 = turn * geo.MILES_PER_DEGREE * cosine, (lat - lat0) * geo.MILES_PER_DEGREE, east * east + north * north
    t = np.clip(np.divide(px * east + py * north, l2, out=np.zeros_like(l2), where=l2 > 0), 0.0, 1.0)
    dx, dy = px - t * east, py - t * north
    off = np.sqrt(dx * dx + dy * dy)
    off[np.isnan(off)] = np.inf
    i = int(off.argmin())
    return (float(off[i]), float(cum0[i] + t[i] * (cum1[i] - cum0[i]))) if off[i] < np.inf else None


def followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places of fixes: of each share of a route its segments come first, then its fixes car by car in order."""
    share, car, hint, pieces, whole = None, None, None, (), ()
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            if (row.route_id, row.share) != share:
                share, car, pieces, whole = (row.route_id, row.share), None, tuple(array("d") for _ in range(7)), ()
            if row.kind == 0:
                for column, value in zip(pieces, (row.lat, row.lon, row.cosine, row.east, row.north, row.cum0, row.cum1)):
                    column.append(value)
                continue
            if car != row.car or not row.again:
                car, hint = row.car, None
            place = near_place(pieces, row.lat, row.lon, hint) if hint is not None else None
            if place is None:
                whole = whole or tuple(np.frombuffer(column) for column in pieces)
                place = nearest_place(whole, row.lat, row.lon)
            if place is not None:
                off, hint = place
                rows.append((row.car, row.fix_at, row.event_id, row.route_id, hint, off))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOLLOWED.split(", ")])


def follow_route(fixes: DataFrame, segments: DataFrame, order: str = "event_id") -> DataFrame:
    """car, fix_at, order, route_id, along, off of fixes (car, route_id, fix_at, order, lat, lon) on their cars' routes.

    A route that crosses itself or doubles back doesn't make a car jump: the next fix is sought from ``BEHIND`` miles behind
    to ``AHEAD`` miles ahead of the last place, and on the whole route only if that window has nothing within ``NEAR_ROUTE``
    miles. Both are looked at car by car, in the route's segments in order: 56 bytes each, of one route at a time. A fix
    that is found in its window costs what the window has, and one that isn't a pass of numpy over the route's columns.
    A fix without a position, or whose route has no segment, isn't followed.
    """
    f = fixes.where("lat is not null and lon is not null and route_id is not null").join(segments.select("route_id").distinct(), "route_id", "left_semi")
    f = f.select("car", "route_id", F.col("fix_at").cast("timestamp").alias("fix_at"), F.col(order).alias("event_id"), "lat", "lon")
    before = F.lag("route_id").over(Window.partitionBy("car").orderBy("fix_at", "event_id"))
    f = f.withColumn("again", F.coalesce(before == F.col("route_id"), F.lit(False))).withColumn("share", F.pmod(F.xxhash64("car"), F.lit(SHARES)).cast("int"))
    east, north = geo.planar_xy(F.col("lat1"), F.col("lon1"), F.col("lat0"), F.col("lon0"))
    s = segments.join(f.select("route_id", "share").distinct(), "route_id")
    none = F.lit(0.0)
    s = s.select("route_id", "share", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("car"), F.lit(None).cast("timestamp").alias("fix_at"), F.col("seq").cast("long").alias("event_id"), F.lit(False).alias("again"), F.col("lat0").alias("lat"), F.col("lon0").alias("lon"), F.cos(F.radians("lat0")).alias("cosine"), east.alias("east"), north.alias("north"), "cum0", "cum1")
    f = f.select("route_id", "share", F.lit(1).alias("kind"), "car", "fix_at", "event_id", "again", "lat", "lon", *(none.alias(c) for c in ("cosine", "east", "north", "cum0", "cum1")))
    rows = s.union(f).repartition("route_id", "share").sortWithinPartitions("route_id", "share", "kind", "car", "fix_at", "event_id")
    return rows.mapInPandas(followed, FOLLOWED).withColumnRenamed("event_id", order)


def progress(followed: DataFrame, segments: DataFrame) -> DataFrame:
    """``followed`` with ``left``, the miles to the end of the route, as ``route_alerts`` takes it."""
    ends = segments.groupBy("route_id").agg(F.max("cum1").alias("_length"))
    return followed.join(ends, "route_id").withColumn("left", F.col("_length") - F.col("along")).drop("_length")
