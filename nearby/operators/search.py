"""Reader's search over live listings and places: filters, facets, order, day plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearby.functions import geo, vocab as V
from nearby.functions.classify import is_free, price_known
from nearby.functions.text import haystack, normalise_city


@dataclass(frozen=True)
class Query:
    """What a reader asks. Unknown is not no: unpriced and unplaced listings pass the cap and the radius."""

    families: bool = True
    seniors: bool = True
    adults: bool = True
    repeats: str = "any"  # any, once, or a cadence
    show_hidden: bool = False
    venue: str | None = None
    food: bool = False
    outdoor: bool = False
    interested: bool = False
    time_of_day: str | None = None
    free: bool = False
    signup: bool = False
    price_cap: float | None = None
    radius: float | None = None
    horizon: int | str | None = None  # days, "weekend", or None for all
    text: str | None = None

    @classmethod
    def open(cls, venue: str) -> Query:
        """All that is on at one place."""
        return cls(venue=venue, show_hidden=True)

    @classmethod
    def free_tonight(cls) -> Query:
        return cls(horizon=0, time_of_day="nighttime", free=True, radius=25)

    def but(self, **changes: object) -> Query:
        return replace(self, **changes)


def weekend(today: Column) -> tuple[Column, Column]:
    """The coming Friday to Sunday; from within, what is left of it (Sunday: that day only)."""
    dow = F.dayofweek(today)  # 1 is Sunday
    start = F.when(dow.isin(1, 6, 7), today).otherwise(F.date_add(today, F.lit(6) - dow))
    end = F.when(dow == 1, today).when(dow == 7, F.date_add(today, 1)).otherwise(F.date_add(today, F.lit(8) - dow))
    return start, end


def in_horizon(horizon: int | str | None, today: Column, day: Column, end: Column) -> Column:
    if horizon is None:
        return F.lit(True)
    if horizon == "weekend":
        a, b = weekend(today)
        return (day <= b) & (F.coalesce(F.to_date(end), day) >= a)
    return F.datediff(day, today).between(0, horizon)


def search_listings(live: DataFrame, q: Query, now: Column, decisions: DataFrame | None = None, muted: DataFrame | None = None, interested: DataFrame | None = None) -> DataFrame:
    """Listings of ``live`` (see ``recur.live_listings``) that answer a query.

    ``decisions`` (id, verdict), ``muted`` (venue_key) and ``interested`` (venue_key) are the reader's
    lists; they are semi and anti joins, so Spark may broadcast or shuffle them by their size.
    """
    c = F.col
    keep = F.lit(True)
    for name, shown in (("family", q.families), ("seniors", q.seniors), ("adults", q.adults)):
        if not shown:
            keep = keep & ~F.coalesce(c("audience") == name, F.lit(False))
    if q.repeats == "once":
        keep = keep & ~F.coalesce(c("repeats"), F.lit(False))
    elif q.repeats != "any":
        keep = keep & (c("cadence") == q.repeats)
    if q.venue is not None:
        keep = keep & (c("venue_key") == q.venue)
    if q.food:
        keep = keep & c("has_food")
    if q.outdoor:
        keep = keep & (c("setting") == "outdoor")
    if q.time_of_day:
        keep = keep & (c("time_of_day") == q.time_of_day)
    if q.free:
        keep = keep & is_free(c("price_min"))
    if q.signup:
        keep = keep & c("signup_required")
    if q.price_cap is not None:
        keep = keep & (~price_known(c("price_min")) | (c("price_min") <= q.price_cap))
    if q.radius is not None:
        keep = keep & (c("miles").isNull() | (c("miles") <= q.radius))
    if q.text:
        fields = [c(x) for x in ("title", "venue", "venue_key", "city", "address", "description") if x in live.columns]
        keep = keep & haystack(*fields).contains(q.text.lower())
    out = live.where(keep & in_horizon(q.horizon, F.to_date(now), c("day"), c("end_at")))
    if decisions is not None:
        gone = decisions.where(c("verdict").isin(*(["saved"] if q.show_hidden else ["saved", "hidden"]))).select("id")
        out = out.join(gone, "id", "left_anti")
    if muted is not None and q.venue is None:
        out = out.join(muted.select("venue_key"), "venue_key", "left_anti")
    if q.interested and interested is not None:
        out = out.join(interested.select("venue_key"), "venue_key", "left_semi")
    return out


def type_filter(df: DataFrame, include: list[str], exclude: list[str], types: str = "types") -> DataFrame:
    """Any of ``include`` and none of ``exclude``; excluding wins."""
    some = lambda xs: F.arrays_overlap(types, F.array(*map(F.lit, xs)))
    if exclude:
        df = df.where(~some(exclude))
    return df.where(some(include)) if include else df


def type_facets(df: DataFrame, types: str = "types") -> DataFrame:
    """Listings of each type, counted before the type filter."""
    return df.select(F.explode(types).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


def when_key(all_day: Column, at: Column) -> Column:
    """A time to sort by; untimed listings come last in their day."""
    return F.when(all_day, F.to_date(at).cast("timestamp") + F.expr("interval 86399 seconds")).otherwise(at.cast("timestamp"))


def order_keys(by: str) -> list[Column]:
    when = when_key(F.col("all_day"), F.col("next_at"))
    if by == "nearest":
        return [F.col("miles").asc_nulls_last(), when.asc(), F.col("id").asc()]
    if by == "cheapest":
        return [F.col("price_min").asc_nulls_last(), when.asc(), F.col("id").asc()]
    return [F.col("day").asc(), when.asc(), F.col("miles").asc_nulls_last(), F.col("id").asc()]


def sort_listings(df: DataFrame, by: str = "soonest") -> DataFrame:
    return df.orderBy(*order_keys(by))


def page(df: DataFrame, by: str = "soonest", number: int = 0, size: int = 40) -> DataFrame:
    """One page of an order (top-k, no full sort)."""
    return df.orderBy(*order_keys(by)).offset(number * size).limit(size)


#: Seconds of a stretch of the day plan.
STRETCH = 900


def day_plan(df: DataFrame) -> DataFrame:
    """``df`` with how many listings its day has and the listing's place in it.

    Days are counted by stretches of time; a listing's place is what comes before its stretch and its place within it, so
    a busy day is many tasks.
    """
    d = df.withColumn("_stretch", F.floor(F.unix_seconds(when_key(F.col("all_day"), F.col("next_at"))) / STRETCH))
    by_time = Window.partitionBy("day").orderBy(F.col("_stretch").asc())
    counts = d.groupBy("day", "_stretch").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(by_time.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).withColumn("day_count", F.sum("_n").over(Window.partitionBy("day")))
    counts = counts.select(F.col("day").alias("_day"), F.col("_stretch").alias("_at"), "_before", "day_count")
    place = F.row_number().over(Window.partitionBy("day", "_stretch").orderBy(*order_keys("soonest")[1:]))
    met = d.withColumn("_place", place).join(counts, F.col("day").eqNullSafe(F.col("_day")) & F.col("_stretch").eqNullSafe(F.col("_at")))
    return met.withColumn("day_pos", F.col("_before") + F.col("_place")).drop("_stretch", "_before", "_place", "_day", "_at")


def saved(listings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Saved listings, soonest first."""
    return sort_listings(listings.join(decisions.where("verdict = 'saved'").select("id"), "id", "left_semi"))


def liked_places(places: DataFrame, liked: DataFrame, by: str = "distance") -> DataFrame:
    """Places whose name the reader likes (name), in an order of ``sort_places``."""
    return sort_places(places.join(liked.select("name"), "name", "left_semi"), by)


def place_keys(by: str = "distance") -> list[Column]:
    far, name = F.col("miles").asc_nulls_last(), [F.col("name").asc(), F.col("id").asc()]
    return {"name": name, "events": [F.col("events").desc_nulls_last(), far, *name]}.get(by, [far, *name])


def sort_places(places: DataFrame, by: str = "distance") -> DataFrame:
    """Places by distance, name or events; unknown distances last, names break ties."""
    return places.orderBy(*place_keys(by))


def programme(listings: DataFrame, decisions: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` listings of each venue that aren't hidden, in time order."""
    shown = listings.join(decisions.where("verdict = 'hidden'").select("id"), "id", "left_anti")
    w = Window.partitionBy("venue_key").orderBy("next_at", "id")
    return shown.where("venue_key is not null").withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


@dataclass(frozen=True)
class PlaceQuery:
    scope: str = "all"  # visit, eat, all
    with_events: bool = False
    independents: bool = False
    open_now: bool = False
    text: str | None = None


def search_places(places: DataFrame, q: PlaceQuery, saved_ids: DataFrame | None = None) -> DataFrame:
    """Places that answer a query. Unknown hours are not open; a brand is not independent.

    The text is sought in the name, the town, and the labels of the kind and of each cuisine, one by one. Among places to visit the food
    filters rest: hours and brands aren't asked there.
    """
    food = F.col("kind").isin(*V.FOOD_KINDS)
    keep = {"visit": ~food, "eat": food}.get(q.scope, F.lit(True))
    if q.with_events:
        keep = keep & (F.coalesce("events", F.lit(0)) > 0)
    if q.independents and q.scope != "visit":
        keep = keep & F.col("brand").isNull()
    if q.open_now and q.scope != "visit":
        keep = keep & (F.coalesce("minutes_left", F.lit(-1.0)) > 0)
    if q.text and q.text.strip():
        labels = lambda pairs: F.create_map(*(F.lit(x) for pair in pairs for x in pair))
        said = F.array(F.col("name"), F.col("city"), labels(V.PLACE_KINDS)[F.col("kind")])
        if "cuisine" in places.columns:
            said = F.concat(said, F.coalesce(F.transform("cuisine", lambda c: F.coalesce(labels(V.CUISINES)[c], c)), F.array().cast("array<string>")))
        keep = keep & F.exists(said, lambda x: F.coalesce(F.lower(x).contains(q.text.strip().lower()), F.lit(False)))
    out = places.where(keep)
    return out if saved_ids is None else out.join(saved_ids.select("id"), "id", "left_semi")


def place_facets(places: DataFrame) -> DataFrame:
    """kind, label, n in the vocabulary's order; kinds outside it are ``other`` and last."""
    kinds = [k for k, _ in V.PLACE_KINDS]
    labels = F.create_map(*(F.lit(x) for pair in V.PLACE_KINDS for x in pair))
    kind = F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise("other")
    n = places.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    at = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    return n.select("kind", F.coalesce(labels[F.col("kind")], F.lit("Other")).alias("label"), "n", F.when(at > 0, at).otherwise(len(kinds) + 1).cast("int").alias("pos"))


def cuisine_facets(places: DataFrame) -> DataFrame:
    """cuisine, n, pos in the vocabulary's order (others last); the row without a cuisine counts the places that state one."""
    named = [c for c, _ in V.CUISINES]
    each = places.select(F.explode(F.array_distinct("cuisine")).alias("cuisine")).groupBy("cuisine").agg(F.count("*").alias("n"))
    total = places.where(F.size("cuisine") > 0).agg(F.lit(None).cast("string").alias("cuisine"), F.count("*").alias("n"))
    at = F.array_position(F.array(*map(F.lit, named)), F.col("cuisine"))
    return each.union(total).select("cuisine", "n", F.when(F.col("cuisine").isNull(), 0).when(at > 0, at).otherwise(len(named) + 1).cast("int").alias("pos"))


def preset_towns(places: DataFrame, regions: DataFrame | None = None, origin: tuple[float, float] | None = None, slots: int = 8, region_slots: int = 3, apart: float = 12.0) -> DataFrame:
    """Presets of a reader's map: town, n, lat, lon, pos.

    Up to ``region_slots`` regions (name, lat, lon) come first, the nearest to the reader where ``origin`` is known; then
    the busiest towns (by name without asides) that are no preset yet and at least ``apart`` miles from all so far. With an
    origin the presets are ordered by distance. Counting is distributed; each of the at most ``slots`` choices looks at all
    towns that are left and takes one row.
    """
    away = lambda lat, lon, p: geo.haversine_miles(F.lit(p[0]), F.lit(p[1]), lat, lon)
    chosen: list[tuple] = []
    if regions is not None:
        r = regions.select(normalise_city(F.col("name")).alias("town"), "lat", "lon")
        order = [away(F.col("lat"), F.col("lon"), origin), F.col("town")] if origin else [F.col("town")]
        chosen = [(x["town"], None, x["lat"], x["lon"]) for x in r.orderBy(*order).limit(region_slots).collect()]
    located = places.select(normalise_city(F.col("city")).alias("town"), "lat", "lon").where("town is not null and town <> '?' and lat is not null and lon is not null")
    towns = located.groupBy("town").agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).checkpoint()
    while len(chosen) < slots:
        left = towns
        for town, _, lat, lon in chosen:
            left = left.where((F.col("town") != town) & (away(F.col("lat"), F.col("lon"), (lat, lon)) >= apart))
        best = left.orderBy(F.desc("n"), "town").limit(1).collect()
        if not best:
            break
        chosen.append(tuple(best[0]))
    out = places.sparkSession.createDataFrame([(*c, i + 1) for i, c in enumerate(chosen)], "town string, n long, lat double, lon double, pos int")
    if origin is None:
        return out
    near = Window.orderBy(away(F.col("lat"), F.col("lon"), origin), "pos")  # of at most ``slots`` rows
    return out.withColumn("pos", F.row_number().over(near))
