"""Recurring schedules: patterns inferred from dates, next occurrences, expansion to dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearby.functions.text import norm_title

STEP_DAYS = {"daily": 1, "weekday": 1, "weekly": 7, "fortnightly": 14}
#: Occurrences looked at when skipped days are passed over, and those at most that fall on one day: a Saturday's and a Sunday's
#: move to Monday's.
MOST_STEPS, OF_A_DAY = 400, 3
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def step_days(cadence: Column) -> Column:
    """Days between occurrences; null for cadences without a step of days."""
    out = F.lit(None).cast("int")
    for name, days in STEP_DAYS.items():
        out = F.when(cadence == name, days).otherwise(out)
    return out


def on_weekday(at: Column) -> Column:
    """The same hour of the next working day, if it is a weekend."""
    return F.when(F.dayofweek(at) == 7, plus_days(at, F.lit(2))).when(F.dayofweek(at) == 1, plus_days(at, F.lit(1))).otherwise(at)


def plus_days(at: Column, days: Column) -> Column:
    return at + F.make_dt_interval(days.cast("int"))


def plus_months(at: Column, months: Column) -> Column:
    """Months on from the first date; the last day of a shorter month stands for days it lacks."""
    return at + F.make_ym_interval(F.lit(0), months.cast("int"))


def nth_after(start: Column, cadence: Column, now: Column, n: Column) -> Column:
    """The occurrence ``n`` steps after the first one at or after ``now``; null without a step."""
    step = step_days(cadence)
    behind = F.greatest(F.lit(0.0), F.ceil((F.unix_micros(now.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 86_400_000_000 / step))
    by_days = plus_days(start, (behind + n) * step)
    k = F.greatest(F.lit(0.0), F.floor(F.months_between(now, start, False)))
    k = F.when(plus_months(start, k) >= now, k).otherwise(k + 1)
    return F.when(cadence == "monthly", plus_months(start, k + n)).when(cadence == "weekday", on_weekday(by_days)).when(step.isNotNull(), by_days)


def next_occurrence(start: Column, repeats: Column, cadence: Column, now: Column) -> Column:
    """The first occurrence at or after ``now``; what doesn't repeat by a named step stands on its start."""
    moves = F.coalesce(repeats, F.lit(False)) & (start < now)
    return F.when(moves, F.coalesce(nth_after(start, cadence, now, F.lit(0)), start)).otherwise(start)


def is_all_day(start: Column, end: Column) -> Column:
    """Midnight without an end: a day, not an hour."""
    return end.isNull() & (F.date_format(start, "HH:mm") == "00:00")


def live_listings(listings: DataFrame, now: Column, skips: DataFrame | None = None) -> DataFrame:
    """Listings that are still to come or on, with next_at, day, ongoing, underway, all_day.

    ``skips`` (id, day) are days waved off; a listing moves on to its first occurrence on another day,
    at most ``MOST_STEPS`` steps; no more are made than its days could wave off, and one. A series past
    ``until_at`` is over; a run lasts until its end, an all-day listing until its day's end, a timed one until its start.
    """
    df = listings.withColumn("next_at", next_occurrence(F.col("start_at"), F.col("repeats"), F.col("cadence"), now))
    if skips is not None:
        waved = skips.groupBy(F.col("id").alias("s_id")).agg(F.collect_set("day").alias("waved"))
        df = df.join(waved, F.col("id") == F.col("s_id"), "left")
        steps = F.least(F.lit(MOST_STEPS), F.size("waved") * OF_A_DAY + 1)
        later = F.transform(F.sequence(F.lit(1), steps), lambda n: nth_after(F.col("start_at"), F.col("cadence"), F.greatest(now, F.col("start_at")), n))
        free = F.get(F.filter(later, lambda t: t.isNotNull() & ~F.array_contains(F.col("waved"), F.to_date(t))), 0)
        hit = F.col("waved").isNotNull() & F.array_contains(F.col("waved"), F.to_date("next_at"))
        df = df.withColumn("next_at", F.when(~F.coalesce(hit, F.lit(False)), F.col("next_at")).when(F.coalesce("repeats", F.lit(False)), free)).where("next_at is not null").drop("s_id", "waved")
    today = F.to_date(now)
    ends, once = F.col("end_at").isNotNull(), ~F.coalesce("repeats", F.lit(False))
    ongoing = F.coalesce(ends & (F.to_date("next_at") < today) & (F.to_date("end_at") >= today), F.lit(False))
    all_day = is_all_day(F.col("start_at"), F.col("end_at"))
    over = F.coalesce(F.col("next_at") > F.col("until_at"), F.lit(False))
    alive = F.when(over, False).when(ends & once, F.col("end_at") >= now).when(ongoing, True).when(all_day, F.to_date("next_at") >= today).otherwise(F.col("next_at") >= now)
    underway = F.coalesce(ends & (F.col("next_at") <= now) & (F.col("end_at") >= now), F.lit(False))
    return df.withColumn("ongoing", ongoing).withColumn("underway", underway).withColumn("all_day", all_day).withColumn("day", F.when(ongoing, today).otherwise(F.to_date("next_at"))).where(alive)


def expand_occurrences(listings: DataFrame, d0: Column, d1: Column) -> DataFrame:
    """One row for each occurrence of each listing from day ``d0`` to day ``d1``: ``listings`` with occurs_at."""
    step = step_days(F.col("cadence"))
    moves = F.coalesce("repeats", F.lit(False)) & (step.isNotNull() | (F.col("cadence") == "monthly"))
    first, last = F.to_date("start_at"), F.least(d1, F.coalesce(F.to_date("until_at"), d1))
    k0 = F.greatest(F.lit(0), F.ceil(F.datediff(d0, first) / step)).cast("int")
    k1 = F.floor(F.datediff(last, first) / step).cast("int")
    m0, m1 = F.greatest(F.lit(0), F.floor(F.months_between(d0, first)) - 1).cast("int"), (F.floor(F.months_between(last, first)) + 1).cast("int")
    steps = lambda a, b: F.when(b >= a, F.sequence(a, F.greatest(a, b)))
    days = F.transform(steps(k0, k1), lambda k: plus_days(F.col("start_at"), k * step))
    days = F.when(F.col("cadence") == "weekday", F.filter(days, lambda t: ~F.dayofweek(t).isin(1, 7))).otherwise(days)
    months = F.transform(steps(m0, m1), lambda k: plus_months(F.col("start_at"), k))
    at = F.when(~moves, F.array("start_at")).when(F.col("cadence") == "monthly", months).otherwise(days)
    out = listings.withColumn("occurs_at", F.explode(at))
    return out.where(F.to_date("occurs_at").between(d0, d1) & (~moves | F.to_date("occurs_at").between(first, last)))


def infer_cadence(df: DataFrame, keys: list[str], ts: str = "start_at") -> DataFrame:
    """``keys`` with pattern, n_days, first_day, last_day of the distinct days of each key; pattern is null if they have none.

    Gaps come from windows over distinct days; what is left of a key is one row.
    """
    days = df.where(F.col(ts).isNotNull()).select(*keys, F.to_date(ts).alias("day")).distinct()
    w, v = Window.partitionBy(*keys).orderBy("day"), Window.partitionBy(*keys, F.weekday("day")).orderBy("day")
    days = days.withColumn("gap", F.datediff("day", F.lag("day").over(w))).withColumn("wgap", F.datediff("day", F.lag("day").over(v))).withColumn("wd", F.weekday("day"))
    by_weekday = days.groupBy(*keys, "wd").agg(F.count("*").alias("n"), F.max("wgap").alias("most"), F.min("day").alias("d0"), F.max("day").alias("d1"), F.min("gap").alias("g0"), F.max("gap").alias("g1"))
    regular = (F.col("n") >= 2) & (F.col("most") <= 21)  # days of one weekday are whole weeks apart
    x = by_weekday.groupBy(*keys).agg(
        F.sum("n").alias("n_days"), F.min("d0").alias("first_day"), F.max("d1").alias("last_day"), F.min("g0").alias("g0"), F.max("g1").alias("g1"),
        F.bool_and(regular).alias("weekly"), F.sort_array(F.collect_set("wd")).alias("wds"),
    )
    span, n = F.datediff("last_day", "first_day") + 1, F.col("n_days")
    names = F.transform("wds", lambda d: F.get(F.array(*map(F.lit, WEEKDAYS)), d))
    few = F.size("wds")
    pattern = (
        F.when(n < 3, None)
        .when((span >= 4) & (n >= span * 0.8), "Every day")
        .when(F.col("weekly") & (F.col("wds") == F.array(*map(F.lit, range(5)))), "Every weekday")
        .when(F.col("weekly") & (few == 1) & (F.col("g0") == 14) & (F.col("g1") == 14), F.concat(F.lit("Every other "), F.get(names, 0)))
        .when(F.col("weekly") & (few <= 3), F.concat(F.lit("Every "), join_and(names)))
        .when((F.col("g0") >= 26) & (F.col("g1") <= 32), "Every month")
        .when((F.col("g0") >= 12) & (F.col("g1") <= 16), "Every other week")
    )
    return x.select(*keys, pattern.alias("pattern"), "n_days", "first_day", "last_day")


def join_and(names: Column) -> Column:
    """"A", "A & B", "A, B & C"."""
    head = F.array_join(F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(1))), ", ")
    return F.when(F.size(names) < 2, F.get(names, 0)).otherwise(F.concat(head, F.lit(" & "), F.get(names, F.size(names) - 1)))


def recurrence_text(pattern: Column, n: Column, last: Column) -> Column:
    return F.concat(F.coalesce(pattern, F.concat(n.cast("string"), F.lit(" dates"))), F.lit(", through "), F.date_format(last, "MMM d"))


def collapse_repeats(listings: DataFrame, threshold: int = 3, order: str = "id") -> DataFrame:
    """At least ``threshold`` listings of one source, title and latitude become the first of them, repeating until the last.

    Adds repeats, recurrence, until_at. Groups are counted by a map-side combined aggregate; only the
    first row of a group is carried whole (``min_by``), so a hot group is never held in one place.
    """
    keyed = listings.withColumn("k_title", norm_title(F.col("title"))).withColumn("k_lat", F.round("lat", 2))
    keys = ["source", "k_title", "k_lat"]
    whole = F.struct(*listings.columns)
    groups = keyed.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by(whole, F.struct("start_at", order)).alias("first"), F.max("start_at").alias("last"))
    patterns = infer_cadence(keyed, keys)
    same = [groups[k].eqNullSafe(patterns[k]) for k in keys]
    many = groups.where(F.col("n") >= threshold).join(patterns, same[0] & same[1] & same[2], "left")
    ended = [c for c in listings.columns if c not in ("end_at", "repeats", "recurrence", "until_at")]
    series = many.select(*(F.col(f"first.{c}").alias(c) for c in ended), F.lit(None).cast("timestamp").alias("end_at"), F.lit(True).alias("repeats"), recurrence_text(F.col("pattern"), F.col("n"), F.col("last")).alias("recurrence"), F.col("last").cast("timestamp").alias("until_at"))
    rare = groups.where(F.col("n") < threshold).select(*(F.col(k).alias(f"_{k}") for k in keys))
    single = keyed.join(rare, keyed["source"].eqNullSafe(rare["_source"]) & keyed["k_title"].eqNullSafe(rare["_k_title"]) & keyed["k_lat"].eqNullSafe(rare["_k_lat"]), "left_semi")
    have = lambda c, kind: F.col(c).cast(kind) if c in listings.columns else F.lit(None).cast(kind)
    single = single.select(*ended, have("end_at", "timestamp").alias("end_at"), F.coalesce(have("repeats", "boolean"), F.lit(False)).alias("repeats"), have("recurrence", "string").alias("recurrence"), have("until_at", "timestamp").alias("until_at"))
    return series.unionByName(single)
