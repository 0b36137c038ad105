"""Opening hours: texts to weekly intervals, and what is open at an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS = ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su")
_DAY = "(?:" + "|".join(DAYS) + ")"
_RANGE = rf"{_DAY}(?:\s*-\s*{_DAY})?"
DAY_LIST = rf"{_RANGE}(?:\s*,\s*{_RANGE})*"
_SPAN = r"\d{1,2}:\d{2}\s*-\s*\d{1,2}:\d{2}"
SPANS = rf"{_SPAN}(?:\s*,\s*{_SPAN})*"
RULE = rf"(?:({DAY_LIST})\s+)?(24/7|off|closed|{SPANS})"
#: Minutes in a day.
DAY = 1440


def day_number(name: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, DAYS)), name) - 1).cast("int")


def minutes(clock: Column) -> Column:
    parts = F.split(F.trim(clock), ":")
    return (F.get(parts, 0).cast("int") * 60 + F.get(parts, 1).cast("int")).cast("int")


def hours_intervals(places: DataFrame, text: str = "opening_hours") -> DataFrame:
    """id, dow (0 is Monday), from_min, to_min, always: weekly intervals of readable texts.

    Later rules replace earlier ones of their days. Intervals past midnight end after 1440. A text with
    anything but rules and separators is unknown and gives no rows; ``readable`` tells the two apart.
    """
    rules = places.where(readable(F.col(text))).select("id", F.posexplode(F.regexp_extract_all(F.col(text), F.lit(RULE), F.lit(0))).alias("pos", "rule"))
    head, body = F.regexp_extract("rule", RULE, 1), F.regexp_extract("rule", RULE, 2)
    ends = lambda r: F.transform(F.split(r, "-"), lambda d: day_number(F.trim(d)))
    span = lambda e: F.when(F.size(e) < 2, F.array(F.get(e, 0))).otherwise(F.transform(F.sequence(F.get(e, 0), F.get(e, 1) + F.when(F.get(e, 1) < F.get(e, 0), 7).otherwise(0)), lambda d: d % 7))
    listed = F.flatten(F.transform(F.split(head, ","), lambda r: span(ends(r))))
    days = F.when(head == "", F.array(*map(F.lit, range(7)))).otherwise(listed)
    by_day = rules.select("id", "pos", body.alias("body"), F.explode(days).alias("dow"))
    last = by_day.groupBy("id", "dow").agg(F.max_by("body", "pos").alias("body"))
    always = F.col("body") == "24/7"
    spans = F.when(always, F.array(F.lit("0:00-24:00"))).when(F.col("body").isin("off", "closed"), F.array().cast("array<string>")).otherwise(F.split("body", ","))
    cut = last.select("id", "dow", always.alias("always"), F.explode(spans).alias("s"))
    a, b = minutes(F.get(F.split("s", "-"), 0)), minutes(F.get(F.split("s", "-"), 1))
    return cut.select("id", "dow", a.alias("from_min"), F.when(b <= a, b + DAY).otherwise(b).cast("int").alias("to_min"), "always")


def readable(text: Column) -> Column:
    left = F.regexp_replace(F.regexp_replace(text, RULE, ""), r"[\s;,]", "")
    return F.coalesce((left == "") & F.regexp_like(text, F.lit(RULE)), F.lit(False))


def minutes_open(places: DataFrame, intervals: DataFrame, at: Column, text: str = "opening_hours") -> DataFrame:
    """``places`` with minutes_left at each row's instant ``at``: 0 if closed, null if unknown, infinite if always open.

    Today's and yesterday's intervals meet each place by equal keys (place, weekday).
    """
    p = places.withColumn("_at", at)
    minute = F.hour("_at") * 60 + F.minute("_at")
    asked = p.select("id", "_at", F.explode(F.array(F.struct(F.weekday("_at").alias("dow"), minute.alias("m")), F.struct(((F.weekday("_at") + 6) % 7).alias("dow"), (minute + DAY).alias("m")))).alias("q")).select("id", "_at", "q.*")
    met = asked.join(intervals, ["id", "dow"]).where((F.col("m") >= F.col("from_min")) & (F.col("m") < F.col("to_min")))
    left = met.groupBy("id", "_at").agg(F.max(F.when(F.col("always"), float("inf")).otherwise((F.col("to_min") - F.col("m")).cast("double"))).alias("left"))
    out = p.join(left, ["id", "_at"], "left")
    return out.withColumn("minutes_left", F.when(readable(F.col(text)), F.coalesce("left", F.lit(0.0)))).drop("left", "_at")
