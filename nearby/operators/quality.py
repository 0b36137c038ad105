"""Row gates: every rule that a row breaks as (id, severity, rule)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearby.functions import geo, vocab as V
from nearby.functions import text as X
from nearby.operators import audit, spatial

AUDIENCES = ("all", "family", "seniors", "adults")
SETTINGS = ("indoor", "outdoor", "unknown")
TIMES = ("daytime", "nighttime", "unknown")
HORIZON_DAYS = 730
MARKUP = r"<[a-z/][^>]*>|&(amp|gt|lt|quot|#\d+);"

Rule = tuple[str, str, Column] | tuple[str, str, Column, Column]


def findings(df: DataFrame, rules: list[Rule], key: str = "id") -> DataFrame:
    """id, severity, rule, detail for each (severity, rule, condition, value to show) that holds; null conditions don't."""
    shown = lambda r: r[3].cast("string") if len(r) > 3 else F.lit(None).cast("string")
    hits = F.array_compact(F.array(*(F.when(r[2], F.struct(F.lit(r[0]).alias("severity"), F.lit(r[1]).alias("rule"), shown(r).alias("detail"))) for r in rules)))
    return df.select(F.col(key).alias("id"), F.explode(hits).alias("h")).select("id", "h.severity", "h.rule", "h.detail")


def duplicates(df: DataFrame, key: str = "id") -> DataFrame:
    again = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).where("n > 1")
    return again.select("id", F.lit("error").alias("severity"), F.lit("duplicate id").alias("rule"), F.col("n").cast("string").alias("detail"))


def outside(values: tuple[str, ...], c: Column) -> Column:
    return c.isNotNull() & ~c.isin(*values)


def check_listings(df: DataFrame, as_of: Column, lat0: float, lon0: float, radius: float) -> DataFrame:
    """Findings of listings: required fields, vocabularies, coordinates, prices, dates, schedules, links, repeated ids.

    Columns that a table lacks are not gated, but for id, title, start_at, lat and lon.
    """
    c = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    blank = lambda n: F.coalesce(c(n).cast("string"), F.lit("")) == ""
    given = lambda *names: all(n in df.columns for n in names)
    at = lambda n: c(n).cast("timestamp")
    types = [t for t, _ in V.TYPES] + ["other"]
    far = geo.haversine_miles(F.lit(lat0), F.lit(lon0), c("lat").cast("double"), c("lon").cast("double"))
    repeats = F.coalesce(c("repeats").cast("boolean"), F.lit(False))
    rules: list[Rule] = [
        ("error", "no id", blank("id")), ("error", "no title", blank("title")), ("error", "no start", c("start_at").isNull()), ("error", "no coordinates", c("lat").isNull() | c("lon").isNull()),
        ("error", "latitude out of range", ~c("lat").cast("double").between(-90, 90), c("lat")), ("error", "longitude out of range", ~c("lon").cast("double").between(-180, 180), c("lon")), ("error", "outside the radius", far > radius, F.round(far, 1)),
        ("error", "unknown audience", outside(AUDIENCES, c("audience")), c("audience")), ("error", "unknown setting", outside(SETTINGS, c("setting")), c("setting")), ("error", "unknown time of day", outside(TIMES, c("time_of_day")), c("time_of_day")),
        ("error", "negative price", c("price_min").cast("double") < 0, c("price_min")), ("error", "price not a number", c("price_min").cast("double").isNotNull() & F.isnan(c("price_min").cast("double"))), ("error", "price range upside down", c("price_max").cast("double") < c("price_min").cast("double"), c("price_max")),
        ("error", "ends before it starts", at("end_at") < at("start_at"), c("end_at")), ("warning", "far ahead", F.datediff(at("start_at"), as_of) > HORIZON_DAYS, F.date_format(at("start_at"), "yyyy-MM-dd")),
        ("error", "until before start", at("until_at") < at("start_at"), F.date_format(at("until_at"), "yyyy-MM-dd")), ("warning", "markup in the description", X.has(c("description"), MARKUP)),
    ]
    required = ("type", "venue", "host", "url", "audience", "setting", "time_of_day")
    rules += [("error", f"no {n.replace('_', ' ')}", blank(n)) for n in required if given(n) and n != "url"]
    rules += [("error", f"{n.replace('_', ' ')} is neither yes nor no", c(n).isNull()) for n in ("has_food", "repeats") if given(n)]
    if given("repeats"):
        rules += [("error", "repeats without cadence", repeats & c("cadence").isNull())]
        rules += [("error", "recurrence without repeats", ~blank("recurrence") & ~repeats)] if given("recurrence") else []
        rules += [("error", "until without repeats", c("until_at").isNotNull() & ~repeats)] if given("until_at") else []
    if given("signup_required", "signup_url"):
        rules += [("error", "signup without an address", F.coalesce(c("signup_required"), F.lit(False)) & blank("signup_url"))]
    if given("kind"):
        rules += [("error", "kind was removed", c("kind").isNotNull(), c("kind"))]
    if given("types"):
        known = F.array(*map(F.lit, types))
        rules += [
            ("error", "no type", F.coalesce(F.size("types"), F.lit(0)) < 1), ("error", "unknown type", F.size(F.array_except("types", known)) > 0, F.array_join(F.array_except("types", known), ",")),
            ("error", "repeated type", F.size("types") > F.size(F.array_distinct("types"))), ("warning", "more than three types", F.size("types") > 3, F.size("types")),
        ]
        rules += [("error", "type isn't the first of types", (F.size("types") > 0) & ~c("type").eqNullSafe(F.get("types", 0)), c("type"))] if given("type") else []
    if given("url"):
        rules += [("error", "no link", blank("url")), ("error", "not a web address", ~blank("url") & ~c("url").rlike("^https?://"), c("url"))]
    return findings(df, rules).union(duplicates(df))


META_FIELDS = ("center_lat", "center_lon", "radius_miles", "timezone", "scraped_at")


def check_meta(meta: DataFrame) -> DataFrame:
    """Findings of a dataset's description (one row of texts): missing fields, and a time without a zone."""
    text = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")) if n in meta.columns else F.lit("")
    rules = [("error", f"no {n.replace('_', ' ')}", text(n) == "") for n in META_FIELDS]
    rules += [("error", "scraped at without a zone", (text("scraped_at") != "") & ~text("scraped_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"), text("scraped_at"))]
    return findings(meta.withColumn("id", F.lit("meta")), rules)


def dataset_meta(df: DataFrame, source: str = "source") -> DataFrame:
    """source, n: what a dataset is made of, a row for each source."""
    return df.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))


def check_places(df: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Findings of places: name, coordinates, kinds, cuisines, pictures by https, rating, quiet places with events, coverage, repeated ids.

    A place without coordinates has that finding (and a missing name's, a repeated id's) alone. ``event_info`` may say ``none`` or nothing. With
    ``regions`` (id, lat, lon, radius_miles) a place has to be inside one, or a mile out at most.
    """
    c = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    kinds = tuple(k for k, _ in V.PLACE_KINDS)
    placed = c("lat").isNotNull() & c("lon").isNotNull()
    rated = c("stars").isNotNull()
    rules: list[Rule] = [
        ("error", "unknown kind", outside(kinds, c("kind")), c("kind")), ("error", "none with events", (c("event_info") == "none") & (c("events").cast("long") > 0), c("events")),
        ("error", "unknown event info", outside(("none",), c("event_info")), c("event_info")), ("error", "stars out of range", rated & ~c("stars").cast("double").between(1, 5), c("stars")),
    ]
    rules += [("error", f"{n.replace('_', ' ')} not by https", ~c(n).startswith("https://"), c(n)) for n in ("image", "wiki_image")]
    if "stars" in df.columns:
        rules += [("error", "rating without a count or source", rated & (~F.coalesce(c("count").cast("long") > 0, F.lit(False)) | c("sources").isNull()))]
    for name, known in (("kinds", kinds), ("cuisine", tuple(x for x, _ in V.CUISINES))):
        if name in df.columns:
            odd = F.array_except(name, F.array(*map(F.lit, known)))
            rules += [("error", f"unknown {name}", F.size(odd) > 0, F.array_join(odd, ","))]
    rules = [(r[0], r[1], placed & r[2], *r[3:]) for r in rules]
    rules += [("error", "no name", F.coalesce(c("name"), F.lit("")) == ""), ("error", "no coordinates", ~placed)]
    found = findings(df, rules).union(duplicates(df))
    if regions is None:
        return found
    spot = F.struct("id", "lat", "lon")  # rows of one id are each looked at
    there = df.where(placed).withColumn("_spot", spot)
    inside = spatial.coverage(there.select(F.col("_spot").alias("id"), "lat", "lon").distinct(), regions, 1.0).select(F.col("id").alias("_spot"))
    out = there.join(inside, "_spot", "left_anti")
    return found.union(out.select("id", F.lit("error"), F.lit("outside every region"), F.lit(None).cast("string")))


def check_audit(df: DataFrame) -> DataFrame:
    """Findings of audit verdicts (domain, verdict, checked, sig)."""
    v = F.col("verdict")
    rules: list[Rule] = [
        ("error", "unknown verdict", outside(audit.VERDICTS, v), v), ("error", "no verdict", v.isNull()), ("error", "checked is no date", F.col("checked").cast("string").try_cast("date").isNull(), F.col("checked")),
        ("error", "none without a signature", (v == "none") & (F.coalesce("sig", F.lit("")) == "")),
    ]
    return findings(df, rules, "domain").union(duplicates(df, "domain"))


def check_regions(df: DataFrame) -> DataFrame:
    rules = [("error", "latitude out of range", ~F.col("lat").between(-90, 90)), ("error", "longitude out of range", ~F.col("lon").between(-180, 180)), ("error", "radius out of range", ~((F.col("radius_miles") > 0) & (F.col("radius_miles") <= 200)))]
    return findings(df, rules).union(duplicates(df))


def listing_summary(df: DataFrame) -> DataFrame:
    """One row of counts of a listing table."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counts = df.agg(F.count("*").alias("total"), n(F.col("price_min").isNotNull()).alias("priced"), n(F.col("price_min") == 0).alias("free"), n(F.col("repeats")).alias("repeating"), *(n(F.col("audience") == a).alias(a) for a in AUDIENCES[1:]), n(F.col("setting") == "outdoor").alias("outdoor"), n(F.col("has_food")).alias("food"))
    types = df.select(F.explode("types").alias("t")).agg(F.count_distinct("t").alias("types"))
    return counts.join(types)  # one row and one row
