"""Tables of fetched iCalendar bodies to event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unfold(body: Column) -> Column:
    return F.regexp_replace(body, r"\r?\n[ \t]", "")


def unescape(value: Column) -> Column:
    """Text values: escaped line ends, commas, semicolons and backslashes."""
    v = F.regexp_replace(F.regexp_replace(value, r"\\\\", "\u0001"), r"\\[nN]", "\n")
    return F.replace(F.regexp_replace(v, r"\\([,;])", "$1"), F.lit("\u0001"), F.lit("\\"))


def prop(block: Column, name: str) -> Column:
    """A property's raw value; null if it isn't there. Names are matched at line starts, whatever their parameters."""
    return F.nullif(F.regexp_extract(block, rf"(?im)^{name}(?:;(?:[^:\r\n\"]|\"[^\"\r\n]*\")*)?:([^\r\n]*)", 1), F.lit(""))


def param(block: Column, name: str, key: str) -> Column:
    """A parameter of a property, unquoted."""
    return F.nullif(F.regexp_extract(block, rf"(?im)^{name};(?:[^:\r\n]*;)?{key}=\"?([^\";:\r\n]*)", 1), F.lit(""))


def instant(value: Column, zone: Column) -> Column:
    """DATE, UTC and zoned values as instants; floating ones are in ``zone``."""
    utc = F.try_to_timestamp(value, F.lit("yyyyMMdd'T'HHmmss'Z'"))
    wall = F.coalesce(F.try_to_timestamp(value, F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(value, F.lit("yyyyMMdd'T'HHmm")), F.try_to_timestamp(value, F.lit("yyyyMMdd")))
    return F.coalesce(utc, F.to_utc_timestamp(wall, zone))


def ical_events(feeds: DataFrame, default_tz: str = "UTC", key: str = "source_id") -> DataFrame:
    """One row for each VEVENT of feeds (key, body) that has a start and a summary. Rules of recurrence are noted, not expanded."""
    block = F.explode(F.regexp_extract_all(unfold(F.col("body")), F.lit(r"(?s)BEGIN:VEVENT\r?\n(.*?)END:VEVENT"), F.lit(1))).alias("b")
    e = feeds.select(key, block)
    b = F.col("b")
    zone = lambda name: F.coalesce(param(b, name, "TZID"), F.lit(default_tz))
    # an unknown zone would fail the whole job; a bare name without a slash is read in the default zone
    safe = lambda z: F.when(z.rlike(r"^[A-Za-z]+/[A-Za-z_/+-]+$") | z.isin("UTC", "GMT"), z).otherwise(default_tz)
    start, end = prop(b, "DTSTART"), prop(b, "DTEND")
    out = e.select(
        key, prop(b, "UID").alias("uid"), unescape(prop(b, "SUMMARY")).alias("title"), instant(start, safe(zone("DTSTART"))).alias("start_at"), instant(end, safe(zone("DTEND"))).alias("end_at"),
        start.rlike(r"^\d{8}$").alias("all_day"), unescape(prop(b, "LOCATION")).alias("location"), unescape(prop(b, "DESCRIPTION")).alias("description"), prop(b, "URL").alias("url"),
        param(b, "ORGANIZER", "CN").alias("organizer"), prop(b, "RRULE").isNotNull().alias("recurring"),
        F.transform(F.split(prop(b, "CATEGORIES"), r"(?<!\\),"), lambda c: F.trim(unescape(c))).alias("categories"),
    )
    return out.where("start_at is not null and title is not null and trim(title) <> ''")


def future_only(events: DataFrame, as_of: Column, grace_hours: int = 0) -> DataFrame:
    """Events that aren't over. An all-day event without an end lasts one day."""
    last = F.coalesce("end_at", F.when(F.col("all_day"), F.col("start_at") + F.expr("interval 1 day")).otherwise(F.col("start_at")))
    return events.where(last >= as_of - F.make_interval(hours=F.lit(grace_hours)))


def feed_status(registry: DataFrame, feeds: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """source_id, status, n_events, n_future, latest, months of each registered source (source_id, enabled): what its harvest gave."""
    future = F.col("start_at") >= as_of
    e = events.groupBy("source_id").agg(F.count("*").alias("n_events"), F.count_if(future).alias("n_future"), F.max("start_at").alias("latest"), F.collect_set(F.date_format("start_at", "yyyy-MM")).alias("m"))
    # A source may answer in several pages; each is looked at where it is.
    body = F.col("body")
    calendar, json = body.contains("BEGIN:VCALENDAR"), F.ltrim(body).rlike(r"^[\[{]")
    page = feeds.select("source_id", body.isNotNull().alias("answered"), calendar.alias("calendar"), body.contains("BEGIN:VEVENT").alias("filled"), ((F.col("status") == 202) | (~calendar & ~json & F.lower(body).contains("<html"))).alias("blocked"))
    f = page.groupBy("source_id").agg(*(F.bool_or(F.coalesce(c, F.lit(False))).alias(c) for c in ("answered", "calendar", "filled", "blocked")))
    j = registry.join(f, "source_id", "left").join(e, "source_id", "left")
    status = (
        F.when(~F.col("enabled"), "disabled").when(~F.coalesce("answered", F.lit(False)), "no answer").when(F.col("blocked"), "blocked").when(F.col("calendar") & ~F.col("filled"), "empty")
        .when(F.coalesce("n_events", F.lit(0)) == 0, "no events").when(F.col("n_future") == 0, "stale").otherwise("ok")
    )
    months = F.array_join(F.slice(F.sort_array("m", asc=False), 1, 8), ",")
    return j.select("source_id", status.alias("status"), F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("n_future", F.lit(0)).alias("n_future"), "latest", months.alias("months"))
