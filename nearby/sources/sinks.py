"""Tables out and in: item files, the directory, calendar texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearby.functions import vocab as V


def read_items(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of JSON-lines or Parquet files, by a stated schema."""
    return spark.read.schema(schema).parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(schema).json(path)


def write_places(places: DataFrame, path: str, form: str = "json") -> None:
    """Places without empty fields, food apart from the rest (``is_food`` folders), near ones first within each file."""
    text = [f.name for f in places.schema.fields if isinstance(f.dataType, T.StringType)]
    out = places.select(*(F.nullif(c, F.lit("")).alias(c) if c in text else F.col(c) for c in places.columns)).withColumn("is_food", F.col("kind").isin(*V.FOOD_KINDS))
    order = [c for c in ("miles", "name", "id") if c in places.columns]
    out = out.repartition("is_food", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("is_food", *order)
    writer = out.write.mode("overwrite").partitionBy("is_food")
    writer.option("ignoreNullFields", "true").json(path) if form == "json" else writer.parquet(path)


def fold(line: Column, width: int = 74) -> Column:
    """A content line in pieces of ``width`` characters, later ones after a space."""
    rest = F.regexp_replace(F.substring(line, F.lit(width + 1), F.length(line)), f"(?s)(.{{{width - 1}}})(?=.)", "$1\r\n ")
    return F.when(F.length(line) <= width, line).otherwise(F.concat(F.substring(line, 1, width), F.lit("\r\n "), rest))


def escape(text: Column) -> Column:
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for a, b in ((";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\n", "\\n")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def ics_export(listings: DataFrame, now: Column, stamp: Column) -> DataFrame:
    """(id, ics): a calendar text for one visit of each listing (id, title, start_at, end_at, venue, address, city, description, url, lat, lon).

    A run under way is visited today at its usual hour; what has no end or lasts over a day is two hours. Of the
    venue, address and city those that another contains are left out.
    """
    c = lambda n, t="string": F.col(n) if n in listings.columns else F.lit(None).cast(t)
    start, end = F.col("start_at").cast("timestamp"), c("end_at", "timestamp").cast("timestamp")
    at = now.cast("timestamp")
    today = F.to_timestamp(F.concat(F.date_format(at, "yyyy-MM-dd"), F.date_format(start, " HH:mm:00")), "yyyy-MM-dd HH:mm:ss")
    begin = F.when((start < at) & (end > at), today).otherwise(start)
    long = F.unix_seconds(end) - F.unix_seconds(start)
    run = long.isNull() | (long > 86400)
    finish = F.timestamp_seconds(F.unix_seconds(begin) + F.when(run, 7200).otherwise(long))
    parts = F.array_distinct(F.filter(F.array(c("venue"), c("address"), c("city")), lambda x: x.isNotNull() & (x != "")))
    where = F.array_join(F.filter(parts, lambda x: ~F.exists(parts, lambda y: (x != y) & y.contains(x))), ", ")
    notes = F.concat_ws("\n\n", F.nullif(c("description"), F.lit("")), F.when(run & end.isNotNull(), F.concat(F.lit("Runs through "), F.date_format(end, "yyyy-MM-dd"), F.lit(" — this is one visit."))), F.when(c("url").isNotNull(), F.concat(F.lit("Details: "), c("url"))), F.when(run, "End time is an estimate — check the listing."))
    utc = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss'Z'")
    point = F.when(c("lat").isNotNull() & c("lon").isNotNull(), F.concat(F.lit("GEO:"), c("lat").cast("string"), F.lit(";"), c("lon").cast("string")))
    lines = F.array_compact(F.array(
        *map(F.lit, ("BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//nearby//EN", "CALSCALE:GREGORIAN", "BEGIN:VEVENT")), F.concat(F.lit("UID:"), escape(F.col("id")), F.lit("@nearby")), F.concat(F.lit("DTSTAMP:"), utc(stamp.cast("timestamp"))),
        F.concat(F.lit("DTSTART:"), utc(begin)), F.concat(F.lit("DTEND:"), utc(finish)), F.concat(F.lit("SUMMARY:"), escape(F.col("title"))), F.when(where != "", F.concat(F.lit("LOCATION:"), escape(where))),
        F.when(notes != "", F.concat(F.lit("DESCRIPTION:"), escape(notes))), F.when(c("url").isNotNull(), F.concat(F.lit("URL:"), c("url"))), point, F.lit("END:VEVENT"), F.lit("END:VCALENDAR"),
    ))
    return listings.where("start_at is not null").select("id", F.concat(F.array_join(F.transform(lines, lambda x: fold(x)), "\r\n"), F.lit("\r\n")).alias("ics"))
