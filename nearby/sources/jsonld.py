"""Structured-data blocks of page bodies to event rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearby.functions.classify import price_range
from nearby.functions.text import iso_duration_seconds, split_postal
from nearby.plans.session import shared_dir

BLOCK = r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
#: Levels of nesting that one plan walks; deeper ones are walked in rounds of as many, while there are any.
ROUND = 6
EVENT_TYPE = "Event$|^Festival$|^Hackathon$"


def get(node: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(node, path, kind)


def below(level: DataFrame, key: str) -> DataFrame:
    """The objects and lists right inside those of ``level`` (key, block, node)."""
    level.createOrReplaceTempView("_ld_level")
    return level.sparkSession.sql(f"select {key}, block, e.value as node from _ld_level, lateral variant_explode(node) as e where schema_of_variant(e.value) like 'OBJECT%' or schema_of_variant(e.value) like 'ARRAY%'")


def nodes(pages: DataFrame, key: str) -> DataFrame:
    """(key, block, level, node): every object and list inside the page's structured data, at any depth.

    ``ROUND`` levels are one plan; each explodes the last one's values, so the work follows the data and no Python runs.
    What lies deeper starts from a checkpoint, round by round until nothing does. Only blocks with brackets enough to
    reach that deep are looked at for it, which are few.
    """
    shared_dir(pages.sparkSession)
    blocks = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(BLOCK), F.lit(1))).alias("block", "text"))
    parsed = lambda b: b.select(key, "block", F.try_parse_json(F.trim("text")).alias("node")).where("node is not null")
    found, level = [], parsed(blocks)
    for n in range(ROUND):
        found.append(level.withColumn("level", F.lit(n)))
        level = below(level, key)
    deep = parsed(blocks.where(F.length("text") - F.length(F.translate("text", "[{", "")) > ROUND))
    for _ in range(ROUND):
        deep = below(deep, key)
    deep, n = deep.checkpoint(), ROUND
    while not deep.isEmpty():
        for _ in range(ROUND):
            found.append(deep.withColumn("level", F.lit(n)))
            deep, n = below(deep, key), n + 1
        deep = deep.checkpoint()
    return reduce(DataFrame.union, found)


def types(node: Column) -> Column:
    """@type as an array, whether it is one or a text."""
    many = F.try_variant_get(node, "$['@type']", "array<string>")
    return F.coalesce(many, F.when(get(node, "$['@type']").isNotNull(), F.array(get(node, "$['@type']"))), F.array().cast("array<string>"))


def wall(text: Column) -> Column:
    """The clock time a stated time shows, without its offset."""
    t = F.regexp_replace(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?)", 1), " ", "T")
    return F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd"))).cast("timestamp_ntz")


def repair_times(start: Column, door: Column, end: Column, duration: Column) -> tuple[Column, Column]:
    """Start and end as wall clocks: a bare date takes the doors' clock; a missing or early end is the start and the duration."""
    clock = F.regexp_extract(F.coalesce(door, F.lit("")), r"(\d{2}:\d{2})(?::\d{2})?", 1)
    bare = start.rlike(r"^\d{4}-\d{2}-\d{2}$") & (clock != "")
    at = wall(F.when(bare, F.concat(start, F.lit("T"), clock)).otherwise(start))
    stated, seconds = wall(end), iso_duration_seconds(duration)
    later = F.when(seconds.isNotNull(), at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")))
    return at, F.when(stated.isNull() | (stated <= at), later).otherwise(stated)


def location_of(node: Column) -> Column:
    """struct(venue, address, city, state, lat, lon) of a location: a text, or a place with an address of either kind and a point."""
    at = lambda p, k="string": get(node, f"$.location{p}", k)
    plain = F.when(F.schema_of_variant(F.try_variant_get(node, "$.location", "variant")) == "STRING", at(""))
    line = F.coalesce(F.when(at(".address.streetAddress").isNull() & at(".address.addressLocality").isNull(), at(".address")), plain)
    post = split_postal(F.when(~F.coalesce(line, F.lit("{")).startswith("{"), line))
    return F.struct(
        at(".name").alias("venue"), F.coalesce(at(".address.streetAddress"), post["street"]).alias("address"), F.coalesce(at(".address.addressLocality"), post["city"]).alias("city"),
        F.coalesce(at(".address.addressRegion"), post["state"]).alias("state"), at(".geo.latitude", "double").alias("lat"), at(".geo.longitude", "double").alias("lon"),
    )


def price_of(node: Column) -> Column:
    """struct(min, max) of offers: one offer or a list of them; null if none states a number."""
    fields = ("price", "lowPrice", "highPrice")
    one = F.array(*(get(node, f"$.offers.{f}") for f in fields))
    many = F.coalesce(F.try_variant_get(node, "$.offers", "array<variant>"), F.array().cast("array<variant>"))
    listed = F.flatten(F.transform(many, lambda o: F.array(*(get(o, f"$.{f}") for f in fields))))
    return price_range(F.array_compact(F.concat(one, listed)))


def jsonld_events(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Events of page bodies (key, html): key, name, types, start_at, end_at, url, location, price_min, price_max.

    A name and a start are needed; of repeats of a name and start day on a page the first counts.
    """
    n = F.col("node")
    e = nodes(pages, key).where(F.exists(types(n), lambda t: t.rlike(EVENT_TYPE)))
    at, end = repair_times(get(n, "$.startDate"), get(n, "$.doorTime"), get(n, "$.endDate"), get(n, "$.duration"))
    price = price_of(n)
    out = e.select(key, "block", "level", F.trim(get(n, "$.name")).alias("name"), types(n).alias("types"), at.alias("start_at"), end.alias("end_at"), get(n, "$.url").alias("url"), location_of(n).alias("location"), price["min"].alias("price_min"), price["max"].alias("price_max"))
    out = out.where("name <> '' and start_at is not null").withColumn("day", F.to_date("start_at"))
    rest = [c for c in out.columns if c not in (key, "name", "day", "block", "level")]
    first = out.groupBy(key, "name", "day").agg(F.min_by(F.struct(*rest), F.struct("block", "level", "start_at")).alias("e"))
    return first.select(key, "name", "day", "e.*")


def embedded_json(pages: DataFrame, marker: str, key: str = "page_id") -> DataFrame:
    """(key, payload): the JSON object that follows a marker in a page; what stands behind it is ignored."""
    after = F.when(F.contains("html", F.lit(marker)), F.expr(f"substring(html, locate('{{', html, locate({marker!r}, html)))"))
    return pages.select(key, F.try_parse_json(F.coalesce(F.nullif(F.regexp_extract(after, r"(?s)^(\{.*?\})\s*;?\s*</script>", 1), F.lit("")), after)).alias("payload")).where("payload is not null")
