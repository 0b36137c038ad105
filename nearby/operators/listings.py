"""Steps of the weekly listing refresh around the merge: what goes out, what is derived again, what is still to price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearby.functions import classify as C
from nearby.functions import text as X
from nearby.functions import vocab as V
from nearby.operators import recur, resolve


def is_curated(id_: Column) -> Column:
    return id_.startswith("manual-")


def drop_noise(df: DataFrame, campus: DataFrame | None = None) -> DataFrame:
    """Without committee meetings, closures and schools' own affairs; of campus sources (``campus``: source) only what is public. Curated rows stay."""
    keep = is_curated(F.col("id")) | ~C.is_noise(F.col("title"))
    if campus is None:
        return df.where(keep)
    marked = df.where(keep).join(campus.select("source", F.lit(True).alias("_campus")).distinct(), "source", "left")
    public = F.col("_campus").isNull() | is_curated(F.col("id")) | C.public_on_campus(F.col("title"))
    return marked.where(public).drop("_campus")


def is_over(as_of: Column) -> Column:
    """Whether a one-off's last day or a series' ``until_at`` is past; an open series never ends."""
    last = F.greatest(F.coalesce(F.to_date("end_at"), F.to_date("start_at")), F.to_date("start_at"))
    return F.when(F.coalesce("repeats", F.lit(False)), F.coalesce(F.to_date("until_at") < as_of, F.lit(False))).otherwise(last < as_of)


def drop_finished(df: DataFrame, as_of: Column) -> DataFrame:
    """Without what ``is_over``."""
    return df.where(~is_over(as_of))


def fates(df: DataFrame, as_of: Column) -> DataFrame:
    """id, reason: why a refresh drops a listing (noise, finished, no link; the first that holds), or ``kept``."""
    noise = ~is_curated(F.col("id")) & C.is_noise(F.col("title"))
    reason = F.when(noise, "noise").when(is_over(as_of), "finished").when(F.coalesce("url", F.lit("")) == "", "no link").otherwise("kept")
    return df.select("id", reason.alias("reason"))


def drop_unlinkable(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("url", F.lit("")) != "")


def derive(df: DataFrame) -> DataFrame:
    """Types, setting, audience, food, time of day and cadence of listings, from their own text. Curated rows keep what they have."""
    c = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    types = C.types_of(c("title"), c("description"), c("venue"))
    text = F.concat_ws(" ", c("title"), c("description"), c("venue"))
    new = {
        "types": types, "type": F.get(types, 0), "setting": C.setting_of(text), "audience": C.audience_of(text, c("title"), F.get(types, 0)), "has_food": C.has_food(text),
        "time_of_day": C.time_of_day(F.col("start_at")), "cadence": C.cadence_of(c("recurrence"), F.coalesce(F.col("repeats"), F.lit(False)) if "repeats" in df.columns else F.lit(False)),
    }
    held = is_curated(F.col("id"))
    return df.withColumns({n: F.when(held, F.col(n)).otherwise(v) if n in df.columns else v for n, v in new.items()})


def finalize(df: DataFrame, as_of: Column, richness: Column, order: Column, campus: DataFrame | None = None, threshold: int = 3) -> DataFrame:
    """The refresh in its order: noise out, repeats collapsed, duplicates folded, rows derived, venues spelled one way, ended and linkless rows out, ids unique."""
    df = recur.collapse_repeats(drop_noise(df, campus), threshold)
    df = resolve.fold_duplicates(df, richness, order).drop("members")
    df = resolve.canonical_venues(derive(df))
    return resolve.unique_ids(drop_unlinkable(drop_finished(df, as_of)), richness, order)


#: Misses in a row after which a host is left alone.
MOST_MISSES = 5


def trailing_misses(log: DataFrame) -> DataFrame:
    """host, misses: how many of a host's last answers in a row had no price (``log``: host, asked_at, n, price_min; ``n`` orders equal times).

    The log is cut at each host's last hit and what follows is counted; both are combined before the shuffle, so a host
    with very many answers is no hot window.
    """
    place = F.struct("asked_at", "n")
    hits = log.where("price_min is not null").groupBy(F.col("host").alias("_host")).agg(F.max(place).alias("hit"))
    tail = log.where("price_min is null").join(hits, F.col("host") == F.col("_host"), "left").where(F.col("hit").isNull() | (place > F.col("hit")))
    counts = tail.groupBy("host").agg(F.count("*").alias("misses"))
    return log.select("host").distinct().join(counts, "host", "left").withColumn("misses", F.coalesce("misses", F.lit(0)))


def price_worklist(df: DataFrame, cache: DataFrame, as_of: Column, limit: int = 500, fresh_days: int = 30, log: DataFrame | None = None, most_misses: int = MOST_MISSES) -> DataFrame:
    """The pages to ask for prices: of unpriced coming listings without a fresh answer (``cache``: url, checked; an answer without a price is
    one), busiest venues first, each page once. Hosts that are known to tell none, and those whose last ``most_misses`` answers in
    ``log`` had none, are left alone."""
    coming = df.where(F.col("price_min").isNull() & F.col("url").rlike("^https?://") & (F.to_date("start_at") >= as_of) & ~is_curated(F.col("id")))
    coming = coming.withColumn("host", X.host(F.col("url"))).where(~F.col("host").isin(*V.PRICELESS_HOSTS))
    known = cache.where(F.datediff(as_of, "checked") < fresh_days).select("url")
    weight = coming.groupBy("venue_key").agg(F.count("*").alias("weight"))
    todo = coming.join(known, "url", "left_anti").join(weight, "venue_key")
    if log is not None:
        todo = todo.join(trailing_misses(log).where(F.col("misses") >= most_misses).select("host"), "host", "left_anti")
    return todo.groupBy("url").agg(F.max("weight").alias("weight"), F.min("start_at").alias("start_at")).orderBy(F.desc("weight"), "start_at", "url").limit(limit)


def picture_targets(places: DataFrame, verdicts: DataFrame, kinds: tuple[str, ...], skip: tuple[str, ...] = ()) -> DataFrame:
    """(page, url): the pages worth reading for pictures, one of each page (smallest place id): of map places without a brand, on sites that are neither bad nor skipped."""
    p = places.where(F.col("kind").isin(*kinds) & F.col("brand").isNull() & F.col("url").isNotNull()).withColumn("domain", X.domain_of(F.col("url")))
    p = p.where(~F.col("domain").isin(*skip)) if skip else p
    p = p.join(verdicts.where(F.col("verdict").isin("suspect", "parked")).select("domain"), "domain", "left_anti")
    return p.groupBy(X.page_key(F.col("url")).alias("page")).agg(F.min_by("url", "id").alias("url"))


def directory_summary(places: DataFrame) -> DataFrame:
    """One row of the directory's counts: total, with_events, quiet, chains."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return places.agg(F.count("*").alias("total"), n(F.col("events") > 0).alias("with_events"), n(F.col("event_info") == "none").alias("quiet"), n(F.col("brand").isNotNull()).alias("branded"))


def reasons(df: DataFrame, column: str = "reason") -> DataFrame:
    """How many rows have each reason."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def busiest(df: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` sources with most listings and their share of all."""
    n = df.groupBy("source").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total")).withColumn("_one", F.lit(1))  # one row, met by k
    top = n.orderBy(F.desc("n"), "source").limit(k).withColumn("_one", F.lit(1))
    return top.join(total, "_one").select("source", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))
