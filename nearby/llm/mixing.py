"""Mixing sources to target weights by temperature.

Source weights are token shares raised to an exponent and normalised: 1 keeps the shares, 0 makes all
sources equal. The exponent is bisected to the lowest that keeps the most repeated source within
``repetition`` passes while none gives less than one, or to the one with a wanted entropy. Weights times
the token budget give each source its number of passes. A pass is a permutation of the source's blocks
of documents (ordered by a hash of block and pass); the last, partial pass takes the permutation's
documents as far as the budget goes. ``position`` interleaves all sources: sorted by it, any stretch of
the mixture has about the target weights.

Sources stay a table: the driver sees sums over them alone. A source of any size is spread over its blocks: token
sums by block come from one map-side combined aggregate, running sums go over ranges of the permutation, over the
blocks of a range, then within each block. Where the partial pass ends is one place for each source (a block and a
document in it), so each document can tell from its source's row how often it is used, and whole texts never move
(``remix``).

Defined results: a null source is a source of its own; null and empty texts have no tokens and come in every full
pass, and in the partial one where their place is; rows that are equal in id, source and text are rows of their own
that are used together, at one position; rows that repeat an id or have none are told apart by their texts; sources
without tokens get weight 0 and one pass; an empty table gives an empty mixture.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearby.llm.common import fresh

#: Documents in a block, about.
BLOCK = 2048
#: Sources whose rows may be broadcast (some 100 bytes each); more are joined with salts.
FEW_SOURCES, SALTS = 100_000, 64
#: Points of an entropy search that one aggregate looks at.
GRID = 64


@dataclass(frozen=True)
class MixParams:
    #: Most passes of any source, with every source read once at least.
    repetition: float = 1.5
    #: Wanted entropy of the weights in nats; takes the place of ``repetition``.
    entropy: float | None = None
    #: Tokens of the mixture; by default as many as give every source one pass at least.
    budget: int | None = None
    seed: int = 17


def word_count(text: Column) -> Column:
    """Words between space and U+0009..U+000D."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def bisect(too_flat: Callable[[float], bool], steps: int = 60) -> float:
    """The lowest exponent in 0..1 that isn't too flat."""
    low, high = 0.0, 1.0
    if not too_flat(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if too_flat(middle) else (low, middle)
    return high


def entropies(shares: DataFrame, exponents: list[float]) -> list[float]:
    """Entropy of the weights at each exponent; one aggregate over the sources."""
    sums = [x for a in exponents for x in (F.sum(F.pow("share", F.lit(a))), F.sum(F.pow("share", F.lit(a)) * F.log("share")))]
    row = shares.agg(*(c.alias(f"s{i}") for i, c in enumerate(sums))).first()
    return [math.log(z) - a * v / z for a, z, v in zip(exponents, row[::2], row[1::2])]


def exponent(shares: DataFrame, spread: float, params: MixParams) -> float:
    """Of sources with tokens: ``shares`` has the share of each; ``spread`` is the largest over the smallest."""
    if params.entropy is None:
        # A source's passes go with its tokens to the power of the exponent less one.
        return bisect(lambda a: spread ** (1 - a) > params.repetition)
    low, high = 0.0, 1.0
    for _ in range(10):
        points = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        flat = [h > params.entropy for h in entropies(shares, points)]  # falls as the exponent grows
        if not flat[0]:
            return points[0]
        at = max(i for i, x in enumerate(flat) if x)
        low, high = points[at], points[min(at + 1, GRID)]
    return high


def plan(sizes: DataFrame, params: MixParams) -> DataFrame:
    """``sizes`` (s, tokens, rows) with blocks, weight, take (tokens to use), full (whole passes) and rest (tokens of the partial one)."""
    known = sizes.where("tokens > 0")
    row = known.agg(F.count("*").alias("n"), F.min("tokens").alias("least"), F.max("tokens").alias("most"), F.sum("tokens").alias("total")).first()
    out = sizes.withColumn("blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("rows") / BLOCK)))
    if not row["n"]:
        return out.select("*", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("take"), F.lit(1).cast("long").alias("full"), F.lit(0).cast("long").alias("rest"))
    share = F.col("tokens") / F.lit(row["total"])
    a = exponent(known.select(share.alias("share")), row["most"] / row["least"], params) if row["n"] > 1 else 0.0
    power = F.when(F.col("tokens") > 0, F.pow(share, F.lit(a))).otherwise(0.0)
    weighed = out.withColumn("weight", power / F.lit(known.agg(F.sum(power)).first()[0]))
    budget = params.budget or math.floor(weighed.where("tokens > 0").agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] + 1e-6)
    take = F.floor(F.lit(budget) * F.col("weight") + F.lit(1e-6))
    taken = weighed.withColumn("take", F.greatest(take, "tokens") if params.budget is None else take)
    full = F.when(F.col("tokens") == 0, F.lit(1).cast("long")).otherwise(F.floor(F.col("take") / F.col("tokens")))
    return taken.withColumn("full", full).withColumn("rest", F.col("take") - F.col("full") * F.col("tokens"))


def with_sources(df: DataFrame, s: str, tie: str, sources: DataFrame, few: bool) -> DataFrame:
    """``df`` with its source's row; a source of any size is many tasks."""
    right = sources.withColumnRenamed("s", "_s")
    if few:
        return df.join(F.broadcast(right), F.col(s).eqNullSafe(F.col("_s"))).drop("_s")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = F.col(s).eqNullSafe(F.col("_s")) & (F.pmod(F.xxhash64(tie), F.lit(SALTS)) == F.col("_salt"))
    return df.join(right, same).drop("_s", "_salt")


def place(block: Column, nth: Column, seed: int) -> Column:
    """A block's place in the permutation of a pass (ties by block)."""
    return F.xxhash64(block, nth.cast("long"), F.lit(seed))


def range_of(h: Column) -> Column:
    """A range of places: the upper bits, in order."""
    return F.shiftright(h, 54)


def before(column: Column, *keys: str, order: list[str | Column]) -> Column:
    return F.coalesce(F.sum(column).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def cuts(sources: DataFrame, totals: DataFrame, rows: DataFrame, few: bool, seed: int) -> DataFrame:
    """Where each source's partial pass ends: s, cut_place, cut_block and cut_tie (the first document that isn't used).

    ``totals`` has (s, block, block_tokens), ``rows`` (s, block, tie, tokens of all rows of that tie).
    """
    part = sources.where("rest > 0").select("s", "full", "rest")
    own = with_sources(totals, "s", "block", part, few).withColumn("h", place(F.col("block"), F.col("full"), seed)).withColumn("r", range_of(F.col("h")))
    over = F.col("start") + F.col("size") > F.col("rest")
    ranges = own.groupBy("s", "rest", "r").agg(F.sum("block_tokens").alias("size")).withColumn("start", before(F.col("size"), "s", order=["r"]))
    first = lambda df, *order: df.where(over).withColumn("nth", F.row_number().over(Window.partitionBy("s").orderBy(*order))).where("nth = 1")
    at_range = first(ranges, "r").select("s", F.col("r").alias("_r"), F.col("start").alias("_start"))
    inside = with_sources(own.withColumnRenamed("block_tokens", "size"), "s", "block", at_range, few).where("r = _r")
    blocks = inside.withColumn("start", F.col("_start") + before(F.col("size"), "s", order=["h", "block"]))
    at_block = first(blocks, "h", "block").select("s", "rest", F.col("h").alias("cut_place"), F.col("block").alias("cut_block"), F.col("start").alias("_start"))
    members = with_sources(rows.withColumnRenamed("tokens", "size"), "s", "tie", at_block, few).where("block = cut_block")
    ties = members.withColumn("start", F.col("_start") + before(F.col("size"), "s", order=["tie"])).where(over)
    return ties.groupBy("s").agg(F.min("tie").alias("cut_tie"), F.first("cut_place").alias("cut_place"), F.first("cut_block").alias("cut_block"))


def tie_of(docs: DataFrame, id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")), F.lit(seed))


def planned(docs: DataFrame, params: MixParams, source_col: str, text_col: str, id_col: str, keep: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Distinct rows (k0.. for ``keep``, s, n, tie, copies), token sums of blocks, and each source's plan; all narrow and written once.

    Words are counted once for each row here.
    """
    named = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    base = docs.select(*named, F.col(source_col).cast("string").alias("s"), word_count(F.col(text_col)).alias("n"), tie_of(docs, id_col, text_col, params.seed).alias("tie"))
    rows = base.groupBy(*base.columns).agg(F.count("*").alias("copies")).checkpoint()
    sizes = rows.groupBy("s").agg(F.sum(F.col("n") * F.col("copies")).alias("tokens"), F.sum("copies").alias("rows")).checkpoint()
    few = sizes.count() <= FEW_SOURCES
    sources = plan(sizes, params).drop("rows").checkpoint()
    rows = with_sources(rows, "s", "tie", sources.select("s", "blocks"), few).withColumn("block", F.pmod("tie", "blocks")).drop("blocks")
    totals = rows.groupBy("s", "block").agg(F.sum(F.col("n") * F.col("copies")).alias("block_tokens")).checkpoint()
    sums = rows.groupBy("s", "block", "tie").agg(F.sum(F.col("n") * F.col("copies")).alias("tokens"))
    end = cuts(sources, totals, sums, few, params.seed).withColumnRenamed("s", "_e")
    return rows, totals, sources.join(end, F.col("s").eqNullSafe(F.col("_e")), "left").drop("_e").checkpoint(), few


def in_partial(block: Column, tie: Column, seed: int) -> Column:
    """Whether a document is in its source's partial pass."""
    h = place(block, F.col("full"), seed)
    earlier = (h < F.col("cut_place")) | (h == F.col("cut_place")) & (block < F.col("cut_block"))
    return F.coalesce((F.col("rest") > 0) & (earlier | (h == F.col("cut_place")) & (block == F.col("cut_block")) & (tie < F.col("cut_tie"))), F.lit(False))


def mix(docs: DataFrame, params: MixParams = MixParams(), source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The mixture: id, source, n_tokens, pass, position for each use of a document."""
    keep = [id_col, source_col]
    rows, totals, sources, few = planned(docs, params, source_col, text_col, id_col, keep)
    one = F.lit(1).cast("long")
    each = with_sources(totals, "s", "block", sources.select("s", "tokens", "full", "rest"), few)
    each = each.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("full") + (F.col("rest") > 0).cast("long"), one) - 1)))
    each = each.withColumn("h", place(F.col("block"), F.col("p"), params.seed)).withColumn("r", range_of(F.col("h")))
    ranges = each.groupBy("s", "p", "r").agg(F.sum("block_tokens").alias("size"))
    ranges = ranges.select(F.col("s").alias("_s"), F.col("p").alias("_p"), F.col("r").alias("_r"), before(F.col("size"), "s", "p", order=["r"]).alias("base"))
    each = each.join(ranges, F.col("s").eqNullSafe(F.col("_s")) & (F.col("p") == F.col("_p")) & (F.col("r") == F.col("_r")))
    start = F.col("p") * F.col("tokens") + F.col("base") + before(F.col("block_tokens"), "s", "p", "r", order=["h", "block"])
    starts = each.select("s", "block", "p", start.alias("start")).groupBy(F.col("s").alias("_s"), F.col("block").alias("_b")).agg(F.collect_list(F.struct("p", "start")).alias("uses"))
    # Rows of a tie share a position: all but the first of them are set back by what the others add.
    within = rows.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("copies")).over(Window.partitionBy("s", "block").orderBy("tie").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    used = within.join(starts, F.col("s").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).drop("_s", "_b")
    used = with_sources(used, "s", "tie", sources.select("s", "take", "full", "rest", "cut_place", "cut_block", "cut_tie"), few)
    used = used.withColumn("u", F.explode("uses")).where((F.col("u.p") < F.col("full")) | in_partial(F.col("block"), F.col("tie"), params.seed))
    used = used.withColumn("copy", F.explode(F.sequence(one, F.col("copies"))))
    names = [fresh(n, keep) for n in ("n_tokens", "pass", "position")]
    return used.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("n").alias(names[0]), F.col("u.p").cast("int").alias(names[1]), ((F.col("u.start") + F.col("before")) / F.greatest("take", F.lit(1))).alias(names[2]))


def mixture(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    return mix(docs.select("doc_id", "source", "text"), params)


def remix(docs: DataFrame, params: MixParams = MixParams(), source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The mixture's documents with the columns of ``docs`` alone; a document stands in it once for each pass.

    Whole rows aren't shuffled while sources are few enough to broadcast: each tells its uses from its source's plan.
    """
    _, _, sources, few = planned(docs, params, source_col, text_col, id_col, [])
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).cast("string").alias("s"), tie_of(docs, id_col, text_col, params.seed).alias("tie"))
    own = with_sources(own, "s", "tie", sources, few)
    uses = F.col("full") + in_partial(F.pmod("tie", "blocks"), F.col("tie"), params.seed).cast("long")
    return own.where(uses > 0).select("row", F.explode(F.array_repeat(F.lit(0), uses.cast("int")))).select("row.*")
