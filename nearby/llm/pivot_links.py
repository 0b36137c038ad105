"""Links between fingerprints by pivot distance tables.

Every fingerprint has its distances to reference fingerprints as columns (``fingerprints``), computed once: whole
ones, and those within each byte.

- Meeting: fingerprints at most two bits apart agree in two of their four 16-bit segments at least, so their
  distances to all references are equal there. They meet in cells of equal coordinates of two segments. A cell
  of more than ``CELL`` fingerprints is cut again: of the four bytes of the other two segments two agree as well, so
  they meet by the coordinates of six bytes. Such a cell has at most 2**16 fingerprints that can be in it (plus
  chance meetings of equal coordinates), whatever the corpus, and is dealt out as pairs of blocks.
- Discard: within a cell, pairs whose whole distances differ by more than ``most`` in any coordinate go.
- Verification: the distance of the survivors. A cell returns the edges of a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearby.llm import fingerprints as fpr
from nearby.llm.common import bounded_batches

MOST = 2
#: Fingerprints in a cell that isn't cut further, and in a block of a cell that can't be.
CELL = 1024
#: Pairs that a task looks at in one step.
STEP = 1 << 20
#: Rows of one number that may be broadcast.
FEW = 100_000


def pairs_within(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places of the same group, for groups of these sizes in a row; about ``STEP`` pairs at a time."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for size in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(size, 1)
        at, most = starts[sizes == size], max(1, STEP // len(i))
        for k in range(0, len(at), most):
            for m in range(0, len(i), STEP):
                yield (at[k : k + most, None] + i[m : m + STEP]).ravel(), (at[k : k + most, None] + j[m : m + STEP]).ravel()


def linked(x: np.ndarray, table: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], most: int) -> pa.RecordBatch | None:
    """Forest edges (a, b) of the near pairs."""
    found = [fpr.near(x, table, i, j, most) for i, j in pairs]
    found = [(i, j) for i, j in found if len(i)]
    if not found:
        return None
    values, place = np.unique(x, return_inverse=True)
    a, b = (place[np.concatenate(c)] for c in zip(*found))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in fpr.forest(values, a, b)], names=["a", "b"])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the groups of an array<struct<fp, d0, d1>> column, its fingerprints and its whole tables."""
    sizes, rows = np.diff(column.offsets.to_numpy()), column.flatten()
    x, low, high = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    return sizes, x, fpr.as_table(low, high)


def small_cells(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, x, table = flat(batch.column(0))
            if len(x) and (out := linked(x, table, pairs_within(sizes), most)):
                yield out

    return run


def block_pairs(most: int):
    """Pairs between two blocks, or within one where the right side is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (n,), x, table = flat(batch.column(0).slice(k, 1))
                (m,), y, more = flat(batch.column(1).slice(k, 1))
                x, table = np.concatenate([x, y]), np.concatenate([table, more])
                rows = max(1, STEP // max(1, m))
                cross = ((np.repeat(np.arange(i, min(n, i + rows)), m), np.tile(np.arange(n, n + m), min(rows, n - i))) for i in range(0, n, rows))
                if out := linked(x, table, cross if m else pairs_within(np.array([n])), most):
                    yield out

    return run


def links(classes: DataFrame, fp: str = "fp", most: int = MOST) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints which chains of at most ``most`` (2 or fewer) bits connect.

    ``classes`` holds distinct fingerprints.
    """
    if not 0 <= most <= 2:
        raise ValueError("cells of two agreeing segments of four find up to two differing bits")
    x = F.col(fp)
    tables = classes.select(x.alias("fp"), *(c.alias(f"d{i}") for i, c in enumerate(fpr.whole_table(x))), *(c.alias(f"t{i}") for i, c in enumerate(fpr.byte_tables(x)))).checkpoint()
    row = F.struct("fp", "d0", "d1").alias("row")
    halves = {s: (f"t{2 * s}", f"t{2 * s + 1}") for s in range(4)}
    cell = lambda salt, *columns: F.xxhash64(F.lit(salt), *columns)
    first = [(cell(k, *halves[a], *halves[b]), [t for s in range(4) if s not in (a, b) for t in halves[s]]) for k, (a, b) in enumerate(combinations(range(4), 2))]
    dealt = tables.select(row, F.posexplode(F.array(*(c for c, _ in first))).alias("k", "cell"), *(f"t{i}" for i in range(8)))
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").checkpoint()
    cold = dealt.join(sizes.where(F.col("n") <= CELL), "cell").groupBy("cell").agg(F.collect_list("row").alias("rows"))
    # A hot cell is cut by two of the four bytes of the segments that it isn't keyed by.
    deeper = F.coalesce(*(F.when(F.col("k") == k, F.array(*(cell(6 * k + i, "cell", x, y) for i, (x, y) in enumerate(combinations(rest, 2))))) for k, (_, rest) in enumerate(first)))
    crowded = sizes.where(F.col("n") > CELL).select("cell")
    n_crowded = crowded.count()
    bounded_batches(classes.sparkSession)
    found = cold.select("rows").mapInArrow(small_cells(most), "a long, b long")
    if not n_crowded:
        return found.distinct()
    hot = dealt.join(F.broadcast(crowded) if n_crowded <= FEW else crowded, "cell").select("row", F.explode(deeper).alias("cell"))
    hot_sizes = hot.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / CELL).cast("int")
    met = hot.join(hot_sizes, "cell").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("row.fp"), F.col("blocks")).cast("int"))
    # A row of block i meets each block once: pair (i, j) for every j.
    to = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("p"), F.greatest(F.col("block"), j).alias("q"))))
    side = lambda own: F.collect_list(F.when((F.col("block") == F.col("t.p")) == own, F.col("row")))
    blocked = met.select("cell", "block", "row", to.alias("t")).groupBy("cell", "t").agg(side(True).alias("left"), side(False).alias("right"))
    return found.union(blocked.select("left", "right").mapInArrow(block_pairs(most), "a long, b long")).distinct()
