"""Exact top-k inner-product search by a three-phase uniform threshold.

A vector's components are cut into ``lists`` score lists: list i ranks all vectors by the inner
product over its share of the components, and a score is the sum over lists.

1. Each block of vectors gathers the k best of each of its local lists for every query; only for these heads
   the other lists are looked up. The k-th best of all gathered scores is a safe cutoff c: the answer is no worse.
2. The cutoff goes to every block with the queries. A list then reports every entry of at least
   c / lists; vectors too short to reach that with the block's queries are passed over unseen. A vector that
   no list reports has a score under c, so what is collected suffices.
3. Collected sums with c / lists for each missing list are upper bounds. Those under c go; the rest
   that lack a list are resolved exactly.

Components are floor(1024 * x); sums are exact in 64-bit integers for scaled components below 2**26
and up to 2048 of them. Defined results: a vector that is null or has a null, NaN or infinite component
takes no part, nor does a null id; shorter vectors count as if zeros followed; every row is a candidate of every
query but its own row, so rows that repeat an id, with the same vector or another, stand for themselves and each
repeated query row is answered; of equal vectors only the k + 1 smallest ids can be in an answer, so only those go on
and ties in a hot vector stay cheap.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a block of vectors or queries as a matrix, and the least rows of one that are worth a task.
BLOCK_BYTES, LEAST_ROWS = 16 << 20, 2048
#: Products that a task holds at once.
TILE = 4_000_000
LISTS = 2
SCALE = 1024
WORST = np.iinfo(np.int64).min


def scaled(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): integer vectors that take part."""
    whole = F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform(vec_col, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return vectors.where(F.col(id_col).isNotNull() & whole).select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("v"))


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of the integer vectors, zeros after short ones."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    if (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = values
    return out


class Products:
    """Inner products of a block of vectors with tiles of a block of queries, list by list: floats where they are exact, for speed."""

    def __init__(self, q: np.ndarray, v: np.ndarray, spans: list[tuple[int, int]]):
        self.exact = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * max(1, q.shape[1]) < 1 << 53
        kind = float if self.exact else np.int64
        self.q, self.v, self.spans = q.astype(kind), v.astype(kind), spans
        self.rows = max(1, TILE // max(1, len(v)))

    def tiles(self):
        """(slice of queries, products of each list)."""
        for i in range(0, len(self.q), self.rows):
            at = slice(i, i + self.rows)
            yield at, [self.q[at, a:b] @ self.v[:, a:b].T for a, b in self.spans]

    def whole(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Full scores of pairs of places."""
        step = max(1, TILE // max(1, self.q.shape[1]))
        cut = [np.einsum("rd,rd->r", self.q[i[k : k + step]], self.v[j[k : k + step]]) for k in range(0, len(i), step)]
        return np.concatenate(cut).astype(np.int64) if cut else np.zeros(0, np.int64)


def in_blocks(vectors: DataFrame, queries: DataFrame, n_blocks: int, n_query_blocks: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` on each block of vectors with each block of queries; both sides of a group are bounded."""
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    v = vectors.select("vec", "v", "copies", block("vec", n_blocks).cast("long").alias("block"), all_of(n_query_blocks).alias("qb"))
    q = queries.select("*", block("query", n_query_blocks).cast("long").alias("qb"), all_of(n_blocks).alias("block"))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left, right)

    return v.groupBy("block", "qb").cogroup(q.groupBy("block", "qb")).applyInArrow(both, schema)


def blocks(n: int, dims: int, tasks: int) -> int:
    """Blocks of bounded bytes, and enough of them for all tasks while they are worth one."""
    return max(1, math.ceil(n * dims * 8 / BLOCK_BYTES), min(tasks, math.ceil(n / LEAST_ROWS)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, lists: int = LISTS, id_col: str = "vec_id", vec_col: str = "embedding", n_blocks: int | None = None, n_query_blocks: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other rows of every row where ``is_query`` (on ``vec_id``) holds.

    ``query_hash`` (of the scaled query vector) tells rows of a query id apart that have different vectors.
    """
    rows = scaled(vectors, id_col, vec_col).groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("vec", F.monotonically_increasing_id()).checkpoint()  # the numbers stay as written
    first = Window.partitionBy("v").orderBy("vec_id")
    entries = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).drop("nth").checkpoint()
    queries = rows.where(is_query).select(F.col("vec").alias("query"), F.col("v").alias("q")).checkpoint()
    size = entries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    n_queries, dims = queries.count(), max(1, size["dims"] or 1, (queries.agg(F.max(F.size("q"))).first()[0] or 1))
    n_blocks = n_blocks or blocks(size["n"], dims, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n_query_blocks = n_query_blocks or blocks(n_queries, dims, 1)
    edges = np.linspace(0, dims, lists + 1).astype(int)
    spans = [(int(a), int(b)) for a, b in zip(edges, edges[1:])]

    def sides(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of vectors and of queries, both matrices, and each query's place among the vectors if its own row alone stands there (else -1)."""
        ids, asked = left["vec"].to_numpy(), right["query"].to_numpy()
        alone = np.where(left["copies"].to_numpy() == 1, ids, -1)
        order = np.argsort(alone)
        at = np.minimum(np.searchsorted(alone[order], asked), len(ids) - 1)
        own = np.where(alone[order][at] == asked, order[at], -1)
        return ids, asked, matrix(left["v"], dims), matrix(right["q"], dims), own

    def hide_own(part: np.ndarray, own: np.ndarray, value: float) -> None:
        at = np.flatnonzero(own >= 0)
        part[at, own[at]] = value

    def heads(left: pa.Table, right: pa.Table) -> pa.Table:
        cols: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, asked, v, q, own = sides(left, right)
            products, n = Products(q, v, spans), min(k, len(ids))
            for at, parts in products.tiles():
                seen = []
                for part in parts:
                    hide_own(part, own[at], WORST)
                    best = np.argpartition(part, len(ids) - n, axis=1)[:, len(ids) - n :]
                    seen.append(np.arange(len(best))[:, None] * len(ids) + best)
                i, j = np.divmod(np.unique(np.concatenate(seen)), len(ids))
                i += at.start
                other = own[i] != j
                i, j = i[other], j[other]
                for col, x in zip(cols, (asked[i], ids[j], products.whole(i, j))):
                    col.append(x)
        return pa.table({n: np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for n, c in zip(("query", "vec", "score"), cols)})

    gathered = in_blocks(entries, queries, n_blocks, n_query_blocks, heads, "query long, vec long, score long")
    high = Window.partitionBy("query").orderBy(F.col("score").desc())
    cutoffs = gathered.withColumn("r", F.row_number().over(high)).where(F.col("r") <= k).groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("cutoff"))
    armed = queries.join(cutoffs, "query", "left").checkpoint()

    def report(left: pa.Table, right: pa.Table) -> pa.Table:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            ids, asked, v, q, own = sides(left, right)
            cut = np.array([WORST // 4 if c is None else c for c in right["cutoff"].to_pylist()])  # under any part
            least = -(-cut // lists)  # part >= least is part * lists >= cutoff
            # |part| is at most the product of lengths: vectors too short for every query of the block aren't looked at.
            length = lambda x, a, b: np.sqrt((x[:, a:b].astype(float) ** 2).sum(1)) * (1 + 1e-9)
            slope = [np.where(least <= 0, 0, least / np.maximum(length(q, a, b), 1e-9)).min() for a, b in spans]
            near = np.flatnonzero(np.any([length(v, a, b) >= s for s, (a, b) in zip(slope, spans)], axis=0))
            place = np.full(len(ids) + 1, -1)
            place[near] = np.arange(len(near))
            own = place[own]  # -1 stays -1
            for at, parts in Products(q, v[near], spans).tiles():
                for which, part in enumerate(parts):
                    hide_own(part, own[at], WORST)
                    i, j = np.nonzero(part >= least[at, None])
                    for col, x in zip(cols, (asked[at][i], np.full(len(i), which), ids[near][j], part[i, j])):
                        col.append(x)
        return pa.table({n: np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for n, c in zip(("query", "list", "vec", "part"), cols)})

    reported = in_blocks(entries, armed, n_blocks, n_query_blocks, report, "query long, list long, vec long, part long")
    sums = reported.groupBy("query", "vec").agg(F.sum("part").alias("seen"), F.count("*").alias("n_lists"))
    bounded = sums.join(armed.select("query", "cutoff"), "query").where(
        F.col("cutoff").isNull() | (F.col("n_lists") == lists) & (F.col("seen") >= F.col("cutoff"))
        | (F.col("n_lists") < lists) & (F.col("seen") * lists + (lists - F.col("n_lists")) * F.col("cutoff") >= F.col("cutoff") * lists)
    ).checkpoint()
    held = entries.select(F.col("vec").alias("_vec"), "v")
    wide = lambda c: F.concat(F.col(c), F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size(c)))
    exact = F.aggregate(F.zip_with(wide("q"), wide("v"), lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    lacking = bounded.where(F.col("n_lists") < lists).select("query", "vec")
    resolved = (
        lacking.join(queries, "query").join(held, F.col("vec") == F.col("_vec")).select("query", "vec", exact.alias("score"))
        .union(bounded.where(F.col("n_lists") == lists).select("query", "vec", F.col("seen").alias("score")))
    )
    # Entries become rows again: of a query's own entry all rows but its own, and an answer for each row of the query.
    of = rows.select(F.col("vec").alias("_vec"), "vec_id", "copies")
    asks = rows.where(is_query).select(F.col("vec").alias("_query"), F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("query_hash"), F.col("copies").alias("times"))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "vec")
    named = resolved.join(of, F.col("vec") == F.col("_vec")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    n_rows = F.least(F.col("copies") - (F.col("vec") == F.col("query")).cast("long"), F.lit(k)).cast("int")
    each = named.select("query", "vec", "vec_id", "score", F.explode(F.sequence(F.lit(1), n_rows)).alias("c"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "vec", "c"))).where(F.col("rank") <= k)
    answered = ranked.join(asks, F.col("query") == F.col("_query")).withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return answered.select("query_id", "rank", "vec_id", "score", "query_hash")


def search(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """Top ``k`` for the rows whose id is divisible by ``every``, against all rows."""
    return top_k(vectors, F.col("vec_id") % every == 0, k).drop("query_hash")


ORACLE = """
with e as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from e q join e c on q.r <> c.r where q.vec_id % 100 = 0),
r as (select query_id, row_number() over (partition by r order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
