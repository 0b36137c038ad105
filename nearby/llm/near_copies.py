"""Near copies: texts that share at least 0.8 of their five-word shingles (size of the common part over size of the union).

This is the SimHash search at a similarity. Texts of equal shingle sets are one class from the start and have one
fingerprint. Fingerprints at most two bits apart are candidates, found by pivot tables; but at 0.8 they are some 10
bits apart, where pivots discard next to nothing. So a class also goes to ``BANDS`` salted cells, each keyed by
``ROWS`` min-hashes of its shingles; classes of a cell are linked to the cell's smallest class, so a hot cell
makes as many links as it has rows. Groups of classes that these links connect are candidates only: in each group
every pair counts that the exact similarity of whole shingle sets links. Groups too large for a task are compared
with a leader first and what it doesn't link in blocks, so no pair is lost there, and no class has a limit on its
partners. In groups of more than ``MANY`` blocks, such as meetings of half alike texts make of much of a corpus, what
the leader doesn't link is compared cell by cell instead, so a text is sent to each of its cells and not to each block.

A pair of similarity s meets in no cell with probability (1 - s**ROWS) ** BANDS: 1.3e-7 at 0.8, less above it.

Defined results: fewer than five words are one shingle; texts without a word (null and empty ones too) are one
class; repeated rows share a class; documents with a null id take part, but a component's id is the smallest id
that isn't null (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearby.llm.common import annotate, bounded_batches, fresh, slices, texts
from nearby.llm.fingerprints import SEED, majority, words_of
from nearby.llm.pivot_links import links as fingerprint_links
from nearby.operators.components import connected_components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 5
#: Classes and bytes of text in a block of a large group, about.
CELL, CELL_BYTES = 1024, 8 << 20
STEP = 1024
#: Blocks of a group beyond which its texts have fewer cells than blocks to go to.
MANY = BANDS
#: Rows of four numbers that may be broadcast.
FEW = 100_000


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    w = np.fromiter((digest(x, SEED) for x in words), np.uint64, len(words))
    n = max(1, len(w) - width + 1)
    h = np.full(n, min(len(w), width), np.uint64)
    for k in range(min(len(w), width)):
        h = (h ^ w[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def class_of(hashes: np.ndarray) -> int:
    """The number of a shingle set, signed."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def salts() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240301)
    xor, odd = rng.integers(0, 1 << 32, (2, BANDS * ROWS, 1), dtype=np.uint32)
    return xor, odd | np.uint32(1)


def cells_of(hashes: np.ndarray) -> np.ndarray:
    """The cell of each band, signed; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    xor, odd = salts_once()
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), STEP):
        x = h[i : i + STEP] ^ xor
        x *= odd
        np.minimum(low, x.min(axis=1), out=low)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(low.reshape(BANDS, ROWS))], np.int64)


_SALTS: list[tuple[np.ndarray, np.ndarray]] = []


def salts_once() -> tuple[np.ndarray, np.ndarray]:
    if not _SALTS:
        _SALTS.append(salts())
    return _SALTS[0]


def near_forest(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Edges (i, j) of a spanning forest of the sets that share ``similarity`` of their union at least.

    A set is compared with those that nothing has reached yet, so a group of near copies takes few steps.
    """
    share = Fraction(similarity).limit_denominator(1000)  # compared in whole numbers
    p, q = share.numerator, share.denominator
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, edges = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1), []
    at = np.concatenate([[0], np.cumsum(sizes)])
    parts = [flat[a:b] for a, b in zip(at, at[1:])]
    mark = np.zeros(int(flat.max(initial=0)) + 1, bool)
    left = np.arange(len(sets))  # not reached yet
    kept, queue = np.zeros(0, np.int64), []  # the sets that ``pool`` holds
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
            if not len(left):
                break
        if len(kept) > 2 * len(left) or not len(kept):
            kept = left
            pool, starts = np.concatenate([parts[i] for i in kept]), np.concatenate([[0], np.cumsum(sizes[kept])[:-1]])
        x = queue.pop()
        fits = (q * sizes[left] >= p * sizes[x]) & (p * sizes[left] <= q * sizes[x])
        if not fits.any():
            continue
        mark[parts[x]] = True
        common = np.zeros(len(sets), np.int64)
        common[kept] = np.add.reduceat(mark[pool].astype(np.int64), starts)
        mark[parts[x]] = False
        ok = fits & ((p + q) * common[left] >= p * (sizes[left] + sizes[x]))
        edges += [(x, int(i)) for i in left[ok]]
        queue += left[ok].tolist()
        left = left[~ok]
    return edges


def mark_classes(docs: DataFrame, text_col: str, name: str, width: int, more: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the class of each whole text and, on demand, its fingerprint and cells. No shuffle."""
    fields = [T.StructField(name, T.LongType())]
    if more:
        fields += [T.StructField(more[0], T.LongType()), T.StructField(more[1], T.ArrayType(T.LongType()))]

    def compute(column: pa.Array) -> list[pa.Array]:
        sets = [shingles(t, width) for t in texts(column)]
        out = [pa.array([class_of(s) for s in sets], pa.int64())]
        return [*out, pa.array([majority(s) for s in sets], pa.int64()), pa.array([cells_of(s) for s in sets], pa.list_(pa.int64()))] if more else out

    return annotate(docs, [text_col], fields, compute)


def sets_of(nodes: list[int], whole: list[str], width: int) -> dict[int, np.ndarray]:
    """Shingle sets by node. A text whose class isn't its node (of a repeated id) is no text of the node and is passed over."""
    sets: dict[int, np.ndarray] = {}
    for node, text in zip(nodes, whole):
        if node not in sets:
            s = shingles(text, width)
            if len(s) and class_of(s) == node:
                sets[node] = s
    return sets


def forests(groups: DataFrame, similarity: float, width: int) -> DataFrame:
    """Edges (a, b) of a spanning forest of each row's exact links; ``groups`` has lists (nodes, texts) of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            edges: set[tuple[int, int]] = set()
            for nodes, whole in zip(batch.column(0), batch.column(1)):
                sets = sets_of(nodes.as_py(), whole.as_py(), width)
                names = sorted(sets)
                if len(names) > 1:
                    edges.update((names[a], names[b]) for a, b in near_forest([sets[n] for n in names], similarity))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], names=["a", "b"])

    bounded_batches(groups.sparkSession)
    return groups.select("nodes", "texts").mapInArrow(run, "a long, b long")


def linked_to_leaders(members: DataFrame, similarity: float, width: int) -> DataFrame:
    """group, node, linked of ``members`` (group, node, text, leader, leader_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[tuple | None, dict] = (None, {})
        for batch in slices(batches):
            found = []
            for node, text, leader, leader_text in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                if (leader, leader_text) != known[0]:
                    known = (leader, leader_text), sets_of([leader], [leader_text], width)
                sets = known[1] | sets_of([node], [text], width)
                found.append(None if node not in sets else node == leader or len(sets) > 1 and bool(near_forest([sets[leader], sets[node]], similarity)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.bool_())], names=["group", "node", "linked"])

    bounded_batches(members.sparkSession)
    found = members.select("group", "node", "text", "leader", "leader_text").mapInArrow(run, "group long, node long, linked boolean")
    return found.where("linked is not null").groupBy("group", "node").agg(F.bool_or("linked").alias("linked"))


def compared(found: DataFrame, members: DataFrame, bins: DataFrame, keys: list[str], similarity: float, width: int) -> DataFrame:
    """Edges (a, b) of what each bin's members that its group's leader doesn't link have to do with one another and the rest of the bin.

    ``members`` has (keys, node, linked), ``bins`` (keys, n, n_linked, blocks), ``found`` the texts of nodes. A bin of one
    block is compared at once; in others the linked and the rest are dealt out to blocks, and two blocks of linked ones never meet.
    """
    n, one = F.col("n"), F.col("blocks") == 1
    share = lambda count: F.when(one, 1).otherwise(F.greatest(F.lit(1), F.ceil(count * F.col("blocks") / n))).cast("int")
    dealt = bins.select(*keys, one.alias("one"), share(F.col("n_linked")).alias("of_linked"), share(n - F.col("n_linked")).alias("of_rest"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("linked"), F.col("of_linked")).otherwise(F.col("of_rest"))).cast("int")
    pair = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("p"), j.alias("q"))
    over = lambda count, make: F.transform(F.sequence(F.lit(0), F.col(count) - 1), make)
    meets = F.when(F.col("one"), F.array(pair("x", F.lit(0), F.lit(0)))).when(F.col("linked"), over("of_rest", lambda j: pair("x", own, j))).otherwise(
        F.concat(over("of_linked", lambda i: pair("x", i, own)), over("of_rest", lambda j: pair("u", F.least(own, j), F.greatest(own, j)))))
    rest = found.select("node", "text").join(members.join(dealt, keys).select(*keys, "node", F.explode(meets).alias("t")), "node")
    return forests(rest.groupBy(*keys, "t").agg(F.collect_list("node").alias("nodes"), F.collect_list("text").alias("texts")), similarity, width)


def blocks_of(n: Column, size: Column) -> Column:
    """Blocks of so many classes and bytes of text."""
    return F.greatest(F.lit(1), F.ceil(n / CELL), F.ceil(size / CELL_BYTES)).cast("int")


def compared_in_cells(found: DataFrame, flags: DataFrame, vast: DataFrame, cells: DataFrame, similarity: float, width: int) -> DataFrame:
    """Edges (a, b) in the groups ``vast``, compared in the ``cells`` (node, cell) that their members share."""
    size = found.join(vast.select("group"), "group").groupBy("group", "node").agg(F.sum(F.octet_length("text")).alias("size"))
    members = flags.join(size, ["group", "node"]).join(cells, "node").select("group", "cell", "node", "linked", "size").checkpoint()
    bins = members.groupBy("group", "cell").agg(F.count("*").alias("n"), F.count_if("linked").alias("n_linked"), F.sum("size").alias("size")).where("n > 1 and n > n_linked")
    return compared(found, members, bins.withColumn("blocks", blocks_of(F.col("n"), F.col("size"))), ["group", "cell"], similarity, width)


def verified_links(found: DataFrame, similarity: float, width: int, cells: DataFrame) -> DataFrame:
    """Edges (a, b) that connect in each group just what its exact links connect.

    ``found`` has (group, node, degree, text), stored, ``cells`` (node, cell). Groups that a task can take are compared
    whole. In larger ones all are compared with a leader first, the class that most meetings name: those that it links need
    no comparison among themselves, so a large family of near copies costs one look at each. What is left is compared in
    blocks with all of its group, or, in groups of more than ``MANY`` blocks, with what shares a cell with it.
    """
    sizes = found.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"), F.max_by("node", F.struct("degree", "node")).alias("leader"))
    sizes = sizes.withColumn("blocks", blocks_of(F.col("n"), F.col("size"))).checkpoint()
    small = found.join(sizes.where("blocks = 1").select("group"), "group")
    edges = forests(small.groupBy("group").agg(F.collect_list("node").alias("nodes"), F.collect_list("text").alias("texts")), similarity, width)
    most = sizes.agg(F.max("blocks")).first()[0] or 1
    if most == 1:
        return edges.distinct()
    large = sizes.where("blocks > 1").select("group", "leader", "blocks")
    members = found.join(large, "group").withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    leaders = members.where("node = leader").select(F.col("group").alias("_g"), F.col("text").alias("leader_text"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_part"))
    flags = linked_to_leaders(members.join(leaders, (F.col("group") == F.col("_g")) & (F.col("part") == F.col("_part"))), similarity, width).checkpoint()
    led = flags.join(large, "group").where("linked and node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    left = flags.groupBy("group").agg(F.count("*").alias("n"), F.count_if("linked").alias("n_linked")).where("n > n_linked")
    if left.isEmpty():
        return edges.union(led).distinct()
    bins, many = left.join(large, "group"), F.col("blocks") > MANY
    edges = edges.union(led).union(compared(found, flags, bins.where(~many), ["group"], similarity, width))
    if most > MANY:
        edges = edges.union(compared_in_cells(found, flags, bins.where(many), cells, similarity, width))
    return edges.distinct()


def meeting_points(classes: DataFrame) -> DataFrame:
    """(cell, low, n) of the cells where classes meet: the smallest class and how many."""
    dealt = classes.select("class", F.explode("cells").alias("cell"))
    return dealt.groupBy("cell").agg(F.min("class").alias("low"), F.count("*").alias("n")).where("n > 1")


def candidates(classes: DataFrame, first: DataFrame) -> DataFrame:
    """Edges (a, b) of ``classes`` (class, fp, cells) that meet in a cell of ``first``, or whose fingerprints link or are equal."""
    prints = classes.where(F.size("cells") > 0).groupBy("fp").agg(F.min("class").alias("low")).checkpoint()
    hub = lambda name: prints.select(F.col("fp").alias(f"_{name}"), F.col("low").alias(name))
    close = fingerprint_links(prints.select("fp")).withColumnsRenamed({"a": "x", "b": "y"})
    close = close.join(hub("a"), F.col("x") == F.col("_a")).join(hub("b"), F.col("y") == F.col("_b")).select("a", "b")
    same = classes.where(F.size("cells") > 0).select("class", "fp").join(prints, "fp").where("class <> low").select(F.col("class").alias("a"), F.col("low").alias("b"))
    dealt = classes.select("class", F.explode("cells").alias("cell"))
    meet = dealt.join(first.select("cell", "low"), "cell").where("class <> low").select(F.col("class").alias("a"), F.col("low").alias("b"))
    return meet.union(same).union(close)


def links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, similarity: float, width: int) -> DataFrame:
    """Exact links (a, b) between ``classes`` (class, id, fp, cells) of ``docs``."""
    first = meeting_points(classes).checkpoint()
    groups = connected_components(candidates(classes, first)).select(F.col("node").alias("class"), F.col("component").alias("group"))
    degree = first.groupBy(F.col("low").alias("class")).agg(F.sum("n").alias("degree"))
    wanted = classes.select("class", F.col("id").alias("_id")).join(groups, "class").join(degree, "class", "left")
    wanted = wanted.select("group", F.col("class").alias("node"), F.coalesce("degree", F.lit(0)).alias("degree"), "_id").checkpoint()
    texts_of = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).where("text is not null")
    side = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    found = texts_of.join(side, F.col("_doc") == F.col("_id")).select("group", "node", "degree", "text")
    if not wanted.where("_id is null").isEmpty():
        # Classes without an id are found by their texts.
        nameless = mark_classes(texts_of.where("_doc is null").select("text"), "text", "_class", width).dropDuplicates(["_class"])
        found = found.union(nameless.join(wanted.where("_id is null"), F.col("_class") == F.col("node")).select("group", "node", "degree", "text"))
    cells = classes.select(F.col("class").alias("node"), F.explode("cells").alias("cell"))
    return verified_links(found.checkpoint(), similarity, width, cells)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """The kept columns of ``docs`` (its id by default), ``component_id`` (the smallest id that links lead to) and a number of the component."""
    keep = [id_col] if keep is None else keep
    cls, fp, cells, cid, number = (fresh(n, [*keep, text_col]) for n in ("class", "fp", "cells", "component_id", "component"))
    marked = mark_classes(docs.select(*dict.fromkeys([*keep, id_col, text_col])), text_col, cls, width, (fp, cells)).select(*keep, cls, fp, cells).checkpoint()
    classes = marked.groupBy(F.col(cls).alias("class")).agg(F.min(id_col).alias("id"), F.first(fp).alias("fp"), F.first(cells).alias("cells")).checkpoint()
    joined = connected_components(links(docs, classes, id_col, text_col, similarity, width))
    named = classes.select("class", "id").join(joined, F.col("class") == F.col("node"), "left").select("class", "id", F.coalesce("component", "class").alias(number))
    smallest = named.groupBy(number).agg(F.min("id").alias(cid))
    label = named.join(smallest, number).select(F.col("class").alias("_class"), cid, number)
    return marked.select(*keep, cls).join(label, F.col(cls) == F.col("_class")).select(*keep, cid, number)


def text_hash(text_col: str) -> Column:
    """Tells the texts of rows apart that repeat an id or have none; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def keep_first(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, h: str, component: str) -> DataFrame:
    """One row of ``docs`` of each component of ``found`` (id, hash of the text, component): of the smallest id (null last), then of the least hash."""
    key, n = [fresh(x, docs.columns) for x in ("winner_id", "winner_hash")], fresh("n", docs.columns)
    first = Window.partitionBy(component).orderBy(F.col(id_col).asc_nulls_last(), h)
    alike = found.groupBy(id_col, h, component).agg(F.count("*").alias(n))
    winners = alike.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").select(F.col(id_col).alias(key[0]), F.col(h).alias(key[1]), n).checkpoint()
    same = F.col(id_col).eqNullSafe(F.col(key[0])) & (text_hash(text_col) == F.col(key[1]))
    once = docs.join(winners.where(F.col(n) == 1), same, "left_semi")
    # Few rows, if any, repeat a winner's id and text; only those are shuffled whole a second time.
    repeated = winners.where(F.col(n) > 1)
    if repeated.isEmpty():
        return once
    hashed = fresh("hash", docs.columns)
    return once.union(docs.join(repeated, same, "left_semi").withColumn(hashed, text_hash(text_col)).dropDuplicates([id_col, hashed]).drop(hashed))
