"""Alignment of two tokenizers over a corpus: which tokens of one stand where which tokens of the other do.

A text's bytes are cut where tokens of both end; a group is what lies between two cuts. Tokens are linked if
their byte ranges overlap. A pair's count is the number of documents that hold it linked.

An array gives for each id of A the id of B with the same bytes, if there is one (the identity map). Groups of one
token each are nearly always of this kind: their documents are counted in vectors as long as A's vocabulary, one for
each task. Only pairs that the map doesn't name are shuffled, summed by task first. To look counts up again, the
vectors, the best count of each id of A and the commonest other pairs go to the tasks, ``HOT`` at most; rarer
pairs are joined. A pair that stands in many documents is therefore never a join key.

Neither tokenizer joins letters across a space or line end between two characters that aren't white space, so texts are
cut there and the stretches' alignments kept in a cache bounded by bytes; a text that has other white space is aligned
whole. Both passes over the texts align anew rather than store pairs.

Defined results: texts that are null or empty or whose tokens' bytes aren't a space and the text have no tokens:
zeros and an empty digest; repeated rows count as documents each; a null id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearby.llm.bpe import byte_letters
from nearby.llm.common import annotate, bounded_batches, slices, texts
from nearby.llm.vocab import public_path, read_json

#: Bytes of a worker's cache.
CACHE_BYTES = 160 << 20
#: Pairs, besides those of the identity map, whose counts go to all tasks (16 bytes each).
HOT = 1 << 18
#: Pairs that a task sums before it hands them on.
MOST_PAIRS, BUFFER = 1 << 20, 1 << 22
SPACE_MARK = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


#: The alignment of a stretch of text: numbers of tokens of A and B and of groups (three longs), its links (longs) and its
#: groups as text, each closed by a semicolon. ``None`` stands for one that can't be aligned.
Form = tuple[bytes, bytes, bytes]
#: Stretches that are encoded as one text.
MANY = 1024


class Cache:
    """Stretch -> alignment, for about ``most`` bytes; what comes later is aligned again in each batch."""

    #: Bytes of an entry besides its letters and links.
    ENTRY = 420

    def __init__(self, make: Callable[[list[str]], Iterable[Form | None]], most: int):
        self.make, self.left, self.known = make, most, {}

    def of(self, keys: set[str]) -> dict[str, Form | None]:
        missing = [k for k in keys if k not in self.known]
        if not missing:
            return self.known
        made = dict(zip(missing, self.make(missing)))
        if self.left > 0:
            self.left -= self.ENTRY * len(made) + sum(map(len, made)) + sum(len(f[1]) + len(f[2]) for f in made.values() if f)
            self.known.update(made)
            return self.known
        return {k: made[k] if k in made else self.known[k] for k in keys}


class Aligner:
    """Both tokenizers, the bytes of their tokens and the identity map."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        letters = byte_letters()
        vocab = read_json(path_a)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            if all(c in letters for c in piece):
                self.bytes_a[i] = bytes(letters[c] for c in piece)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := BYTE_PIECE.fullmatch(x)) else x.replace(SPACE_MARK, " ").encode() for i, x in enumerate(names)]
        self.width = len(names)
        same: dict[bytes, int] = {}
        for i, raw in enumerate(self.bytes_b):
            if not (self.b.is_control(i) or self.b.is_unknown(i)) and (raw not in same or self.b.is_byte(same[raw])):
                same[raw] = i
        #: The B id of the same bytes, -1 if there is none. A piece goes before a byte.
        self.identity = np.array([same.get(raw, -1) if raw else -1 for raw in self.bytes_a], np.int64)
        self.lengths = np.array([len(x) for x in self.bytes_a]), np.array([len(x) for x in self.bytes_b])
        #: Decimal ids with what follows them inside a group and at the end of its half.
        table = lambda n, mark: np.array([b"%d%s" % (i, mark) for i in range(n)], object)
        self.inside = table(len(self.bytes_a), b","), table(self.width, b",")
        self.closing = table(len(self.bytes_a), b"|"), table(self.width, b";")
        self.mark = self.b.piece_to_id(SPACE_MARK)
        #: Whether B may be cut before a space and before a line end: no piece goes on there.
        self.cuts = not any(re.search(rf"[^{SPACE_MARK}]{SPACE_MARK}|\n", x) for x in names) and self.bytes_b[self.mark] == b" "
        self.plain = Cache(self.plain_forms, CACHE_BYTES)

    def encoded(self, whole: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text that starts with a space, or with a line end that a text has inside."""
        a = self.a.encode_batch_fast([whole], add_special_tokens=False)[0].ids
        b = self.b.encode(whole[1:] if whole[0] == " " else whole)
        if whole[0] != " ":  # without the space that B puts in front
            b = b[1:] if b[:1] == [self.mark] else []
        return np.array(a, np.int64), np.array(b, np.int64)

    def plain_forms(self, keys: list[str]) -> Iterator[Form | None]:
        """Forms of stretches between single spaces, which they lack, or from a line end on; None also for those that a text may
        not be cut around. The others may stand one after another in one text, so many are aligned at once."""
        cores = [k[1:] if k[:1] == "\n" else k for k in keys]
        fits = [bool(c) and not c[0].isspace() and not c[-1].isspace() for c in cores]
        whole = [k if k[0] == "\n" else " " + k for k, ok in zip(keys, fits) if ok]
        made = iter([f for i in range(0, len(whole), MANY) for f in self.aligned(whole[i : i + MANY])])
        return (next(made) if ok else None for ok in fits)

    def aligned(self, whole: list[str]) -> list[Form | None]:
        """The alignments of stretches that make up a text; one by one if together they don't hold."""
        raws = [w.encode("utf-8", "replace") for w in whole]
        raw = b"".join(raws)
        a, b = self.encoded("".join(whole)) if raw else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        stops = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))
        same = raw and b"".join(map(self.bytes_a.__getitem__, a.tolist())) == raw and b"".join(map(self.bytes_b.__getitem__, b.tolist())) == raw
        if same:
            ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
            cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)  # tokens have bytes
            same = len(whole) == 1 or np.array_equal(cuts[np.minimum(np.searchsorted(cuts, stops), len(cuts) - 1)], stops)
        if not same:
            return [f for w in whole for f in self.aligned([w])] if len(whole) > 1 else [None]
        ends = np.union1d(ends_a, ends_b)  # between two of them one token of A meets one of B
        links = a[np.searchsorted(ends_a, ends)] * self.width + b[np.searchsorted(ends_b, ends)]
        of_a, of_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)  # groups
        before = np.concatenate([[0], np.searchsorted(ends_b, cuts[:-1], "right")])
        text = np.empty(len(a) + len(b), object)
        text[np.arange(len(a)) + before[of_a]] = np.where(cuts[of_a] == ends_a, self.closing[0][a], self.inside[0][a])
        text[np.arange(len(b)) + np.searchsorted(ends_a, cuts, "right")[of_b]] = np.where(cuts[of_b] == ends_b, self.closing[1][b], self.inside[1][b])
        n_a, n_b, n_groups, n_links = (np.searchsorted(e, stops, "right") for e in (ends_a, ends_b, cuts, ends))
        counts = np.diff(np.stack([n_a, n_b, n_groups], axis=1), axis=0, prepend=0).astype("<i8").tobytes()
        links, text = links.astype("<i8").tobytes(), text.tolist()
        to_links, to_text = (8 * n_links).tolist(), (n_a + n_b).tolist()
        return [(counts[24 * k : 24 * k + 24], links[i:j], b"".join(text[x:y])) for k, (i, j, x, y) in enumerate(zip([0, *to_links], to_links, [0, *to_text], to_text))]

    def align(self, batch: list[str]) -> list[list[Form] | None]:
        """The alignments of each text's stretches, in order; None if it has no tokens. Stretches are cut before single spaces and line ends."""
        cuts = [t.replace("\n", " \n").split(" ") if self.cuts and t and not t[0].isspace() else None for t in batch]
        known = self.plain.of(set(chain.from_iterable(c for c in cuts if c)))
        out = []
        for text, keys in zip(batch, cuts):
            found = list(map(known.__getitem__, keys)) if keys else [None]
            if None in found and text:
                found = self.aligned([" " + text])
            out.append(None if None in found else found)
        return out


@lru_cache(maxsize=2)
def worker(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


@dataclass(frozen=True)
class Vocabularies:
    """Files of the two tokenizers."""

    a: str
    b: str


def public_vocabularies() -> Vocabularies:
    return Vocabularies(public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))


def distinct_links(forms: list[Form]) -> tuple[np.ndarray, np.ndarray]:
    """A document's distinct links and how often each stands in it."""
    return np.unique(np.frombuffer(b"".join([f[1] for f in forms]), "<i8"), return_counts=True)


def groups(docs: DataFrame, vocabularies: Vocabularies | None = None, text_col: str = "text", name: str = "groups") -> DataFrame:
    """``docs`` with the groups of each whole text, in order: arrays of ids of A and of B. Null for texts without tokens."""
    v = vocabularies or public_vocabularies()
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def compute(column: pa.Array) -> list[pa.Array]:
        numbers = lambda x: list(map(int, x.split(",")))
        rows = [None if f is None else [dict(zip("ab", map(numbers, g.split("|")))) for x in f for g in x[2].decode()[:-1].split(";")] for f in worker(v.a, v.b).align(texts(column))]
        return [pa.array(rows, kind)]

    ids = T.ArrayType(T.IntegerType())
    return annotate(docs, [text_col], [T.StructField(name, T.ArrayType(T.StructType([T.StructField("a", ids), T.StructField("b", ids)])))], compute)


def summed(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    return keys, np.bincount(at, np.concatenate(counts), len(keys)).astype(np.int64)


def raw_counts(docs: DataFrame, v: Vocabularies, text_col: str, most: int = MOST_PAIRS) -> DataFrame:
    """(same, key, n) sums of tasks: documents of pairs of the identity map under their A id, of other pairs under their pair's number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda same, keys, n: pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), same)), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["same", "key", "n"])
        aligner, vector, parts, counts, held = None, None, [], [], 0
        for batch in slices(batches):
            if aligner is None:
                aligner = worker(v.a, v.b)
                vector = np.zeros(len(aligner.identity), np.int64)
            links = [distinct_links(f)[0] for f in aligner.align(texts(batch.column(0))) if f]
            if not links:
                continue
            keys = np.concatenate(links)
            a, b = np.divmod(keys, aligner.width)
            same = aligner.identity[a] == b
            vector += np.bincount(a[same], minlength=len(vector))
            other, n = np.unique(keys[~same], return_counts=True)
            parts.append(other)
            counts.append(n)
            held += len(other)
            if held > BUFFER:
                other, n = summed(parts, counts)
                parts, counts, held = ([], [], 0) if len(other) > most else ([other], [n], len(other))
                if not parts:
                    yield out(False, other, n)
        if parts:
            yield out(False, *summed(parts, counts))
        if vector is not None:
            at = np.flatnonzero(vector)
            yield out(True, at, vector[at])

    bounded_batches(docs.sparkSession)
    return docs.select(text_col).mapInArrow(count, "same boolean, key long, n long")


@dataclass(frozen=True)
class Counts:
    """Corpus-wide counts: of the identity map's pairs by A id, the best of each A id, the commonest other pairs, and all of those as a table (key, n)."""

    same: np.ndarray
    best: np.ndarray
    hot: np.ndarray
    hot_n: np.ndarray
    others: DataFrame
    rare: bool


def corpus_counts(docs: DataFrame, v: Vocabularies, text_col: str = "text", hot: int = HOT) -> Counts:
    aligner = worker(v.a, v.b)
    size, width = len(aligner.identity), aligner.width
    sums = raw_counts(docs, v, text_col).checkpoint()
    same, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in sums.where("same").groupBy("key").agg(F.sum("n").alias("n")).collect():  # A's vocabulary at most
        same[r["key"]] = r["n"]
    others = sums.where("not same").groupBy("key").agg(F.sum("n").alias("n")).checkpoint()
    for r in others.groupBy(F.floor(F.col("key") / width).alias("a")).agg(F.max("n").alias("n")).collect():  # likewise
        best[r["a"]] = r["n"]
    best = np.maximum(best, same)
    # The least count whose pairs and all commoner ones are ``hot`` at most: counts are rounded down to eighths of powers of two.
    power = F.floor(F.log2("n"))
    level = (power * 8 + F.floor(F.col("n") / F.pow(F.lit(2.0), power) * 8) - 8).cast("long")
    levels = sorted(((r["level"], r["least"], r["n"]) for r in others.groupBy(level.alias("level")).agg(F.min("n").alias("least"), F.count("*").alias("n")).collect()), reverse=True)
    least, held, rare = None, 0, False
    for _, low, n in levels:
        if held + n > hot:
            rare = True
            break
        least, held = low, held + n
    rows = sorted((r["key"], r["n"]) for r in others.where(F.col("n") >= least).collect()) if least is not None else []
    keys, counts = (np.array(c, np.int64) for c in (zip(*rows) if rows else ((), ())))
    return Counts(same, best, keys, counts, others, rare)


def pair_counts(docs: DataFrame, vocabularies: Vocabularies | None = None, text_col: str = "text") -> DataFrame:
    """a_id, b_id, n_docs: how many documents hold each pair linked."""
    v = vocabularies or public_vocabularies()
    aligner = worker(v.a, v.b)
    sums = raw_counts(docs, v, text_col)
    others = sums.where("not same").groupBy("key").agg(F.sum("n").alias("n_docs"))
    same = sums.where("same").groupBy("key").agg(F.sum("n").alias("n_docs"))
    mapped = docs.sparkSession.createDataFrame([(i, int(b)) for i, b in enumerate(aligner.identity) if b >= 0] or [(-1, -1)], "key long, b_id long")
    width = aligner.width
    return same.join(mapped, "key").select(F.col("key").alias("a_id"), "b_id", "n_docs").union(others.select(F.floor(F.col("key") / width).alias("a_id"), (F.col("key") % width).alias("b_id"), "n_docs"))


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align(docs: DataFrame, vocabularies: Vocabularies | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, the counts of ``FIELDS`` and groups_sha256 for each row of ``docs``."""
    v = vocabularies or public_vocabularies()
    docs = docs.select("doc_id", "text")
    counts = corpus_counts(docs, v, hot=hot)
    shared = docs.sparkSession.sparkContext.broadcast((counts.same, counts.best, counts.hot, counts.hot_n))
    rare = counts.rare

    def compute(column: pa.Array) -> list[pa.Array]:
        aligner, (same, best, hot_keys, hot_n) = worker(v.a, v.b), shared.value
        rows, digests, left = [], [], []
        for forms in aligner.align(texts(column)):
            if not forms:
                rows.append((0,) * len(FIELDS))
                digests.append("")
                left.append([])
                continue
            sizes = np.frombuffer(b"".join([f[0] for f in forms]), "<i8").reshape(-1, 3).sum(0).tolist()
            keys, times = distinct_links(forms)
            a, b = np.divmod(keys, aligner.width)
            known = aligner.identity[a] == b
            n = np.where(known, same[a], 0)
            if len(hot_keys):
                at = np.minimum(np.searchsorted(hot_keys, keys), len(hot_keys) - 1)
                found = ~known & (hot_keys[at] == keys)
                n[found] = hot_n[at[found]]
                known |= found
            rows.append((*sizes, int(times.sum()), int(times[known & (n == best[a])].sum()), int((times * n)[known].sum())))
            digests.append(hashlib.sha256(b"".join([f[2] for f in forms])[:-1]).hexdigest())
            if rare:
                left.append([{"key": int(k), "times": int(t), "best": int(x)} for k, t, x in zip(keys[~known], times[~known], best[a[~known]])])
        out = [*(pa.array(c, pa.int64()) for c in zip(*rows)), pa.array(digests, pa.string())]
        return [*out, pa.array(left, pa.list_(pa.struct([("key", pa.int64()), ("times", pa.int64()), ("best", pa.int64())])))] if rare else out

    fields = [*(T.StructField(x, T.LongType()) for x in FIELDS), T.StructField("groups_sha256", T.StringType())]
    if not rare:
        return annotate(docs, ["text"], fields, compute).drop("text")
    pair = T.StructType([T.StructField(x, T.LongType()) for x in ("key", "times", "best")])
    found = annotate(docs, ["text"], [*fields, T.StructField("left", T.ArrayType(pair))], compute).drop("text")
    found = found.withColumn("row", F.monotonically_increasing_id()).checkpoint()  # the numbers stay as written
    links = found.select("row", F.explode("left").alias("l")).select("row", "l.*").join(counts.others, "key")
    more = links.groupBy(F.col("row").alias("_row")).agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    whole = found.join(more, F.col("row") == F.col("_row"), "left")
    plus = {"n_best": "_best", "count_sum": "_sum"}
    return whole.select("doc_id", *((F.col(x) + F.coalesce(plus[x], F.lit(0))).alias(x) if x in plus else F.col(x) for x in FIELDS), "groups_sha256")
