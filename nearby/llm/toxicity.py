"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased runs of letters, digits and non-ASCII characters. A text's features are
the set of its hashed words, word pairs and pairs with one word skipped. FTRL-proximal keeps a
rate for each coordinate and sets most weights to exactly zero (L1), so what is broadcast to
score the corpus is the short list of the weights that are left.

Defined results: a null or empty text has no features and gets the score of the bias alone;
repeated rows get equal scores, one for each row; without any label of both kinds every score
is the share of toxic labels (0 if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearby.llm.common import annotate, bounded_batches, crc32_fold, fresh, labelled_sample, sigmoid, slices, texts

#: ASCII characters that end a word.
BREAKS = bytes(b for b in range(128) if not chr(b).isalnum())
FOLD = bytes.maketrans(BREAKS, b" " * len(BREAKS))
#: Odd multipliers for hashing words, pairs and skipped pairs apart.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


@dataclass(frozen=True)
class FtrlParams:
    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.01
    epochs: int = 4
    #: The largest number of labelled texts that are learned from.
    most_rows: int = 12_000


@dataclass(frozen=True)
class SparseModel:
    bits: int
    bias: float
    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.index] = self.weight
        return w


def features(text: str, bits: int) -> np.ndarray:
    """Hashed words, pairs and skipped pairs of a text, repeats included."""
    words = text.lower().encode("utf-8", "replace").translate(FOLD).split()
    h = np.fromiter(map(crc32, words), np.uint64, len(words)) + np.uint64(1)
    one, two, three, four, five = MIX
    shift = np.uint64(64 - bits)
    return np.concatenate([(h * one), (h[:-1] * two + h[1:] * three), (h[:-2] * four + h[2:] * five) * one]) >> shift


def fit_ftrl(rows: list[tuple[int, np.ndarray]], p: FtrlParams) -> SparseModel:
    """Learn from (label, distinct features) rows, in their order, ``epochs`` times."""
    size = 1 << p.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    positive = sum(y for y, _ in rows)
    if positive in (0, len(rows)):
        share = positive / len(rows) if rows else 0.0
        return SparseModel(p.bits, float(np.log((share + 1e-9) / (1 - share + 1e-9))), np.zeros(0, np.int64), np.zeros(0, np.float32))

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == size, 0.0, p.l1)  # the bias isn't shrunk
        return np.where(np.abs(z[at]) <= l1, 0.0, (np.sign(z[at]) * l1 - z[at]) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for y, at in rows:
            at = np.append(at, size)
            w = weights(at)
            g = float(sigmoid(w.sum())) - y
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / p.alpha * w
    w = weights(np.arange(size + 1))
    kept = np.flatnonzero(w[:size])
    return SparseModel(p.bits, float(w[size]), kept, w[kept].astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, train_when: Column, label: str = "toxic", text_col: str = "text", id_col: str = "doc_id", params: FtrlParams = FtrlParams()) -> SparseModel:
    """Fit on at most ``params.most_rows`` labelled texts. Features are hashed where the texts are;
    one task sees the sample's hashes, ordered by a hash of the id so that a rerun gives the same model."""
    sample = labelled_sample(docs, labels, label, text_col, id_col, train_when, params.most_rows)
    bits = params.bits

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [np.unique(features(t, bits)).astype(np.uint32).tobytes() for t in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("order"), b.column("y"), pa.array(sets, pa.binary())], names=["order", "y", "at"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((o, y, at) for b in batches for o, y, at in zip(*(b.column(i).to_pylist() for i in range(3))))
        m = fit_ftrl([(y, np.frombuffer(at, np.uint32).astype(np.int64)) for _, y, at in rows], params)
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([m.index.astype(np.int64).tobytes()], pa.binary()), pa.array([m.weight.tobytes()], pa.binary())], names=["bias", "at", "w"])

    bounded_batches(docs.sparkSession)
    row = sample.mapInArrow(hashed, "order long, y int, at binary").repartition(1).mapInArrow(fit, "bias double, at binary, w binary").collect()[0]
    return SparseModel(bits, row["bias"], np.frombuffer(bytes(row["at"]), np.int64), np.frombuffer(bytes(row["w"]), np.float32))


def score(docs: DataFrame, model: SparseModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column of the model's probabilities. The model is at most 2**bits weights (12 bytes each), whatever the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    dense: list[np.ndarray] = []

    def compute(column: pa.Array) -> list[pa.Array]:
        m = shared.value
        if not dense:
            dense.append(m.dense())
        w, out = dense[0], []
        for text in texts(column):
            at = features(text, m.bits)
            out.append(m.bias + float(w[np.unique(at[w[at] != 0])].sum()))
        return [pa.array(sigmoid(np.array(out)), pa.float64())]

    return annotate(docs, [text_col], [T.StructField(name, T.DoubleType())], compute)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc32_fold(F.col(id_col), 5) == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; learned from the ids that aren't held out."""
    model = train(docs, labels, ~held_out(), params=params)
    scored = score(docs.select("doc_id", "text"), model).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams()) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with their own columns."""
    model = train(docs, labels, ~held_out(), params=params)
    name = fresh("toxicity", docs.columns)
    return score(docs, model, name=name).where(F.col(name) < 0.5).drop(name)
