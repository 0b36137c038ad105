"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text gives ``len(STATS)`` dense inputs in 0..1 (structure and the size metadata) and one input
for each distinct hashed word. All pairs of inputs interact through low-rank factors; the pair
sum is had in linear time as half of (square of the sum - sum of the squares) for each factor.

Defined results: null and empty texts have all-zero inputs and score as the bias says; repeated
rows get equal scores; without labels of both kinds every score is the share of label 1 (0 if none).
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

from nearby.llm.common import annotate, bounded_batches, crc32_fold, labelled_sample, sigmoid, slices, texts

STATS = ("length", "symbols", "pipes", "bangs", "capitals", "digits", "distinct", "stutter", "repeated_lines", "word_length", "line_length", "stops")
SYMBOLS, UPPER, DIGITS = b"#*$%&<>@^~=+{}[]", bytes(range(65, 91)), bytes(range(48, 58))


@dataclass(frozen=True)
class FmParams:
    bits: int = 13
    rank: int = 6
    rate: float = 0.1
    l2: float = 1e-4
    epochs: int = 6
    seed: int = 7
    #: The largest number of labelled texts that are learned from.
    most_rows: int = 8_000


@dataclass(frozen=True)
class FmModel:
    bias: float
    w: np.ndarray
    v: np.ndarray
    bits: int

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        own = self.v[at] * x[:, None]
        sums = own.sum(0)
        return self.bias + float(self.w[at] @ x) + 0.5 * float(sums @ sums - (own * own).sum())


def inputs(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's inputs; statistics first, then distinct hashed words of equal value."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    less = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    stats = np.array([
        np.log1p(len(raw)) / 16, less(SYMBOLS) / n, less(b"|") / n, less(b"!") / n, 3 * less(UPPER) / size, 3 * less(DIGITS) / size,
        len(set(words)) / n, sum(map(bytes.__eq__, words, words[1:])) / n, 1 - len(set(lines)) / len(lines) if lines else 0.0,
        size / n / 30, n / max(1, len(lines)) / 200, less(b".") / n,
    ])
    h = np.unique(np.fromiter(map(crc32, raw.lower().split()), np.int64, len(words)) & ((1 << bits) - 1))
    at = np.concatenate([np.arange(len(STATS)), h + len(STATS)])
    value = np.concatenate([np.clip(stats, 0, 1) if words else np.zeros(len(STATS)), np.full(len(h), 1 / np.sqrt(max(1, len(h))))])
    return at, value


def fit_fm(rows: list[tuple[int, np.ndarray, np.ndarray]], p: FmParams) -> FmModel:
    """Logistic loss by AdaGrad over (label, indices, values) rows, in their order."""
    size, rng = len(STATS) + (1 << p.bits), np.random.default_rng(p.seed)
    w, v, b = np.zeros(size), rng.normal(0, 0.05, (size, p.rank)), 0.0
    share = sum(y for y, *_ in rows) / len(rows) if rows else 0.0
    if share in (0.0, 1.0):
        return FmModel(float(np.log((share + 1e-9) / (1 - share + 1e-9))), np.zeros(size), np.zeros((size, p.rank)), p.bits)
    gw, gv, gb = np.full(size, 1e-6), np.full((size, p.rank), 1e-6), 1e-6
    for _ in range(p.epochs):
        for y, at, x in rows:
            va = v[at]
            own = va * x[:, None]
            sums = own.sum(0)
            g = float(sigmoid(b + w[at] @ x + 0.5 * (sums @ sums - (own * own).sum()))) - y
            dw, dv = g * x + p.l2 * w[at], g * (x[:, None] * sums - va * (x * x)[:, None]) + p.l2 * va
            gb += g * g
            gw[at] += dw * dw
            gv[at] += dv * dv
            b -= p.rate * g / np.sqrt(gb)
            w[at] -= p.rate * dw / np.sqrt(gw[at])
            v[at] -= p.rate * dv / np.sqrt(gv[at])
    return FmModel(float(b), w, v, p.bits)


def train(docs: DataFrame, labels: DataFrame, train_when: Column, label: str = "quality", text_col: str = "text", id_col: str = "doc_id", params: FmParams = FmParams()) -> FmModel:
    """Fit on at most ``params.most_rows`` labelled texts; inputs are computed where the texts are, one task learns."""
    sample = labelled_sample(docs, labels, label, text_col, id_col, train_when, params.most_rows)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            both = [inputs(t, params.bits) for t in texts(b.column("text"))]
            columns = [pa.array([at.astype(np.int32).tobytes() for at, _ in both], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in both], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("order"), b.column("y"), *columns], names=["order", "y", "at", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(4))))
        m = fit_fm([(y, np.frombuffer(at, np.int32), np.frombuffer(x, np.float32).astype(float)) for _, y, at, x in rows], params)
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([m.w.tobytes()], pa.binary()), pa.array([m.v.tobytes()], pa.binary())], names=["bias", "w", "v"])

    bounded_batches(docs.sparkSession)
    row = sample.mapInArrow(made, "order long, y int, at binary, x binary").repartition(1).mapInArrow(fit, "bias double, w binary, v binary").collect()[0]
    return FmModel(row["bias"], np.frombuffer(bytes(row["w"])), np.frombuffer(bytes(row["v"])).reshape(-1, params.rank), params.bits)


def score(docs: DataFrame, model: FmModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the model's probabilities. The model's size is fixed by its parameters (2**bits * (rank + 1) numbers)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(column: pa.Array) -> list[pa.Array]:
        m = shared.value
        return [pa.array(sigmoid(np.array([m.raw(*inputs(t, m.bits)) for t in texts(column)])), pa.float64())]

    return annotate(docs, [text_col], [T.StructField(name, T.DoubleType())], compute)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc32_fold(F.col(id_col), 3) == 1, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, params: FmParams = FmParams()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; learned from the ids that aren't held out."""
    model = train(docs, labels, ~held_out(), params=params)
    scored = score(docs.select("doc_id", "text"), model).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
