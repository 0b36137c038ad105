"""SimHash fingerprints and their pivot distance tables.

A fingerprint bit is the majority of that bit over the hashes of all shingles of a text. A pivot table holds a
fingerprint's Hamming distances to fixed reference fingerprints; it is computed once for each fingerprint, as
columns. Distances are kept whole (for the discard by the maximum coordinate difference) and by byte of the
fingerprint: two fingerprints that agree in a byte have equal distances there to every reference, so equal
coordinates are where links can meet.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
#: References in the whole table (one byte each in two longs), and those of them in the tables by byte (4 bits each in a long).
PIVOTS, BYTE_PIVOTS = 16, 12


def words_of(text: str) -> list[bytes]:
    """Words with A-Z lowered, cut at space and 09-0D."""
    return text.encode("utf-8", "replace").lower().split()  # of bytes


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed 64-bit number."""
    ones, h = np.zeros(64, np.int64), hashes.astype("<u8", copy=False)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: str, width: int) -> int:
    """The fingerprint of a text's shingles of ``width`` words, repeats included, as a signed 64-bit number."""
    words = words_of(text)
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[width - 1 :] - 1 if len(words) >= width else ends[-1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops)), "<u8", n))


def pivots() -> list[int]:
    """Fixed reference fingerprints, signed; random ones spread distances best."""
    return np.random.default_rng(20240229).integers(-(1 << 63), 1 << 63, PIVOTS, dtype=np.int64, endpoint=False).tolist()


def packed(parts: list[Column], bits: int) -> Column:
    return reduce(Column.bitwiseOR, (F.shiftleft(x.cast("long"), bits * i) for i, x in enumerate(parts)))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def whole_table(fp: Column) -> list[Column]:
    """Distances of a fingerprint to all references: two longs of a byte for each distance."""
    d = [F.bit_count(fp.bitwiseXOR(F.lit(p))) for p in pivots()]
    return [packed(d[:8], 8), packed(d[8:], 8)]


def byte_tables(fp: Column) -> list[Column]:
    """For each byte of the fingerprint, its distances to the references there, in one long."""
    return [packed([F.bit_count(fp.bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(signed(0xFF << 8 * b)))) for p in pivots()[:BYTE_PIVOTS]], 4) for b in range(8)]


def as_table(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows of the whole table from its two longs."""
    return np.stack([low, high], 1).astype("<i8").view(np.int8).reshape(-1, PIVOTS)


def near(x: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) of places in ``x`` that are at most ``most`` bits apart: first pairs with a larger
    difference in any coordinate of the table are discarded, a few coordinates at a time, then the rest are verified."""
    for p in range(0, PIVOTS, 4):
        ok = (np.abs(table[i, p : p + 4] - table[j, p : p + 4]) <= most).all(1)
        i, j = i[ok], j[ok]
    ok = np.bitwise_count((x[i] ^ x[j]).view(np.uint64)) <= most
    return i[ok], j[ok]


def forest(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, smaller root value) of a spanning forest of the pairs (a, b) of places in ascending ``values``."""
    root = np.arange(len(values))
    while len(a):  # hook to the smallest neighbour, then jump; done when all ends agree
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        still = root[a] != root[b]
        a, b = a[still], b[still]
    at = np.flatnonzero(root != np.arange(len(values)))
    return values[at], values[root[at]]
