"""Byte-pair encoding and decoding with a public vocabulary.

A piece's symbols are a doubly linked list. Every adjacent pair that has a merge is in a priority
queue by (rank, position); a popped pair is skipped if either symbol has changed since, else its
two symbols become one and the pairs at its new borders are queued. Decoding concatenates the
vocabulary's byte strings and reads them as UTF-8.

A space between two characters that aren't white space always starts a piece, so distinct words
between such spaces are encoded once for a worker's cache; other texts are cut into chunks around
white space. The finer split and the merges are as the vocabulary file says.
Special tokens named by the file are recognised in texts. Defined results: null and empty texts
have no ids and decode to the empty text; repeated rows are encoded each; the order of rows
doesn't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nearby.llm.common import annotate, texts
from nearby.llm.vocab import SPACE, WordCache, public_path, read_json

#: The published split pattern of this family of vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNKS = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Bytes of each of a worker's two caches.
CACHE_BYTES = 64 << 20


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, to the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of a vocabulary file."""

    def __init__(self, path: str):
        spec = read_json(path)
        letters = byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        #: (left id, right id) -> (rank, id of both)
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}.get
        self.single = [0] * 256
        for letter, byte in letters.items():
            self.single[byte] = vocab[letter]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: bytes(letters[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile(SPLIT)
        self.pieces = WordCache(lambda pieces: (tuple(self.piece(p.encode("utf-8", "replace"))) for p in pieces), CACHE_BYTES, 8)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one piece of bytes."""
        ids = [self.single[b] for b in raw]
        n, merge = len(ids), self.merge
        # by rank, then by position; a pair's symbols go along to tell if it is stale
        queue = [(*m, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (m := merge((a, b)))]
        if not queue:
            return ids
        queue = [(rank, i, both, a, b) for rank, both, i, a, b in queue]
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            _, i, both, a, b = heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale
            ids[i], ids[j] = both, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := merge((both, ids[k]))):
                    heappush(queue, (m[0], i, m[1], both, ids[k]))
            h = before[i]
            if h >= 0 and (m := merge((ids[h], both))):
                heappush(queue, (m[0], h, m[1], ids[h], both))
        return [x for x in ids if x >= 0]

    def chunks(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """Ids of chunks that the split pattern may treat one by one."""
        split = [self.split.findall(c) for c in chunks]
        known = self.pieces.of(set(chain.from_iterable(split)))
        return [known[p[0]] if len(p) == 1 else tuple(chain.from_iterable(map(known.__getitem__, p))) for p in split]

    def words(self, words: list[str]) -> list[tuple[int, ...] | None]:
        """Ids of words cut at single spaces (see ``cut``); None for those that the pattern may not treat alone."""
        alone = [bool(w.strip()) and not w[w[0] == " " :][0].isspace() and not w[-1].isspace() for w in words]
        made = iter(self.chunks([w[1:] if w[0] == " " else " " + w for w, ok in zip(words, alone) if ok]))
        return [next(made) if ok else None for ok in alone]

    def parts(self, text: str) -> list[str]:
        """Texts between special tokens and, at odd places, special tokens."""
        return self.specials.split(text) if self.specials and any(s in text for s in self.special) else [text]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def cut(text: str) -> list[str]:
    """Words between spaces. The first, which no space precedes, is told by a space of its own."""
    words = text.split(" ")
    words[0] = " " + words[0]
    return words


@lru_cache(maxsize=2)
def worker(path: str) -> tuple[Bpe, WordCache, dict[int, str]]:
    """One encoder and cache for each Python worker and vocabulary."""
    bpe = Bpe(path)
    return bpe, WordCache(bpe.words, CACHE_BYTES, 8), {i: str(i) for i in bpe.bytes}


def encode_slowly(bpe: Bpe, text: str) -> list[int]:
    """Ids of any text: special tokens, then chunks, then pieces."""
    ids: list[int] = []
    for k, part in enumerate(bpe.parts(text)):
        ids.extend([bpe.special[part]] if k % 2 else chain.from_iterable(bpe.chunks(CHUNKS.findall(part))))
    return ids


def encode_batch(batch: list[str], path: str) -> list[list[int]]:
    bpe, cache, _ = worker(path)
    cuts = [None if not t or any(s in t for s in bpe.special) else cut(t) for t in batch]
    known = cache.of(set(chain.from_iterable(c for c in cuts if c)))
    out = []
    for text, words in zip(batch, cuts):
        found = list(map(known.__getitem__, words)) if words else [None]
        out.append(encode_slowly(bpe, text) if None in found else list(chain.from_iterable(found)))
    return out


def token_columns(docs: DataFrame, fields: list[T.StructField], make: Callable[[str, list[list[int]]], list[pa.Array]], vocabulary: str, text_col: str = "text") -> DataFrame:
    return annotate(docs, [text_col], fields, lambda column: make(vocabulary, encode_batch(texts(column), vocabulary)))


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text."""
    return token_columns(docs, [T.StructField(name, T.ArrayType(T.IntegerType()))], lambda _, rows: [pa.array(rows, pa.list_(pa.int32()))], vocabulary, text_col)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the text that each list of ids stands for; null ids give null."""

    def compute(column: pa.Array) -> list[pa.Array]:
        bpe = worker(vocabulary)[0]
        return [pa.array([None if x is None else bpe.decode(x) for x in column.to_pylist()], pa.string())]

    return annotate(df, [ids_col], [T.StructField(name, T.StringType())], compute)


def digests(path: str, rows: list[list[int]]) -> list[pa.Array]:
    bpe, _, decimal = worker(path)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return [
        pa.array([len(x) for x in rows], pa.int64()),
        pa.array([sha(",".join(map(decimal.__getitem__, x)).encode()) for x in rows], pa.string()),
        pa.array([sha(bpe.decode(x).encode()) for x in rows], pa.string()),
    ]


def round_trip(docs: DataFrame, vocabulary: str | None = None, keep: tuple[str, ...] = ("doc_id",), ids: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text; the ids too, in a column ``ids`` if that is given a name. One pass, no shuffle."""
    vocabulary = vocabulary or public_path("byte_bpe_50k.json")
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if not ids:
        return token_columns(docs.select(*keep, "text"), fields, digests, vocabulary).drop("text")
    with_ids = lambda path, rows: [*digests(path, rows), pa.array(rows, pa.list_(pa.int32()))]
    return token_columns(docs.select(*keep, "text"), [*fields, T.StructField(ids, T.ArrayType(T.IntegerType()))], with_ids, vocabulary).drop("text")
