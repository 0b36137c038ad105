"""Token ids of a corpus as binary shards with Elias-Fano coded document boundaries.

Documents are range-partitioned by id, into shards of about ``SHARD_BYTES`` of text. Each task writes ``<shard>.ids``, the concatenated ids (2
bytes each if the vocabulary allows, else 4), and ``<shard>.ef``: document ids and end offsets as
Elias-Fano sequences, whose select finds a document's offsets without a table of 64-bit numbers.
A manifest (one row for each shard) gives the shards' token counts; their running sum turns local
offsets into global ones.

Defined results: a null text is an empty one and holds the end id alone; null document ids come
first; documents of equal id stand in the order of their texts' hashes; an empty table gives no
shards and no rows.
"""

from __future__ import annotations

import os
import string
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearby.llm import elias_fano
from nearby.llm.common import bounded_batches, new_folder, remove_folder, slices
from nearby.llm.vocab import SPACE, WordCache, public_path
from nearby.sources.files import Replacing, store

#: Bytes of each of a worker's two caches.
CACHE_BYTES = 96 << 20
HEAD = struct.Struct("<4sBQQq")
MAGIC = b"TKEF"
#: The vocabulary's white space as RE2 writes it.
GAPS = "[" + SPACE.encode().decode("unicode_escape") + "]+"
#: Control characters that Arrow's split takes for white space and the vocabulary doesn't.
SEPARATORS = "[\x1c\x1d\x1e\x1f]"
#: Bytes of a worker's cache of marks at words' ends.
MARKS_BYTES = 4 << 20
#: Bytes of text in a shard, about; smaller where that gives all tasks a shard.
SHARD_BYTES = 128 << 20
#: Texts encoded at once.
WRITE_ROWS = 1024
#: Words whose ids are laid out at once.
LAID_WORDS = 1 << 20
#: Tokens read at once.
READ_TOKENS = 4_000_000


def pack_head(*fields: int) -> bytes:
    return HEAD.pack(MAGIC, *fields)


def unpack_head(raw: bytes) -> tuple[tuple[int, ...], bytes]:
    """width, documents, null ids, base id; and what follows."""
    magic, *fields = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a boundary file")
    return tuple(fields), raw[HEAD.size :]


class WordEncoder:
    """Words to ids by the tokenizers library, as little-endian numbers of ``dtype``.

    The vocabulary drops white space, so a text's ids are those of its words in a row. It also lower-cases and
    always cuts between letters and marks other than the apostrophe that end a word, so such words share their letters'
    and their marks' entries. Words of letters alone are one piece each and are encoded many at once, joined by line ends: the
    token that ends a piece tells where a word's ids stop.
    """

    #: Letters whose lower case depends on what stands around them, or is more than one letter.
    ODD = frozenset("Σİẞŉǰΐΰև")
    #: Marks that are a piece of their own after letters. An apostrophe may begin a piece with letters.
    MARKS = string.punctuation.replace("'", "")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_padding()
        self.t.no_truncation()
        vocab = self.t.get_vocab(with_added_tokens=True)
        self.size = len(vocab)
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.letters = WordCache(self.joined, CACHE_BYTES, 1)
        self.marks = WordCache(self.each, MARKS_BYTES, 1)

    def each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.t.encode_batch_fast(words, add_special_tokens=False)]

    def joined(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(words), 8192):
            part = words[i : i + 8192]
            ids = np.array(self.t.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                raw, cuts = ids.tobytes(), (stops * self.dtype.itemsize).tolist()
                out += [raw[x:y] for x, y in zip([0, *cuts], cuts)]
            else:
                out += self.each(part)
        return out

    def __call__(self, words: list[str]) -> list[bytes]:
        out, at, cores, tails, rest = [b""] * len(words), [], [], [], []
        for i, w in enumerate(words):
            low = w.lower()
            core = low.rstrip(self.MARKS)
            if core.isalpha() and (w.isascii() or self.ODD.isdisjoint(w)):
                at.append(i)
                cores.append(core)
                tails.append(low[len(core) :])
            elif w:
                rest.append(i)
        for own, i in zip(self.each([words[i] for i in rest]), rest):
            out[i] = own
        letters, marks = (dict(zip(once, cache.in_order(once))) for once, cache in ((list(dict.fromkeys(cores)), self.letters), (list({t for t in tails if t}), self.marks)))
        marks[""] = b""
        for i, core, tail in zip(at, cores, tails):
            out[i] = letters[core] + marks[tail]
        return out


@lru_cache(maxsize=2)
def worker(path: str) -> tuple[WordCache, WordEncoder]:
    """A Python worker's cache of encoded words and their encoder."""
    encoder = WordEncoder(path)
    return WordCache(encoder, CACHE_BYTES, 1), encoder


def encode_column(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of a column in a row, and how many each text has. Texts are cut and equal words are found
    by Arrow; only distinct words are Python objects."""
    cache, encoder = worker(path)
    column = pc.fill_null(column, "")
    odd = pc.any(pc.match_substring_regex(column, SEPARATORS)).as_py()
    rows = pc.split_pattern_regex(column, GAPS) if odd else pc.utf8_split_whitespace(column)
    words = rows.flatten().dictionary_encode()
    forms = cache.in_order(words.dictionary.to_pylist())
    blob = np.frombuffer(b"".join(forms), encoder.dtype)
    sizes = np.fromiter(map(len, forms), np.int64, len(forms)) // encoder.dtype.itemsize
    starts = np.cumsum(sizes) - sizes
    which = words.indices.to_numpy()
    laid, before = [], np.zeros(len(which) + 1, np.int64)
    for i in range(0, len(which), LAID_WORDS):
        w = which[i : i + LAID_WORDS]
        n = sizes[w]
        stops = np.cumsum(n)
        laid.append(blob[np.arange(stops[-1]) + np.repeat(starts[w] - (stops - n), n)])
        before[i + 1 : i + 1 + len(w)] = before[i] + stops
    cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(rows).to_numpy())])
    return np.concatenate(laid) if laid else np.zeros(0, encoder.dtype), np.diff(before[cuts])


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Write the shards under ``folder`` and return their manifest: shard, n_docs, n_tokens, width, ids_bytes, ef_bytes."""
    spark = docs.sparkSession
    if not shards:
        size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
        shards = max(1, -(-(size["bytes"] or 0) // SHARD_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), size["n"]))
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        ids_file, doc_ids, ends, nulls, total = None, array("q"), array("Q"), 0, 0
        width = 2 if max(worker(vocabulary)[1].size, end_id + 1) <= 1 << 16 else 4
        for batch in slices(batches, WRITE_ROWS):
            ids_file = ids_file or Replacing(folder, f"{shard:06d}.ids", attempt)
            ids, counts = encode_column(batch.column(1), vocabulary)
            stops = np.cumsum(counts)
            ids_file.write(np.insert(ids.astype(f"<u{width}"), stops, end_id).tobytes())
            ends.frombytes((stops + np.arange(1, len(stops) + 1) + total).astype(np.uint64).tobytes())
            total = ends[-1]
            own = batch.column(0).drop_null()
            nulls += batch.num_rows - len(own)
            doc_ids.frombytes(own.to_numpy(zero_copy_only=False).astype(np.int64).tobytes())
        if ids_file:
            ef_file = Replacing(folder, f"{shard:06d}.ef", attempt)
            base = doc_ids[0] if doc_ids else 0
            ef_file.write(pack_head(width, len(ends), nulls, base))
            ef_file.write(elias_fano.encode((np.frombuffer(doc_ids, np.int64) - base).view(np.uint64)))
            ef_file.write(elias_fano.encode(np.frombuffer(ends, np.uint64)))
            row = shard, len(ends), total, width, ids_file.done(), ef_file.done()
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=["shard", "n_docs", "n_tokens", "width", "ids_bytes", "ef_bytes"])

    dealt = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    dealt = dealt.repartitionByRange(shards, F.col("id").asc_nulls_first(), "h").sortWithinPartitions(F.col("id").asc_nulls_first(), "h")
    bounded_batches(spark)
    manifest = dealt.select("id", "text").mapInArrow(put, "shard long, n_docs long, n_tokens long, width long, ids_bytes long, ef_bytes long")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian 32-bit) of every document of the shards, found through select."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over shards, not documents
    placed = manifest.select("shard", "n_docs", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset"))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, n_docs, offset in (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)))):
            fs, path = store(f"{folder}/{shard:06d}")
            with fs.open_input_stream(f"{path}.ef") as f:
                raw = f.read()
            (width, n, nulls, base), raw = unpack_head(raw)
            if n != n_docs:
                raise ValueError(f"shard {shard} isn't whole")
            doc_ids = elias_fano.Sequence(raw)
            ends = elias_fano.Sequence(raw[doc_ids.size :])
            with fs.open_input_file(f"{path}.ids") as f:
                first, start = 0, 0
                while first < n:
                    last = min(n, first + 2048)
                    stops = ends.select(first, last).astype(np.int64)
                    last = first + max(1, int(np.searchsorted(stops, start + READ_TOKENS, "right")))
                    stops = stops[: last - first]
                    f.seek(start * width)
                    ids = np.frombuffer(f.read((int(stops[-1]) - start) * width), f"<u{width}").astype("<u4")
                    starts = np.concatenate([[start], stops[:-1]])
                    own = [None] * max(0, min(last, nulls) - first) + [int(x) + base for x in doc_ids.select(max(0, first - nulls), max(0, last - nulls))]
                    cut = [ids[a - start : b - start].tobytes() for a, b in zip(starts, stops)]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(starts + offset, pa.int64()), pa.array(stops - starts, pa.int64()), pa.array(cut, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                    first, start = last, int(stops[-1])

    return placed.repartition(max(1, manifest.count()), "shard").mapInArrow(get, "doc_id long, start long, n_tokens long, ids binary")


def store_and_read(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files just written. The files go once all are read."""
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    manifest = write(docs, folder, vocabulary or public_path("word_bpe_49k.json"), end_id)
    found = read(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")).checkpoint()
    remove_folder(spark, folder)
    return found
