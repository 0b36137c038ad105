"""WARC archives: a deduplicating writer and a splittable reader.

Writing: payloads of at least ``least`` bytes that are equal (SHA-1 and length) are stored once, in
the response record of their largest page id; the others become revisit records that name it. Each
record is a gzip member of its own and each task writes one archive.

Reading: archives are cut into byte ranges. A task scans its range for the gzip magic, validates a
candidate by inflating its first bytes and decoding a WARC header, and owns the records that start
inside its range; from the first one it goes on from member end to member start, beyond the range's
end if the last record needs it. No index is read and any range can be read again alone.

Defined results: a null html is an empty payload; a null url is written as an empty target; a page
with a null id is written and read back with a null id, and is no other record's response; repeated
ids are records of their own (equal payloads refer to the id); an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearby.llm.common import bounded_batches, new_folder, remove_folder, slices
from nearby.sources.files import Replacing, store

LEAST = 1000
SPLIT_BYTES = 16 << 20
#: Tasks over which the payloads of a hot digest are spread.
SALTS = 16
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
#: Bytes read at once while scanning and inflating.
STEP = 1 << 18
PAGE = re.compile(rb"<urn:page:(-?\d+)>")
CREATED = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. A revisit keeps the HTTP header, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {CREATED}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    raw = VERSION + "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, size, refers_to.

    Payloads under ``least`` bytes never move. Digests are combined before they are shuffled; larger payloads meet the
    repeated digests, which are broadcast by size where few repeat, else joined with salts, so a hot digest is many tasks.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    p = p.withColumn("size", F.octet_length("payload").cast("long"))
    small = p.where(F.col("size") < least).select("page_id", "url", "payload", F.sha1("payload").alias("digest"), "size", F.lit(None).cast("long").alias("refers_to"))
    large = p.where(F.col("size") >= least).withColumn("digest", F.sha1("payload"))
    repeats = large.groupBy("digest", "size").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    salted = repeats.select(F.col("digest").alias("_d"), F.col("size").alias("_s"), "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    joined = large.join(salted, (F.col("digest") == F.col("_d")) & (F.col("size") == F.col("_s")) & (F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)) == F.col("_salt")), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return small.union(joined.select("page_id", "url", "payload", "digest", "size", refers.alias("refers_to")))


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write archives under ``folder``; returns their manifest (name, bytes, records)."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, out, n = f"part-{task.partitionId():06d}.warc.gz", None, 0
        for b in slices(batches):
            for row in zip(*(b.column(i).to_pylist() for i in range(6))):
                out = out or Replacing(folder, name, task.taskAttemptId())
                out.write(record(*row))
                n += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out.done()], pa.int64()), pa.array([n], pa.int64())], names=["name", "bytes", "records"])

    bounded_batches(pages.sparkSession)
    planned(pages, least).mapInArrow(put, "name string, bytes long, records long").write.mode("overwrite").parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def headers(block: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in block.split(b"\r\n")[1:])}


def starts_record(data: bytes) -> bool:
    """Whether bytes that begin with the gzip magic inflate to the head of a WARC record."""
    try:
        return zlib.decompressobj(31).decompress(data, 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


class Window:
    """A growing view of a file from some offset on."""

    def __init__(self, f, at: int, size: int):
        self.f, self.at, self.size, self.data = f, at, size, b""

    def more(self) -> bool:
        if self.at + len(self.data) >= self.size:
            return False
        self.f.seek(self.at + len(self.data))
        self.data += self.f.read(min(STEP, self.size - self.at - len(self.data)))
        return True

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def members(f, size: int, start: int, stop: int) -> Iterator[bytes]:
    """Inflated members that start in [start, stop)."""
    w, inside = Window(f, start, size), False
    while w.at < stop:
        if not inside:  # look for the first member's start
            while (at := w.data.find(MAGIC)) < 0:
                w.skip(max(0, len(w.data) - len(MAGIC) + 1))
                if w.at >= stop or not w.more():
                    return
            w.skip(at)
            while len(w.data) < 512 and w.more():
                pass
            if w.at >= stop:
                return
            if not starts_record(w.data[:512]):
                w.skip(1)
                continue
            inside = True
        unpack, out = zlib.decompressobj(31), []
        if not w.data and not w.more():
            return
        while True:
            out.append(unpack.decompress(w.data))
            if unpack.eof:
                w.skip(len(w.data) - len(unpack.unused_data))
                break
            w.skip(len(w.data))
            if not w.more():
                raise EOFError(f"a member before byte {w.at} is cut off")
        yield b"".join(out)


def page_of(name: bytes | None) -> int | None:
    found = PAGE.fullmatch(name or b"")
    return int(found[1]) if found else None


def parse(raw: bytes) -> tuple | None:
    """page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest of an inflated record.

    None for records that hold no page (warcinfo, request, metadata and others, or a response without an HTTP head).
    Archives of other writers may name records otherwise (the page id is null then) and state no digest or none of SHA-1
    (the payload's own is given; of a revisit null).
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = headers(head)
    kind = h.get(b"warc-type", b"").decode("ascii", "replace").lower()
    body = rest[: int(h[b"content-length"])] if h.get(b"content-length", b"").isdigit() else rest
    if kind not in ("response", "revisit") or not body.startswith(b"HTTP/"):
        return None
    http, _, payload = body.partition(b"\r\n\r\n")
    scheme, _, value = h.get(b"warc-payload-digest", b"").partition(b":")
    stated = base64.b32decode(value).hex() if scheme.lower() == b"sha1" and len(value) == 32 else None
    length = headers(http).get(b"content-length", b"")
    size = int(length) if kind == "revisit" and length.isdigit() else len(payload)
    digest = hashlib.sha1(payload).hexdigest() if kind == "response" else stated
    if kind == "response" and stated and digest != stated:
        raise ValueError(f"payload of {h.get(b'warc-record-id')!r} doesn't have its digest")
    url = h.get(b"warc-target-uri", b"").decode("utf-8", "replace")
    return page_of(h.get(b"warc-record-id")), url, kind, page_of(h.get(b"warc-refers-to")), payload if kind == "response" else None, size, digest


def read(archives: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Records of archives (name, bytes): page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest."""
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    ranges = archives.select("name", "bytes", cuts.alias("start"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, size, start in (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)))):
            fs, path = store(f"{folder}/{name}")
            rows: list[tuple] = []
            with fs.open_input_file(path) as f:
                for raw in members(f, size, start, min(size, start + split_bytes)):
                    if not (row := parse(raw)):
                        continue
                    rows.append(row if with_payload else (*row[:4], None, *row[5:]))
                    if len(rows) == 64:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    size = archives.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).first()
    tasks = (size["bytes"] or 0) // split_bytes + size["n"] or 1
    return ranges.repartition(tasks).mapInArrow(get, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the archives just written. They go once all are read."""
    folder = new_folder(pages.sparkSession, "warc")
    found = read(write(pages, folder), folder, with_payload=False)
    found = found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").checkpoint()
    remove_folder(pages.sparkSession, folder)
    return found


#: DuckDB has SHA-1 over text's UTF-8 bytes.
ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h))::bigint as payload_bytes, sha1(h) as payload_digest from p),
m as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as top from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> top then top end as refers_to
from m
"""
