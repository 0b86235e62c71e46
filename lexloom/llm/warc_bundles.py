"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about ``FRAME_BYTES``; each frame is a Zstandard frame of its own. Behind the frames
stands the seek table of the public seekable format: a skippable frame (magic 0x184D2A5E) with the compressed and the plain size of each frame,
their number, a descriptor byte and the magic 0x8F92EAB1. Any Zstandard tool reads a bundle from end to end; one record is
read from its frame alone by the index (record_id -> file, frame, offset within the plain frame, length).

Of records with equal payloads of at least ``least`` bytes the one with the smallest page_id is a response, all others are revisits.

Defined results: a null html is an empty payload; a null page_id comes after all others; rows that repeat the smallest page_id of a
payload are responses all, with ids of their own; a null url leaves its header out; an empty table gives no bundle and an empty result; other
columns play no part, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, slices, written

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 256 << 20, 3
#: Compressed bytes that a reading task gets.
TASK_BYTES = 4 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    """A response's id follows from its page and payload, so that revisits can name it; others are told apart by their place."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}{place}')}>"


def base32(digest_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(digest_hex)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, least: int | None, date: str = DATE, place: str = "", single: bool = True) -> tuple[str, bytes]:
    """(record id, bytes of one WARC record). place: what tells a record apart that isn't the only response of its page and payload; single:
    whether the response that a revisit refers to is the only one, else the header that names it is left out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    own = record_id(page_id, digest, place)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {len(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(least, digest)}"] if single else []
        head += [f"X-Refers-To-Page: {least}", f"WARC-Profile: {PROFILE}"]
    block = http if revisit else http + payload
    head.append(f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).hexdigest())}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return own, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(plain: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of the records of a plain frame."""
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("no record starts here")
        head = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        block = plain[start:stop]
        yield head, block[block.index(b"\r\n\r\n") + 4 :]
        at = stop + 4


class Bundle:
    """Writes one file; ``add`` returns where a record lies."""

    def __init__(self, uri: str):
        self.uri = uri
        fs, path = filesystem(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path, compression=None)
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.sizes: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.plain = self.at = 0

    def add(self, data: bytes) -> tuple[int, int]:
        if self.plain and self.plain + len(data) > FRAME_BYTES:
            self.flush()
        place = len(self.sizes), self.plain
        self.held.append(data)
        self.plain += len(data)
        return place

    def flush(self) -> None:
        if self.held:
            frame = self.pack.compress(b"".join(self.held))
            self.out.write(frame)
            self.sizes.append((len(frame), self.plain))
            self.at += len(frame)
            self.held, self.plain = [], 0

    def close(self) -> list[tuple[int, int]]:
        """Offset and size of each frame in the file."""
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        places, at = [], 0
        for size, _ in self.sizes:
            places.append((at, size))
            at += size
        return places


def seek_table(uri: str) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame, from the end of the file."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        end = f.size()
        f.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        f.seek(end - 9 - 8 * n)
        sizes = list(struct.iter_unpack("<II", f.read(8 * n)))
    out, at = [], 0
    for packed, plain in sizes:
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(uri: str, offset: int, size: int) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return zstandard.ZstdDecompressor().decompress(f.read(size))


INDEX = "page_id long, record_id string, file string, frame long, frame_at long, frame_size long, offset long, length long"
_NAMES = [c.split()[0] for c in INDEX.split(", ")]


def write_bundles(pages: DataFrame, root: str, least: int = 0) -> DataFrame:
    """Writes bundles for (page_id, url, html) below ``root`` and returns the written index of all records."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    size = F.octet_length("payload")
    pages_ = rows.where(size >= least).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("rows"))
    heads = pages_.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "rows"))).alias("first"), F.sum("rows").alias("n"))
    heads = heads.where(F.col("n") > 1).select("digest", F.col("first.page_id").alias("least"), F.coalesce(F.col("first.rows") == 1, F.lit(False)).alias("single"))
    # only repeated payloads are joined; a payload that a third of the rows share is split by adaptive execution
    revisit = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    marked = rows.join(heads, "digest", "left").select("page_id", "url", "payload", "digest", "least", revisit.alias("revisit"), F.coalesce("single", F.lit(True)).alias("single"))
    # payloads too small to be looked at can repeat as well
    marked = marked.withColumn("single", F.col("single") & (F.octet_length("payload") >= least))
    folder = f"{root}/bundles"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, rows, part = None, [], TaskContext.get().partitionId()

        def close() -> Iterator[pa.RecordBatch]:
            places = bundle.close()
            for r in rows:
                r["frame_at"], r["frame_size"] = places[r["frame"]]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(n, pa.string() if n in ("record_id", "file") else pa.int64()) for n in _NAMES]))

        for batch in slices(batches, 500, "payload"):
            if bundle is None:
                bundle = Bundle(f"{folder}/{part:06d}-{uuid.uuid4().hex}.warc.zst")  # only the index names files, so a repeated task does no harm
            for page, url, data, digest, least_, revisit, single in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = "" if single and not revisit else f"/{bundle.uri}/{len(rows)}"
                own, made = record(page, url, data, base32(digest), revisit, least_, place=place, single=single)
                frame, offset = bundle.add(made)
                rows.append({"page_id": page, "record_id": own, "file": bundle.uri, "frame": frame, "offset": offset, "length": len(made)})
            if bundle.at > BUNDLE_BYTES:
                yield from close()
                bundle, rows = None, []
        if bundle is not None:
            yield from close()

    return written(marked.mapInArrow(write, INDEX), f"{root}/index")


def read_bundles(spark: SparkSession, index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to from the frames that an index names; a response's payload is hashed
    again and must have the digest that its header gives."""
    frames = index.groupBy("file", "frame_at", "frame_size").agg(F.count(F.lit(1)).alias("n"))
    # tasks follow the bytes of the frames, not those of the index
    tasks = max(1, -(-int(frames.agg(F.sum("frame_size")).first()[0] or 0) // TASK_BYTES))
    frames = frames.repartition(tasks, "file", "frame_at")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at, size, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = []
                for head, payload in records(read_frame(file, at, size)):
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = head["WARC-Type"] == "revisit"
                    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{head['WARC-Record-ID']}: the payload doesn't have its digest")
                    page = head.get("X-Page-ID")
                    out.append({"page_id": None if page is None else int(page), "payload_bytes": int(head["X-Payload-Bytes"]) if revisit else len(payload), "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": int(head["X-Refers-To-Page"]) if revisit else None})
                if len(out) != n:
                    raise ValueError(f"{file}: a frame holds {len(out)} records, its index {n}")
                yield pa.RecordBatch.from_pylist(out, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    return frames.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
