"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of whole records, and a last skippable
frame with the seek table (sizes of all frames). A record's place is its bundle, frame and offset
in the frame's plain bytes, so a record is read by decompressing its frame alone.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import new_path, written

FRAME_BYTES = 1 << 19
BUNDLE_BYTES = 64 << 20
#: Frames of a bundle that one read task opens.
FRAMES_A_READ = 32
SMALLEST_REVISIT = 100
# Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, bundle string, frame int, offset long, length long"


def store(path: str):  # noqa: ANN201
    """Filesystem and path of a folder or file in a shared store."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def record(page_id: int, url: str, kind: str, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record with an HTTP response of the payload; a revisit has the HTTP head alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    if kind == "response":
        block += payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join(c if c > ' ' else f'%{ord(c):02X}' for c in url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


class Bundle:
    """Writes one bundle; add() returns a record's frame and its offset and length in it."""

    def __init__(self, path: str) -> None:
        import zstandard

        where, self.path = store(path)
        self.file = where.open_output_stream(self.path, compression=None)
        self.compress = zstandard.ZstdCompressor(level=3).compress
        self.frames: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.size = self.bytes = 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        if self.size and self.size + len(data) > FRAME_BYTES:
            self.flush()
        at = len(self.frames), self.size, len(data)
        self.parts.append(data)
        self.size += len(data)
        return at

    def flush(self) -> None:
        if self.parts:
            frame = self.compress(b"".join(self.parts))
            self.file.write(frame)
            self.frames.append((len(frame), self.size))
            self.bytes += len(frame)
            self.parts, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.file.close()


def seek_table(file) -> list[tuple[int, int, int]]:  # noqa: ANN001
    """Start, size and plain size of each frame, from the end of an open bundle."""
    end = file.size()
    n, _, magic = struct.unpack("<IBI", file.read_at(9, end - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    at, out = 0, []
    for size, plain in struct.iter_unpack("<II", file.read_at(8 * n, end - 9 - 8 * n)):
        out.append((at, size, plain))
        at += size
    return out


def classified(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest and refers_to (null: a response).

    Of equal payloads of at least 100 bytes, the least page_id is the response. The least is
    folded before the shuffle; the groups of two and more are then joined to the pages, where
    adaptive execution splits a group that holds many rows.
    """
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    large = rows.where(F.col("payload_bytes") >= SMALLEST_REVISIT).select("page_id", "payload_digest")
    groups = written(large.groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("payload_digest").alias("_digest"), "_first"), "payloads")
    out = rows.join(groups, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") >= SMALLEST_REVISIT), "left")
    return out.withColumn("refers_to", F.when(F.col("page_id") != F.col("_first"), F.col("_first"))).drop("_digest", "_first")


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes every page into bundles under ``folder`` and returns the index: each record's place.

    Each task fills its own bundles, so an archive grows with the cluster; a bundle's name holds
    its task attempt, and the index names only bundles of attempts that ended, so a task that is
    run again leaves at most a file that nothing refers to. Null html is an empty payload;
    repeated rows each have a record; an empty table has no bundle.
    """
    folder = folder or new_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        bundle, number = None, 0
        for batch in batches:
            rows = []
            for page, url, payload, size, digest, refers in zip(*[c.to_pylist() for c in batch.columns]):
                if bundle is None:
                    where, path = store(folder)
                    where.create_dir(path, recursive=True)
                    name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number}.warc.zst"
                    bundle, number = Bundle(name), number + 1
                kind = "response" if refers is None else "revisit"
                rows.append((page, name, *bundle.add(record(page, url, kind, payload, size, digest, refers))))
                if bundle.bytes >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["page_id", "bundle", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    rows = classified(pages).select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")
    return written(rows.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at the places in ``index``: page_id, type, size, digest, refers_to (and payload).

    A read opens a bundle, takes the frames' places from its seek table and decompresses each
    frame that is asked for once. A response whose payload does not have its digest is an error.
    """

    def read(key: tuple, table: pa.Table) -> pa.Table:
        import zstandard

        where, path = store(key[0].as_py())
        unpack = zstandard.ZstdDecompressor().decompress
        by_frame: dict[int, list[tuple[int, int]]] = {}
        for frame, offset, length in zip(*[table[c].to_pylist() for c in ("frame", "offset", "length")]):
            by_frame.setdefault(frame, []).append((offset, length))
        rows = []
        with where.open_input_file(path) as file:
            frames = seek_table(file)
            for frame, places in sorted(by_frame.items()):
                start, size, plain = frames[frame]
                data = unpack(file.read_at(size, start), max_output_size=plain)
                for offset, length in places:
                    headers, payload = parsed(data[offset : offset + length])
                    digest, size_ = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["WARC-Payload-Length"])
                    kind = headers["WARC-Type"]
                    if kind == "response" and (len(payload) != size_ or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
                    ids = [None if x is None or x == "None" else int(x) for x in (headers["WARC-Record-ID"][10:-1], headers.get("WARC-Refers-To", "<urn:page:None>")[10:-1])]
                    rows.append((ids[0], size_, digest, kind, ids[1], payload if payloads and kind == "response" else None))
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return index.groupBy("bundle", F.floor(F.col("frame") / FRAMES_A_READ).alias("part")).applyInArrow(read, schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_records(archived(pages), payloads=False).drop("payload")


OP3_SQL = """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
         g AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
    SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
           CASE WHEN g.first IS NULL OR g.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN g.first <> p.page_id THEN g.first END AS refers_to
    FROM p LEFT JOIN g ON p.d = g.d AND p.n >= 100
"""
