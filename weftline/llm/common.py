"""Shared pieces: the working folder, tables written between steps, sizing, hashing of bytes."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; in local mode alone, a folder of its own where none is set."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        found = tempfile.mkdtemp(prefix="weftline-", dir="/tmp/checkpoints")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir() or found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that ends inside are removed at its end, not when the driver collects garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None, path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with freed_shuffles(spark):
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder of a written table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Rows of an Arrow batch, at most: texts can be long, and both the JVM and Python hold a batch of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(rows))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_digest(name: str = "text") -> Column:
    """128 bits of the SHA-256 of a text (null: empty)."""
    return F.substring(F.unhex(F.sha2(text_or_empty(name), 256)), 1, 16)


def scan_bytes(df: DataFrame, text: str = "text") -> int:
    """Size of ``df``: its files' as Catalyst knows it, or else half the bytes of its texts, counted."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 52:
        return known
    return (df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0) // 2


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column laid end to end, and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def packed_groups(docs: DataFrame, group: Column, groups: int, once: str | None = None, remembered: int = 200_000) -> DataFrame:
    """``docs`` dealt by ``group`` (0 to ``groups`` - 1): (grp, rows), rows a compressed Arrow stream.

    Half the bytes of a plain shuffle of texts, and few rows. With ``once``, a task lets a row of each value of
    that column pass, and forgets what it has let pass after ``remembered`` values.
    """
    columns = docs.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        seen: set[object] = set()
        for batch in batches:
            if once is not None:
                values = batch.column(columns.index(once) + 1).to_pylist()
                seen = set() if len(seen) > remembered else seen
                batch = batch.take(pa.array([i for i, v in enumerate(values) if v not in seen and not seen.add(v)], pa.int64()))
            grp = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(grp, kind="stable")
            rows = batch.select(columns).take(pa.array(order))
            ends = np.r_[np.flatnonzero(np.diff(grp[order])) + 1, len(order)]
            out = []
            for a, b in zip(np.r_[0, ends[:-1]], ends) if len(order) else ():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                    writer.write_batch(pa.concat_batches([rows.slice(a, b - a)]))
                out.append((int(grp[order[a]]), sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["grp", "rows"])

    return docs.select(group.cast("int").alias("grp"), *columns).mapInArrow(pack, "grp int, rows binary")


def unpacked_groups(table: pa.Table) -> Iterator[pa.Table]:
    """The rows of a group of packed_groups(), stream by stream."""
    for rows in table["rows"]:
        yield pa.ipc.open_stream(rows.as_buffer()).read_all()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


P61 = np.uint64((1 << 61) - 1)
_M30, _M31 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_30, _31, _61, _1 = (np.uint64(k) for k in (30, 31, 61, 1))


def folded(x: np.ndarray) -> np.ndarray:
    """Any unsigned 64-bit numbers modulo 2**61 - 1."""
    x = (x & P61) + (x >> _61)
    return np.where(x >= P61, x - P61, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, of numbers below 2**61, by halves of 30 and 31 bits."""
    au, ad, bu, bd = a >> _31, a & _M31, b >> _31, b & _M31
    mid = ad * bu + au * bd
    return folded(((au * bu) << _1) + (mid >> _30) + ((mid & _M30) << _31) + ad * bd)


class Powers:
    """Powers of a base and of its inverse modulo 2**61 - 1, kept by the process."""

    #: Two bases for independent hashes (fixed values, drawn once).
    BASES = (0x1A6F3C9D27B14E83, 0x0B5D41E7C8F2963B)
    _held: dict[int, tuple[np.ndarray, ...]] = {}

    @classmethod
    def of(cls, base: int, n: int) -> tuple[np.ndarray, ...]:
        """n powers, their high and low halves, and n powers of the inverse."""
        held = cls._held.get(base)
        if held is None or len(held[0]) < n:
            rows = []
            for b in (base, pow(base, -1, int(P61))):
                up = np.ones(1, np.uint64)
                while len(up) < n:
                    up = np.concatenate([up, product(up, np.full(1, pow(b, len(up), int(P61)), np.uint64))])
                rows.append(up)
            held = cls._held[base] = (rows[0], rows[0] >> _31, rows[0] & _M31, rows[1])
        return tuple(x[:n] for x in held)


class Rolling:
    """Polynomial hashes modulo 2**61 - 1 of any range of a row of numbers, from running sums.

    Different strings of n bytes share a hash for at most n of the 2**61 bases. Sums of the high and
    low halves of the terms are kept apart, so they stay exact (differences are, even when the sums
    wrap round).
    """

    def __init__(self, data: np.ndarray, base: int = 0) -> None:
        """``data``: bytes, or numbers below 2**61; ``base``: which of the two."""
        n = len(data)
        up, high, low, self.inverse = Powers.of(Powers.BASES[base], n + 1)
        if data.dtype == np.uint8:
            own = data.astype(np.uint64)
            own += _1
            high, low = own * high[:-1], own * low[:-1]
        else:
            terms = product(data, up[:-1])
            high, low = terms >> _31, terms & _M31
        self.high, self.low = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(high, out=self.high[1:])
        np.cumsum(low, out=self.low[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each range [start, end), spread over 64 bits; equal content gives equal hashes wherever it lies."""
        high, low = folded(self.high[end] - self.high[start]), folded(self.low[end] - self.low[start])
        total = folded((((high << _31) & P61) | (high >> _30)) + low)
        return mixed(product(total, self.inverse[start]))
