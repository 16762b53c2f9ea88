"""Substring dedup of word windows through a log-structured fingerprint index.

The index is a list of immutable runs. A run is a table of buckets, each with the sorted, distinct
fingerprints of windows that documents of earlier batches have. A fingerprint is a polynomial modulo
2**61 - 1 over the hashes of the window's words, which are such polynomials over the words' bytes;
the bucket comes from a second hash of the words with another base, and a match must agree in both.
Every batch of documents (by ascending doc_id) is merge-joined with all runs, becomes a run itself,
and runs are compacted when enough of one size stand.

A task settles what repeats within its own documents; only the first document of each of its windows
goes to the window's bucket, so a passage in very many documents loads a bucket once a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Rolling, dropped, new_path, scan_bytes, small_batches, text_or_empty, utf8, written

WINDOW = 13
BATCHES = 4
#: Runs of one tier that are compacted into a run of the next.
FANOUT = 3
#: Text that a task hashes at once, and windows that it gathers before it deals them into buckets.
CHUNK_BYTES, GATHERED = 1 << 18, 1_000_000
#: Windows aimed at in a bucket of the whole index.
BUCKET_WINDOWS = 1_000_000
GROUP_BYTES = 4 << 20
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROW = "bucket int, grp int, vals binary, docs binary, idx binary"
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def squeezed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes under Zstandard; planes that are zero are left out."""
    import zstandard

    planes = np.ascontiguousarray(numbers.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    keep = next((k for k in range(8, 0, -1) if planes[k - 1].any()), 0)
    return bytes([keep]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:keep]).tobytes())


def unsqueezed(data: bytes, n: int) -> np.ndarray:
    import zstandard

    out = np.zeros((n, 8), np.uint8)
    if data[0] and n:
        out[:, : data[0]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:], max_output_size=data[0] * n), np.uint8).reshape(data[0], n).T
    return out.reshape(-1).view("<u8")


def run_bytes(values: np.ndarray) -> bytes:
    """Sorted fingerprints as differences."""
    return len(values).to_bytes(8, "little") + squeezed(np.diff(values, prepend=np.uint64(0)))


def run_values(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(data[8:], int.from_bytes(data[:8], "little")), dtype=np.uint64)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of texts laid end to end, and the words of each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def windows_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, second hash, text number and position of every window of ``size`` words in one text."""
    starts, ends, words = word_bounds(data, offsets)
    count = np.maximum(words - size + 1, 0)
    text = np.repeat(np.arange(len(words)), count)
    idx = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    if not len(text):
        none = np.zeros(0, np.uint64)
        return none, none, text, idx
    first = (np.cumsum(words) - words)[text] + idx
    value, other = (Rolling(Rolling(data, base).ranges(starts, ends) >> np.uint64(3), base).ranges(first, first + size) for base in (0, 1))
    return value, other, text, idx


def batch_rows(docs: DataFrame, bits: int, size: int, groups: int) -> DataFrame:
    """Windows of ``docs`` (_k, _h, text) dealt into 2**bits buckets: fingerprints, documents and positions of each, packed.

    A window of a later document of the same task is a hit already: such rows carry no fingerprints,
    name the group of documents they are for, and only pass through a bucket.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            value, other, doc, text, idx = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(value, kind="stable")
            starts = np.flatnonzero(np.r_[True, value[order][1:] != value[order][:-1]])
            first = np.repeat(np.minimum.reduceat(doc[order], starts), np.diff(np.r_[starts, len(order)]))
            again = np.zeros(len(value), bool)
            again[order] = doc[order] > first
            rows = []
            mine = np.flatnonzero(~again)
            for bucket, at in split_by(other[mine] >> np.uint64(64 - bits) if bits else np.zeros(len(mine), np.uint64)):
                at = mine[at]
                rows.append((bucket, None, value[at].tobytes(), packed_owners(doc[at], text[at]), squeezed(idx[at])))
            mine = np.flatnonzero(again)
            for grp, at in split_by(np.mod(doc[mine] ^ text[mine], groups)):
                at = mine[at]
                rows.append((grp % (1 << bits), grp, None, packed_owners(doc[at], text[at]), squeezed(idx[at])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "grp", "vals", "docs", "idx"])

        for batch in batches:
            ids, hashes, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            ends = utf8(texts)[1]
            a = 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK_BYTES, "right")) - 1)
                value, other, text, idx = windows_of(*utf8(texts.slice(a, b - a)), size)
                if len(value):
                    held.append((value, other, ids[a:b][text], hashes[a:b][text], idx))
                if sum(len(h[0]) for h in held) >= GATHERED:
                    yield out()
                a = b
        if held:
            yield out()

    return docs.select("_k", "_h", "text").mapInArrow(deal, ROW)


def split_by(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key in ascending order, with its places in their own order."""
    if len(key):
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for at in np.split(order, cuts):
            yield int(key[at[0]]), at


def packed_owners(doc: np.ndarray, text: np.ndarray) -> bytes:
    """Documents (id and hash of the text) that come in runs: how many, the ids, the hashes and the lengths."""
    at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])])
    ids, hashes = squeezed(doc[at].view(np.uint64) ^ np.uint64(1 << 63)), text[at].tobytes()
    return b"".join([len(at).to_bytes(8, "little"), len(ids).to_bytes(8, "little"), ids, hashes, squeezed(np.diff(at, append=len(doc)))])


def unpacked_owners(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = int.from_bytes(data[:8], "little"), 16 + int.from_bytes(data[8:16], "little")
    ids = (unsqueezed(data[16:size], n) ^ np.uint64(1 << 63)).view(np.int64)
    count = unsqueezed(data[size + 8 * n :], n).astype(np.int64)
    return np.repeat(ids, count), np.repeat(np.frombuffer(data[size : size + 8 * n], np.int64), count)


def packed_runs(doc: np.ndarray) -> bytes:
    """Document ids that come in runs: how many, the ids and the lengths."""
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    ids = squeezed(doc[at].view(np.uint64) ^ np.uint64(1 << 63))
    return len(at).to_bytes(8, "little") + len(ids).to_bytes(8, "little") + ids + squeezed(np.diff(at, append=len(doc)))


def unpacked_runs(data: bytes) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    ids = (unsqueezed(data[16 : 16 + size], n) ^ np.uint64(1 << 63)).view(np.int64)
    return np.repeat(ids, unsqueezed(data[16 + size :], n).astype(np.int64))


def prime_from(n: int) -> int:
    while any(n % p == 0 for p in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def merged_batch(key: tuple, new: pa.Table, old: pa.Table, groups: int) -> pa.Table:
    """One bucket of a batch against the same bucket of all runs: what repeats, by group of documents, and the new run."""
    rows: list[tuple] = []
    through = [r for r in zip(*[new[c].to_pylist() for c in ("grp", "docs", "idx")]) if r[0] is not None]
    rows += [("hit", grp, None, docs, idx) for grp, docs, idx in through]
    new = [r for r in zip(*[new[c].to_pylist() for c in ("vals", "docs", "idx")]) if r[0] is not None]
    if new:
        counts = [len(v) // 8 for v, _, _ in new]
        value = np.frombuffer(b"".join([v for v, _, _ in new]), np.uint64)
        doc, text = (np.concatenate(x) for x in zip(*[unpacked_owners(d) for _, d, _ in new]))
        idx = np.concatenate([unsqueezed(x, n) for (_, _, x), n in zip(new, counts)]).astype(np.int64)
        order = np.lexsort((doc, value))
        value, doc, text, idx = value[order], doc[order], text[order], idx[order]
        fresh = np.ones(len(value), bool)
        fresh[1:] = value[1:] != value[:-1]
        first = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        known = np.zeros(len(first), bool)
        for data in old["vals"].to_pylist():
            run = run_values(data)
            at = np.searchsorted(run, value[first])
            known |= run[np.minimum(at, len(run) - 1)] == value[first]
        hit = known[group] | (doc > doc[first][group])
        rows.append(("run", key[0].as_py(), run_bytes(value[first][~known]), None, None))
        doc, text, idx = doc[hit], text[hit], idx[hit]
        order = np.lexsort((idx, text, doc))
        doc, text, idx = doc[order], text[order], idx[order]
        for part, at in split_by(np.mod(doc ^ text, groups)):
            rows.append(("hit", part, None, packed_owners(doc[at], text[at]), squeezed(idx[at])))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["kind", "at", "vals", "docs", "idx"])


class Index:
    """A growing index of window fingerprints. Batches must come by ascending doc_id."""

    def __init__(self, spark: SparkSession, bits: int, groups: int, size: int = WINDOW, fanout: int = FANOUT) -> None:
        self.spark, self.bits, self.groups, self.size, self.fanout = spark, bits, groups, size, fanout
        self.runs: list[tuple[int, DataFrame, str]] = []  # tier, table, folder

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "bucket int, vals binary")

    def history(self) -> DataFrame:
        out = self.empty()
        for _, run, _ in self.runs:
            out = out.unionByName(run)
        return out

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds a batch (_k, _h, text); returns its repeated windows, packed by group of documents."""
        groups = self.groups

        def merge(key: tuple, new: pa.Table, old: pa.Table) -> pa.Table:
            return merged_batch(key, new, old, groups)

        new = batch_rows(docs, self.bits, self.size, groups)
        both = new.groupBy("bucket").cogroup(self.history().groupBy("bucket"))
        path = new_path(self.spark, "windows")
        out = written(both.applyInArrow(merge, "kind string, at int, vals binary, docs binary, idx binary"), "windows", ["kind"], path)
        self.runs.append((0, out.where("kind = 'run'").select(F.col("at").alias("bucket"), "vals"), f"{path}/kind=run"))
        self.compact()
        return out.where("kind = 'hit'").select(F.col("at").alias("grp"), "docs", "idx")

    def compact(self) -> None:
        """Merges the runs of a tier into one of the next as soon as there are ``fanout``; the old ones go."""
        tier = 0
        while len(old := [(r, p) for t, r, p in self.runs if t == tier]) >= self.fanout:

            def merge(key: tuple, table: pa.Table) -> pa.Table:
                # Sorted runs without a value in common: a stable sort merges them.
                values = np.sort(np.concatenate([run_values(v) for v in table["vals"].to_pylist()]), kind="stable")
                return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([run_bytes(values)], pa.binary())], ["bucket", "vals"])

            union = old[0][0]
            for run, _ in old[1:]:
                union = union.unionByName(run)
            path = new_path(self.spark, "run")
            new = written(union.groupBy("bucket").applyInArrow(merge, "bucket int, vals binary"), "run", path=path)
            self.runs = [r for r in self.runs if r[0] != tier] + [(tier + 1, new, path)]
            for _, gone in old:
                dropped(self.spark, gone)
            tier += 1


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n words lie in a window at one of ``starts``."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + size, n), -1)
    return np.cumsum(marks[:-1]) > 0


def deduplicated(docs: DataFrame, size: int = WINDOW, batches: int = BATCHES, digests: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept words (or their digest) of every whole text.

    A word goes if a window over it has the words of a window in a document of smaller doc_id. The
    documents enter the index in ``batches`` by ascending doc_id (equal ids share a batch and do not
    count as smaller; a null id is smallest). Rows are told apart by doc_id and text: rows that
    repeat both are alike, rows of one id with several texts are texts of their own. A null text has
    no words. One passage in any number of documents costs each of them its own windows and no more.
    """
    spark = docs.sparkSession
    size_of = scan_bytes(docs)
    small_batches(docs.sparkSession)
    text = text_or_empty()
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("_k"), F.xxhash64(text).alias("_h"), text.alias("text"))
    groups = prime_from(max(1, size_of // group_bytes) + 1)
    bits = min(30, max(0, (size_of // 4 // BUCKET_WINDOWS).bit_length()))
    found = rows.agg(F.percentile_approx("_k", [k / batches for k in range(1, batches)], 10_000).alias("q")).first()["q"] if batches > 1 else []
    edges = sorted(set(found or []))
    index, hits = Index(spark, bits, groups, size), None
    for low, high in zip([None, *edges], [*edges, None]):
        part = rows if low is None else rows.where(F.col("_k") >= low)
        part = part if high is None else part.where(F.col("_k") < high)
        new = index.add(part)
        hits = new if hits is None else hits.unionByName(new)

    def kept(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        at: dict[tuple[int, int], list[np.ndarray]] = {}
        for owners, idx in zip(found["docs"].to_pylist(), found["idx"].to_pylist()):
            doc, own = unpacked_owners(owners)
            places = unsqueezed(idx, len(doc)).astype(np.int64)
            cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(own) != 0)) + 1
            begin = np.r_[0, cuts]
            for d, h, p in zip(doc[begin].tolist(), own[begin].tolist(), np.split(places, cuts)):
                at.setdefault((d, h), []).append(p)
        n, gone, left = [], [], []
        for k, h, text in zip(texts["_k"].to_pylist(), texts["_h"].to_pylist(), texts["text"]):
            words = WORD.findall(text.as_py())
            n.append(len(words))
            if (k, h) in at:
                out = covered(len(words), np.concatenate(at[k, h]), size)
                words = [w for w, x in zip(words, out.tolist()) if not x]
            gone.append(n[-1] - len(words))
            line = " ".join(words)
            left.append(hashlib.sha256(line.encode()).hexdigest() if digests else line)
        return pa.table([texts["doc_id"].combine_chunks().cast(pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())], ["doc_id", "n_words", "n_removed", last])

    last = "kept_sha256" if digests else "kept"
    dealt = rows.withColumn("grp", F.pmod(F.col("_k").bitwiseXOR(F.col("_h")), F.lit(groups)).cast("int"))
    return dealt.groupBy("grp").cogroup(hits.groupBy("grp")).applyInArrow(kept, f"doc_id long, n_words long, n_removed long, {last} string")


def op8_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)


OP8_SQL = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
         pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w),
         g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM pos),
         h AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM g) WHERE first < doc_id),
         gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM h),
         lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
         words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
         kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS line FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
    FROM w LEFT JOIN lost ON w.doc_id = lost.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
