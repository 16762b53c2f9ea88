"""Removal of repeated byte strings by a blockwise suffix array over a difference cover.

A difference cover D modulo v has, for any two positions i and j, a shift d < v that puts both
i + d and j + d on sample positions (residue in D). So two equal strings of ``length`` bytes hold
equal sample strings of length - v + 1 bytes at the same shift.

1. The sample strings of all documents are dealt into buckets by hash, a bucket is sorted at a time;
   a sample string that occurs once can be part of no repeat and is dropped.
2. Where the whole surroundings of samples (all strings of ``length`` bytes over the sample) are
   equal, everything there repeats (the sample's and its surroundings' hashes, of two bases, must
   agree). What is left is contested: one sample string, unequal surroundings.
3. Suffixes: those that run into contested samples start up to v - 1 bytes before one. A suffix
   bucket is sorted alone: its sample strings get ranks in byte order, and suffixes are ordered by
   the few bytes before the sample, long ties over the sample by its rank, then by the bytes after
   it. Neighbours in these orders tell which strings repeat; every comparison is of real bytes.

Memory is bounded by a bucket or a group of documents. Samples with equal surroundings within a task
are folded there, so a passage in very many copies loads a bucket once a task. A bucket of very many
members is parted by the bytes that its suffixes must share, which loses none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Rolling, mixed, scan_bytes, small_batches, text_or_empty, utf8, written
from weftline.llm.windows import packed_runs, prime_from, split_by, squeezed, unpacked_runs, unsqueezed

CHUNK_BYTES, GATHERED = 1 << 18, 500_000
BUCKET_SAMPLES = 1_000_000
GROUP_BYTES = 4 << 20
#: Members of a contested sample string beyond which it is parted.
LARGE = 20_000
#: Contested samples whose bytes a group of documents holds at once.
CONTESTED = 50_000
WHOLE = 7


@dataclass(frozen=True)
class Cover:
    """Length of the strings that must not repeat, period of the cover and its residues (a perfect difference set)."""

    length: int
    period: int
    residues: tuple[int, ...]
    #: Kinds of sub-bucket that a large bucket is parted into; a divisor of the period.
    parts: int = 7

    @property
    def sample(self) -> int:
        return self.length - self.period + 1

    @property
    def side(self) -> int:
        return self.period - 1

    @property
    def step(self) -> int:
        return self.period // self.parts

    @cached_property
    def check(self) -> bool:
        apart = {(a - b) % self.period for a in self.residues for b in self.residues}
        return len(apart) == self.period and self.period % self.parts == 0 and self.sample > 0 and self.parts <= WHOLE

    def positions(self, n: int) -> np.ndarray:
        """Sample positions of a text of n bytes at which a whole sample string stands."""
        at = (np.arange(0, max(n, 0) + self.period, self.period)[:, None] + np.array(self.residues)).ravel()
        return at[: np.searchsorted(at, n - self.sample, "right")]


# Perfect difference sets modulo 133 and 91.
BYTES_400 = Cover(400, 133, (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121))
BYTES_256 = Cover(256, 91, (0, 1, 3, 9, 27, 49, 56, 61, 77, 81))


def samples(data: np.ndarray, offsets: np.ndarray, cover: Cover = BYTES_400) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each sample string, hash of its surroundings, text number and position in the text."""
    sizes = np.diff(offsets)
    template = cover.positions(int(sizes.max(initial=0)))
    count = np.where(sizes >= cover.length, np.searchsorted(template, sizes - cover.sample, "right"), 0)
    text = np.repeat(np.arange(len(sizes)), count)
    at = template[np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)]
    if not len(text):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), text, at
    left, right = np.minimum(at, cover.side), np.minimum(sizes[text] - at - cover.sample, cover.side)
    p = offsets[:-1][text] + at
    around = Rolling(data, 1).ranges(p - left, p + cover.sample + right) ^ mixed((left * 1024 + right).astype(np.uint64))
    return Rolling(data, 0).ranges(p, p + cover.sample), around, text, at


def dealt_samples(docs: DataFrame, bits: int, groups: int, cover: Cover) -> DataFrame:
    """Samples of all texts by bucket (the hash's top bits): hashes, documents and positions, packed.

    Of samples of a task with equal surroundings one goes to the bucket, marked; the others are known
    to repeat: their rows have no hashes, name a group of documents and only pass through.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            key, around, doc, at = (np.concatenate(x) for x in zip(*held))
            held.clear()
            both = key ^ mixed(around)
            order = np.argsort(both, kind="stable")
            new = np.r_[True, (key[order][1:] != key[order][:-1]) | (around[order][1:] != around[order][:-1])]
            starts = np.flatnonzero(new)
            several = np.zeros(len(key), np.int64)
            several[order[starts]] = np.diff(np.r_[starts, len(order)]) > 1
            first = np.zeros(len(key), bool)
            first[order[starts]] = True
            rows = []
            mine = np.flatnonzero(first)
            for bucket, w in split_by(key[mine] >> np.uint64(64 - bits) if bits else np.zeros(len(mine), np.uint64)):
                w = mine[w]
                rows.append((bucket, None, key[w].tobytes(), around[w].tobytes(), packed_runs(doc[w]), squeezed(at[w] * 2 + several[w])))
            mine = np.flatnonzero(~first)
            for grp, w in split_by(np.mod(doc[mine], groups)):
                w = mine[w]
                rows.append((grp % (1 << bits), grp, None, None, packed_runs(doc[w]), squeezed(at[w])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.binary()] * 4))], ["bucket", "grp", "keys", "around", "docs", "at"])

        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            ends = utf8(texts)[1]
            a = 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK_BYTES, "right")) - 1)
                key, around, text, at = samples(*utf8(texts.slice(a, b - a)), cover)
                if len(key):
                    held.append((key, around, ids[a:b][text], at))
                if sum(len(h[0]) for h in held) >= GATHERED:
                    yield out()
                a = b
        if held:
            yield out()

    return docs.mapInArrow(deal, "bucket int, grp int, keys binary, around binary, docs binary, at binary")


RANKED = "grp int, kind string, docs binary, at binary, keys binary"


def ranked(key: tuple, table: pa.Table, groups: int, most: int = LARGE) -> pa.Table:
    """The samples of one bucket, sorted: those whose surroundings repeat, and contested ones with their name."""
    rows: list[tuple] = [(grp, "same", docs, at, None) for grp, docs, at in zip(*[table[c].to_pylist() for c in ("grp", "docs", "at")]) if grp is not None]
    own = [r for r in zip(*[table[c].to_pylist() for c in ("keys", "around", "docs", "at")]) if r[0] is not None]
    if own:
        name, around = (np.frombuffer(b"".join(x), np.uint64) for x in list(zip(*own))[:2])
        doc = np.concatenate([unpacked_runs(d) for _, _, d, _ in own])
        at = np.concatenate([unsqueezed(x, len(k) // 8) for k, _, _, x in own]).astype(np.int64)
        order = np.lexsort((around, name))
        name, around, doc, at = name[order], around[order], doc[order], at[order]
        several, at = (at & 1).astype(bool), at >> 1
        new = np.ones(len(name), bool)
        new[1:] = name[1:] != name[:-1]
        inner = new.copy()
        inner[1:] |= around[1:] != around[:-1]
        rank, kind = np.cumsum(new) - 1, np.cumsum(inner) - 1
        same = (np.bincount(kind)[kind] > 1) | several
        kinds = np.bincount(rank[inner])
        # Of equal surroundings one stands for all in the contest.
        asked = (kinds[rank] > 1) & inner
        large = asked & (kinds[rank] > most)
        for what, chosen in (("same", same), ("ask", asked & ~large), ("large", large)):
            where = np.flatnonzero(chosen)
            where = where[np.lexsort((at[where], doc[where]))]
            for part, w in split_by(np.mod(doc[where], groups)):
                w = where[w]
                rows.append((part, what, packed_runs(doc[w]), squeezed(at[w]), None if what == "same" else name[w].tobytes()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()))], ["grp", "kind", "docs", "at", "keys"])


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that the intervals cover."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[first], reach[np.r_[first[1:] - 1, len(reach) - 1]]


def by_doc(table: pa.Table) -> dict[int, dict[str, list[np.ndarray]]]:
    """What ranked() and sorted_suffixes() say, by document."""
    out: dict[int, dict[str, list[np.ndarray]]] = {}
    for kind, ids, at, keys in zip(*[table[c].to_pylist() for c in ("kind", "docs", "at", "keys")]):
        doc = unpacked_runs(ids)
        place = unsqueezed(at, len(doc)).astype(np.int64)
        if kind == "span":
            extra = unsqueezed(keys, len(doc)).astype(np.int64)
        elif kind == "same":
            extra = place
        else:
            extra = np.frombuffer(keys, np.int64)
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for d, p, x in zip(doc[np.r_[0, cuts]].tolist(), np.split(place, cuts), np.split(extra, cuts)):
            out.setdefault(d, {}).setdefault(kind, []).append(np.stack([p, x]))
    return out


def settled(doc: int | None, data: bytes, start: np.ndarray, end: np.ndarray, digests: bool) -> tuple:
    """The result row of a document from the intervals to remove."""
    start, end = merged(start, end)
    kept, at = [], 0
    for a, b in zip(start.tolist(), end.tolist()):
        kept.append(data[at:a])
        at = b
    left = b"".join([*kept, data[at:]])
    return doc, len(data), len(data) - len(left), len(start), hashlib.sha256(left).hexdigest() if digests else None, None if digests else left


def without_orphans(kept: bytes) -> str:
    """Kept bytes as text; bytes of code points that a removal cut through go too."""
    return kept.decode("utf-8", "ignore")


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
KEYED_OUT = f"{OUT}, k long"
STEP_C = f"kind string, {KEYED_OUT}, text binary, starts binary, ends binary, bucket int, strings binary, which binary, parts binary, sides binary, docs binary, at binary"


def contexts(data: np.ndarray, places: np.ndarray, cover: Cover) -> tuple[np.ndarray, np.ndarray]:
    """Of each sample: its string; the bytes before it, from near to far, and after it, zero beyond the text."""
    padded = np.zeros(len(data) + 2 * cover.side, np.uint8)
    padded[cover.side : cover.side + len(data)] = data
    at = places[:, None] + cover.side
    before, after = at - 1 - np.arange(cover.side), at + cover.sample + np.arange(cover.side)
    return padded[at + np.arange(cover.sample)], padded[np.concatenate([before, after], axis=1)]


def context_rows(held: list[tuple[np.ndarray, ...]], bits: int, cover: Cover) -> Iterator[tuple]:
    """Contested samples of some documents by suffix bucket: their distinct strings, and what surrounds each."""
    name, part, left, right, strings, sides, doc, place = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((place, doc))
    for bucket, w in split_by(mixed(name[order]) >> np.uint64(64 - bits) if bits else np.zeros(len(name), np.uint64)):
        w = order[w]
        distinct, which = np.unique(np.ascontiguousarray(strings[w]).view(f"S{cover.sample}").ravel(), return_inverse=True)
        meta = np.stack([part[w], left[w], right[w]], axis=1).astype(np.uint8).tobytes()
        yield ("ctx", *[None] * 10, bucket, squeezed_bytes(distinct), squeezed(which), meta, squeezed_bytes(sides[w]), packed_runs(doc[w]), squeezed(place[w]))


def resolve(bits: int, digests: bool, cover: Cover):  # noqa: ANN201
    """By group of documents: results of those that no contest concerns; of the others, texts and contested surroundings."""
    side, size, step = cover.side, cover.sample, cover.step

    def run(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        known = by_doc(found)
        rows: list[tuple] = []
        held: list[tuple[np.ndarray, ...]] = []
        for doc, k, text in zip(texts["doc_id"].to_pylist(), texts["_k"].to_pylist(), texts["text"]):
            data = text.as_py().encode()
            own = known.get(k, {})
            n = len(data)
            place = np.concatenate([x[0] for x in own["same"]]) if "same" in own else np.zeros(0, np.int64)
            start, end = np.maximum(place - side, 0), np.minimum(place + size + side, n)
            if "ask" not in own and "large" not in own:
                rows.append(("done", *settled(doc, data, start, end, digests), k, *[None] * 10))
                continue
            start, end = merged(start, end)
            rows.append(("carry", doc, *[None] * 5, k, data, squeezed(start), squeezed(end), len(start), *[None] * 6))
            array = np.frombuffer(data, np.uint8)
            for kind in ("ask", "large"):
                if kind not in own:
                    continue
                places, names = np.concatenate(own[kind], axis=1)
                for a in range(0, len(places), CONTESTED):
                    place, name = places[a : a + CONTESTED], names[a : a + CONTESTED].view(np.uint64)
                    left, right = np.minimum(place, side), np.minimum(n - place - size, side)
                    strings, sides = contexts(array, place, cover)
                    if kind == "ask":
                        held.append((name, np.full(len(place), WHOLE), left, right, strings, sides, np.full(len(place), k), place))
                    else:
                        rolling = Rolling(array)
                        for j in range(cover.parts):
                            ok = (left >= step * j) & (right >= side - step * (j + 1) + 1)
                            p = place[ok]
                            shared = rolling.ranges(p - step * j, p + size + side - step * (j + 1) + 1)
                            held.append((mixed(shared ^ mixed(name[ok] + np.uint64(j))), np.full(len(p), j), left[ok], right[ok], strings[ok], sides[ok], np.full(len(p), k), p))
                    if sum(len(h[0]) for h in held) >= CONTESTED:
                        rows += context_rows(held, bits, cover)
                        held.clear()
        if held:
            rows += context_rows(held, bits, cover)
        return as_table(rows, STEP_C)

    return run


def squeezed_bytes(data: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(data).tobytes())


def unsqueezed_bytes(data: bytes, n: int, width: int) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=n * width), np.uint8).reshape(n, width)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def as_table(rows: list[tuple], ddl: str) -> pa.Table:
    names, types = zip(*[c.strip().split(" ") for c in ddl.split(",")])
    return pa.table([pa.array(c, _TYPES[t]) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], list(names))


def sorted_suffixes(rank: np.ndarray, part: np.ndarray, left: np.ndarray, right: np.ndarray, sides: np.ndarray, cover: Cover) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contested samples with ranks: which have a repeated string over them, and its least and greatest lead.

    Both sides are sorted within each rank once; the common prefixes of neighbours then tell, for
    each lead x, which suffixes agree on x bytes before the sample and side - x after it.
    """
    n, side = len(rank), cover.side
    classes = []
    for half in (sides[:, :side], sides[:, side:]):
        head = np.concatenate([rank.astype(">u8").view(np.uint8).reshape(-1, 8), half], axis=1)
        order = np.argsort(np.ascontiguousarray(head).view(f"S{8 + side}").ravel(), kind="stable")
        differ = np.ones((n, 9 + side), bool)
        differ[1:, : 8 + side] = head[order][1:] != head[order][:-1]
        common = differ.argmax(axis=1) - 8  # of a suffix with the one before it; below zero for another rank
        common[0] = -9
        classes.append((order, common))
    low, high = np.full(n, cover.period), np.full(n, -1)
    ids = np.empty((2, n), np.int64)
    for x in range(cover.period):
        for k, depth in ((0, x), (1, side - x)):
            order, common = classes[k]
            ids[k, order] = np.cumsum(common < depth)
        ok = np.flatnonzero((left >= x) & (right >= side - x) & ((part == WHOLE) | (part == x // cover.step)))
        if len(ok) < 2:
            continue
        both = ids[0, ok] * (n + 1) + ids[1, ok]
        order = np.argsort(both, kind="stable")
        equal = both[order][1:] == both[order][:-1]
        again = ok[order[np.r_[equal, False] | np.r_[False, equal]]]
        low[again] = np.minimum(low[again], x)
        high[again] = x
    found = np.flatnonzero(high >= 0)
    return found, low[found], high[found]


def suffix_bucket(key: tuple, table: pa.Table, groups: int, cover: Cover) -> pa.Table:
    """Ranks the sample strings of one bucket in byte order and sorts its suffixes; spans to remove, by group of documents."""
    meta = [np.frombuffer(x, np.uint8).reshape(-1, 3).astype(np.int64) for x in table["parts"].to_pylist()]
    counts = [len(x) for x in meta]
    meta = np.concatenate(meta)
    strings, which, at = [], [], 0
    for data, own, n in zip(table["strings"].to_pylist(), table["which"].to_pylist(), counts):
        own = unsqueezed(own, n).astype(np.int64)
        some = int(own.max()) + 1
        strings.append(unsqueezed_bytes(data, some, cover.sample).view(f"S{cover.sample}").ravel())
        which.append(own + at)
        at += some
    rank = np.unique(np.concatenate(strings), return_inverse=True)[1][np.concatenate(which)]
    sides = np.concatenate([unsqueezed_bytes(x, n, 2 * cover.side) for x, n in zip(table["sides"].to_pylist(), counts)])
    doc = np.concatenate([unpacked_runs(x) for x in table["docs"].to_pylist()])
    place = np.concatenate([unsqueezed(x, n) for x, n in zip(table["at"].to_pylist(), counts)]).astype(np.int64)
    # A rank and part that stand alone here repeat nothing.
    rank = rank * (WHOLE + 1) + meta[:, 0]
    _, inverse, number = np.unique(rank, return_inverse=True, return_counts=True)
    live = np.flatnonzero(number[inverse] > 1)
    rows: list[tuple] = []
    if len(live):
        found, low, high = sorted_suffixes(rank[live], meta[live, 0], meta[live, 1], meta[live, 2], sides[live], cover)
        doc, place = doc[live][found], place[live][found]
        start, end = place - high, place - low + cover.length
        order = np.lexsort((start, doc))
        for part, w in split_by(np.mod(doc[order], groups)):
            w = order[w]
            rows.append((part, "span", packed_runs(doc[w]), squeezed(start[w]), squeezed(end[w])))
    return as_table(rows, RANKED)


def finish(digests: bool):  # noqa: ANN201
    """By group: carried documents with the spans of their contests."""

    def run(key: tuple, carried: pa.Table, spans: pa.Table) -> pa.Table:
        known = by_doc(spans)
        rows = []
        for doc, k, data, start, end, n in zip(*[carried[c].to_pylist() for c in ("doc_id", "k", "text", "starts", "ends", "bucket")]):
            own = np.concatenate(known[k]["span"], axis=1) if k in known else np.zeros((2, 0), np.int64)
            start, end = (np.r_[unsqueezed(x, n).astype(np.int64), y] for x, y in zip((start, end), own))
            rows.append((*settled(doc, data, start, end, digests), k))
        return as_table(rows, KEYED_OUT)

    return run


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with ``_k``, a number that names its (doc_id, text), and whether any of these repeats.

    That is doc_id where it has one text. Null ids and ids of several texts get numbers outside the
    range of ids, given once and written; if no such range is left, all pairs are numbered.
    """
    named = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_text_id": F.unhex(F.md5(text_or_empty()))})
    pairs = written(named.groupBy("_id", "_text_id").agg(F.count(F.lit(1)).alias("rows")), "texts")
    several = pairs.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR _id IS NULL").select(F.col("_id").alias("_several"))
    chosen = pairs.join(several, F.col("_id").eqNullSafe(F.col("_several")), "left_semi")
    seen = pairs.agg(F.min("_id").alias("low"), F.max("_id").alias("high"), F.max("rows").alias("rows")).first()
    repeated = (seen["rows"] or 0) > 1

    def numbered(some: DataFrame) -> tuple[DataFrame, int | None]:
        given = written(some.select(F.col("_id").alias("_i"), F.col("_text_id").alias("_t"), F.monotonically_increasing_id().alias("_number")), "keys")
        return given, given.agg(F.max("_number").alias("n")).first()["n"]

    given, top = numbered(chosen)
    if top is None:
        return named.withColumn("_k", F.col("_id")).drop("_id", "_text_id"), repeated
    low, high = seen["low"] or 0, seen["high"] or 0
    number = F.col("_number")
    if high + 1 + top < 1 << 63:
        number = F.lit(high + 1).cast("long") + number
    elif low - 1 - top >= -(1 << 63):
        number = F.lit(low - 1).cast("long") - number
    else:
        given, _ = numbered(pairs)
    joined = named.join(given, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text_id") == F.col("_t")), "left")
    return joined.withColumn("_k", F.coalesce(number, F.col("_id"))).drop("_id", "_text_id", "_i", "_t", "_number"), repeated


def deduplicated(docs: DataFrame, digests: bool = False, group_bytes: int = GROUP_BYTES, large: int = LARGE, cover: Cover = BYTES_400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes (or their digest) of every whole text.

    A byte goes if a string of ``cover.length`` bytes over it also starts anywhere else, in the same
    document or another; strings are judged on the input. A null text is empty; shorter texts stay
    whole. doc_id and text name a row: rows that repeat both are each other's repeats and share a
    result; texts without an id, or of one id, are texts of their own.
    """
    return results(docs, keyed(docs)[0], digests, group_bytes, large, cover).drop("k")


def results(docs: DataFrame, named: DataFrame, digests: bool = False, group_bytes: int = GROUP_BYTES, large: int = LARGE, cover: Cover = BYTES_400) -> DataFrame:
    """deduplicated() of ``docs``, with the key ``k`` that ``named``, from keyed(), has as ``_k``."""
    if not cover.check:
        raise ValueError("the residues are no difference cover of the period, or the parts do not divide it")
    size_of = scan_bytes(docs)
    small_batches(docs.sparkSession)
    groups = prime_from(max(1, size_of // group_bytes) + 1)
    bits = min(30, max(0, (size_of * len(cover.residues) // cover.period * 2 // BUCKET_SAMPLES).bit_length()))
    rows = named.select("doc_id", "_k", text_or_empty().alias("text"))
    ranks = dealt_samples(rows.select("_k", "text"), bits, groups, cover).groupBy("bucket").applyInArrow(lambda key, table: ranked(key, table, groups, large), RANKED)
    ranks = written(ranks, "ranks")
    dealt = rows.withColumn("grp", F.pmod("_k", F.lit(groups)).cast("int"))
    step = dealt.groupBy("grp").cogroup(ranks.groupBy("grp")).applyInArrow(resolve(bits, digests, cover), STEP_C)
    step = written(step, "suffixes", ["kind"])
    buckets = step.where("kind = 'ctx'").select("bucket", "strings", "which", "parts", "sides", "docs", "at")
    spans = buckets.groupBy("bucket").applyInArrow(lambda key, table: suffix_bucket(key, table, groups, cover), RANKED)
    carried = step.where("kind = 'carry'").select("doc_id", "k", "text", "starts", "ends", "bucket", F.pmod("k", F.lit(groups)).cast("int").alias("grp"))
    last = carried.groupBy("grp").cogroup(spans.groupBy("grp")).applyInArrow(finish(digests), KEYED_OUT)
    columns = [c.strip().split(" ")[0] for c in KEYED_OUT.split(",")]
    out = step.where("kind = 'done'").select(*columns).unionByName(last)
    return out.drop("kept" if digests else "kept_sha256")


def deduplicated_texts(docs: DataFrame, cover: Cover = BYTES_400) -> DataFrame:
    """``docs`` with the removals applied to ``text`` and n_chars renewed; other columns stay as they are."""

    @F.pandas_udf("string")
    def text(kept: pd.Series) -> pd.Series:
        return kept.map(without_orphans)

    named, repeated = keyed(docs)
    left = results(docs, named, cover=cover).select(F.col("k").alias("_left"), F.when(F.col("n_removed") > 0, text("kept")).otherwise(F.col("kept").cast("string")).alias("_text"))
    left = left.dropDuplicates(["_left"]) if repeated else left
    rest = named.drop("text", "n_chars")
    out = rest.join(left, F.col("_k") == F.col("_left"))
    renewed = {"text": left["_text"], "n_chars": F.length(left["_text"]).cast("long")}
    return out.select(*[renewed[c].alias(c) if c in renewed else rest[c] for c in docs.columns])


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
