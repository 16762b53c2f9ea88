"""SimHash near duplicates through covering locality-sensitive hashing.

near_duplicates() links 64-bit fingerprints within a radius. similar() finds texts whose sets of word
shingles have a Jaccard similarity of 0.8 or more: a fingerprint of several 64-bit words, covering
masks within each word, and an exact look at the sets wherever the fingerprints leave a doubt.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import mixed, small_batches, text_or_empty, written
from weftline.llm.windows import run_bytes, run_values, split_by, squeezed, unsqueezed

RADIUS = 3
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Fingerprints that one task compares with one another; larger buckets are cut into blocks.
BLOCK = 1024
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str, k: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle, repeats included; of the whole sequence if it is shorter."""
    import xxhash

    words = WORD.findall(text.translate(LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    joined = " ".join(words).encode()
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - k] + 1).tolist()]
    ends = [*gaps[k - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes; zero for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 14):  # bounded memory for texts of any length
        counts += np.unpackbits(hashes[a : a + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint of every whole text as a signed 64-bit number (null text: zero)."""

    @F.pandas_udf("long")
    def made(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = np.array([fingerprint(shingle_hashes(t)) if t else 0 for t in batch], np.uint64)
            yield pd.Series(found.view(np.int64))

    return docs.drop("fp").withColumn("fp", made.asNondeterministic()(F.col("text")))


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2**(radius + 1) - 1 masks such that any two numbers at most ``radius`` bits apart agree under one.

    Each bit position has a vector of radius + 1 bits (its number, so vectors are spread evenly);
    mask v keeps the positions whose vector has odd parity with v. The vectors of at most
    ``radius`` positions leave some v that is even with all of them, and under that mask none of
    these positions shows.
    """
    size = 1 << (radius + 1)
    return [sum(1 << i for i in range(bits) if bin((i % size) & v).count("1") & 1) for v in range(1, size)]


def spanning(fps: np.ndarray, other: np.ndarray | None = None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges that join just what the close pairs among ``fps`` (or between it and ``other``) join; under n of them.

    Compares in numpy, a row against all; keeps only edges that join two components.
    """
    own = other is None
    right = fps if own else other
    parent = list(range(len(fps) + (0 if own else len(right))))
    shift = 0 if own else len(fps)

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in range(len(fps)):
        rest = right[i + 1 :] if own else right
        for j in np.flatnonzero(np.bitwise_count(rest ^ fps[i]) <= radius).tolist():
            j += i + 1 if own else 0
            a, b = top(i), top(j + shift)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(fps[i]), int(right[j])))
    return out


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints: each is at most ``radius`` bits long, and together
    they connect just what all such pairs connect.

    fps has distinct ``fp``. Each mask is a table, its buckets the masked values. A bucket of up to
    ``block`` fingerprints is compared in one task; a larger one is cut into blocks and every pair
    of blocks is compared by a task of its own, so no task sees more than two blocks and no pair is
    missed. What a task emits is a forest, never the pairs.
    """
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("value")) for k, m in enumerate(covering_masks(radius))])).alias("key"))
    keyed = keyed.select("fp", "key.mask", "key.value")
    counts = keyed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = written(counts, "buckets")
    keyed = keyed.join(counts, ["mask", "value"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    # Block b meets blocks 0..b as the second and b.. as the first of a pair.
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    dealt = keyed.withColumns({"blocks": blocks, "mine": mine}).select("mask", "value", "fp", "mine", F.explode(pairs).alias("pair"))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        fp, mine = table["fp"].to_numpy().view(np.uint64), table["mine"].to_numpy()
        keys = [table[c].to_numpy() for c in ("mask", "value", "i", "j")]
        order = np.lexsort(keys)
        ends = np.flatnonzero(np.any([np.diff(k[order]) != 0 for k in keys], axis=0)) + 1
        found: list[tuple[int, int]] = []
        for at in np.split(order, ends):
            i, j = keys[2][at[0]], keys[3][at[0]]
            found += spanning(fp[at], None, radius) if i == j else spanning(fp[at[mine[at] == i]], fp[at[mine[at] == j]], radius)
        a, b = (np.array([e[k] for e in found], np.uint64).view(np.int64) for k in (0, 1))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    # Whole comparisons are dealt evenly into groups of some blocks' worth of rows each.
    rows = counts.agg(F.sum(F.col("n") * F.ceil(F.col("n") / block)).alias("n")).first()["n"] or 0
    dealt = dealt.select("mask", "value", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "fp", "mine")
    part = F.pmod(F.xxhash64("mask", "value", "i", "j"), F.lit(max(1, rows // (16 * block)))).alias("part")
    return dealt.groupBy(part).applyInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node that it reaches, for the nodes of ``edges`` (a, b).

    Large-star and small-star rounds until nothing changes; each round is a table in the shared
    folder, so a lost executor costs a round at most. Nothing gathers a node's neighbours: both
    stars are a minimum by node and a join.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    mark = None
    while True:
        # Large star: every larger neighbour of u hangs on the least of u and its neighbours.
        two = both(now)
        least = two.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = two.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "edges")
        # Small star: u and its smaller neighbours hang on the least of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select(F.col("a").alias("u"), "m")
        small = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = written(small.where("a <> b").distinct(), "edges")
        new = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == new:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = new


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links) of every document.

    Equal fingerprints are one node from the start, so groups of copies of any size cost one row.
    A null or wordless text has fingerprint zero and links like any other; repeated rows share a
    component; an empty table gives an empty one; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = written(fingerprinted(docs.select("doc_id", "text")).select("doc_id", "fp"), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = written(nodes, "nodes")
    found = written(components(links(nodes.select("fp"), radius)), "components")
    rooted = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # By fingerprint: the class of each; a fingerprint that many documents share is a hot key only
    # of narrow rows, which adaptive execution splits.
    classes = written(rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id"), "classes")
    return rows.join(classes, F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", "component_id")


# --- texts of similar shingle sets ----------------------------------------------------------------

WORDS, LEAST = 5, 0.8
#: Share of pairs just at the threshold that may meet in no table.
MISSED = 0.01
#: Sets below this size are always compared themselves.
SMALL = 64
#: Keys of up to so many nodes give all their pairs at once (1.5 a node at most) and need no second look.
FEW = 4
#: Nodes of a tile and bytes of its sets; two tiles are compared by one task.
TILE, TILE_BYTES = 128, 1 << 23
#: Rows (a key's node with its fingerprint) that one group of keys holds, about.
MEETING_ROWS = 100_000
#: Keys of a bucket, about, that are sorted and compared at once.
RANGE = 1 << 18
#: Keys of a group of nodes, about; pairs of nodes that it holds at once; and fingerprints that it compares at once.
ENTRIES, PAIRS, COMPARED = 1 << 19, 1 << 20, 1 << 16
#: Keeps products that are whole numbers from being rounded past themselves.
ROUNDING = 1e-9


def apart(least: float) -> float:
    """Share of fingerprint bits in which two equally large sets of that Jaccard similarity differ."""
    return math.acos(2 * least / (1 + least)) / math.pi


def tables(rows: int, least: float) -> tuple[int, int]:
    """Bits of a key and words of a fingerprint for that many rows.

    A key has 4 bits more than the rows' number (24 at least), so unlike texts hardly ever share one;
    there are as many words, of 15 tables each, as make the share of missed pairs at the threshold
    MISSED, whatever the number of rows.
    """
    bits = 2 * math.ceil(max(24, (max(rows, 1) - 1).bit_length() + 4) / 2)
    bits = min(bits, 32)
    return bits, math.ceil(-math.log(MISSED) / (1 - apart(least)) ** bits / len(covering_masks()))


def majority(words: np.ndarray) -> np.ndarray:
    """Of rows of 64-bit words, the bits that are set in over half the rows, by carry-save adding of whole words."""
    n, width = words.shape
    count = np.zeros(64 * width, np.int64)
    weight = 1
    while len(words):
        carries = []
        while len(words) >= 3:
            q = len(words) // 3
            a, b, c = words[:q], words[q : 2 * q], words[2 * q : 3 * q]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * q :]])
        count += weight * np.unpackbits(words.astype(">u8").view(np.uint8).reshape(len(words), -1), axis=1).sum(axis=0, dtype=np.int64)
        words = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return np.packbits(2 * count > n).view(">u8").astype(np.uint64)


def wide_fingerprint(shingles: np.ndarray, words: int) -> np.ndarray:
    """``words`` independent SimHash words of a set of shingle hashes."""
    if not len(shingles):
        return np.zeros(words, np.uint64)
    seeds = mixed(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    total = None
    if len(shingles) <= 1 << 16:
        return majority(mixed(shingles[:, None] ^ seeds))
    for a in range(0, words, 4):  # bounded memory for texts of any length
        part = majority(mixed(shingles[:, None] ^ seeds[a : a + 4]))
        total = part if total is None else np.concatenate([total, part])
    return total


def text_hash() -> Column:
    return F.xxhash64(text_or_empty())


def described(docs: DataFrame, k: int, words: int) -> DataFrame:
    """doc_id and text_hash, which name a row; node (a hash of the shingle set), its size n and the wide fingerprint."""

    @F.pandas_udf("node binary, n int, wide array<long>")
    def made(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in texts:
            out = []
            for text in batch:
                own = np.unique(shingle_hashes(text or "", k))
                out.append((xxhash.xxh3_128_digest(own.tobytes()), len(own), wide_fingerprint(own, words).view(np.int64)))
            yield pd.DataFrame(out, columns=["node", "n", "wide"])

    rows = docs.select("doc_id", text_hash().alias("text_hash"), made.asNondeterministic()("text").alias("_m"))
    return rows.select("doc_id", "text_hash", "_m.*")


def key_ranges(packed_keys: pa.ChunkedArray, packed_ids: pa.ChunkedArray, firsts: pa.ChunkedArray, entries: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and ids of packed runs in order, about ``entries`` at a time; all of a key come together."""
    held = []
    for x, y, first in zip(packed_keys, packed_ids, firsts):
        keys = run_values(x.as_py())
        ids = unsqueezed(y.as_py(), len(keys)).view(np.int64)
        held.append((keys, ids.astype(np.int32) if len(ids) and ids.max() < 1 << 31 else ids, first.as_py()))
    total = sum(len(keys) for keys, _, _ in held)
    # Ends of the ranges: of so many keys of each run, evenly taken, those that part the whole evenly.
    parts = max(1, -(-total // entries))
    marks = np.sort(np.concatenate([keys[:: max(1, len(keys) // (4 * parts))] for keys, _, _ in held])) if parts > 1 else np.zeros(0, np.uint64)
    ends = np.unique(marks[np.arange(1, parts) * len(marks) // parts]) if parts > 1 else marks
    cuts = [np.r_[0, np.searchsorted(keys, ends, "right"), len(keys)] for keys, _, _ in held]
    for k in range(len(ends) + 1):
        keys = np.concatenate([x[at[k] : at[k + 1]] for (x, _, _), at in zip(held, cuts)])
        ids = np.concatenate([y[at[k] : at[k + 1]].astype(np.int64) + first for (_, y, first), at in zip(held, cuts)])
        order = np.lexsort((ids, keys))
        yield keys[order], ids[order]


def reached(ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The least of ``ids`` (distinct, in order) that each of them reaches over edges between them."""
    a, b = np.searchsorted(ids, edges[:, 0]), np.searchsorted(ids, edges[:, 1])
    least = np.arange(len(ids))
    while True:
        low, new = np.minimum(least[a], least[b]), least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, least):
            return ids[least]
        least = new


def gathered(packed_keys: pa.ChunkedArray, packed_ids: pa.ChunkedArray, firsts: pa.ChunkedArray, entries: int = RANGE, listed: bool = True) -> tuple[np.ndarray, ...]:
    """kind, a, b and c of met() for a bucket's packed runs; what is worked on at once is a range of its keys."""
    pairs, large, stars, times = [np.zeros((0, 2), np.int64)], [np.zeros((2, 0), np.int64)], np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    grouped = np.zeros(0, np.int64)
    for keys, ids in key_ranges(packed_keys, packed_ids, firsts, entries):
        new = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
        first = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        several = np.diff(np.r_[first, len(keys)])[of] > FEW
        star = np.flatnonzero(several & ~new)
        star = star[ids[star] != ids[first[of[star]]]]
        if len(star):
            both, at = np.unique(np.concatenate([stars, np.stack([ids[star], ids[first[of[star]]]], axis=1)]), axis=0, return_inverse=True)
            stars, times = both, np.bincount(at.ravel(), np.r_[times, np.ones(len(star), np.int64)], len(both)).astype(np.int64)
        own = []
        for step in range(1, FEW):
            at = np.flatnonzero((of[step:] == of[:-step]) & ~several[step:])
            own.append(np.stack([ids[at], ids[at + step]], axis=1))
        pairs.append(np.unique(np.concatenate(own), axis=0))
        if listed:
            large.append(np.stack([keys[several].view(np.int64), ids[several]]))
        else:
            grouped = np.union1d(grouped, ids[several])
    best = np.lexsort((stars[:, 1], -times, stars[:, 0]))
    stars, times = stars[best], times[best]
    own = np.flatnonzero(np.r_[True, stars[1:, 0] != stars[:-1, 0]]) if len(stars) else np.zeros(0, np.int64)
    pairs, large = np.unique(np.concatenate(pairs), axis=0), np.concatenate(large, axis=1)
    inside = np.isin(pairs[:, 0], grouped) & np.isin(pairs[:, 1], grouped)
    least = grouped if listed else reached(grouped, np.concatenate([stars, pairs[inside]]))
    parts = ((0, pairs[~inside, 0], pairs[~inside, 1], None), (1, large[0], large[1], None), (2, stars[own, 1], stars[own, 0], times[own]), (3, least, grouped, None))
    return tuple(np.concatenate(x) for x in zip(*[(np.full(len(a), k, np.int32), a, b, np.ones(len(a), np.int64) if c is None else c) for k, a, b, c in parts]))


def key_tables(bits: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of every word's tables, and the numbers that tell all tables' keys apart, word by word."""
    masks = np.array(covering_masks(RADIUS, 2 * bits), np.uint64)
    return masks, mixed(np.arange(1, words * len(masks) + 1, dtype=np.uint64))


def met(nodes: DataFrame, bits: int, words: int, rows: int, listed: bool = True) -> DataFrame:
    """Nodes (id, wide) that share a key in some table.

    kind 0 are pairs (a, b): all of a key that up to FEW nodes have. kind 1 are (key, id) of the keys that more nodes
    have, whose pairs are still to be looked at. kind 2 are pairs of a node of such keys and the least id of most of its keys
    in a bucket, with their number c: see starred().

    Not ``listed``, there is no kind 1, but kind 3: (a, b) of every node b of such keys in a bucket, one a bucket, with the
    least node a that it reaches there over keys. Pairs of two such nodes of a bucket are left out, as partners() finds all
    that these nodes share.
    """
    masks, table_of = key_tables(bits, words)
    buckets = max(0, (rows * words * len(masks) // 2_000_000).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 2048):
                part = batch.slice(a, 2048)
                ids = part["id"].to_numpy(zero_copy_only=False)
                wide = part["wide"].flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(ids), words)
                keys = mixed((wide[:, :, None] & masks).reshape(len(ids), -1) ^ table_of).ravel()
                own = np.repeat(ids - ids[0], words * len(masks))
                order = np.argsort(keys)
                keys, own = keys[order], own[order]
                out = [(bucket, run_bytes(keys[at]), squeezed(own[at].view(np.uint64)), int(ids[0])) for bucket, at in split_by(keys >> np.uint64(64 - buckets) if buckets else np.zeros(len(keys), np.uint64))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.int64()))], ["bucket", "keys", "ids", "first"])

    def gather(_: tuple, table: pa.Table) -> pa.Table:
        kind, a, b, c = gathered(table["keys"], table["ids"], table["first"], listed=listed)
        return pa.table([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["kind", "a", "b", "c"])

    dealt = nodes.select("id", "wide").mapInArrow(deal, "bucket int, keys binary, ids binary, first long")
    return written(dealt.groupBy("bucket").applyInArrow(gather, "kind int, a long, b long, c long"), "met", ["kind"])


def starred(shared: DataFrame) -> DataFrame:
    """Pairs (a, b) that join most of the nodes which crossing() would find apart: a node of large keys and the least id of most of them.

    One a node, however many keys a group's nodes share: the rest of a large key's pairs is crossing()'s, by tiles.
    """
    times = shared.where("kind = 2").groupBy("a", "b").agg(F.sum("c").alias("c"))
    return times.groupBy("b").agg(F.max(F.struct("c", (-F.col("a")).alias("a")))["a"].alias("a")).select((-F.col("a")).alias("a"), "b")


def judged(pairs: DataFrame, nodes: DataFrame, words: int, least: float) -> DataFrame:
    """Pairs (a, b) that may be similar: ``sure`` where the fingerprints leave no doubt that they are.

    Bits of a fingerprint are independent: the distance of a pair at the threshold is within five
    standard deviations of its mean but for three pairs in ten million.
    """
    share, total = apart(least), 64 * words
    spread = math.sqrt(share * (1 - share) * total)
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"wide_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least - ROUNDING)
    distance = F.aggregate(F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = both.select("a", "b", F.least("n_a", "n_b").alias("n"), distance.alias("d")).where(F.col("d") <= math.ceil(share * total + 5 * spread))
    return both.select("a", "b", ((F.col("d") <= math.floor(share * total - 5 * spread)) & (F.col("n") >= SMALL)).alias("sure"))


def shingle_sets(ids: DataFrame, docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """id and words, the whole set of shingle hashes in order, of the nodes in ``ids`` (distinct id)."""

    @F.pandas_udf("binary")
    def packed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: np.unique(shingle_hashes(t or "", k)).tobytes())

    asked = nodes.join(ids, "id").select("id", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    texts = docs.select("doc_id", "text", text_hash().alias("_h")).join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")))
    return written(texts.select("id", "text").dropDuplicates(["id"]).select("id", packed.asNondeterministic()("text").alias("words")), "sets")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes that are similar, by their whole sets."""
    pairs = written(pairs, "asked")

    @F.pandas_udf("boolean")
    def similar_sets(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both >= least * (len(x) + len(y) - both) - ROUNDING)
            yield pd.Series(out, dtype=bool)

    sets = shingle_sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), docs, nodes, k)
    a, b = sets.select(F.col("id").alias("a"), F.col("words").alias("_a")), sets.select(F.col("id").alias("b"), F.col("words").alias("_b"))
    seen = pairs.join(a, "a").join(b, "b").select("a", "b", similar_sets.asNondeterministic()("_a", "_b").alias("_s"))
    return written(seen.where("_s").select("a", "b"), "similar")


def rooted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and root of every node under the edges."""
    found = components(edges).withColumnRenamed("node", "_node")
    return written(nodes.select("id").join(found, F.col("id") == F.col("_node"), "left").select("id", F.coalesce("root", "id").alias("root")), "roots")


def linked(candidates: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, words: int, least: float) -> DataFrame:
    """The similar ones among the candidate pairs (a, b); doubtful pairs that sure ones join anyway are left out."""
    found = written(judged(candidates, nodes, words, least), "judged")
    sure, doubt = found.where("sure").select("a", "b"), found.where("NOT sure").select("a", "b")
    roots = rooted(sure, nodes)
    ra, rb = roots.select(F.col("id").alias("a"), F.col("root").alias("_ra")), roots.select(F.col("id").alias("b"), F.col("root").alias("_rb"))
    doubt = doubt.join(ra, "a").join(rb, "b").where("_ra <> _rb").select("a", "b")
    return written(sure.unionByName(verified(doubt, docs, nodes, k, least)), "edges")


def tiled(groups: DataFrame, stars: DataFrame, roots: DataFrame, nodes: DataFrame, tile: int, tile_bytes: int) -> DataFrame:
    """id, root, n, wide, hub, m and tile of the nodes of large keys, where a hub's m nodes are of several components.

    Nodes whose ``groups`` (a, b: kind 3 of met()) hang together have one hub; nodes of two hubs share no key.
    Within it, nodes whose ``stars`` hang together are dealt evenly into tiles of about ``tile`` nodes and sets of ``tile_bytes`` at most.
    """

    def placed(rows: DataFrame, edges: DataFrame, name: str) -> DataFrame:
        found = components(edges).withColumnRenamed("root", "_root")
        return rows.join(found, F.col("id") == F.col("node"), "left").withColumn(name, F.coalesce("_root", "id")).drop("node", "_root")

    hubs = placed(placed(groups.select(F.col("b").alias("id")).distinct(), groups, "hub"), stars, "star")
    hubs = written(hubs.join(roots, "id").join(nodes.select("id", "n", "wide"), "id"), "hubs")
    mixed_hubs = hubs.groupBy("hub").agg(F.count(F.lit(1)).alias("m"), (F.min("root") < F.max("root")).alias("_mixed")).where("_mixed").drop("_mixed")
    tiles = F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(8 * F.sum("n") / tile_bytes), F.lit(1))
    sizes = hubs.groupBy("star").agg(tiles.alias("tiles"))
    own = F.xxhash64("star", F.pmod(F.xxhash64("id"), F.col("tiles"))).alias("tile")
    return written(hubs.join(mixed_hubs, "hub").join(sizes, "star").select("id", "root", "n", "wide", "hub", "m", own), "tiles")


def partnered(keys: np.ndarray, own: np.ndarray, ids: np.ndarray, root: np.ndarray, n: np.ndarray, tile: np.ndarray, wide: np.ndarray, least: float, limit: int, block: int = BLOCK, pairs: int = PAIRS) -> tuple[np.ndarray, ...]:
    """kind, a, b and id of partners() for entries (keys, own: a place in the nodes' columns) of whole keys.

    Pairs are made key by key, each with the next, the one after it and so on; ``pairs`` of them, about, are held at once.
    """
    order = np.argsort(keys, kind="stable")
    keys, own = keys[order], own[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    size = np.diff(np.r_[first, len(keys)])
    several = np.minimum.reduceat(root[own], first) != np.maximum.reduceat(root[own], first) if len(first) else np.zeros(0, bool)
    m, place = np.repeat(size, size), np.arange(len(keys)) - np.repeat(first, size)
    over = np.repeat(several & (size > block), size)
    _, tile_of = np.unique(tile, return_inverse=True)
    tiles, count = int(tile_of.max(initial=0)) + 1, len(ids)
    held, found = [np.zeros(0, np.int64)], np.zeros(0, np.int64)

    def compared(codes: np.ndarray) -> np.ndarray:
        """Nodes by pairs of tiles, as numbers, of the pairs whose fingerprints allow similarity."""
        out = [np.zeros(0, np.int64)]
        for a in range(0, len(codes), COMPARED):
            x, y = codes[a : a + COMPARED] // count, codes[a : a + COMPARED] % count
            near = np.bitwise_count(wide[x] ^ wide[y]).sum(axis=1, dtype=np.int64) <= limit
            x, y = x[near], y[near]
            both = np.minimum(tile_of[x], tile_of[y]) * tiles + np.maximum(tile_of[x], tile_of[y])
            out.append(np.unique(np.concatenate([both * count + x, both * count + y])))
        return np.concatenate(out)

    left = np.flatnonzero(np.repeat(several & (size <= block), size))
    for step in range(1, int(m[left].max(initial=1))):
        left = left[place[left] + step < m[left]]
        x, y = own[left], own[left + step]
        fits = (root[x] != root[y]) & (np.minimum(n[x], n[y]) >= np.maximum(n[x], n[y]) * least - ROUNDING)
        held.append(np.minimum(x, y)[fits] * count + np.maximum(x, y)[fits])
        if sum(map(len, held)) > pairs:
            found = np.union1d(found, compared(np.unique(np.concatenate(held))))
            held = held[:1]
    found = np.union1d(found, compared(np.unique(np.concatenate(held))))
    of = np.unique(tile)
    both, node = found // max(count, 1), found % max(count, 1)
    parts = ((0, of[both // tiles], of[both % tiles], ids[node]), (1, keys[over].view(np.int64), m[over], ids[own[over]]))
    return tuple(np.concatenate(x) for x in zip(*[(np.full(len(a), kind, np.int32), a, b, c) for kind, a, b, c in parts]))


def partners(placed: DataFrame, bits: int, words: int, least: float, entries: int = ENTRIES, block: int = BLOCK) -> DataFrame:
    """(i, j, id): the nodes of two tiles (or one) that have a partner there: another component's node that shares
    a key and whose size and fingerprint allow similarity.

    Never more rows than two a pair, and no more a node than there are tiles that it has partners in, for each group that it is in.
    A node goes once, with its fingerprint, to the group of its hub, where all keys are made; a hub of over ``entries`` keys is
    parted by keys, so that no node goes to more groups than it has keys. Only keys of over ``block`` nodes are
    listed, with their number m, where these are of several components: meetings() compares them block by block.
    """
    share, total = apart(least), 64 * words
    limit = math.ceil(share * total + 5 * math.sqrt(share * (1 - share) * total))
    masks, table_of = key_tables(bits, words)
    each = words * len(masks)
    names = ["id", "root", "n", "tile", "wide"]

    def keys_of(wide: pa.Array | pa.ChunkedArray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        wide = wide.to_numpy(zero_copy_only=False).view(np.uint64).reshape(rows, words)
        return wide, mixed((wide[:, :, None] & masks).reshape(rows, each) ^ table_of)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                rows = batch.slice(a, 256)
                splits = rows["splits"].to_numpy().astype(np.uint64)
                keys = keys_of(rows["wide"].flatten(), len(rows))[1] % splits[:, None]
                keys.sort(axis=1)
                node, at = np.nonzero(np.diff(keys.astype(np.int64), axis=1, prepend=-1))
                out = pa.Table.from_batches([rows]).take(pa.array(node)).append_column("split", pa.array(keys[node, at].astype(np.int64)))
                yield from out.select(["part", "splits", "split", *names]).combine_chunks().to_batches()

    def compare(_: tuple, table: pa.Table) -> pa.Table:
        splits, split, ids, root, n, tile = (table[c].to_numpy().astype(np.int64) for c in ("splits", "split", "id", "root", "n", "tile"))
        wide, keys = keys_of(table["wide"].combine_chunks().flatten(), len(ids))
        node, at = np.nonzero(keys % splits.astype(np.uint64)[:, None] == split.astype(np.uint64)[:, None])
        out = partnered(keys[node, at], node, ids, root, n, tile, wide, least, limit, block)
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["kind", "a", "b", "id"])

    # Hubs of fewer keys share groups; each part of a larger one is a group of its own.
    groups = max(1, -(-placed.count() * each // entries))
    splits = F.ceil(F.col("m") * each / entries).cast("long")
    part = F.when(splits > 1, F.col("hub")).otherwise(-1 - F.pmod(F.xxhash64("hub"), F.lit(groups)))
    form = "part long, splits long, split long, id long, root long, n int, tile long, wide array<long>"
    dealt = placed.select(part.alias("part"), splits.alias("splits"), *names).mapInArrow(deal, form)
    found = written(dealt.groupBy("part", "split").applyInArrow(compare, "kind int, a long, b long, id long"), "partners", ["kind"])
    meeting = found.where("kind = 0").select(F.col("a").alias("i"), F.col("b").alias("j"), "id").distinct()
    keyed = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("m"), "id")
    return written(meeting if keyed.isEmpty() else meeting.union(meetings(keyed, placed.drop("hub", "m"), words, least, block)).distinct(), "meetings")


def meetings(keyed: DataFrame, placed: DataFrame, words: int, least: float, block: int = BLOCK) -> DataFrame:
    """partners() by the keys (key, id, m) alone; those of over ``block`` nodes are compared block by block, a pair of blocks a group of its own."""
    share, total = apart(least), 64 * words
    limit = math.ceil(share * total + 5 * math.sqrt(share * (1 - share) * total))
    blocks = F.ceil(F.col("m") / block).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    names = ["key", "id", "root", "n", "tile", "wide", "mine"]
    dealt = keyed.join(placed, "id").withColumns({"blocks": blocks, "mine": mine}).select(*names, F.explode(pairs).alias("pair"))
    dealt = dealt.select(*names, F.col("pair.i").alias("i"), F.col("pair.j").alias("j"))

    def compare(_: tuple, table: pa.Table) -> pa.Table:
        ids, root, n, tile, mine, key, i, j = (table[c].to_numpy() for c in ("id", "root", "n", "tile", "mine", "key", "i", "j"))
        wide = table["wide"].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(ids), words)
        order = np.lexsort((j, i, key))
        ends = np.flatnonzero(np.any([np.diff(x[order]) != 0 for x in (key, i, j)], axis=0)) + 1
        found = [np.zeros((0, 3), np.int64)]
        for at in np.split(order, ends):
            left, right = (at, at) if i[at[0]] == j[at[0]] else (at[mine[at] == i[at[0]]], at[mine[at] == j[at[0]]])
            here = found[:1]
            for x in left:
                fits = (root[right] != root[x]) & (np.minimum(n[right], n[x]) >= np.maximum(n[right], n[x]) * least - ROUNDING)
                near = right[fits]
                near = near[np.bitwise_count(wide[near] ^ wide[x]).sum(axis=1, dtype=np.int64) <= limit]
                low, high = np.minimum(tile[near], tile[x]), np.maximum(tile[near], tile[x])
                here.append(np.stack([low, high, ids[near]], axis=1))
                here.append(np.unique(np.stack([low, high, np.full(len(near), ids[x])], axis=1), axis=0))
            found.append(np.unique(np.concatenate(here), axis=0))
        out = np.unique(np.concatenate(found), axis=0)
        return pa.table([pa.array(out[:, c], pa.int64()) for c in range(3)], ["i", "j", "id"])

    # Nodes of a large group meet at many keys: the fewer groups keys are dealt to, the more of that folds where it is found.
    rows = keyed.agg(F.sum(F.ceil(F.col("m") / block)).alias("n")).first()["n"] or 0
    part = F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, -(-rows // MEETING_ROWS)))).alias("part")
    return written(dealt.groupBy(part).applyInArrow(compare, "i long, j long, id long").distinct(), "meetings")


def joined_sets(ids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges (a, b) between similar sets that join just the components which all similar pairs join; fewer than components.

    Every set is compared with all later ones of other components at once, by marking its members.
    """
    _, parent = np.unique(roots, return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    marks = np.zeros(len(codes), bool)
    out = []
    for x in range(len(sets) - 1):
        if not np.any(parent[x + 1 :] != parent[x]):
            continue
        own = codes[starts[x] : starts[x] + sizes[x]]
        marks[own] = True
        counts = np.r_[0, np.cumsum(marks[codes[starts[x + 1] :]])]
        marks[own] = False
        ends = starts[x + 1 :] - starts[x + 1]
        both = counts[ends + sizes[x + 1 :]] - counts[ends]
        alike = both >= least * (sizes[x] + sizes[x + 1 :] - both) - ROUNDING
        for y in (x + 1 + np.flatnonzero(alike)).tolist():
            if parent[x] != parent[y]:
                parent[parent == parent[y]] = parent[x]
                out.append((int(ids[x]), int(ids[y])))
    return out


def crossing(groups: DataFrame, stars: DataFrame, roots: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, bits: int, words: int, least: float, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Edges (a, b) between similar nodes of different components that share a key, of the nodes of large keys (``groups``: kind 3 of met()); a forest a pair of tiles.

    Each node's whole set goes once to every pair of tiles where it has a partner, not once to each
    partner; there all are compared exactly. A group holds the sets of two tiles at most.
    """
    placed = tiled(groups, stars, roots, nodes, tile, tile_bytes)
    meeting = partners(placed, bits, words, least)
    sets = shingle_sets(meeting.select("id").distinct(), docs, nodes, k)

    def settle(_: tuple, table: pa.Table) -> pa.Table:
        found = joined_sets(table["id"].to_numpy(), table["root"].to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for c in table["words"].chunks for x in c], least)
        return pa.table([pa.array([e[c] for e in found], pa.int64()) for c in (0, 1)], ["a", "b"])

    members = meeting.join(placed.select("id", "root"), "id").join(sets, "id").select("i", "j", "id", "root", "words")
    return written(members.groupBy("i", "j").applyInArrow(settle, "a long, b long").distinct(), "crossing")


def similar(docs: DataFrame, k: int = WORDS, least: float = LEAST) -> DataFrame:
    """doc_id and text_hash of every row, with those of its component's first row: kept_id, kept_hash.

    Links are between texts whose sets of ``k``-word shingles have a Jaccard similarity of ``least``
    or more. Such a pair meets in one of the tables but for the share MISSED at the threshold, and
    far less above it. First is the least doc_id, null after all others, then the least hash of the
    text: rows are named by both, so texts without an id, or that share one, stay apart. Equal sets
    are one node from the start; null texts and texts without words are equal.
    """
    small_batches(docs.sparkSession)
    n = docs.count()
    bits, words = tables(n, least)
    rows = written(described(docs, k, words), "shingles")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    nodes = rows.groupBy("node").agg(first, F.first("n").alias("n"), F.first("wide").alias("wide"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    shared = met(nodes, bits, words, n, listed=False)
    stars = written(starred(shared), "stars")
    pairs = written(shared.where("kind = 0").select("a", "b").union(stars).distinct(), "pairs")
    edges = linked(pairs, docs, nodes, k, words, least)
    roots = rooted(edges, nodes)
    groups = shared.where("kind = 3").select("a", "b")
    more = None if groups.isEmpty() else crossing(groups, stars, roots, docs, nodes, k, bits, words, least)
    if more is not None and not more.isEmpty():
        roots = rooted(edges.unionByName(more), nodes)
    placed = nodes.select("id", "node", "first").join(roots, "id")
    least_of = placed.groupBy("root").agg(F.min("first").alias("kept"))
    classes = placed.join(least_of, "root").select("node", F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_hash").alias("kept_hash"))
    return rows.join(classes, "node").select("doc_id", "text_hash", "kept_id", "kept_hash")


def without_copies(docs: DataFrame, k: int = WORDS, least: float = LEAST) -> DataFrame:
    """``docs`` with the first row of each component of similar() alone."""
    kept = similar(docs, k, least).select(F.col("kept_id").alias("_id"), F.col("kept_hash").alias("_kept")).distinct()
    named = docs.withColumn("_hash", text_hash())
    return named.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_kept")), "left_semi").dropDuplicates(["doc_id", "_hash"]).select(docs.columns)


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
