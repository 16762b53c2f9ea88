"""Exact Jaccard join of n-gram sets by prefix lists that skip by position and answers that derive from one another.

1. Equal texts are one from the start. Distinct texts are dealt into groups; every group's shingles are counted
   over all groups (sorted runs, a bucket for each range of hashes), and the group gets back how frequent each is.
2. A set's prefix is its rarest shingles, as many as a similar set cannot all lack. A shingle that one text alone
   has starts no list. Equal sets are one node from here on.
3. Lists of a few nodes give their pairs. Longer ones, once each where several have the same members, are cut into
   blocks by size and by position in the prefix; two blocks meet only if their sizes and what is left after these
   positions allow a similar pair.
4. Where blocks meet, a set's overlaps with all others are derived from those of a very similar set already
   answered: only the shingles in which the two differ are looked up. A forest of links comes out, not the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.audit import PASS_BYTES, eights, word_hashes
from weftline.llm.common import mixed, packed_groups, scan_bytes, small_batches, text_digest, unpacked_groups, utf8, written
from weftline.llm.simhash import components
from weftline.llm.windows import run_bytes, run_values, word_bounds

WORDS, PERCENT = 3, 90
#: Input of a group of texts, and of a bucket of shingles, in bytes of files.
GROUP_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20
#: Leading bits of a shingle's hash that its frequency is counted by (shared ones only look more frequent).
COUNTED_BITS = 48
#: Lists of up to so many nodes give all their pairs.
FEW = 4
#: Nodes of a block and bytes of its sets, at most; ranges of positions that blocks are cut by.
BLOCK, BLOCK_BYTES, RANGES = 512, 4 << 20, 4
#: Sets whose answers are kept for others to derive theirs from.
ANSWERS = 8


def needed(size: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """Least overlap of a set of that size with any similar set."""
    return -(-percent * size // 100)


def codes_of(frequency: np.ndarray) -> np.ndarray:
    """A byte that grows with the number of texts that hold a shingle; zero for one."""
    return np.minimum(255, np.floor(8 * np.log2(frequency))).astype(np.uint8)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of every text, A-Z lower-cased; of the whole sequence if it is shorter.

    Words are hashed from their bytes and shingles from their words, many texts at once.
    """
    data, offsets = utf8(texts)
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PASS_BYTES, side="right")) - 1)
        part = data[offsets[a] : offsets[b]]
        part = np.where((part >= 65) & (part <= 90), part + np.uint8(32), part)
        starts, ends, count = word_bounds(part, offsets[a : b + 1] - offsets[a])
        words = word_hashes(part, eights(part), starts, ends - starts) if len(starts) else np.zeros(0, np.uint64)
        first = np.cumsum(count) - count
        # A word and the k - 1 after it; what reaches into the next text is not used.
        joined = mixed(words + np.uint64(k))
        for step in range(1, k):
            joined[: len(words) - step] = mixed(joined[: len(words) - step] ^ words[step:])
        for at, n in zip(first.tolist(), count.tolist()):
            if n >= k:
                yield np.unique(joined[at : at + n - k + 1])
            elif n:
                whole = np.array([n], np.uint64)
                for w in words[at : at + n]:
                    whole = mixed(whole ^ w)
                yield whole
            else:
                yield np.zeros(0, np.uint64)
        a = b


def sets_of(table: pa.Table, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """digest and shingle set of every distinct text of a group."""
    seen: set[bytes] = set()
    for rows in unpacked_groups(table):
        digests = rows["digest"].to_pylist()
        fresh = [i for i, d in enumerate(digests) if d not in seen and not seen.add(d)]
        yield from zip((digests[i] for i in fresh), shingle_sets(rows["text"].take(pa.array(fresh, pa.int64())), k))


def runs(dealt: DataFrame, buckets: int, k: int) -> DataFrame:
    """(bucket, grp, tokens, counts): each group's distinct shingles and in how many of its texts they are, by range of hashes."""

    def count(key: tuple, table: pa.Table) -> pa.Table:
        import zstandard

        own = [tokens for _, tokens in sets_of(table, k)]
        tokens, counts = np.unique(np.concatenate(own) >> np.uint64(64 - COUNTED_BITS) if own else np.zeros(0, np.uint64), return_counts=True)
        cuts = np.searchsorted(tokens, (np.arange(buckets + 1, dtype=object) * (1 << COUNTED_BITS) // buckets).astype(np.float64).astype(np.uint64))
        cuts[-1] = len(tokens)
        pack = zstandard.ZstdCompressor(level=1).compress
        out = [(b, key[0].as_py(), run_bytes(tokens[a:z]), pack(np.minimum(counts[a:z], 1 << 30).astype("<u4").tobytes())) for b, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])) if z > a]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "grp", "tokens", "counts"])

    return dealt.groupBy("grp").applyInArrow(count, "bucket int, grp int, tokens binary, counts binary")


def frequencies(counted: DataFrame) -> DataFrame:
    """(grp, bucket, codes): for each run, in its order, how frequent its shingles are in all texts."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        import zstandard

        values = [run_values(x) for x in table["tokens"].to_pylist()]
        inflate = zstandard.ZstdDecompressor().decompress
        counts = np.concatenate([np.frombuffer(inflate(c, max_output_size=4 * len(v)), "<u4") for c, v in zip(table["counts"].to_pylist(), values)])
        _, of = np.unique(np.concatenate(values), return_inverse=True)
        codes = codes_of(np.bincount(of, weights=counts)[of])
        ends = np.cumsum([len(v) for v in values])
        pack = zstandard.ZstdCompressor(level=3).compress
        return pa.table([table["grp"], table["bucket"], pa.array([pack(codes[z - len(v) : z].tobytes()) for v, z in zip(values, ends)], pa.binary()), pa.array([len(v) for v in values], pa.int32())], ["grp", "bucket", "codes", "n"])

    return counted.groupBy("bucket").applyInArrow(add, "grp int, bucket int, codes binary, n int")


TEXTS = "digest binary, node binary, n int, tokens array<long>, places array<int>, words binary"


def prefixes(dealt: DataFrame, told: DataFrame, k: int, percent: int) -> DataFrame:
    """Of every distinct text: its node (a hash of the set), set size n, and where others have some of its rarest shingles
    these with their places in the prefix, and all of its shingles that other texts have."""

    def cut(key: tuple, texts: pa.Table, codes: pa.Table) -> pa.Table:
        import xxhash
        import zstandard

        inflate = zstandard.ZstdDecompressor().decompress
        codes = codes.sort_by("bucket")
        parts = [np.frombuffer(inflate(c, max_output_size=n), np.uint8) for c, n in zip(codes["codes"].to_pylist(), codes["n"].to_pylist())]
        found = list(sets_of(texts, k))
        known = np.unique(np.concatenate([t for _, t in found]) >> np.uint64(64 - COUNTED_BITS) if found else np.zeros(0, np.uint64))
        codes = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        out = []
        for digest, tokens in found:
            code = codes[np.searchsorted(known, tokens >> np.uint64(64 - COUNTED_BITS))]
            order = np.lexsort((tokens, code))[: len(tokens) - needed(len(tokens), percent) + 1] if len(tokens) else np.zeros(0, np.int64)
            place = np.flatnonzero(code[order] > 0)
            words = tokens[code > 0].tobytes() if len(place) else None
            out.append((digest, xxhash.xxh3_128_digest(tokens.tobytes()), len(tokens), tokens[order[place]].view(np.int64).tolist(), place.tolist(), words))
        kinds = (pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], ["digest", "node", "n", "tokens", "places", "words"])

    return dealt.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(cut, TEXTS)


def described(docs: DataFrame, k: int, percent: int, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """prefixes() of the distinct texts of ``docs`` (text)."""
    size = scan_bytes(docs.select("text"))
    groups, buckets = max(1, -(-size // group_bytes)), max(1, -(-size // bucket_bytes))
    texts = docs.select(text_digest().alias("digest"), "text")
    # An equal text goes once from each batch of rows of a task, however many have it.
    dealt = packed_groups(texts, F.pmod(F.xxhash64("digest"), F.lit(groups)), groups, once="digest")
    told = written(frequencies(runs(dealt, buckets, k)), "frequencies")
    return written(prefixes(dealt, told, k, percent), "prefixes")


def in_lists(nodes: DataFrame) -> DataFrame:
    """(token, id, n, place, m): the entries of every list of several nodes, m of them."""
    entries = nodes.select("id", "n", F.explode(F.arrays_zip("tokens", "places")).alias("e")).select(F.col("e.tokens").alias("token"), "id", "n", F.col("e.places").alias("place"))
    counts = entries.groupBy(F.col("token").alias("_token")).agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("x")).where("m > 1")
    # Lists of the same members are one: a member's place is its first in any of them, which passes no fewer pairs.
    same = counts.groupBy("m", "s", "x").agg(F.min("_token").alias("list"), F.collect_list("_token").alias("all"))
    same = same.select("list", "m", F.explode("all").alias("_token"))
    return entries.join(same, F.col("token") == F.col("_token")).groupBy("list", "id", "n", "m").agg(F.min("place").alias("place"))


def may_match(a: str, b: str, percent: int) -> Column:
    """Whether the entries a and b (columns n and place) can be the first that two similar sets share: sizes, and what is left of both."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(n_a - F.col(f"{a}.place"), n_b - F.col(f"{b}.place"))
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & ((100 + percent) * left >= percent * (n_a + n_b))


def pair_links(lists: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the nodes of lists of up to FEW nodes, by the whole sets."""
    few = written(lists.where(F.col("m") <= FEW), "few")
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.list") == F.col("y.list")) & (F.col("x.id") < F.col("y.id")) & may_match("x", "y", percent))
    pairs = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("words").alias(f"w_{x}"))

    @F.pandas_udf("boolean")
    def linked(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for left, right, n_left, n_right in batches:
            shared = np.array([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(left, right)], np.int64)
            total = n_left.to_numpy().astype(np.int64) + n_right.to_numpy() - shared
            yield pd.Series(100 * shared >= percent * total)

    seen = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", linked.asNondeterministic()("w_a", "w_b", "n_a", "n_b").alias("_linked"))
    return seen.where("_linked").select("a", "b")


def met_blocks(lists: DataFrame, sizes: DataFrame, percent: int, block: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The members of longer lists (list, blk, id) and the pairs of their blocks (list, i, j) that may hold a similar pair.

    A block has nodes of one class of sizes (a similar set is in the same class or the next) and one range of
    positions, cut evenly until it has ``block`` nodes and ``block_bytes`` of sets at most.
    """
    many = lists.where(F.col("m") > FEW).join(sizes, "id")
    kind = F.floor(F.log("n") / math.log(100 / percent)).cast("int")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    range_of = F.when(F.col("m") <= block, 0).otherwise(F.least(F.lit(RANGES - 1), F.floor(F.col("place") * RANGES / prefix))).cast("int")
    many = many.select("list", "id", "n", "place", "bytes", F.when(F.col("m") <= block, 0).otherwise(kind).alias("kind"), range_of.alias("range"))
    cut = many.groupBy("list", "kind", "range").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("bytes") / block_bytes), F.lit(1)).cast("int").alias("cuts"))
    placed = many.join(cut, ["list", "kind", "range"])
    placed = written(placed.select("list", "id", "n", "place", F.xxhash64("kind", "range", F.pmod(F.xxhash64("id"), F.col("cuts"))).alias("blk")), "blocks")
    ends = placed.groupBy("list", "blk").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("place")).alias("left"))
    x, y = ends.alias("x"), ends.alias("y")
    sized = (100 * F.col("x.high") >= percent * F.col("y.low")) & (100 * F.col("y.high") >= percent * F.col("x.low"))
    reach = (100 + percent) * F.least("x.left", "y.left") >= percent * (F.col("x.low") + F.col("y.low"))
    pairs = x.join(y, (F.col("x.list") == F.col("y.list")) & (F.col("x.blk") <= F.col("y.blk")) & sized & reach)
    return placed, pairs.select(F.col("x.list").alias("list"), F.col("x.blk").alias("i"), F.col("y.blk").alias("j"))


def forest(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (a, b) that join what all similar pairs of a ``left`` and a ``right`` set join; fewer than sets.

    The overlaps of a set with all others come from its shingles' lists, or, where it differs little from a set
    already answered, from that one's overlaps and the lists of the shingles in which they differ.
    """
    lengths = np.array([len(x) for x in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(sets)), lengths)
    order = np.argsort(codes, kind="stable")
    members = owner[order]
    to = np.cumsum(np.bincount(codes))
    at = np.r_[0, to[:-1]]
    own = [np.sort(codes[z - n : z]) for z, n in zip(ends, lengths)]

    def holders(tokens: np.ndarray) -> np.ndarray:
        """How many of ``tokens`` each set has."""
        size = to[tokens] - at[tokens]
        if not size.sum():
            return np.zeros(len(sets), np.int64)
        where = np.arange(size.sum()) + np.repeat(at[tokens] - (np.cumsum(size) - size), size)
        return np.bincount(members[where], minlength=len(sets))

    parent = np.arange(len(sets))
    answers: list[tuple[int, np.ndarray]] = []
    out = []
    for x in left.tolist():
        other = right[(parent[right] != parent[x]) & (100 * np.minimum(sizes[right], sizes[x]) >= percent * np.maximum(sizes[right], sizes[x]))]
        if not len(other):
            continue
        near = max(answers, key=lambda e: 2 * e[1][x] - lengths[e[0]], default=None)
        if near is not None and lengths[near[0]] + lengths[x] - 2 * near[1][x] < lengths[x] // 2:
            y, known = near
            overlap = known + holders(np.setdiff1d(own[x], own[y], assume_unique=True)) - holders(np.setdiff1d(own[y], own[x], assume_unique=True))
        else:
            overlap = holders(own[x])
            answers = [*answers[-ANSWERS + 1 :], (x, overlap)]
        shared = overlap[other]
        for y in other[100 * shared >= percent * (sizes[x] + sizes[other] - shared)].tolist():
            if parent[x] != parent[y]:
                parent[parent == parent[y]] = parent[x]
                out.append((int(ids[x]), int(ids[y])))
    return out


def block_links(lists: DataFrame, nodes: DataFrame, percent: int, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) that join what the similar pairs of longer lists join."""
    placed, pairs = met_blocks(lists, nodes.select("id", F.octet_length("words").alias("bytes")), percent, block, block_bytes)
    pairs = written(pairs, "met")
    sides = pairs.select("list", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("blk"))
    rows = sides.join(placed.select("list", "blk", "id"), ["list", "blk"]).join(nodes.select("id", "n", "words"), "id").select("list", "i", "j", "blk", "id", "n", "words")

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in table["words"].chunks for x in c]
        blk, i, j = table["blk"].to_numpy(), key[1].as_py(), key[2].as_py()
        found = forest(table["id"].to_numpy(), table["n"].to_numpy().astype(np.int64), sets, np.flatnonzero(blk == i), np.flatnonzero(blk == j), percent)
        return pa.table([pa.array([e[c] for e in found], pa.int64()) for c in (0, 1)], ["a", "b"])

    return rows.groupBy("list", "i", "j").applyInArrow(settle, "a long, b long")


def joined(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable over links) of every document.

    Sets of ``k``-word shingles link where 100 * intersection >= ``percent`` * union. The join is exact but for hashes: a shingle
    is a 64-bit hash of its words, equal texts share 128 bits of SHA-256 and equal sets 128 bits of XXH3. Texts without words, null ones among
    them, link with nothing: their component is their own doc_id. Repeated rows share a component; a null doc_id is never the least,
    and a component of null ids alone has a null one; an empty table gives an empty one; other columns are not read.
    """
    small_batches(docs.sparkSession)
    texts = described(docs.select("text"), k, percent)
    nodes = texts.where(F.size("tokens") > 0).dropDuplicates(["node"]).withColumn("id", F.monotonically_increasing_id())
    nodes = written(nodes.select("id", "node", "n", "tokens", "places", "words"), "nodes")
    lists = written(in_lists(nodes), "lists")
    edges = written(pair_links(lists, nodes, percent).unionByName(block_links(lists, nodes, percent, block, block_bytes)), "links")
    found = written(components(edges), "components")
    rows = docs.select("doc_id", text_digest().alias("digest"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    rooted = nodes.select("id", F.col("node").alias("_node")).join(found.select(F.col("node").alias("_id"), "root"), F.col("id") == F.col("_id"), "left")
    known = texts.select("digest", "node", "n").join(first, "digest").join(rooted.select("_node", F.coalesce("root", "id").alias("root")), F.col("node") == F.col("_node"), "left")
    known = written(known.select("digest", "n", "first", "root"), "rooted")
    # Where no root is, no other text has one of the rarest shingles: the text is a component by itself.
    least = known.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("first").alias("least"))
    classes = known.join(least, "root", "left").select(F.col("digest").alias("_digest"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "first").alias("component_id"))
    classes = written(classes, "classes")
    out = rows.join(classes, F.col("digest") == F.col("_digest"))
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op12_jaccard(spark, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
    WITH RECURSIVE
         d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
         s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                                   ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
         n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
         p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
         l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
         r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id
"""
