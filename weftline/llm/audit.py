"""How document filters interact: what each removes, and what it would have removed, in every order of application.

Texts are measured by a table-driven byte transducer: one pass over the UTF-8 bytes looks up, for the state
before a byte and the byte, what to count, and gives the spans of the words, which go into an open-addressing
hash table that compares the words' bytes before it takes two as equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import mixed, small_batches, text_digest, utf8, written

#: Outputs of the transducer, a bit each.
START, END, CAPITAL, SYMBOL, POINT = 1, 2, 4, 8, 16
SYMBOLS = b"#$%&*|"
SPACES = bytes([32, *range(9, 14)])
#: Bytes of text that one pass takes at once (a longer text is a pass of its own).
PASS_BYTES = 4 << 20
#: Words of more bytes are hashed and compared one by one.
LONG_WORD = 1024
FILTERS = "ABCDE"


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """The next state by byte, and the outputs by 256 * state + byte; state 0 is outside a word, 1 inside.

    UTF-8 continuation bytes (10xxxxxx) are in words and start no code point.
    """
    byte = np.arange(256)
    state = (~np.isin(byte, list(SPACES))).astype(np.uint8)
    own = np.where((byte >= 65) & (byte <= 90), CAPITAL, 0) | np.where(np.isin(byte, list(SYMBOLS)), SYMBOL, 0) | np.where((byte & 0xC0) != 0x80, POINT, 0)
    return state, np.concatenate([own | np.where(state == 1, START, 0), own | np.where(state == 0, END, 0)]).astype(np.uint8)


STATE, OUTPUT = transducer()


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number (zeros past the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


#: Keeps the first 0 to 8 bytes of such a number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, view: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    import xxhash

    out = lengths.astype(np.uint64)
    at = np.flatnonzero(lengths <= LONG_WORD)
    k = 0
    while len(at):
        out[at] = mixed(out[at] ^ (view[starts[at] + k] & _FIRST[np.minimum(lengths[at] - k, 8)]) + np.uint64(0x9E3779B97F4A7C15))
        k += 8
        at = at[lengths[at] > k]
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + lengths[i]].tobytes())
    return out


def same_bytes(data: np.ndarray, view: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans of ``lengths`` at ``a`` and at ``b`` have the same bytes."""
    out = np.ones(len(a), bool)
    at = np.flatnonzero(lengths <= LONG_WORD)
    k = 0
    while len(at):
        out[at] &= ((view[a[at] + k] ^ view[b[at] + k]) & _FIRST[np.minimum(lengths[at] - k, 8)]) == 0
        k += 8
        at = at[(lengths[at] > k) & out[at]]
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[i] = np.array_equal(data[a[i] : a[i] + lengths[i]], data[b[i] : b[i] + lengths[i]])
    return out


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, texts: int, hashes: np.ndarray | None = None) -> np.ndarray:
    """The number of different words of each text: the spans are put into a hash table, all at once and round by round.

    In a round every span that is still out looks at its slot: an empty one is claimed; a holder of the same
    text, hash and bytes means that the word is there already; another holder sends the span a slot on.
    ``hashes`` replaces the words' hashes (tests make them collide).
    """
    view, lengths = eights(data), ends - starts
    hashes = word_hashes(data, view, starts, lengths) if hashes is None else hashes
    mask = (1 << max(1, (2 * len(starts)).bit_length())) - 1
    slot = (mixed(hashes ^ mixed(owner.astype(np.uint64) + np.uint64(1))) & np.uint64(mask)).astype(np.int64)
    table = np.full(mask + 1, -1, np.int64)
    out = np.arange(len(starts))
    while len(out):
        empty = out[table[slot[out]] < 0]
        table[slot[empty]] = empty
        holder = table[slot[out]]
        there = (holder != out) & (owner[holder] == owner[out]) & (hashes[holder] == hashes[out]) & (lengths[holder] == lengths[out])
        at = np.flatnonzero(there)
        there[at] = same_bytes(data, view, starts[out[at]], starts[holder[at]], lengths[out[at]])
        out = out[(holder != out) & ~there]
        slot[out] = (slot[out] + 1) & mask
    return np.bincount(owner[table[table >= 0]], minlength=texts)


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: words, different words, capitals, code points, symbols (five columns)."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros((n, 5), np.int64)
    before = np.zeros(len(data), np.int64)
    before[1:] = STATE[data[:-1]]
    before[offsets[:-1][offsets[:-1] < len(data)]] = 0  # every text begins outside a word
    found = OUTPUT[256 * before + data]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    starts = np.flatnonzero(found & START)
    # A word ends where a later byte says so, or with its text.
    ends = np.sort(np.concatenate([np.flatnonzero(found & END), last[STATE[data[last]] == 1] + 1]))
    owner = np.searchsorted(offsets, starts, side="right") - 1
    count = lambda bit: np.diff(np.searchsorted(np.flatnonzero(found & bit), offsets))
    return np.stack([np.diff(np.searchsorted(starts, offsets)), distinct_words(data, starts, ends, owner, n), count(CAPITAL), count(POINT), count(SYMBOL)], axis=1)


MEASURES = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def measured(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the five measures of every whole text (null: empty)."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col("text").alias("_measured"))
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(len(names)))
            out, a = [np.zeros((0, 5), np.int64)], 0
            while a < len(offsets) - 1:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PASS_BYTES, side="right")) - 1)
                out.append(measures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                a = b
            found = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), *(pa.array(found[:, k], pa.int64()) for k in range(5))], [*names, *MEASURES])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, " + ", ".join(f"{m} long" for m in MEASURES))


def own_failures() -> Column:
    """Bits 1, 2, 4, 8 for the filters A, B, C and D, which look at a text alone."""
    tests = (F.col("n_words") < 100, 100 * F.col("n_distinct") < 80 * F.col("n_words"), 100 * F.col("n_capitals") > 10 * F.col("n_points"), F.col("n_symbols") > 0)
    return sum((F.when(t, F.lit(1 << k)).otherwise(F.lit(0)) for k, t in enumerate(tests)), F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask (bits 1 to 16 for failing A to E), n, good and toxic: documents by which filters they fail.

    E needs the table: a document fails it if a smaller doc_id has its text. Documents are folded by text and doc_id
    before texts meet, so a text that a third of all rows share is a few rows. A null doc_id neither fails E nor
    makes others fail; rows that repeat a doc_id do not fail for one another. Several labels of a doc_id: one that says so is enough.
    """
    rows = measured(docs, [F.col("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_digest().alias("digest")])
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.select("doc_id", "part", "digest", own_failures().alias("mask")).join(marks, F.col("doc_id") == F.col("_id"), "left")
    kinds = ["digest", "part", "mask", "good", "toxic"]
    rows = rows.withColumns({"good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))}).groupBy(*kinds, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("doc_id").isNotNull()
    folded = rows.groupBy(*kinds).agg(F.min("doc_id").alias("first"), F.sum("n").alias("n"), F.min_by(F.when(known, F.col("n")), "doc_id").alias("at_first"), F.sum(F.when(known, F.lit(0)).otherwise(F.col("n"))).alias("no_id"))
    least = F.min("first").over(Window.partitionBy("digest"))
    passing = F.col("no_id") + F.when(F.col("first") == F.col("least"), F.col("at_first")).otherwise(F.lit(0))
    folded = folded.withColumn("least", least).withColumn("passing", passing)
    both = F.explode(F.array(F.struct(F.lit(0).alias("bit"), F.col("passing").alias("n")), F.struct(F.lit(16).alias("bit"), (F.col("n") - F.col("passing")).alias("n")))).alias("e")
    told = folded.select("part", "mask", "good", "toxic", both).select("part", (F.col("mask") + F.col("e.bit")).alias("mask"), "good", "toxic", F.col("e.n").alias("n")).where("n > 0")
    return told.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def interactions(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and the seven counts, from failure_counts(): every order of the filters, step by step."""
    orders = F.explode(F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")).alias("filter_order")
    steps = counts.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    before = lambda x: F.instr("filter_order", x) < F.col("step")
    earlier = sum((F.when(before(x), F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumns({"letter": letter, "earlier": earlier}).withColumn("bit", F.element_at(F.create_map(*[v for k, x in enumerate(FILTERS) for v in (F.lit(x), F.lit(1 << k))]), F.col("letter")))
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("earlier")) > 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(F.lit(0)))
    out = steps.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audited(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of all documents by ``part``: 600 rows a part, zeros included; an empty table has no part and no row.

    Only doc_id, text and ``part`` of the documents and doc_id, quality and toxic of the labels are read, whatever else they hold.
    """
    return interactions(written(failure_counts(docs, labels, part), "failures"))


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audited(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
         w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
         b AS (SELECT part, coalesce(quality = 1, false)::INT AS good, coalesce(toxic = 1, false)::INT AS toxic,
                      (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
                      + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INT
                      + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > least, false)::INT AS mask
               FROM w LEFT JOIN labels ON w.doc_id = labels.doc_id),
         m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM b GROUP BY part, mask),
         f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
         o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
               WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
         g AS (SELECT filter_order, step, filter_order[step] AS letter, 1 << (strpos('ABCDE', filter_order[step]) - 1)::INT AS bit,
                      (CASE WHEN strpos(filter_order, 'A') < step THEN 1 ELSE 0 END + CASE WHEN strpos(filter_order, 'B') < step THEN 2 ELSE 0 END
                       + CASE WHEN strpos(filter_order, 'C') < step THEN 4 ELSE 0 END + CASE WHEN strpos(filter_order, 'D') < step THEN 8 ELSE 0 END
                       + CASE WHEN strpos(filter_order, 'E') < step THEN 16 ELSE 0 END) AS earlier
               FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
         r AS (SELECT part, filter_order, step, letter,
                      sum(CASE WHEN mask & bit = 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                      sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
                      sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                      sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
                      sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
                      sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
               FROM m, g GROUP BY part, filter_order, step, letter)
    SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
    FROM r
"""
