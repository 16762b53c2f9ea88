"""Ranked lexical search of a table of queries over all documents: term at a time over short lists, then document at a time.

The index is a table of segments. A segment holds the posting lists of some megabytes of documents, in order of
doc_id, for the terms that the queries have. Within a segment a query adds up its short lists term by term; the
sums are one more iterator with a known bound, which joins the long lists in a document-at-a-time pass over
blocks of documents. A block whose bounds cannot reach the query's tenth score is skipped with all its postings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, written

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Text of a segment, in bytes (a longer text is a segment of its own).
SEGMENT_BYTES = 8 << 20
#: Documents of a block, and lists of fewer postings in a segment than this are short.
BLOCK, SHORT = 128, 256
#: Bytes of query texts that are answered together; more queries are more blocks of queries, each over all documents.
QUERY_BYTES = 4 << 20
TOP = 10
SEGMENT = "ids array<long>, null_ids array<boolean>, lengths array<long>, terms array<int>, sizes array<int>, docs array<int>, counts array<int>"


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(text.translate(LOWER)) if text else []


def segment(ids: list[int | None], counters: list[Counter], lengths: list[int]) -> list[object]:
    """One row of the index: documents by ascending doc_id (null ones last), and per term its documents and counts.

    A counter has the occurrences of each of the queries' terms, by number, in a document.
    """
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    doc = np.repeat(np.arange(len(order)), [len(counters[i]) for i in order])
    term = np.fromiter((t for i in order for t in counters[i]), np.int64, len(doc))
    count = np.fromiter((c for i in order for c in counters[i].values()), np.int64, len(doc))
    at = np.lexsort((doc, term))
    terms, sizes = np.unique(term, return_counts=True)
    return [[ids[i] or 0 for i in order], [ids[i] is None for i in order], [lengths[i] for i in order], terms.tolist(), sizes.tolist(), doc[at].tolist(), count[at].tolist()]


def indexed(docs: DataFrame, numbers: dict[str, int], segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Segments of all whole texts for the terms of ``numbers`` (bounded by the block of queries), written as a table."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(numbers)
    kinds = pa.schema([("ids", pa.list_(pa.int64())), ("null_ids", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), *((n, pa.list_(pa.int32())) for n in ("terms", "sizes", "docs", "counts"))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = shared.value, ([], [], []), 0

        def row() -> pa.RecordBatch:
            values = segment(*held)
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, kinds)], schema=kinds)

        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                found = terms_of(text)
                if found:
                    counter = Counter(map(known.get, found))
                    counter.pop(None, None)
                    for x, v in zip(held, (k, counter, len(found))):
                        x.append(v)
                size += len(text)
                if size >= segment_bytes:
                    if held[0]:
                        yield row()
                    size = 0
        if held[0]:
            yield row()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, SEGMENT), "segments")


class Lists:
    """The posting lists of a segment with the contributions of every posting, but for its term's weight."""

    def __init__(self, row: dict, total: int, words: int, weights: np.ndarray, short: int, block: int) -> None:
        self.terms, sizes, self.docs, count = (row[n] for n in ("terms", "sizes", "docs", "counts"))
        self.n, self.block = len(row["ids"]), block
        count = count.astype(np.int64)
        m = 10 + (90 * row["lengths"] * total) // words
        self.parts = (1_000_000_000 * count) // (1000 * count + 8 * m[self.docs])
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.weight = weights[self.terms]
        self.short = sizes < short
        # Of the long lists: where each block's postings start, and the largest contribution in it.
        self.row = np.full(len(sizes), -1)
        long = np.flatnonzero(~self.short)
        self.row[long] = np.arange(len(long))
        self.blocks = -(-self.n // block)
        edges = np.arange(self.blocks + 1) * block
        self.cut = np.empty((len(long), self.blocks + 1), np.int64)
        self.most = np.zeros((len(long), self.blocks), np.int64)
        for r, t in enumerate(long.tolist()):
            own = self.docs[self.starts[t] : self.ends[t]]
            self.cut[r] = self.starts[t] + np.searchsorted(own, edges)
            filled = np.flatnonzero(np.diff(self.cut[r]))
            self.most[r, filled] = np.maximum.reduceat(self.parts[self.starts[t] : self.ends[t]], self.cut[r, filled] - self.starts[t]) * self.weight[t]

    def summed(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term at a time: the documents of the lists ``at``, ascending, with their summed contributions."""
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs = np.concatenate([self.docs[self.starts[t] : self.ends[t]] for t in at])
        parts = np.concatenate([self.parts[self.starts[t] : self.ends[t]] * self.weight[t] for t in at])
        docs, of = np.unique(docs, return_inverse=True)
        total = np.zeros(len(docs), np.int64)
        np.add.at(total, of, parts)
        return docs.astype(np.int64), total

    def best(self, query: np.ndarray, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (positions, ascending) and scores that hold all of the query's ``top`` best of this segment, ties included.

        ``query`` has positions in ``terms``; nothing that scores under ``least`` is needed.
        """
        query = query[self.weight[query] > 0]
        docs, sums = self.summed(query[self.short[query]])
        long = query[~self.short[query]]
        if len(sums) >= top:
            least = max(least, int(np.partition(sums, -top)[-top]))
        if not len(long):
            keep = sums >= max(least, 1)
            return docs[keep], sums[keep]
        rows = self.row[long]
        # The accumulators are one more list: its blocks and bounds.
        cut = np.searchsorted(docs, np.arange(self.blocks + 1) * self.block)
        own = np.zeros(self.blocks, np.int64)
        filled = np.flatnonzero(np.diff(cut))
        if len(filled):
            own[filled] = np.maximum.reduceat(sums, cut[filled])
        bound = self.most[rows].sum(axis=0) + own
        found_docs, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        held = np.zeros(0, np.int64)
        b = -1
        while True:
            ahead = np.flatnonzero(bound[b + 1 :] >= max(least, 1))
            if not len(ahead):
                break
            b += 1 + int(ahead[0])
            scores = np.zeros(self.block, np.int64)
            scores[docs[cut[b] : cut[b + 1]] - b * self.block] = sums[cut[b] : cut[b + 1]]
            most = self.most[rows, b]
            order = np.argsort(-most, kind="stable")
            rest = int(most.sum())
            for k in order.tolist():
                # No document of the block can still come up to the tenth score: its other postings are skipped.
                if int(scores.max()) + rest < least or not most[k]:
                    break
                a, z = self.cut[rows[k], b], self.cut[rows[k], b + 1]
                scores[self.docs[a:z] - b * self.block] += self.parts[a:z] * self.weight[long[k]]
                rest -= int(most[k])
            else:
                rest = 0
            if rest and int(scores.max()) + rest < least:
                continue
            at = np.flatnonzero(scores >= max(least, 1))
            found_docs.append(at + b * self.block)
            found.append(scores[at])
            held = np.concatenate([held, scores[at]])
            if len(held) >= top:
                held = np.partition(held, -top)[-top:]
                least = max(least, int(held.min()))
        return np.concatenate(found_docs), np.concatenate(found)


def answered(segments: DataFrame, queries: list[np.ndarray], weights: np.ndarray, total: int, words: int, top: int, short: int, block: int) -> DataFrame:
    """(query, doc_id, score): each task's ``top`` best documents of every query over its segments."""
    shared = segments.sparkSession.sparkContext.broadcast((queries, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        none = np.zeros(0, np.int64)
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(none, none.astype(bool), none)] * len(queries)
        for batch in batches:
            for i in range(len(batch)):
                row = {f: batch.column(f)[i].values.to_numpy(zero_copy_only=False) for f in batch.schema.names}
                lists = Lists(row, total, words, weights, short, block)
                here = np.full(len(weights), -1)
                here[lists.terms] = np.arange(len(lists.terms))
                for q, terms in enumerate(queries):
                    own = here[terms]
                    own = own[own >= 0]
                    if not len(own):
                        continue
                    ids, no_id, scores = best[q]
                    docs, found = lists.best(own, int(scores.min()) if len(scores) == top else 0, top)
                    ids, no_id, scores = np.r_[ids, row["ids"][docs]], np.r_[no_id, row["null_ids"][docs]], np.r_[scores, found]
                    order = np.lexsort((ids, no_id, -scores))[:top]
                    best[q] = ids[order], no_id[order], scores[order]
        number = np.repeat(np.arange(len(best)), [len(s) for _, _, s in best])
        ids, no_id, scores = (np.concatenate([b[k] for b in best]) if best else none for k in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(ids, pa.int64(), mask=no_id.astype(bool)), pa.array(scores, pa.int64())], ["query", "doc_id", "score"])

    return segments.mapInArrow(search, "query int, doc_id long, score long")


def ranked(items: DataFrame, docs: DataFrame, item: str = "item_id", top: int = TOP, query_bytes: int = QUERY_BYTES, segment_bytes: int = SEGMENT_BYTES, short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of every row of ``items`` (``item``, text).

    Scores are exact and in whole numbers, and no list is cut. Equal scores rank by ascending doc_id, null ids last;
    every row of a repeated item or document counts for itself. An item or document without a term, or with a null
    text, has no row; so has an empty table. Queries are answered in blocks of ``query_bytes`` of text at most
    (or one item): what is sent to the tasks is bounded by that, and every block reads all documents.
    """
    spark = docs.sparkSession
    kind = items.schema[item].dataType
    asked = items.select(F.col(item).alias("item_id"), F.col("text").alias("query_text"), F.octet_length("text").alias("size")).where("size > 0")
    blocks = max(1, -(-(asked.agg(F.sum("size").alias("n")).first()["n"] or 0) // query_bytes))
    asked = written(asked.withColumn("part", F.pmod(F.xxhash64("item_id", "query_text"), F.lit(blocks)).cast("int")), "items")
    out = []
    for part in range(blocks):
        rows = [(r["item_id"], terms_of(r["query_text"])) for r in asked.where(F.col("part") == part).select("item_id", "query_text").toLocalIterator()]
        numbers: dict[str, int] = {}
        queries = [np.array(sorted({numbers.setdefault(t, len(numbers)) for t in terms}), np.int64) for _, terms in rows]
        segments = indexed(docs, numbers, segment_bytes)
        size = segments.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
        if not size["n"]:
            continue
        total, words = size["n"], size["l"]
        df = segments.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy("t.terms").agg(F.sum("t.sizes").alias("df"))
        weights = np.zeros(len(numbers), np.int64)
        found = df.select("terms", F.floor(1000 * F.log((2 * F.lit(total) + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")).toPandas()
        weights[found["terms"].to_numpy()] = found["w"].to_numpy()
        partial = answered(segments, queries, weights, total, words, top, short, block)
        names = spark.createDataFrame([(q, k) for q, (k, _) in enumerate(rows)], f"query int, item_id {kind.simpleString()}")
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        kept = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        out.append(written(kept.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked"))
    if not out:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


def op11_ranked(spark, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
    WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
         tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM tok GROUP BY doc_id, term),
         len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
         tot AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM len),
         q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
         w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, tot
               WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
         m AS (SELECT doc_id, 100 - 90 + ((90 * n * docs) // words) AS m FROM len, tot),
         s AS (SELECT item_id, tf.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
               FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m ON m.doc_id = tf.doc_id GROUP BY item_id, tf.doc_id),
         r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
