"""Quality rules of documents and of the hosts they come from (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import SPACE, text_or_empty, written

SYMBOLS = "#*$%&|<>"
#: At most this many hosts are sent to every executor; beyond it the verdicts are joined by a shuffle.
BROADCAST_HOSTS = 100_000


def document_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the rule figures of every whole text; a null text has no words.

    Equal rows give equal rows; an empty table gives an empty one; columns beside doc_id, text and
    ``host`` are not read, whatever their names. Three-word windows are compared by 64-bit hash;
    sorting (hash, position) puts equal windows side by side, n log n for a text of any length.
    """
    text = F.col("_text")
    step = docs.select("doc_id", F.col(host).cast("string").alias("host"), text_or_empty().alias("_text"))
    step = step.select("*", F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "").alias("_words"))
    step = step.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.transform(F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(F.col("_words"), i + 1), F.get(F.col("_words"), i + 2))).alias("_windows"),
    )
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    step = step.select("*", F.when(repeated, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none).alias("_pairs"))
    near = lambda p, k: (F.get(F.col("_pairs"), k - 1)["h"] == p["h"]) | (F.get(F.col("_pairs"), k + 1)["h"] == p["h"])
    step = step.select("*", F.array_sort(F.transform(F.filter("_pairs", lambda p, k: F.coalesce(near(p, k), F.lit(False))), lambda p: p["i"])).alias("_at"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    covered = F.aggregate(F.transform("_at", lambda i, k: F.least(F.lit(3), F.coalesce(F.get(F.col("_at"), k + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return step.select(
        "doc_id",
        "host",
        "n_words",
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def host_rates(rules: DataFrame, failed: str = "base_failed") -> DataFrame:
    """Per host: documents, failures and the failure rate shrunk by an empirical beta prior.

    The prior's mean is the failure rate of all documents and its strength follows from how far
    the hosts' rates differ (method of moments), so a host of few documents stays near the mean.
    Documents without a host take no part. One host may hold most rows: counts are folded before
    the shuffle.
    """
    hosts = rules.where(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("f"))
    mean = F.sum("f") / F.sum("n")
    prior = hosts.agg(mean.alias("m"), F.sum("n").alias("docs"), F.sum(F.col("f") * F.col("f") / F.col("n")).alias("ff"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count(F.lit(1)).alias("k"))
    within = F.col("m") * (1 - F.col("m"))
    # Between-host spread of the rates beyond what sampling explains, with weights n.
    spread = (F.col("ff") - F.col("docs") * F.col("m") * F.col("m") - (F.col("k") - 1) * within) / F.nullif(F.col("docs") - F.col("nn") / F.col("docs"), F.lit(0.0))
    strength = F.when(spread > 0, F.least(F.greatest(within / spread - 1, F.lit(1.0)), F.lit(10_000.0))).otherwise(F.lit(10_000.0))
    prior = prior.select("m", F.coalesce(strength, F.lit(1.0)).alias("strength"))
    # One row of prior against the hosts: a broadcast of a single row.
    return hosts.join(F.broadcast(prior)).select("host", "n", "f", ((F.col("f") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("rate"))


def judged(docs: DataFrame, host: str = "source", min_words: int = 50, max_repeat_pct: int = 50, max_host_rate: float = 0.5) -> DataFrame:
    """Rule figures of every document with ``base_failed`` and ``kept``.

    A document is kept if it passes the base rules and its host's shrunk failure rate is at most
    ``max_host_rate``; without a host, only the base rules count.
    """
    rules = document_rules(docs, host)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    rules = written(rules.withColumn("base_failed", failed), "quality")
    bad = host_rates(rules).where(F.col("rate") > max_host_rate).select(F.col("host").alias("_host"), F.lit(True).alias("_bad"))
    n = bad.limit(BROADCAST_HOSTS + 1).count()
    bad = F.broadcast(bad) if n <= BROADCAST_HOSTS else bad
    out = rules.join(bad, F.col("host") == F.col("_host"), "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("_bad").isNull()).drop("_host", "_bad")


def op9_host_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs).drop("host")


OP9_SQL = r"""
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
         w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
                      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
         pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
         g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM pos),
         r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY doc_id),
         b AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                      len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
               FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
         f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
         h AS (SELECT source, count(*)::DOUBLE AS n, count_if(base_failed)::DOUBLE AS f FROM f WHERE source IS NOT NULL GROUP BY source),
         m AS (SELECT sum(f) / sum(n) AS m, sum(n) AS docs, sum(f * f / n) AS ff, sum(n * n) AS nn, count(*) AS k FROM h),
         v AS (SELECT m, m * (1 - m) AS within, (ff - docs * m * m - (k - 1) * m * (1 - m)) / nullif(docs - nn / docs, 0) AS spread FROM m),
         s AS (SELECT m, CASE WHEN spread > 0 THEN least(greatest(within / spread - 1, 1.0), 10000.0) ELSE 10000.0 END AS strength FROM v),
         bad AS (SELECT source FROM h, s WHERE (f + m * strength) / (n + strength) > 0.5)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
    FROM f
"""
