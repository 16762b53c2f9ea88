"""Language identification: known words first, shorter and shorter character n-grams for the rest."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, written

#: A word is a run of letters; texts are lower-cased first.
WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
#: Words not in the model that a task remembers, and how far it goes before it forgets them.
REMEMBERED = 100_000


@dataclass
class Model:
    """Per-language log frequencies of frequent words and of n-grams by length. Bounded by fit()'s limits."""

    langs: list[str]
    words: dict[str, tuple[float, ...]]
    grams: dict[str, tuple[float, ...]]


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams_of(word: str, n: int) -> list[str]:
    """n-grams of a word with its ends marked; n = 1 has the letters alone."""
    if n == 1:
        return list(word)
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words (n = 0) and n-grams by language; n-grams are cut once for each distinct word."""
    words: dict[str, Counter[str]] = {}

    def out() -> Iterator[pd.DataFrame]:
        for lang, found in words.items():
            for n in range(LONGEST + 1):
                units: Counter[str] = Counter() if n else found
                for word, c in found.items() if n else ():
                    for g in grams_of(word, n):
                        units[g] += c
                yield pd.DataFrame({"lang": lang, "n": n, "unit": list(units), "c": list(units.values())})
        words.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        if sum(map(len, words.values())) > 100_000:
            yield from out()
    yield from out()


def fit(docs: DataFrame, learn: Column, max_docs: int = 2_000, max_words: int = 15_000, max_grams: int = 5_000) -> Model:
    """A model from the text and lang of rows where ``learn`` holds and neither is null.

    Of each language about ``max_docs`` rows, chosen by a hash of doc_id, are read whole; its
    ``max_words`` most frequent words and ``max_grams`` n-grams of each length enter the model. With
    the number of languages these three bound what reaches the driver and every executor, at any
    input size, and a rare language has its share. Ties go to the lesser string.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    limits = F.broadcast(rows.groupBy("lang").agg(F.least(F.lit(1.0), max_docs / F.count(F.lit(1))).alias("_share")).withColumnRenamed("lang", "_lang"))
    sample = rows.join(limits, F.col("lang") == F.col("_lang")).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.ceil(F.col("_share") * (1 << 20))).select("lang", "text")
    counts = written(sample.mapInPandas(_counts, "lang string, n int, unit string, c long").groupBy("n", "unit", "lang").agg(F.sum("c").alias("c")), "language")
    totals = {(r["n"], r["lang"]): r["c"] for r in counts.groupBy("n", "lang").agg(F.sum("c").alias("c")).collect()}
    langs = sorted({lang for _, lang in totals})
    # The sample bounds a window: one language's units of one length.
    place = F.row_number().over(Window.partitionBy("n", "lang").orderBy(F.desc("c"), "unit"))
    most = F.when(F.col("n") == 0, max_words).otherwise(max_grams)
    chosen = counts.withColumn("_place", place).where(F.col("_place") <= most).select("n", "unit").distinct()
    units = counts.join(chosen, ["n", "unit"]).groupBy("n", "unit").agg(F.map_from_entries(F.collect_list(F.struct("lang", "c"))).alias("by"))
    words: dict[str, tuple[float, ...]] = {}
    grams: dict[str, tuple[float, ...]] = {}
    sizes = {0: max_words} | dict.fromkeys(range(1, LONGEST + 1), max_grams)
    for r in units.orderBy("n", "unit").toLocalIterator():
        # Strings of different n-gram lengths never clash: all grams share one table.
        n, by = r["n"], r["by"]
        (grams if n else words)[r["unit"]] = tuple(math.log((by.get(lang, 0) + 0.5) / (totals.get((n, lang), 0) + 0.5 * sizes[n])) for lang in langs)
    return Model(langs, words, grams)


class Scorer:
    """Scores words by row number in a growing matrix; unseen words are backed off once and remembered."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known = len(model.words)
        self.rows = np.zeros((self.known + 4096, max(len(model.langs), 1)))
        if model.words:
            self.rows[: self.known] = list(model.words.values())
        self.forget()

    def forget(self) -> None:
        scorer = self

        class Index(dict):
            def __missing__(self, word: str) -> int:
                at = self[word] = scorer.back_off(word, len(self))
                return at

        self.index = Index(zip(self.model.words, range(self.known)))

    def back_off(self, word: str, at: int) -> int:
        if at >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        get = self.model.grams.get
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            if hits := [v for g in grams_of(word, n) if (v := get(g)) is not None]:
                self.rows[at] = [sum(x) / len(hits) for x in zip(*hits)]
                return at
        self.rows[at] = 0  # nothing known: no evidence for any language
        return at

    def score(self, text: str | None) -> tuple[str, float, float]:
        """The likeliest language, its share of the posterior under equal priors, and the share of words that are known; und without a letter."""
        words = WORD.findall(text.lower()) if text else []
        if not words or not self.model.langs:
            return "und", 0.0, 0.0
        if len(self.index) > self.known + REMEMBERED:
            self.forget()
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        logs = self.rows[at].sum(axis=0)
        best = int(logs.argmax())
        return self.model.langs[best], float(1 / np.exp(np.maximum(logs - logs[best], -700)).sum()), float((at < self.known).mean())


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and known for every whole text; other columns pass through untouched.

    ``known`` is the share of a text's words that the model has. Null texts and texts without a
    letter are ``und`` with score 0; equal texts score alike. Columns of these names are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, known double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(held.value)
        for texts in batches:
            yield pd.DataFrame([scorer.score(t) for t in texts], columns=["lang_pred", "score", "known"])

    out = docs.drop("lang_pred", "score", "known").withColumn("_lang", scored.asNondeterministic()(F.col("text")))
    return out.select(*[c for c in out.columns if c != "_lang"], "_lang.lang_pred", "_lang.score", "_lang.known")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, ~held_out() & F.col("doc_id").isNotNull())
    return identified(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text", "known")
