"""A corpus pipeline over documents: language, near duplicates, repeated passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; each result
is written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import language, packing, pii, simhash, suffix
from weftline.llm.common import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A prediction with less than this share of the posterior is no prediction.
LEAST_SCORE = 0.5


#: Columns that stages read or renew; all others pass through them under names of their own.
USED = ("doc_id", "text", "lang", "n_chars")


def shielded(stage: Stage) -> Stage:
    """``stage`` with the columns that it has no use for out of its way, whatever their names: they come out as they went in."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in USED else f"_column_{k}" for k, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[docs[f"`{c}`"].alias(n) for c, n in names.items()]), sf_dir)
        return out.select(*[out[n].alias(c) for c, n in names.items()])

    return run


@shielded
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: und and undecided ones go, lang becomes the prediction."""
    model = language.fit(docs, ~language.held_out() & F.col("doc_id").isNotNull())
    found = language.identified(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(docs.columns)


@shielded
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts that share 0.8 or more of their five-word shingles, the document of least doc_id."""
    return simhash.without_copies(docs)


@shielded
def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 256 bytes (some 50 short words) that start twice or more in what is left."""
    return suffix.deduplicated_texts(docs, suffix.BYTES_256)


@shielded
def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind."""
    found = pii.redacted(docs, pii.fit(pii.labelled(spark)))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    import public_tokenizers as files

    return packing.packed(docs, files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: Tokenizing, hashing and the random field have no SQL; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
