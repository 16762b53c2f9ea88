"""Plain tables as conversation rows and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.schema import JUDGE, MESSAGE, METADATA


def message(role: Column, text: Column) -> Column:
    none = F.lit(None)
    return F.struct(role.alias("role"), text.alias("content"), none.alias("tool_calls"), none.alias("tool_call_id"), none.alias("name")).cast(MESSAGE)


def metadata(id_: Column, leaf: Column | None = None, path: Column | None = None, flags: Column | None = None, score: Column | None = None) -> Column:
    """A metadata struct with the given parts, all else at its default."""
    none = F.lit(None)
    judge = none.cast(JUDGE) if score is None else F.when(score.isNotNull(), F.struct(score.cast("double").alias("score"), F.create_map().cast("map<string,int>").alias("criteria"), F.lit("").alias("rationale"), none.cast("string").alias("verdict")))
    parts = {"id": id_.cast("string"), "leaf_id": leaf if leaf is not None else none, "leaf_path": path if path is not None else F.array().cast("array<string>"), "difficulty": F.lit("medium"), "task_type": F.lit("EXPLAIN"), "persona": none, "style": none, "adversarial": F.lit(False), "models": F.create_map().cast("map<string,string>"), "judge": judge, "flags": flags if flags is not None else F.array().cast("array<string>"), "answer": none, "strategy": none, "flaw": none}
    return F.struct(*[v.alias(k) for k, v in parts.items()]).cast(METADATA)


def documents_as_rows(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Each document as a one-turn row: id, status, kind, model (source), leaf (lang), messages, metadata, score.

    With labels: toxic documents are refused, labelled bad ones flagged, good ones accepted, and
    the score is 4.5 or 1.5 by quality.
    """
    rows = docs
    if labels is not None:
        rows = rows.join(labels.select(F.col("doc_id").alias("_d"), "quality", "toxic"), F.col("doc_id") == F.col("_d"), "left")
    else:
        rows = rows.withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    status = F.when(F.col("toxic") == 1, "refusal").when(F.col("quality") == 0, "flagged").when(F.col("quality") == 1, "accepted").otherwise("draft")
    score = F.when(F.col("quality") == 1, 4.5).when(F.col("quality") == 0, 1.5)
    flags = F.filter(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "low_quality")), lambda f: f.isNotNull())
    return rows.select(
        F.col("doc_id").cast("string").alias("id"), F.lit("p").alias("project_id"), F.lit(None).cast("string").alias("prompt_id"), F.col("lang").alias("leaf_id"), F.lit("sft").alias("kind"), status.alias("status"),
        F.lit(None).cast("string").alias("prev_status"), F.lit(None).cast("string").alias("filter_reason"), F.col("source").alias("model_slug"), F.array(message(F.lit("assistant"), F.col("text"))).alias("messages"),
        F.lit(None).cast("string").alias("tools"), metadata(F.col("doc_id"), F.col("lang"), F.array("lang"), flags, score).alias("metadata"), score.alias("score"), F.col("doc_id").cast("double").alias("created_at"), F.col("doc_id").cast("double").alias("updated_at"),
    )


def conversation_rows(turns: DataFrame) -> DataFrame:
    """Turns gathered into one row a conversation, in order: conv_id, messages, metadata."""
    held = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    rows = turns.groupBy("conv_id").agg(held.alias("_t"))
    return rows.select("conv_id", F.transform("_t", lambda t: message(t["role"], t["text"])).alias("messages"), metadata(F.col("conv_id")).alias("metadata"), F.lit("sft").alias("kind"), F.lit("draft").alias("status"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("tools"))


def event_calls(events: DataFrame) -> DataFrame:
    """Events as a ledger: the user is the project, the value the cost."""
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("project_id"), F.col("event_type").alias("kind"), F.col("value").alias("cost_usd"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_at"))
