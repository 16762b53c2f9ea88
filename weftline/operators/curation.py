"""The filter stage: rules in order, first match wins, every removal with a reason and a way back."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import schema
from weftline.functions import text as T
from weftline.functions.messages import assistant_text, conversation_text, first_user_text
from weftline.operators import dedup

#: Order of the rules; each sees only what the ones before it kept.
RULES = ("exact_dup", "near_dup", "refusal", "pii", "length", "language")


@dataclass(frozen=True)
class FilterConfig:
    enabled: frozenset[str] = field(default_factory=lambda: frozenset(RULES))
    near_dup_threshold: float = 0.92
    min_chars: int = 40
    max_chars: int = 12_000
    language: str = "en"


def texts(rows: DataFrame) -> DataFrame:
    """``rows`` with the three texts that rules look at: whole, asked and answered."""
    messages = F.col("messages")
    return rows.withColumns({"_whole": conversation_text(messages), "_asked": first_user_text(messages), "_answer": assistant_text(messages)})


def evaluated(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are computed once a row: Spark puts an expression that is merely named into every place that uses it."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return rows.select("*", made.alias("_made")).select(*rows.columns, *[F.col("_made")[n].alias(n) for n in columns])


def row_reason(config: FilterConfig, rules: Sequence[str] = RULES) -> Column:
    """rule and reason of the first rule that looks at one row alone and removes it, or null."""
    whole, asked, answer = F.col("_whole"), F.col("_asked"), F.col("_answer")
    chars, kinds = F.length(answer), T.pii_kinds(whole)
    found = {
        "refusal": (T.is_refusal(asked, answer), F.lit("assistant refused")),
        "pii": (F.size(kinds) > 0, F.concat(F.lit("contains "), F.array_join(kinds, ", "))),
        "length": (
            (chars < config.min_chars) | (chars > config.max_chars),
            F.when(chars < config.min_chars, F.concat(chars.cast("string"), F.lit(f" chars, minimum {config.min_chars}"))).otherwise(F.concat(chars.cast("string"), F.lit(f" chars, maximum {config.max_chars}"))),
        ),
        "language": (~T.looks_english(answer) if config.language == "en" else F.lit(False), F.lit("not English")),
    }
    on = [r for r in RULES if r in found and r in rules and r in config.enabled]
    none = F.lit(None).cast("struct<rule:string,reason:string>")
    return F.coalesce(*[F.when(found[r][0], F.struct(F.lit(r).alias("rule"), found[r][1].alias("reason"))) for r in on], none)


def removals(rows: DataFrame, config: FilterConfig | None = None, vectors: DataFrame | None = None, rules: Sequence[str] = RULES) -> DataFrame:
    """id, rule and reason of every candidate row that the cascade removes.

    Exact duplicates go by a minimum per hash, near duplicates by the greedy scan over what that
    left, and the other four rules are one expression over the survivors. What a rule removes is written (ids and
    reasons alone), so no rule runs the ones before it again.
    """
    config = config or FilterConfig()
    dedup.ensure_checkpoints(rows.sparkSession)
    left = texts(rows.where(F.col("status").isin(*schema.CANDIDATE)).withColumn("_at", F.coalesce("created_at", F.lit(0.0))))
    out = None
    if "exact_dup" in rules and "exact_dup" in config.enabled:
        same = dedup.exact_dup(left, "_whole", ["_at", "id"])
        out = same.select("id", F.lit("exact_dup").alias("rule"), F.concat(F.lit("identical to "), F.col("first_id")).alias("reason")).checkpoint()
        left = left.join(out.select("id"), "id", "left_anti")
    if vectors is not None and "near_dup" in rules and "near_dup" in config.enabled:
        held = left.select("id", "_at").join(vectors.select("id", "v"), "id")
        near = dedup.near_dup(held, config.near_dup_threshold, ["_at", "id"])
        near = near.select("id", F.lit("near_dup").alias("rule"), F.format_string("cosine %.3f with %s", "sim", "partner_id").alias("reason")).checkpoint()
        out = near if out is None else out.unionByName(near)
        left = left.join(near.select("id"), "id", "left_anti")
    said = evaluated(left.select("id", "messages"), _whole=conversation_text(F.col("messages")), _asked=first_user_text(F.col("messages")), _answer=assistant_text(F.col("messages")))
    rest = evaluated(said.select("id", "_whole", "_asked", "_answer"), _r=row_reason(config, rules)).where(F.col("_r").isNotNull()).select("id", "_r.rule", "_r.reason").checkpoint()
    return rest if out is None else out.unionByName(rest)


def marked(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """``rows`` with the removals applied: status, previous status, reason and flag."""
    gone = removed.select(F.col("id").alias("_id"), "rule", "reason")
    hit, inside = F.col("rule").isNotNull(), F.col("status").isin(*schema.REMOVED)
    flags = F.coalesce(F.col("metadata.flags"), F.array().cast("array<string>"))
    new_flags = F.when(F.array_contains(flags, F.col("rule")), flags).otherwise(F.concat(flags, F.array("rule")))
    joined = rows.join(gone, F.col("id") == F.col("_id"), "left")
    out = joined.withColumns(
        {
            "prev_status": F.when(hit & ~inside, F.col("status")).otherwise(F.col("prev_status")),
            "filter_reason": F.when(hit, F.concat_ws(": ", "rule", "reason")).otherwise(F.col("filter_reason")),
            "metadata": F.when(hit, F.col("metadata").withField("flags", new_flags)).otherwise(F.col("metadata")),
            "status": F.when(hit, F.when(F.col("rule") == "refusal", "refusal").otherwise("filtered")).otherwise(F.col("status")),
        }
    )
    return out.select(*rows.columns)


def restored(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` with removals of the given ids undone; other statuses stay. A refusal without a reason keeps its flag."""
    back = rows.join(ids.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull() & F.col("status").isin(*schema.REMOVED)
    rule = F.split(F.coalesce("filter_reason", F.lit("")), ":", 2)[0]
    out = back.withColumns(
        {
            "metadata": F.when(hit, F.col("metadata").withField("flags", F.filter(F.coalesce(F.col("metadata.flags"), F.array().cast("array<string>")), lambda f: f != rule))).otherwise(F.col("metadata")),
            "status": F.when(hit, F.coalesce("prev_status", F.lit("draft"))).otherwise(F.col("status")),
            "prev_status": F.when(~hit, F.col("prev_status")),
            "filter_reason": F.when(~hit, F.col("filter_reason")),
        }
    )
    return out.select(*rows.columns)


def summary(removed: DataFrame) -> DataFrame:
    """Removals by rule, zero rows for rules without any."""
    every = removed.sparkSession.createDataFrame([(i, r) for i, r in enumerate(RULES)], "place int, rule string")
    return every.join(removed.groupBy("rule").agg(F.count(F.lit(1)).alias("removed")), "rule", "left").select("rule", F.coalesce("removed", F.lit(0)).alias("removed"))


def embedding_plan(rows: DataFrame, vectors: DataFrame, batch: int = 64) -> DataFrame:
    """Batches of rows that lack a vector: batch number, ids and estimated tokens."""
    missing = texts(rows.where(F.col("status").isin(*schema.CANDIDATE))).join(vectors.select("id"), "id", "left_anti")
    placed = dedup.numbered(missing.select("id", F.coalesce("created_at", F.lit(0.0)).alias("_at"), F.length("_whole").alias("chars")), ["_at", "id"])
    return placed.groupBy(F.floor(F.col("n") / batch).alias("batch")).agg(F.sort_array(F.collect_list("id")).alias("ids"), F.sum(F.floor(F.col("chars") / 4)).alias("tokens"))
