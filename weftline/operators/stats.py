"""Statistics of projects, rows, refusals, pairs and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import two_places


def counts(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def status_counts(rows: DataFrame) -> DataFrame:
    return counts(rows, "status")


def flag_counts(rows: DataFrame, flags: str = "metadata.flags") -> DataFrame:
    return counts(rows.select(F.explode(flags).alias("flag")), "flag")


def refusal_rollups(rows: DataFrame) -> DataFrame:
    """Refusals by model and by leaf in one pass: (kind, key, n); missing keys are unknown."""
    keys = F.array(*[F.struct(F.lit(kind).alias("kind"), F.coalesce(F.col(c), F.lit("unknown")).alias("key")) for kind, c in (("model", "model_slug"), ("leaf", "leaf_id"))])
    return counts(rows.where("status = 'refusal'").select(F.explode(keys).alias("_k")).select("_k.kind", "_k.key"), "kind", "key")


def refusal_matrix(rows: DataFrame, model: str = "model_slug", topic: str = "topic") -> DataFrame:
    """Refusals, total and rate by model and topic."""
    out = rows.groupBy(model, topic).agg(F.count_if(F.col("status") == "refusal").alias("refusals"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("rate", F.col("refusals") / F.col("total"))


def review_totals(rows: DataFrame) -> DataFrame:
    flags = F.coalesce(F.col("metadata.flags"), F.array().cast("array<string>"))
    return rows.agg(
        F.count_if(F.col("status").isin("draft", "accepted", "edited")).alias("exportable"),
        F.count_if(F.array_contains(flags, "edited")).alias("edited"),
        F.count_if(F.col("status") == "flagged").alias("flagged"),
    )


def project_summary(projects: DataFrame, nodes: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row a project: leaves, planned and present rows, pairs, refusals, filtered, accepted, spend and cap."""
    leaf = nodes.where("is_leaf").groupBy("project_id").agg(F.count(F.lit(1)).alias("leaves"), F.sum(F.coalesce("rows_per_leaf", F.lit(0))).alias("target_rows"))
    row = rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("status").isin(*s)).alias(n) for n, s in (("refusals", ["refusal"]), ("filtered", ["filtered"]), ("accepted", ["accepted", "edited"]))])
    pair = counts(pairs, "project_id", name="pairs")
    out = projects.select(F.col("id").alias("project_id"), F.round("spend_usd", 4).alias("spend_usd"), "budget_cap_usd")
    for part in (leaf, row, pair):
        out = out.join(part, "project_id", "left")
    return out.fillna(0, ["leaves", "target_rows", "rows", "refusals", "filtered", "accepted", "pairs"])


def stage_status(runs: DataFrame, stages: int = 8) -> DataFrame:
    """Status of each stage of each project by its latest run, and what was ever done."""
    last = runs.groupBy("project_id", "stage").agg(F.max_by("status", F.struct("created_at", "id")).alias("last"), F.bool_or(F.col("status") == "done").alias("ever"))
    grid = runs.select("project_id").distinct().select("project_id", F.explode(F.sequence(F.lit(1), F.lit(stages))).alias("stage"))
    status = F.when(F.col("last").isin("queued", "running"), "running").when(F.col("last").isin("paused", "budget_stop"), "paused").when(F.col("last") == "failed", F.when(F.col("ever"), "done").otherwise("failed")).when(F.coalesce("ever", F.lit(False)), "done").otherwise("todo")
    return grid.join(last, ["project_id", "stage"], "left").select("project_id", "stage", status.alias("status"))


def next_stage(stages: DataFrame) -> DataFrame:
    """The running stage of a project, else its first unfinished one."""
    rank = F.when(F.col("status") == "running", 0).when(F.col("status").isin("todo", "paused", "failed"), 1)
    return stages.where(rank.isNotNull()).groupBy("project_id").agg(F.min(F.struct(rank.alias("r"), "stage")).alias("m")).select("project_id", F.col("m.stage").alias("next_stage"))


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Pairs by status, by flaw and by strategy: (kind, key, n)."""
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in ("status", "flaw", "strategy")])
    return counts(pairs.select(F.explode(keys).alias("_k")).select("_k.kind", "_k.key").where("key is not null"), "kind", "key")


def removed_by_rule(rows: DataFrame, whole: bool = False) -> DataFrame:
    """Filtered rows by rule, or by whole reason."""
    reason = F.coalesce("filter_reason", F.lit("unspecified"))
    return counts(rows.where("status = 'filtered'").select((reason if whole else F.split(reason, ":", 2)[0]).alias("reason")), "reason", name="removed")


def breakdown(items: DataFrame, leaf: str = "leaf", difficulty: str = "difficulty", key: str = "id") -> DataFrame:
    """Items once each by id, by leaf and by difficulty: (kind, key, n)."""
    once = items.groupBy(key).agg(F.min(F.struct(leaf, difficulty)).alias("m")).select(F.col(f"m.{leaf}").alias("a"), F.col(f"m.{difficulty}").alias("b"))
    keys = F.array(F.struct(F.lit("leaf").alias("kind"), F.col("a").alias("key")), F.struct(F.lit("difficulty").alias("kind"), F.col("b").alias("key")))
    return counts(once.select(F.explode(keys).alias("_k")).select("_k.kind", "_k.key"), "kind", "key")


def size_category(n: Column) -> Column:
    return F.when(n < 1_000, "n<1K").when(n < 10_000, "1K<n<10K").when(n < 100_000, "10K<n<100K").when(n < 1_000_000, "100K<n<1M").otherwise("n>1M")


def conversation_stats(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, refusals, multi-turn rows and their shares."""
    multi = F.size(F.filter("messages", lambda m: m["role"] == "assistant")) > 1
    out = rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "refusal").alias("refusals"), F.count_if(multi).alias("multi_turn"), F.count_distinct("model_slug").alias("models"))
    return out.withColumns({"refusal_share": F.col("refusals") / F.col("rows"), "multi_share": F.col("multi_turn") / F.col("rows")})


def progress(events: DataFrame) -> DataFrame:
    """The state of each run from its events: last progress, last status, workers by id, how many logs."""
    at = F.col("seq")
    worker = events.where("type = 'worker'").groupBy("run_id", "worker_id").agg(F.max_by("state", at).alias("state")).groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("worker_id", "state"))).alias("workers"))
    run = events.groupBy("run_id").agg(
        F.max_by(F.when(F.col("type") == "progress", F.col("done")), F.when(F.col("type") == "progress", at)).alias("done"),
        F.max_by(F.when(F.col("type") == "progress", F.col("total")), F.when(F.col("type") == "progress", at)).alias("total"),
        F.max_by(F.when(F.col("type") == "done", F.col("state")), F.when(F.col("type") == "done", at)).alias("status"),
        F.least(F.count_if(F.col("type") == "log"), F.lit(300)).alias("logs"),
    )
    return run.join(worker, "run_id", "left").withColumn("percent", two_places(100.0 * F.col("done") / F.nullif(F.col("total"), F.lit(0))))


def card_figures(done: Column, total: Column, spend: Column, cap: Column) -> dict[str, Column]:
    """Shares capped at 100 and their tone: good under 70, warn under 90, else high."""
    share = F.least(F.lit(100.0), F.coalesce(100.0 * spend / F.nullif(cap, F.lit(0.0)), F.lit(0.0)))
    return {"rows_pct": F.least(F.lit(100.0), F.coalesce(100.0 * done / F.nullif(total, F.lit(0)), F.lit(0.0))), "spend_pct": share, "tone": F.when(share >= 90, "high").when(share >= 70, "warn").otherwise("good")}


def kept_count(candidates: Column, removed: Column) -> Column:
    """Rows that a filter run leaves, never below zero; a null counts as zero."""
    zero = F.lit(0).cast("long")
    return F.greatest(zero, F.coalesce(candidates, zero) - F.coalesce(removed, zero))


def adversarial_share(prompts: DataFrame, *by: str) -> DataFrame:
    """Prompts, adversarial ones and their share, by ``by``; null is not adversarial."""
    hit = F.count_if(F.coalesce("adversarial", F.lit(False)))
    return prompts.groupBy(*by).agg(F.count(F.lit(1)).alias("prompts"), hit.alias("adversarial"), (hit / F.count(F.lit(1))).alias("share"))
