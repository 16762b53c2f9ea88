"""What screens and callers are shown: projections of the tables, and tables by leaf with its label."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import schema
from weftline.operators import rows as R, scoring
from weftline.operators.settings import STAGES


def names(ddl: str) -> list[str]:
    return [c.split()[0].strip("`") for c in ddl.split(", ")]


def row_view(rows: DataFrame) -> DataFrame:
    """The sixteen fields of a row; metadata is empty, never null."""
    empty = F.struct(*[F.lit(None).alias(f) for f in rows.schema["metadata"].dataType.names]).cast(schema.METADATA)
    return rows.select(*[F.coalesce("metadata", empty).alias("metadata") if c == "metadata" else F.col(c) for c in names(schema.ROWS)])


def prompt_view(prompts: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """A prompt without its vector, with its leaf's label where nodes are given (null where the leaf is gone)."""
    shown = R.with_leaf(prompts, nodes) if nodes is not None else prompts.withColumn("leaf_label", F.lit(None).cast("string"))
    return shown.select("id", "leaf_id", "leaf_label", "run_id", "text", "persona", "style", "adversarial", "noise", "status", "created_at")


def pair_view(pairs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """A pair, with its chosen row as a struct where rows are given (null where the row is gone)."""
    fields = ["id", "project_id", "row_id", "run_id", "rejected_messages", "strategy", "flaw", "model_slug", "status", "judge", "created_at"]
    if rows is None:
        return pairs.select(*fields, F.lit(None).alias("chosen_row"))
    own = row_view(rows)
    chosen = own.select(F.col("id").alias("_row"), F.struct(*own.columns).alias("chosen_row"))
    return pairs.join(chosen, F.col("row_id") == F.col("_row"), "left").select(*fields, "chosen_row")


def run_view(runs: DataFrame) -> DataFrame:
    """A run with the name of its stage, null for a number that is none."""
    stage_name = F.get(F.array(*map(F.lit, STAGES)), F.col("stage") - 1)
    return runs.select("id", "project_id", "stage", stage_name.alias("stage_name"), *[c for c in names(schema.RUNS) if c not in ("id", "project_id", "stage")])


def project_view(projects: DataFrame) -> DataFrame:
    return projects.select("id", "slug", "name", "domain_brief", "preset", "data_types", "config", "budget_cap_usd", "stop_at_pct", "spend_usd", "created_at", "updated_at")


def prompts_of(prompts: DataFrame, nodes: DataFrame, leaf_id: str | None = None, q: str | None = None) -> DataFrame:
    """Prompts with their leaf's label, of one leaf or with a text in them; those of leaves that are gone stay."""
    out = prompt_view(prompts, nodes)
    out = out.where(F.col("leaf_id") == leaf_id) if leaf_id else out
    return out.where(F.col("text").ilike(f"%{q}%")) if q else out


def refusals_by_leaf(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Refused rows by model and leaf with its label (null where the leaf is gone), most first. Folded before the labels are joined."""
    cells = rows.where("status = 'refusal'").groupBy("model_slug", "leaf_id").agg(F.count(F.lit(1)).alias("count"))
    return R.with_leaf(cells, nodes).select("model_slug", "leaf_id", "leaf_label", "count").orderBy(F.desc("count"), "model_slug", "leaf_id")


def rows_by_leaf(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows by leaf with its label, most first, then by label. Folded before the labels are joined."""
    cells = rows.groupBy("leaf_id").agg(F.count(F.lit(1)).alias("count"))
    return R.with_leaf(cells, nodes).select("leaf_id", "leaf_label", "count").orderBy(F.desc("count"), "leaf_label", "leaf_id")


def judge_summary(rows: DataFrame, pairs: DataFrame, teachers: DataFrame, judge_slug: str, threshold: float = 3.0) -> DataFrame:
    """One row: histogram, mean, median and low scores of rows, ties, turned and judged pairs, and whether the judge is of a teacher's family.

    rows: score; pairs: status, judge; teachers: slug. Every row with a score counts, filtered ones too. A pair is turned if its judge
    prefers the rejected side.
    """
    counted = pairs.agg(F.count_if(F.col("status") == "tie").alias("ties"), F.count_if(F.col("judge.verdict") == "rejected").alias("flipped"), F.count("judge").alias("judged_pairs"), F.lit(1).alias("_one"))
    makers = teachers.agg(F.sort_array(F.collect_set(scoring.family(F.col("slug")))).alias("teacher_families"))
    own = scoring.family(F.lit(judge_slug))
    # Three rows of one: each is an aggregate of its own table.
    out = scoring.summary(rows, threshold).withColumn("_one", F.lit(1)).join(counted, "_one").join(makers.withColumn("_one", F.lit(1)), "_one")
    return out.select("histogram", "mean", "median", "low_count", "ties", "flipped", "judged_rows", "judged_pairs", F.array_contains("teacher_families", own).alias("same_family_warning"), "teacher_families", own.alias("judge_family"), F.lit(judge_slug).alias("judge_model"))


def used(df: DataFrame, *columns: str) -> DataFrame:
    """How many different values each column has, a null counting as one."""
    one = lambda c: (F.count_distinct(c) + F.max(F.col(c).isNull().cast("long"))).alias(c)
    return df.agg(*[F.coalesce(one(c), F.lit(0)).alias(c) for c in columns])


def projects_total(projects: DataFrame) -> DataFrame:
    """Spend of all projects and their different data types, in order."""
    kinds = projects.select(F.explode("data_types").alias("k")).agg(F.sort_array(F.collect_set("k")).alias("data_types"), F.lit(1).alias("_one"))
    spend = projects.agg(F.coalesce(F.sum("spend_usd"), F.lit(0.0)).alias("spend_usd"), F.count(F.lit(1)).alias("projects"), F.lit(1).alias("_one"))
    return spend.join(kinds, "_one").drop("_one")


def judged_totals(pairs: DataFrame, criteria: DataFrame) -> DataFrame:
    """Pairs that the judge called a tie, judged pairs, and the sum of a rubric's weights (criteria: weight)."""
    weights = criteria.agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("weight_total"), F.lit(1).alias("_one"))
    return pairs.agg(F.count_if(F.col("judge.verdict") == "tie").alias("ties"), F.count("judge").alias("judged"), F.lit(1).alias("_one")).join(weights, "_one").drop("_one")


def eval_rows(exportable: Column, share: Column) -> Column:
    """Rows that a split will hold back: the product, halves up."""
    return F.floor(exportable * share + 0.5).cast("long")


def money(amount: Column) -> Column:
    """Dollars as shown: two places, four where there is less than a cent."""
    return F.when((amount > 0) & (amount < 0.01), F.format_string("$%.4f", amount)).otherwise(F.format_string("$%.2f", amount))


def relative_time(then: Column, now: Column) -> Column:
    """How long ago, in whole minutes, hours or days."""
    gone = now - then
    ago = lambda unit, short: F.concat(F.floor(gone / unit).cast("string"), F.lit(f"{short} ago"))
    return F.when(gone < 60, F.lit("just now")).when(gone < 3600, ago(60, "m")).when(gone < 86400, ago(3600, "h")).otherwise(ago(86400, "d"))


def truncated(text: Column, n: int) -> Column:
    """Text of at most ``n`` characters, the last of them an ellipsis where some are left out."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def thousands(tokens: Column) -> Column:
    """A context length: 128k, 1.0M."""
    return F.when(tokens >= 1_000_000, F.format_string("%.1fM", tokens / 1_000_000)).otherwise(F.concat(F.floor(tokens / 1000 + 0.5).cast("string"), F.lit("k")))


def packed_vector(vector: Column) -> Column:
    """A vector as little-endian 32-bit floats; null stays null."""

    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return pack(vector.cast("array<float>"))


def unpacked_vector(blob: Column) -> Column:
    """The vector of packed_vector(); a blob that is no whole number of floats fails."""

    @F.pandas_udf("array<float>")
    def unpack(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.frombuffer(v, "<f4"))

    return unpack(blob)
