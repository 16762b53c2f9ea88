"""Reading and editing rows: search, filters, sorting, pages, patches, joins between the tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import schema
from weftline.functions.messages import rstrip_assistant, validate_messages

SORTS = {"created_at": F.asc, "-created_at": F.desc, "score": F.asc, "-score": F.desc, "status": F.asc, "model": F.asc, "id": F.asc}


def search(rows: DataFrame, status: str | None = None, q: str | None = None, flag: str | None = None, flags: Sequence[str] = (), min_score: float | None = None, max_score: float | None = None, text: Column | None = None, **equal: object) -> DataFrame:
    """Rows by comma-listed statuses, text (% and _ are wildcards), flags, score range and equal columns.

    The text is that of the messages, or ``text``; the id matches too. Null scores fall out of a range.
    """
    out = rows
    if status:
        out = out.where(F.col("status").isin(*status.split(",")))
    for name, value in equal.items():
        if value is not None:
            out = out.where(F.col(name) == value)
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    if max_score is not None:
        out = out.where(F.col("score") <= max_score)
    if q:
        found = F.exists("messages", lambda m: F.coalesce(m["content"], F.lit("")).ilike(f"%{q}%")) if text is None else text.ilike(f"%{q}%")
        out = out.where(found | F.col("id").cast("string").ilike(f"%{q}%"))
    for f in [*([flag] if flag else []), *flags]:
        out = out.where(F.array_contains("metadata.flags", f))
    return out


def ordered(rows: DataFrame, sort: str = "created_at") -> DataFrame:
    """Rows by one of the seven sort keys, ties by id; an unknown key sorts by age."""
    how = SORTS.get(sort)
    column = {"model": "model_slug"}.get(sort.lstrip("-"), sort.lstrip("-")) if how else "created_at"
    return rows.orderBy((how or F.asc)(column), "id")


def collated(rows: DataFrame, column: str, descending: bool = False, key: str = "id", locale: str = "UNICODE") -> DataFrame:
    """Rows as a table shows them: numbers by size, text as a reader of the locale sorts it (accents and case last), ties by ``key``.

    A collation of Spark's is compared (ICU), never the bytes. Nulls sort as the text "null" would in a table of text, after all
    numbers in one of numbers, and the other way round when ``descending``.
    """
    kind = rows.schema[column].dataType.simpleString()
    number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    if number:
        return rows.orderBy(F.col(column).desc_nulls_first() if descending else F.col(column).asc_nulls_last(), key)
    shown = F.collate(F.coalesce(F.col(column).cast("string"), F.lit("null")), locale)
    return rows.orderBy(shown.desc() if descending else shown.asc(), key)


def page(rows: DataFrame, number: int = 1, size: int = 50, sort: str = "created_at") -> DataFrame:
    """One page of rows, 1 to 1000 a page."""
    size = min(max(size, 1), 1000)
    return ordered(rows, sort).offset((max(number, 1) - 1) * size).limit(size)


def set_flags(flags: Column, add: Sequence[str] = (), remove: Sequence[str] = ()) -> Column:
    """Flags without the removed and with the added ones, in order, none twice."""
    held = F.coalesce(flags, F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return F.array_union(F.array_except(held, F.array(*map(F.lit, remove)) if remove else none), F.array(*map(F.lit, add)) if add else none)


def patched(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """``rows`` with patches (id, messages, status; null: unchanged) applied: edited rows are flagged and marked so.

    A patch whose messages do not pass validation changes nothing and shows in ``patch_issues``.
    """
    new = patches.select(F.col("id").alias("_id"), rstrip_assistant(F.col("messages")).alias("_m"), F.col("status").alias("_s"))
    step = rows.join(new, F.col("id") == F.col("_id"), "left").withColumn("patch_issues", F.when(F.col("_m").isNotNull(), validate_messages(F.col("_m"))))
    edit = F.coalesce(F.size("patch_issues") == 0, F.lit(False))
    fine = F.col("patch_issues").isNull() | edit
    out = step.withColumns(
        {
            "metadata": F.when(edit, F.col("metadata").withField("flags", set_flags(F.col("metadata.flags"), ["edited"]))).otherwise(F.col("metadata")),
            "messages": F.when(edit, F.col("_m")).otherwise(F.col("messages")),
            "status": F.when(fine & F.col("_s").isNotNull(), F.col("_s")).when(edit, F.lit("edited")).otherwise(F.col("status")),
        }
    )
    return out.select(*rows.columns, "patch_issues")


def bulk(rows: DataFrame, ids: DataFrame, action: str) -> DataFrame:
    """accept, flag, unflag or delete the rows of the given ids."""
    chosen = ids.select(F.col("id").alias("_id")).distinct()
    if action == "delete":
        return rows.join(chosen, F.col("id") == F.col("_id"), "left_anti")
    hit = F.col("_id").isNotNull()
    new = {"accept": F.lit("accepted"), "flag": F.lit("flagged"), "unflag": F.when(F.col("status") == "flagged", F.lit("draft")).otherwise(F.col("status"))}[action]
    out = rows.join(chosen, F.col("id") == F.col("_id"), "left").withColumn("status", F.when(hit, new).otherwise(F.col("status")))
    return out.select(*rows.columns)


def with_leaf(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` with the label of their leaf, null where there is none."""
    return rows.join(nodes.select(F.col("id").alias("_leaf"), F.col("label").alias("leaf_label")), F.col("leaf_id") == F.col("_leaf"), "left").drop("_leaf")


def prompts_pending(prompts: DataFrame, rows: DataFrame) -> DataFrame:
    """Active prompts that no row answers."""
    done = rows.where(F.col("prompt_id").isNotNull()).select(F.col("prompt_id").alias("id"))
    return prompts.where("status = 'active'").join(done, "id", "left_anti")


def rows_without_pair(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows eligible for a preference pair that have none."""
    eligible = rows.where(F.col("status").isin(*schema.EXPORTABLE) & (F.col("kind") != "tools"))
    return eligible.join(pairs.select(F.col("row_id").alias("id")), "id", "left_anti")


def judge_pending(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Work for the judge: candidate rows without a judgement, then pairs without one."""
    own = rows.where(F.col("status").isin(*schema.CANDIDATE) & F.col("metadata.judge").isNull()).select(F.lit("row").alias("target_type"), F.col("id").alias("target_id"))
    return own.unionByName(pairs.where(F.col("judge").isNull()).select(F.lit("pair").alias("target_type"), F.col("id").alias("target_id")))


def selected_rows(rows: DataFrame, threshold: float = 3.0, gate: bool = False, kinds: Sequence[str] | None = None) -> DataFrame:
    """Rows to export; low scores are left out with the gate on, flagged with it off."""
    out = rows.where(F.col("status").isin(*schema.EXPORTABLE))
    out = out.where(F.col("kind").isin(*kinds)) if kinds else out
    low = F.coalesce(F.coalesce("score", "metadata.judge.score") < threshold, F.lit(False))
    if gate:
        return out.where(~low)
    return out.withColumn("metadata", F.when(low, F.col("metadata").withField("flags", set_flags(F.col("metadata.flags"), ["low_score"]))).otherwise(F.col("metadata")))


def selected_pairs(pairs: DataFrame, rows: DataFrame, threshold: float = 3.0, gate: bool = False, drop_ties: bool = True) -> DataFrame:
    """Pairs to export with their rows: no ties (on request), none that the judge turned, no low ones behind the gate."""
    statuses = ["draft", "judged", "accepted", *([] if drop_ties else ["tie"])]
    own = rows.where(~F.col("status").isin(*schema.EXCLUDED)).select(F.col("id").alias("row_id"), F.col("score").alias("row_score"), "messages", "metadata")
    out = pairs.where(F.col("status").isin(*statuses)).join(own, "row_id")
    verdict = F.coalesce("judge.verdict", F.lit(""))
    out = out.where((verdict != "rejected") & ((verdict != "tie") if drop_ties else F.lit(True)))
    low = F.coalesce(F.coalesce("judge.score", "row_score") < threshold, F.lit(False))
    return out.where(~low) if gate else out


def next_numbers(rows: DataFrame, new: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Ids for new rows (prefix, k): numbering goes on from each prefix's largest, padded to four digits."""
    used = rows.select(F.regexp_extract("id", r"^(.*)-(\d+)$", 1).alias(prefix), F.regexp_extract("id", r"^(.*)-(\d+)$", 2).try_cast("long").alias("n")).where(F.col("n").isNotNull()).groupBy(prefix).agg(F.max("n").alias("last"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(prefix).orderBy("k"))
    out = new.withColumn("_r", place).join(used, prefix, "left").withColumn("_n", F.col("_r") + F.coalesce("last", F.lit(0)))
    return out.withColumn("id", F.concat(F.col(prefix), F.lit("-"), F.when(F.col("_n") < 10_000, F.lpad(F.col("_n").cast("string"), 4, "0")).otherwise(F.col("_n").cast("string")))).drop("_r", "_n", "last")


def kind_of_types(types: Column) -> Column:
    """The kind of a project's rows from its data types: tools before grpo before sft; null types count as none."""
    has = lambda kind: F.coalesce(F.array_contains(types, kind), F.lit(False))
    return F.when(has("tools"), "tools").when(has("grpo"), "grpo").otherwise("sft")
