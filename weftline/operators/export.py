"""Exporting: select, validate, split, write; nothing is left behind by an export that fails."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.messages import fold_system, validate_pair, validate_row
from weftline.functions.templates import template_issue
from weftline.operators import formats, rows as row_ops, stats
from weftline.operators.sampling import stratified_split, stratum
from weftline.sources import files


class ExportError(ValueError):
    pass


@dataclass(frozen=True)
class ExportConfig:
    formats: Sequence[str] = ("sft",)
    eval_share: float = 0.05
    stratify_by: str = "leaf"
    seed: int = 42
    template: str | None = None
    gate: bool = False
    threshold: float = 3.0
    drop_ties: bool = True
    with_metadata: bool = False


def issues(items: DataFrame, kind: str, template: str | None = None) -> DataFrame:
    """id and issue of every invalid item: repeated ids, structure, then the template where structure is right."""
    if kind == "row":
        own, whole = validate_row(F.col("messages")), [F.col("messages")]
    else:
        own, whole = validate_pair(F.col("prompt"), F.col("chosen"), F.col("rejected")), [F.concat("prompt", "chosen"), F.concat("prompt", "rejected")]
    step = items.select(F.col("metadata.id").alias("id"), own.alias("_i"), *([F.coalesce(*[template_issue(w, template) for w in whole]).alias("_t")] if template else [F.lit(None).cast("string").alias("_t")]))
    found = F.when(F.size("_i") > 0, F.col("_i")).when(F.col("_t").isNotNull(), F.array(F.concat(F.lit(f"{template} template: "), F.col("_t"))))
    again = step.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("issue"))
    return step.select("id", F.explode(found).alias("issue")).unionByName(again)


def check(items: DataFrame, kind: str, template: str | None = None) -> None:
    """Raises with the number of issues and the first ten of them."""
    found = issues(items, kind, template)
    shown = found.orderBy("id", "issue").limit(10).collect()
    if shown:
        raise ExportError(f"{found.count()} issue(s): " + "; ".join(f"{r['id']}: {r['issue']}" for r in shown))


def items_for(name: str, rows: DataFrame, pairs: DataFrame | None, config: ExportConfig) -> DataFrame:
    """Rows or pairs that a format takes, with the system turn folded for the gemma template."""
    fold = (lambda c: fold_system(F.col(c))) if config.template == "gemma" else F.col
    if name != "dpo":
        out = row_ops.selected_rows(rows, config.threshold, config.gate, formats.KINDS[name])
        return out.withColumn("messages", fold("messages"))
    if pairs is None:
        raise ExportError("dpo needs pairs")
    out = row_ops.selected_pairs(pairs, rows, config.threshold, config.gate, config.drop_ties)
    n = F.size("messages")
    rejected = F.filter("rejected_messages", lambda m: m["role"] == "assistant")
    out = out.withColumns({"prompt": F.slice("messages", F.lit(1), n - 1), "chosen": F.slice("messages", n, F.lit(1)), "rejected": F.slice(rejected, F.size(rejected), F.lit(1))})
    return out.withColumn("prompt", fold("prompt"))


def bundle(rows: DataFrame, pairs: DataFrame | None, target: str, name: str, config: ExportConfig) -> tuple[str, dict[str, dict[str, int]]]:
    """Writes all formats with manifest, settings and card, and moves the folder into place; its path and counts."""
    unknown = set(config.formats) - set(formats.FORMATS)
    if unknown:
        raise ExportError(f"unknown formats {sorted(unknown)}")
    spark = rows.sparkSession
    staged = f"{target}.partial"
    counts: dict[str, dict[str, int]] = {}
    taken = []
    try:
        for fmt in dict.fromkeys(config.formats):
            items = items_for(fmt, rows, pairs, config)
            check(items, "pair" if fmt == "dpo" else "row", config.template)
            lines = formats.formatted(items, fmt, config.with_metadata)
            keyed = items.select(F.col("metadata.id").alias("id"), stratum(config.stratify_by).alias("stratum"))
            split = lines.join(stratified_split(keyed, config.eval_share, config.seed).select("id", "split"), "id")
            counts[fmt] = {part: files.write_lines(split.where(F.col("split") == part), f"{staged}/{fmt}/{part}.jsonl") for part in ("train", "eval")}
            taken.append(items.select(F.col("metadata.id").alias("id"), F.array_join("metadata.leaf_path", " / ").alias("leaf"), F.col("metadata.difficulty").alias("difficulty")))
        if not any(sum(c.values()) for c in counts.values()):
            raise ExportError("nothing to export")
        every = taken[0]
        for t in taken[1:]:
            every = every.unionByName(t)
        leaves = {r["key"] or "": r["n"] for r in stats.breakdown(every).where("kind = 'leaf'").collect()}
        settings = {k: v for k, v in asdict(config).items()}
        files.write_text(spark, f"{staged}/README.md", files.card(name, counts, leaves, settings))
        files.write_text(spark, f"{staged}/config.json", json.dumps(settings, indent=2, default=list))
        listed = [r.asDict() for r in files.manifest(spark, staged).orderBy("path").collect()]
        files.write_text(spark, f"{staged}/manifest.json", json.dumps(listed, indent=2))
        return files.committed(spark, staged, target), counts
    except BaseException:
        fs, at = files._fs(spark, staged)
        fs.delete(at, True)
        raise
