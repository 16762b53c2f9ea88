"""Choices that a stage makes for each item: which reply counts, which teacher, flaw and slot, which attempt makes a pair.

Draws come from generators seeded by project and item, one each, so a choice depends on neither order nor partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.dedup import numbered
from weftline.operators.preferences import too_similar
from weftline.operators.replay import json_part
from weftline.operators.sampling import weighted_choice
from weftline.operators.scoring import seeded

# How a structured reply is asked for, in order; the teacher where none is named; attempts by strategy.
MODES = ("json_schema", "json_object", "plain")
DEFAULT_TEACHER = "anthropic/claude-sonnet-4"
ATTEMPTS = {"corruptor": 3, "weaker": 2, "hightemp": 2}


@dataclass(frozen=True)
class Slot:
    """A model of an ensemble: its name, how often it is drawn, how warm it answers, who serves it."""

    slug: str
    weight: float = 1.0
    temperature: float = 0.7
    provider: str | None = None


def draw(project: str, item: Column, times: int = 1) -> Column:
    """``times`` numbers in [0, 1) of the item's own generator."""

    @F.pandas_udf("array<double>")
    def drawn(items: pd.Series) -> pd.Series:
        def own(x: object) -> list[float]:
            rng = seeded(project, x)
            return [rng.random() for _ in range(times)]

        return items.map(own)

    return drawn(item.cast("string"))


def structured_outcomes(calls: DataFrame, schema: str) -> DataFrame:
    """What recorded calls for a structured reply come to: target_id, value, mode, repaired, cost_usd, error.

    calls: target_id, mode (one of MODES, or repair), status (null or 200: answered), reply, cost_usd. Modes count in order; one
    that was refused with status 400 gives way to the next, any other error ends the target. The first answer is parsed; where
    it does not fit, the repair's is, once. Cost is that of both. A target without an answer has an error, never a value.
    """
    rank = F.array_position(F.array(*map(F.lit, MODES)), F.col("mode"))
    refused = F.coalesce(F.col("status"), F.lit(200)) != 200
    ask = F.struct(rank.alias("rank"), "mode", "status", "reply", F.coalesce("cost_usd", F.lit(0.0)).alias("cost"), refused.alias("refused"))
    held = calls.groupBy("target_id").agg(F.sort_array(F.collect_list(F.when(F.col("mode") != "repair", ask))).alias("_asked"), F.first(F.when(F.col("mode") == "repair", ask), True).alias("_repair"))
    # The last mode's refusal stands, as does any error that is no 400.
    count = F.size("_asked")
    told = F.filter("_asked", lambda a, i: ~a["refused"] | (a["status"] != 400) | (i == count - 1))
    first = F.get(told, F.lit(0))
    step = held.select("target_id", first.alias("_first"), "_repair")
    parse = lambda reply: F.from_json(json_part(F.coalesce(reply, F.lit(""))), schema)
    fits = lambda v: v.isNotNull() & (F.coalesce(F.to_json(v), F.lit("{}")) != "{}")
    step = step.withColumns({"_a": F.when(~F.col("_first.refused"), parse(F.col("_first.reply"))), "_b": F.when(~F.col("_repair.refused"), parse(F.col("_repair.reply")))})
    failed, a, b = F.coalesce(F.col("_first.refused"), F.lit(True)), F.coalesce(fits(F.col("_a")), F.lit(False)), F.coalesce(fits(F.col("_b")), F.lit(False))
    repaired = ~failed & ~a & b
    error = F.when(F.col("_first").isNull(), "no call").when(failed, F.concat(F.lit("status "), F.col("_first.status"))).when(~a & ~b, F.when(F.col("_repair").isNull(), "did not validate").when(F.col("_repair.refused"), F.concat(F.lit("repair: status "), F.col("_repair.status"))).otherwise("did not validate after repair"))
    cost = F.coalesce("_first.cost", F.lit(0.0)) + F.when(~failed & ~a, F.coalesce("_repair.cost", F.lit(0.0))).otherwise(F.lit(0.0))
    return step.select("target_id", F.when(~failed & a, F.col("_a")).when(repaired, F.col("_b")).alias("value"), F.when(~failed, F.col("_first.mode")).alias("mode"), repaired.alias("repaired"), cost.alias("cost_usd"), error.alias("error"))


def teachers(prompts: DataFrame, ensemble: Sequence[Slot], project: str, weighted: bool = False) -> DataFrame:
    """``prompts`` (id, created_at) with ``teacher``: by turns in order of age and id, or by weight with the prompt's own draw."""
    slugs = [s.slug for s in ensemble] or [DEFAULT_TEACHER]
    if weighted and ensemble:
        return prompts.withColumn("teacher", weighted_choice(F.get(draw(project, F.col("id")), F.lit(0)), [(s.slug, s.weight) for s in ensemble]))
    placed = numbered(prompts, ["created_at", "id"])
    return placed.withColumn("teacher", F.get(F.array(*map(F.lit, slugs)), (F.col("n") % len(slugs)).cast("int"))).drop("n")


def with_slot(rows: DataFrame, ensemble: Sequence[Slot], slug: str = "teacher") -> DataFrame:
    """``rows`` with the slot of their teacher: the ensemble's first of that name, else a bare one; of the default where none is named."""
    name = F.coalesce(F.col(slug), F.lit(ensemble[0].slug if ensemble else DEFAULT_TEACHER))
    bare = Slot("")
    field = lambda get, kind: F.coalesce(*[F.when(name == s.slug, F.struct(F.lit(get(s)).cast(kind).alias("x"))) for s in ensemble], F.struct(F.lit(get(bare)).cast(kind).alias("x")))["x"]
    slot = F.struct(name.alias("slug"), field(lambda s: s.temperature, "double").alias("temperature"), field(lambda s: s.provider, "string").alias("provider"))
    return rows.withColumn("slot", slot)


def stage_slug(strategy: str, ensemble: Sequence[Slot], weaker: str | None) -> str:
    """The model that makes rejected answers: the weaker one for that strategy, else the ensemble's first."""
    if strategy == "weaker" and weaker:
        return weaker
    return ensemble[0].slug if ensemble else DEFAULT_TEACHER


def system_prompt_shown(policy: str, item: Column, project: str, pct: float = 50.0) -> Column:
    """Whether an item's teacher sees the system prompt: always, never, or for that share of the items."""
    if policy in ("always", "never"):
        return F.lit(policy == "always")
    return F.get(draw(project, item), F.lit(0)) * 100.0 < pct


def flaw_of(item: Column, flaws: Sequence[tuple[str, float]], project: str) -> Column:
    """The flaw that an item's rejected answer is to have, by weight with the item's own draw."""
    return weighted_choice(F.get(draw(project, item), F.lit(0)), flaws)


def tool_schema(tools: Column, name: Column) -> Column:
    """The first schema of that name in a JSON array of tools, wrapped in ``function`` or bare, as it stands; else an empty one."""
    each = F.from_json(tools, "array<string>")
    named = lambda t: F.coalesce(F.when(F.get_json_object(t, "$.function").isNotNull(), F.get_json_object(t, "$.function.name")).otherwise(F.get_json_object(t, "$.name")), F.lit(""))
    return F.coalesce(F.get(F.filter(each, lambda t: named(t) == name), F.lit(0)), F.lit("{}"))


def pairs_from_attempts(rows: DataFrame, attempts: DataFrame, strategy: str, flaws: Sequence[tuple[str, float]] = (), project: str = "") -> DataFrame:
    """row_id, rejected, strategy, flaw, attempts, cost_usd and error of every row (id, chosen), from recorded attempts (row_id, attempt, rejected, cost_usd).

    The first attempt, of as many as the strategy has, that is not empty and differs enough from the chosen answer makes the pair; later ones do not
    count, nor cost. The corruptor's last attempt is a fresh warm answer and recorded as such. A row without a usable attempt has an error.
    """
    most = ATTEMPTS[strategy]
    own = rows.select(F.col("id").alias("row_id"), F.rtrim("chosen").alias("chosen"))
    tried = own.join(attempts.where(F.col("attempt").between(1, most)).select("row_id", "attempt", F.rtrim(F.coalesce("rejected", F.lit(""))).alias("rejected"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd")), "row_id")
    tried = tried.withColumn("usable", (F.col("rejected") != "") & ~too_similar(F.col("chosen"), F.col("rejected")))
    best = tried.groupBy("row_id").agg(F.min(F.when(F.col("usable"), F.struct("attempt", "rejected"))).alias("_best"), F.collect_list(F.struct("attempt", "cost_usd")).alias("_all"))
    counted = F.filter("_all", lambda a: F.col("_best").isNull() | (a["attempt"] <= F.col("_best.attempt")))
    out = own.select("row_id").join(best, "row_id", "left").withColumn("_counted", F.coalesce(counted, F.expr("array()").cast("array<struct<attempt:int,cost_usd:double>>")))
    used = F.when(F.col("_best.attempt") == most, F.lit("corruptor+hightemp")).otherwise(F.lit(strategy)) if strategy == "corruptor" else F.lit(strategy)
    made = F.col("_best").isNotNull()
    flaw = flaw_of(F.col("row_id"), flaws, project) if strategy == "corruptor" and flaws else F.lit(None).cast("string")
    return out.select(
        "row_id", "_best.rejected", F.when(made, used).alias("strategy"), F.when(made, flaw).alias("flaw"), F.size("_counted").alias("attempts"),
        F.round(F.aggregate("_counted", F.lit(0.0), lambda s, a: s + a["cost_usd"]), 6).alias("cost_usd"), F.when(~made, "no attempt differs enough").alias("error"),
    )
