"""Prompts by rounds over recorded replies: draw, ask, add noise, refuse near duplicates, ask again for what failed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.dedup import dup_mask, ensure_checkpoints
from weftline.operators.sampling import drawn_choice, noisy
from weftline.operators.scoring import seeded

#: Calls after the first that may replace what was refused or missing.
MAX_EXTRA_CALLS = 2


@dataclass(frozen=True)
class Admission:
    project: str
    personas: Sequence[tuple[str, float]]
    styles: Sequence[tuple[str, float]]
    adversarial_pct: float = 0.0
    noise_level: float = 0.0
    threshold: float = 0.92


SPEC = "leaf_id string, place int, persona string, style string, adversarial boolean"
PROMPT = ["leaf_id", "call", "place", "persona", "style", "adversarial", "text", "noise", "status"]


def drawn_specs(leaves: DataFrame, settings: Admission) -> DataFrame:
    """n specs of every leaf (leaf_id, n, existing), drawn from a generator seeded by project, leaf and how many prompts it has."""

    def draw(batches):  # noqa: ANN001, ANN202
        for rows in batches:
            out = []
            for leaf, n, existing in zip(rows["leaf_id"], rows["n"], rows["existing"]):
                rng = seeded(settings.project, leaf, existing)
                out += [(leaf, k, drawn_choice(rng, settings.personas) or "User", drawn_choice(rng, settings.styles) or "question", rng.random() * 100.0 < settings.adversarial_pct) for k in range(n)]
            yield pd.DataFrame(out, columns=["leaf_id", "place", "persona", "style", "adversarial"])

    return leaves.select("leaf_id", "n", "existing").mapInPandas(draw, SPEC)


def admitted(leaves: DataFrame, existing: DataFrame, replies: DataFrame, settings: Admission) -> tuple[DataFrame, DataFrame]:
    """Prompts (PROMPT) and outcomes (leaf_id, calls, active, rejected, missing, status) of every leaf.

    leaves: leaf_id, n; existing: leaf_id, v, the vectors of active prompts; replies: leaf_id, call (from 1), k, text, v, as
    recorded. In a call the replies, in order of k, answer the open specs in order; surplus ones are not used. A prompt that is
    near one of its leaf that was there or was admitted before it is rejected_dup, and its spec is asked again, before those
    that no reply answered. A call without replies ends its leaf. What is open, admitted and refused goes from
    round to round as checkpointed tables; each prompt's noise has a generator of its own, seeded by leaf, call and place.
    A leaf without an active prompt has status error; one that asks for none is done without a call.
    """
    ensure_checkpoints(leaves.sparkSession)
    have = existing.groupBy(F.col("leaf_id").alias("_leaf")).agg(F.count(F.lit(1)).alias("existing"))
    asked = leaves.select("leaf_id", "n").join(have, F.col("leaf_id") == F.col("_leaf"), "left").select("leaf_id", "n", F.coalesce("existing", F.lit(0)).alias("existing"))
    pending = drawn_specs(asked, settings).checkpoint()
    pool = existing.select("leaf_id", F.col("v").cast("array<double>").alias("v"))
    prompts, calls = None, None
    place = lambda *by: (F.row_number().over(Window.partitionBy("leaf_id").orderBy(*by)) - 1).cast("int")
    for call in range(1, 2 + MAX_EXTRA_CALLS):
        own = replies.where(F.col("call") == call).select("leaf_id", place("k").alias("place"), "text", F.col("v").cast("array<double>").alias("v"))
        made = pending.select("leaf_id").distinct().withColumn("call", F.lit(call))
        calls = made if calls is None else calls.unionByName(made)
        batch = pending.join(own, ["leaf_id", "place"]).withColumn("_key", F.concat_ws("|", "leaf_id", F.lit(call), "place"))
        batch = noisy(batch, settings.project, settings.noise_level, "_key").drop("_key")
        batch = batch.select("leaf_id", F.lit(call).alias("call"), "place", "persona", "style", "adversarial", F.col("noisy").alias("text"), "noise", "v")
        judged = dup_mask(batch, pool, settings.threshold, "leaf_id", "place").withColumn("status", F.when(F.col("dup"), "rejected_dup").otherwise("active")).drop("dup").checkpoint()
        prompts = judged if prompts is None else prompts.unionByName(judged)
        pool = pool.unionByName(judged.where("status = 'active'").select("leaf_id", "v"))
        answered = own.select("leaf_id").distinct()
        again = judged.where("status = 'rejected_dup'").select("leaf_id", F.lit(0).alias("_why"), "place", "persona", "style", "adversarial")
        missing = pending.join(judged.select("leaf_id", "place"), ["leaf_id", "place"], "left_anti").join(answered, "leaf_id", "left_semi").select("leaf_id", F.lit(1).alias("_why"), "place", "persona", "style", "adversarial")
        pending = again.unionByName(missing).select("leaf_id", place("_why", "place").alias("place"), "persona", "style", "adversarial").checkpoint()
        if pending.isEmpty():
            break
    told = prompts.groupBy("leaf_id").agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "rejected_dup").alias("rejected"))
    made = calls.groupBy("leaf_id").agg(F.count(F.lit(1)).alias("calls"))
    out = asked.select("leaf_id", "n").join(made, "leaf_id", "left").join(told, "leaf_id", "left").na.fill(0, ["calls", "active", "rejected"])
    status = F.when((F.col("n") > 0) & (F.col("active") == 0), "error").otherwise("done")
    return prompts.select(*PROMPT), out.select("leaf_id", "calls", "active", "rejected", (F.col("n") - F.col("active")).cast("long").alias("missing"), status.alias("status"))
