"""Judging: weighted rubric scores, blind pair order, verdicts, the summary."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import two_places

# The default rubric, and the gap from which scores break a tie.
RUBRIC = (("Correctness", 40), ("Actionability", 25), ("Style adherence", 20), ("Safety", 15))
TIE_GAP = 0.25
BINS = 10


def normalised_criteria(raw: Column, rubric: Sequence[tuple[str, int]] = RUBRIC) -> Column:
    """Rubric scores by name, whatever the case of the given names; null if one is missing or not 1 to 5."""
    known = F.map_from_entries(F.transform(F.map_entries(raw), lambda e: F.struct(F.lower(F.trim(e["key"])), e["value"].try_cast("int"))))
    values = [F.try_element_at(known, F.lit(name.strip().lower())) for name, _ in rubric]
    ok = values[0].between(1, 5)
    for v in values[1:]:
        ok = ok & v.between(1, 5)
    return F.when(F.coalesce(ok, F.lit(False)), F.create_map(*[x for (name, _), v in zip(rubric, values) for x in (F.lit(name), v)]))


def weighted_score(criteria: Column, rubric: Sequence[tuple[str, int]] = RUBRIC) -> Column:
    """Weighted mean to two places; the plain mean where the weights sum to nothing."""
    total = sum(w for _, w in rubric)
    value = lambda name: F.element_at(criteria, F.lit(name)).cast("double")
    if total <= 0:
        return two_places(F.aggregate(F.map_values(criteria), F.lit(0.0), lambda a, v: a + v) / F.size(criteria))
    score = None
    for name, w in rubric:
        score = w * value(name) if score is None else score + w * value(name)
    return two_places(score / total)


def seeded(*parts: object) -> random.Random:
    """A generator seeded by the SHA-256 of the parts joined by bars."""
    return random.Random(int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:16], 16))


def chosen_is_a(project: Column, target: Column) -> Column:
    """Whether the chosen side is shown first: a seeded draw by project and pair."""

    @F.pandas_udf("boolean")
    def drawn(p: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([seeded(a, b).random() < 0.5 for a, b in zip(p, t)])

    return drawn(project, target)


def judged_pairs(pairs: DataFrame, rubric: Sequence[tuple[str, int]] = RUBRIC) -> DataFrame:
    """Pairs with what a blind judge said turned into verdict, scores and status.

    pairs: verdict_ab (A, B or TIE), chosen_first, a, b, criteria (maps), row_score. One set of
    criteria alone goes to the winner, or to both of a tie; sides scored apart by a quarter break it.
    """
    said = F.upper("verdict_ab")
    verdict = F.when(said == "TIE", "tie").when((said == "A") == F.col("chosen_first"), "chosen").otherwise("rejected")
    a, b, one = (normalised_criteria(F.col(c), rubric) for c in ("a", "b", "criteria"))
    alone = a.isNull() & b.isNull()
    a, b = F.when(alone & (said != "B"), one).otherwise(a), F.when(alone & (said != "A"), one).otherwise(b)
    step = pairs.withColumns({"_v": verdict, "_a": a, "_b": b})
    first = F.col("chosen_first")
    step = step.withColumns({"chosen_criteria": F.when(first, F.col("_a")).otherwise(F.col("_b")), "rejected_criteria": F.when(first, F.col("_b")).otherwise(F.col("_a"))})
    step = step.withColumns({"chosen_score": weighted_score(F.col("chosen_criteria"), rubric), "rejected_score": weighted_score(F.col("rejected_criteria"), rubric)})
    gap = F.col("chosen_score") - F.col("rejected_score")
    broken = F.coalesce((F.col("_v") == "tie") & (F.abs(gap) >= TIE_GAP), F.lit(False))
    step = step.withColumns({"tie_broken_by_scores": broken, "verdict": F.when(broken, F.when(gap > 0, "chosen").otherwise("rejected")).otherwise(F.col("_v"))})
    return step.withColumns(
        {
            "score": F.coalesce("chosen_score", "row_score", "rejected_score", F.lit(0.0)),
            "status": F.when(F.col("verdict") == "tie", "tie").otherwise("judged"),
            "order": F.when(first, "chosen_first").otherwise("rejected_first"),
        }
    ).drop("_v", "_a", "_b")


def with_low_flag(flags: Column, score: Column, threshold: float = 3.0) -> Column:
    """Flags with low_score present just when the score is under the threshold."""
    rest = F.array_remove(F.coalesce(flags, F.array().cast("array<string>")), "low_score")
    return F.when(score < threshold, F.concat(rest, F.array(F.lit("low_score")))).otherwise(rest)


def summary(scores: DataFrame, threshold: float = 3.0) -> DataFrame:
    """One row over all scored rows: histogram of ten bins to 5, mean, median, how many are low."""
    bin_of = F.least(F.lit(BINS - 1), F.floor(F.col("score") / 5.0 * BINS)).cast("int")
    counts = [F.count_if(bin_of == k).alias(f"b{k}") for k in range(BINS)]
    row = scores.where(F.col("score").isNotNull()).agg(*counts, F.avg("score").alias("mean"), F.percentile("score", 0.5).alias("median"), F.count_if(F.col("score") < threshold).alias("low_count"), F.count(F.lit(1)).alias("judged_rows"))
    return row.select(F.array(*[f"b{k}" for k in range(BINS)]).alias("histogram"), two_places(F.col("mean")).alias("mean"), two_places(F.col("median")).alias("median"), "low_count", "judged_rows")


def family(slug: Column) -> Column:
    """The maker's part of a model name, with the aliases of makers folded."""
    maker = F.lower(F.split(F.coalesce(slug, F.lit("")), "/", 2)[0])
    alias = {"meta-llama": "meta", "mistralai": "mistral"}
    out = maker
    for a, b in alias.items():
        out = F.when(maker == a, F.lit(b)).otherwise(out)
    return out
