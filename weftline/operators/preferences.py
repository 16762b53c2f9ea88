"""Preference pairs: which recorded attempt makes a pair, and by which teacher."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALIKE = 0.97


def too_similar(chosen: Column, rejected: Column) -> Column:
    """Whether two answers are one but for looks: equal, or close in length and of matching blocks over 97 %."""

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_alike((x or "").strip(), (y or "").strip()) for x, y in zip(a, b)])

    return alike(chosen, rejected)


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    if abs(len(a) - len(b)) > max(len(a), len(b)) * 0.2:
        return False
    match = difflib.SequenceMatcher(None, a, b, autojunk=False)
    # Each of these is an upper bound of the ratio, and cheaper than it.
    return match.real_quick_ratio() > ALIKE and match.quick_ratio() > ALIKE and match.ratio() > ALIKE


def first_acceptable(attempts: DataFrame) -> DataFrame:
    """Of recorded attempts (row_id, attempt, chosen, rejected), the first of each row that is a usable pair."""
    usable = attempts.where((F.trim(F.coalesce("rejected", F.lit(""))) != "")).where(~too_similar(F.col("chosen"), F.col("rejected")))
    return usable.groupBy("row_id").agg(F.min_by(F.struct(*[c for c in attempts.columns if c != "row_id"]), "attempt").alias("a")).select("row_id", "a.*")


def teacher(index: Column, slugs: Sequence[str]) -> Column:
    """Round robin over the ensemble."""
    return F.element_at(F.array(*map(F.lit, slugs)), (index % len(slugs) + 1).cast("int"))
