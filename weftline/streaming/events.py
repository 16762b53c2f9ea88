"""Structured Streaming over run events: progress, replay, budgets, windows (the last beyond the batch operators)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay(events: DataFrame, after: int) -> DataFrame:
    """Events past a sequence number; the same on a batch and on a stream."""
    return events.where(F.col("seq") > after)


def progress_counts(items: DataFrame) -> DataFrame:
    """Running counts by run of finished, failed and refused items (update mode)."""
    return items.groupBy("run_id").agg(F.count_if(F.col("status") != "partial").alias("done"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "refusal").alias("refusals"))


def spend_by_window(calls: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Spend and calls by project and event-time window; what comes later than ``late`` is left out."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", size), "project_id").agg(F.sum("cost_usd").alias("spend"), F.count(F.lit(1)).alias("calls")).select("project_id", F.col("window.start").alias("start"), "spend", "calls")


def first_seen(events: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """Events whose key was not seen within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def budget_guard(calls: DataFrame, cap: float, stop_at_pct: int) -> DataFrame:
    """Live spend of each project and whether it has reached its stop threshold, kept as state by project."""
    limit = cap * stop_at_pct / 100.0

    def guard(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        spend, n = state.get if state.exists else (0.0, 0)
        for rows in batches:
            spend += float(rows["cost_usd"].fillna(0).clip(lower=0).sum())
            n += len(rows)
        state.update((spend, n))
        yield pd.DataFrame({"project_id": [key[0]], "spend": [spend], "calls": [n], "stopped": [spend + 1e-9 >= limit]})

    kind = calls.schema["project_id"].dataType.simpleString()
    return calls.groupBy("project_id").applyInPandasWithState(guard, f"project_id {kind}, spend double, calls long, stopped boolean", "spend double, calls long", "update", "NoTimeout")
