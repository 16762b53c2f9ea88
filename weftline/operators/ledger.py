"""The run ledger: estimates, budgets replayed over recorded calls, aborts, resume plans, progress."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The opening sample that may abort a run, fallback prices in dollars a million tokens.
ABORT_SAMPLE, ABORT_ERRORS, ABORT_SHARE = 20, 8, 0.6
EMA_ALPHA = 0.5
DEFAULT_PRICE = (1.0, 3.0)
PRICES = {
    "anthropic/claude-sonnet-4": (3.0, 15.0),
    "anthropic/claude-3.5-sonnet": (3.0, 15.0),
    "anthropic/claude-3.5-haiku": (0.8, 4.0),
    "openai/gpt-4o": (2.5, 10.0),
    "openai/gpt-4o-mini": (0.15, 0.6),
    "openai/gpt-4.1": (2.0, 8.0),
    "openai/gpt-4.1-mini": (0.4, 1.6),
    "meta-llama/llama-3.1-8b-instruct": (0.05, 0.08),
    "meta-llama/llama-3.1-70b-instruct": (0.4, 0.4),
    "google/gemini-2.0-flash-001": (0.1, 0.4),
    "openai/text-embedding-3-small": (0.02, 0.0),
    "openai/text-embedding-3-large": (0.13, 0.0),
}


def with_prices(df: DataFrame, catalogue: DataFrame | None = None, slug: str = "model_slug") -> DataFrame:
    """``df`` with price_in and price_out: the catalogue's, else the fallback table's, else the default.

    The fallback table is asked for the slug, then for what stands before its first colon.
    """
    spark = df.sparkSession
    fallback = spark.createDataFrame([(k, a, b) for k, (a, b) in PRICES.items()], "_slug string, _in double, _out double")
    out = df.join(F.broadcast(fallback), F.substring_index(slug, ":", 1) == F.col("_slug"), "left")
    if catalogue is not None:
        own = catalogue.select(F.col("id").alias("_id"), F.col("price_in").alias("_cin"), F.col("price_out").alias("_cout"))
        out = out.join(own, F.col(slug) == F.col("_id"), "left")
    else:
        out = out.withColumns({"_id": F.lit(None).cast("string"), "_cin": F.lit(None).cast("double"), "_cout": F.lit(None).cast("double")})
    return out.withColumns({"price_in": F.coalesce("_cin", "_in", F.lit(DEFAULT_PRICE[0])), "price_out": F.coalesce("_cout", "_out", F.lit(DEFAULT_PRICE[1]))}).drop("_slug", "_in", "_out", "_id", "_cin", "_cout")


def estimates(plan: DataFrame) -> DataFrame:
    """``plan`` (prompt_chars, max_tokens, calls, price_in, price_out) with est_tokens_in, est_tokens_out and est_usd."""
    tokens_in, tokens_out = F.floor(F.col("prompt_chars") / 4), F.floor(F.col("max_tokens") * 0.6)
    per_call = tokens_in / 1e6 * F.col("price_in") + tokens_out / 1e6 * F.col("price_out")
    return plan.withColumns({"est_tokens_in": (tokens_in * F.col("calls")).cast("long"), "est_tokens_out": (tokens_out * F.col("calls")).cast("long"), "est_usd": F.round(per_call * F.col("calls"), 6)})


def call_costs(calls: DataFrame) -> DataFrame:
    """``calls`` with cost filled: what was billed, else price times tokens (of characters where not counted)."""
    tin, tout = F.coalesce("tokens_in", F.floor(F.col("request_chars") / 4)), F.coalesce("tokens_out", F.floor(F.col("response_chars") / 4))
    guess = tin / 1e6 * F.col("price_in") + tout / 1e6 * F.col("price_out")
    return calls.withColumns({"estimated": F.col("cost_usd").isNull(), "cost": F.coalesce("cost_usd", guess)})


def usage_tokens(usage: Column) -> dict[str, Column]:
    """Tokens of a usage record in JSON under whichever of the known names comes first."""
    first = lambda *paths: F.coalesce(*[F.get_json_object(usage, f"$.{p}").try_cast("long") for p in paths])
    return {
        "tokens_in": first("prompt_tokens", "input_tokens"),
        "tokens_out": first("completion_tokens", "output_tokens"),
        "cache_read": first("prompt_tokens_details.cached_tokens", "cache_read_input_tokens"),
        "cache_write": first("prompt_tokens_details.cache_write_tokens", "cache_creation_input_tokens"),
    }


def budget_replay(calls: DataFrame, cap: float, stop_at_pct: int, by: str = "project_id", at: str = "created_at", key: str = "id", cost: str = "cost_usd") -> DataFrame:
    """For each project: what was spent when a call first took it to the stop threshold, and how many calls ran before.

    Spend is a running sum by time and id, taken in two passes: calls are dealt by ranges of (project, time, id), so a
    project with most calls lies in many tasks; each range's sums are folded, running sums of those say what was spent before
    a range, and within a range calls are summed on from there.
    """
    from weftline.operators.dedup import ensure_checkpoints

    ensure_checkpoints(calls.sparkSession)
    spent = F.greatest(F.coalesce(F.col(cost).cast("double"), F.lit(0.0)), F.lit(0.0))
    # Written out, as ranges would shift if a lost executor had them drawn again.
    dealt = calls.select(by, at, key, spent.alias("_cost")).repartitionByRange(by, at, key).withColumn("_range", F.spark_partition_id()).checkpoint()
    ranges = dealt.groupBy(by, "_range").agg(F.sum("_cost").alias("_sum"), F.count(F.lit(1)).alias("_count"))
    earlier = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_before"), F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_n"))
    order = Window.partitionBy(by, "_range").orderBy(at, key).rowsBetween(Window.unboundedPreceding, 0)
    running = dealt.select(by, key, "_range", F.sum("_cost").over(order).alias("_own"), F.count(F.lit(1)).over(order).alias("_k"))
    running = running.join(ranges, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r"))).select(by, key, (F.col("_own") + F.col("_before")).alias("spend"), (F.col("_k") + F.col("_n")).alias("n"))
    over = F.col("spend") + 1e-9 >= cap * stop_at_pct / 100.0
    return running.groupBy(by).agg(F.min(F.when(over, F.struct("n", "spend", key))).alias("stop"), F.max("spend").alias("total"), F.max("n").alias("calls")).select(
        by, "calls", "total", F.col("stop.n").alias("stopped_after"), F.col("stop.spend").alias("spend_at_stop"), F.col(f"stop.{key}").alias("stopped_by")
    )


def reserved_replay(plan: DataFrame, cap: float, stop_at_pct: int, workers: int, by: str = "project_id") -> DataFrame:
    """Which calls a guard admits when ``workers`` calls are in flight: n, est and cost by project in order of n.

    A call is admitted if spend is under the threshold and spend, open reservations and its own
    estimate stay within the cap; it is billed when its worker comes up again.
    """
    import pandas as pd

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, spend, flight, out, stopped = rows.sort_values("n"), 0.0, [], [], False
        for n, est, cost in zip(rows["n"], rows["est"], rows["cost"]):
            if len(flight) >= workers:
                spend += flight.pop(0)[1]
            held = sum(e for e, _ in flight)
            stopped = stopped or spend + 1e-9 >= cap * stop_at_pct / 100.0 or spend + held + est > cap + 1e-12
            if not stopped:
                flight.append((est, cost))
            out.append(not stopped)
        return pd.DataFrame({by: key[0], "n": rows["n"], "admitted": out})

    return plan.groupBy(by).applyInPandas(run, f"{by} {plan.schema[by].dataType.simpleString()}, n long, admitted boolean")


def should_abort(done: int, errors: int) -> bool:
    """Whether a run's first ``done`` items, ``errors`` of them failed, show that going on is waste."""
    return done <= ABORT_SAMPLE and errors >= ABORT_ERRORS and errors >= done * ABORT_SHARE


def early_abort(items: DataFrame, by: str = "run_id", at: str = "finished_at", key: str = "id") -> DataFrame:
    """Runs whose first items fail so often that going on is waste: the count at which that shows."""
    order = Window.partitionBy(by).orderBy(at, key)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # The opening sample alone is dealt: ranks cut each task's rows before the shuffle.
    opening = items.where(F.col("status").isin("done", "error", "refusal", "skipped")).select(by, at, key, "status", F.row_number().over(order).alias("done")).where(F.col("done") <= ABORT_SAMPLE)
    counted = opening.select(by, "done", F.count_if(F.col("status") == "error").over(upto).alias("errors"))
    bad = (F.col("errors") >= ABORT_ERRORS) & (F.col("errors") >= F.col("done") * ABORT_SHARE)
    return counted.where(bad).groupBy(by).agg(F.min(F.struct("done", "errors")).alias("m")).select(by, F.col("m.done").alias("aborted_at"), F.col("m.errors").alias("errors"))


def cost_ema(calls: DataFrame, by: str = "run_id", at: str = "created_at", key: str = "id", cost: str = "cost_usd", alpha: float = EMA_ALPHA) -> DataFrame:
    """Exponential mean of call costs in order; the first seeds it. ``alpha`` is over 0 and at most 1.

    A run's last calls alone are dealt and folded, as many as have a weight that a double can hold
    (some 1,100 for a half); the oldest of them seeds the mean in place of all before it, whose
    weights together are zero in double precision.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be over 0 and at most 1")
    last = 1 if alpha == 1 else math.ceil(-1100 * math.log(2) / math.log1p(-alpha))
    sorted_ = F.transform(F.sort_array(F.collect_list(F.struct(at, key, F.col(cost).cast("double").alias("c")))), lambda s: s["c"])
    seed = F.lit(None).cast("double")
    return latest(calls.where(F.col(cost).isNotNull()), by, at, key, last).groupBy(by).agg(F.aggregate(sorted_, seed, lambda a, c: F.when(a.isNull(), c).otherwise(alpha * c + (1 - alpha) * a)).alias("ema"))


def resume_plan(items: DataFrame, force: bool = False) -> DataFrame:
    """``items`` with what a resume does: errors and skipped ones are pending again, partial ones only by force."""
    again = ["error", "skipped", *(["partial"] if force else [])]
    return items.withColumns({"requeued": F.col("status").isin(*again), "status": F.when(F.col("status").isin(*again), "pending").otherwise(F.col("status"))})


def crashed(items: DataFrame, calls: DataFrame) -> DataFrame:
    """After a crash: pending items with recorded calls of their run are partial."""
    touched = calls.select("run_id", "target_id").distinct().withColumn("_hit", F.lit(True))
    return items.join(touched, ["run_id", "target_id"], "left").withColumn("status", F.when((F.col("status") == "pending") & F.col("_hit"), "partial").otherwise(F.col("status"))).drop("_hit").select(*items.columns)


def finished_status(status: Column, calls: Column) -> Column:
    return F.when((status == "skipped") & (calls > 0), "partial").otherwise(status)


def rows_per_min(done: Column, started: Column, now: Column) -> Column:
    return F.round(done / F.greatest((now - started) / 60.0, F.lit(1e-9)), 2)


def latest(df: DataFrame, by: str, at: str, key: str, n: int = 1) -> DataFrame:
    """The last ``n`` rows of each key by time and id. Ranks cut each task's rows before they are dealt."""
    order = Window.partitionBy(by).orderBy(F.desc(at), F.desc(key))
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def empty_completion_note(content: Column, tool_calls: Column, finish: Column, usage: Column) -> Column:
    """Why a billed reply is unusable, or null for a reply with content or tool calls."""
    reasoning = F.get_json_object(usage, "$.completion_tokens_details.reasoning_tokens").try_cast("long")
    why = F.concat(F.lit("finish_reason="), F.coalesce(finish, F.lit("unknown")), F.when(reasoning > 0, F.concat(F.lit(", "), reasoning.cast("string"), F.lit(" reasoning tokens"))).otherwise(F.lit("")))
    blank = (F.trim(F.coalesce(content, F.lit(""))) == "") & (F.coalesce(F.size(tool_calls), F.lit(0)) <= 0)
    return F.when(blank, F.concat(F.lit("empty completion ("), why, F.lit("); billed but unusable")))


def active_runs(runs: DataFrame) -> DataFrame:
    """By project, the newest run that is queued or running: (project_id, id, stage). A project may have one at a time.

    Ties of created_at go to the greater id; the newest is a maximum, folded before the shuffle.
    """
    live = runs.where(F.col("status").isin("queued", "running"))
    newest = live.groupBy("project_id").agg(F.max(F.struct("created_at", "id", "stage")).alias("_r"))
    return newest.select("project_id", F.col("_r.id").alias("id"), F.col("_r.stage").alias("stage"))
