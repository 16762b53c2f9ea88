"""What a stage has to do and what it will cost: work items by anti joins, and an estimate folded over them.

Every planner gives (items, estimate). Items have target_id and what the stage needs to know of each; the estimate is one
row: calls, est_tokens_in, est_tokens_out, est_usd, over_cap. Nothing is collected; the estimate of an empty plan is zeros.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import schema
from weftline.functions.messages import assistant_text
from weftline.operators import ledger, rows as R
from weftline.operators.dedup import numbered
from weftline.operators.replay import calls_per_item

# Characters that a stage's instructions add to a call, tokens of a reply, texts of an embedding call.
TREE_CHARS, TREE_TOKENS = 900, 1200
PROMPT_CHARS, PROMPT_CHARS_EACH, PROMPT_TOKENS_EACH = 1200, 160, 120
TURNS_CHARS, TOOLS_CHARS = 600, 400
PAIR_CHARS, JUDGE_CHARS, JUDGE_TOKENS, REJECTED_CHARS = 500, 900, 400, 800
EMBED_BATCH = 64


@dataclass(frozen=True)
class Budget:
    """A project as planners see it: its brief, what it has spent, its cap."""

    brief: str = ""
    spend_usd: float = 0.0
    cap_usd: float = 0.0


def _whole(x: Column) -> Column:
    return F.floor(x).cast("long")


def estimated(sums: DataFrame, slug: str, budget: Budget, catalogue: DataFrame | None = None) -> DataFrame:
    """The estimate of one row of calls, prompt_chars and max_tokens (each call's)."""
    row = ledger.with_prices(sums.withColumn("model_slug", F.lit(slug)), catalogue)
    row = ledger.estimates(row.select(F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("prompt_chars", F.lit(0)).alias("prompt_chars"), F.coalesce("max_tokens", F.lit(0)).alias("max_tokens"), "price_in", "price_out"))
    over = F.lit(budget.spend_usd) + F.col("est_usd") > F.lit(budget.cap_usd)
    return row.select(F.col("calls").cast("long").alias("calls"), "est_tokens_in", "est_tokens_out", "est_usd", ((F.col("calls") > 0) & over).alias("over_cap"))


def tree_calls(depth: int, topics: int, subtopics: int) -> int:
    """Calls that a tree takes: its topics, then the leaves of each, at depth three the subtopics of each between."""
    return 1 + topics if depth <= 2 else 1 + topics + topics * subtopics


def tree_plan(projects: DataFrame, depth: int, topics: int, subtopics: int, slug: str, max_tokens: int, budget: Budget, catalogue: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One item a project (id): its levels depend on one another."""
    items = projects.select(F.col("id").alias("target_id"), F.lit(depth).alias("depth"))
    sums = items.agg((F.count(F.lit(1)) * tree_calls(depth, topics, subtopics)).alias("calls"), F.lit(len(budget.brief) + TREE_CHARS).alias("prompt_chars"), F.lit(min(max_tokens, TREE_TOKENS)).alias("max_tokens"))
    return items, estimated(sums, slug, budget, catalogue)


def prompt_plan(nodes: DataFrame, prompts: DataFrame, slug: str, max_tokens: int, budget: Budget, default_rows: int = 1, force: bool = False, catalogue: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One item a leaf that wants more active prompts (all of them with ``force``): how many."""
    have = prompts.where("status = 'active'").groupBy(F.col("leaf_id").alias("_leaf")).agg(F.count(F.lit(1)).alias("have"))
    wanted = F.coalesce(F.nullif("rows_per_leaf", F.lit(0)), F.lit(default_rows))
    n = wanted if force else F.greatest(F.lit(0), wanted - F.coalesce("have", F.lit(0)))
    items = nodes.where("is_leaf").join(have, F.col("id") == F.col("_leaf"), "left").select(F.col("id").alias("target_id"), n.cast("int").alias("n")).where("n > 0")
    count = F.count(F.lit(1))
    sums = items.agg(count.alias("calls"), _whole(F.sum(F.lit(len(budget.brief) + PROMPT_CHARS) + F.col("n") * PROMPT_CHARS_EACH) / count).alias("prompt_chars"), _whole(F.sum(F.least(F.lit(max_tokens), F.col("n") * PROMPT_TOKENS_EACH)) / count).alias("max_tokens"))
    return items, estimated(sums, slug, budget, catalogue)


def response_plan(prompts: DataFrame, rows: DataFrame, slug: str, max_tokens: int, budget: Budget, system_prompt: str = "", turns: tuple[int, int] | None = None, tools: bool = False, regenerate: bool = False, catalogue: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One item an active prompt that no row answers (every active one with ``regenerate``), numbered by age and id."""
    open_ = prompts.where("status = 'active'") if regenerate else R.prompts_pending(prompts, rows)
    items = numbered(open_.select(F.col("id").alias("target_id"), "created_at", F.length("text").alias("_chars")), ["created_at", "target_id"])
    each = calls_per_item(*(turns or (1, 1)), tools)
    count, more = F.count(F.lit(1)), len(system_prompt) + (TURNS_CHARS if turns else 0) + (TOOLS_CHARS if tools else 0)
    sums = items.agg((count * each).alias("calls"), _whole(F.avg("_chars") + more).alias("prompt_chars"), F.lit(max_tokens).alias("max_tokens"))
    return items.select("target_id", F.col("n").alias("index")), estimated(sums, slug, budget, catalogue)


def _content_chars(messages: Column) -> Column:
    return F.aggregate(F.coalesce(messages, F.array().cast(schema.MESSAGES)), F.lit(0).cast("long"), lambda a, m: a + F.length(F.coalesce(m["content"], F.lit(""))))


def pair_plan(rows: DataFrame, pairs: DataFrame, slug: str, max_tokens: int, budget: Budget, catalogue: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One item a row that may have a pair and has none."""
    items = R.rows_without_pair(rows, pairs).select(F.col("id").alias("target_id"), (F.length(assistant_text(F.col("messages"))) + _content_chars(F.col("messages"))).alias("_chars"))
    sums = items.agg(F.count(F.lit(1)).alias("calls"), _whole(F.avg("_chars") + PAIR_CHARS).alias("prompt_chars"), F.lit(max_tokens).alias("max_tokens"))
    return items.select("target_id"), estimated(sums, slug, budget, catalogue)


def judge_plan(rows: DataFrame, pairs: DataFrame, slug: str, max_tokens: int, budget: Budget, only: str | None = None, catalogue: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One item a row or pair without a judgement; ``only`` rows or pairs."""
    own = rows.where(F.col("status").isin(*schema.CANDIDATE) & F.col("metadata.judge").isNull()).select(F.lit("row").alias("type"), F.col("id").alias("target_id"), _content_chars(F.col("messages")).alias("_chars"))
    two = pairs.where(F.col("judge").isNull()).select(F.lit("pair"), "id", _content_chars(F.col("rejected_messages")) * 2 + REJECTED_CHARS)
    items = own if only == "rows" else two.toDF("type", "target_id", "_chars") if only == "pairs" else own.union(two)
    sums = items.agg(F.count(F.lit(1)).alias("calls"), _whole(F.avg("_chars") + JUDGE_CHARS + len(budget.brief)).alias("prompt_chars"), F.lit(min(max_tokens, JUDGE_TOKENS)).alias("max_tokens"))
    return items.select("type", "target_id"), estimated(sums, slug, budget, catalogue)


def embedding_plan(rows: DataFrame, vectors: DataFrame, slug: str, budget: Budget, again: bool = False, catalogue: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Batches of candidate rows without a vector (``again``: all): target_id emb-0, emb-1, ... with row_ids by age and id."""
    open_ = rows.where(F.col("status").isin(*schema.CANDIDATE))
    open_ = open_ if again else open_.join(vectors.select(F.col("id").alias("_have")), F.col("id") == F.col("_have"), "left_anti")
    placed = numbered(open_.select("id", "created_at", F.length(assistant_text(F.col("messages"))).alias("_chars")), ["created_at", "id"])
    batch = F.floor(F.col("n") / EMBED_BATCH)
    items = placed.groupBy(batch.alias("_b")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("row_ids"), F.sum("_chars").alias("_chars"))
    sums = items.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("_chars"), F.lit(0)).alias("_chars"))
    priced = ledger.with_prices(sums.withColumn("model_slug", F.lit(slug)), catalogue)
    tokens = _whole(F.col("_chars") / 4)
    usd = F.round(tokens / 1e6 * F.col("price_in"), 6)
    over = (F.col("calls") > 0) & (F.lit(budget.spend_usd) + usd > F.lit(budget.cap_usd))
    return items.select(F.concat(F.lit("emb-"), "_b").alias("target_id"), "row_ids"), priced.select("calls", tokens.alias("est_tokens_in"), F.lit(0).cast("long").alias("est_tokens_out"), usd.alias("est_usd"), over.alias("over_cap"))
