"""Recorded model outputs as tables: what a call returned is a column, the rest is a transformation.

No model is called. A reply that does not parse goes to the error column, never to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.messages import rstrip_assistant
from weftline.operators.preferences import first_acceptable
from weftline.sources.adapters import message

TREE = "struct<topics:array<struct<label:string,negative:boolean,leaves:array<struct<label:string,task_type:string,difficulty:string>>>>>"


def json_part(reply: Column) -> Column:
    """The JSON of a reply: inside a code fence, or from the first brace or bracket to the last."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    bare = F.regexp_extract(reply, r"(?s)[\[{].*[\]}]", 0)
    return F.when(fenced != "", F.trim(fenced)).otherwise(bare)


def structured(replies: DataFrame, schema: str, reply: str = "reply") -> DataFrame:
    """``replies`` with ``value`` parsed by the schema, or ``error`` where that fails."""
    value = F.from_json(json_part(F.coalesce(reply, F.lit(""))), schema)
    empty = F.coalesce(F.to_json(value), F.lit("{}")) == "{}"
    return replies.withColumn("value", value).withColumn("error", F.when(F.col("value").isNull() | empty, F.lit("reply does not parse")))


def taxonomy_nodes(replies: DataFrame, task_types: Sequence[str], tiers: bool = False) -> DataFrame:
    """Topic and leaf nodes of recorded taxonomy replies (project_id, reply), in order.

    Blank labels are skipped, negativity passes down, a task type outside the list is its first.
    """
    parsed = structured(replies, TREE).where(F.col("error").isNull())
    topic = parsed.select("project_id", F.posexplode("value.topics").alias("t", "topic")).where(T.strip("topic.label") != "")
    leaf = topic.select("project_id", "t", "topic", F.posexplode("topic.leaves").alias("l", "leaf")).where(T.strip("leaf.label") != "")
    id_of = lambda *c: F.concat_ws("-", "project_id", *c)
    negative = F.coalesce("topic.negative", F.lit(False))
    tops = topic.select(id_of("t").alias("id"), "project_id", F.lit(None).cast("string").alias("parent_id"), T.strip("topic.label").alias("label"), F.col("t").alias("order"), negative.alias("is_negative"), F.lit(False).alias("is_leaf"), F.lit(None).cast("string").alias("task_type"), F.lit(None).cast("string").alias("difficulty"))
    kind = F.when(F.upper("leaf.task_type").isin(*task_types), F.upper("leaf.task_type")).otherwise(F.lit(task_types[0]))
    ends = leaf.select(id_of("t", "l").alias("id"), "project_id", id_of("t").alias("parent_id"), T.strip("leaf.label").alias("label"), F.col("l").alias("order"), negative.alias("is_negative"), F.lit(True).alias("is_leaf"), kind.alias("task_type"), F.col("leaf.difficulty").alias("difficulty") if tiers else F.lit("medium").alias("difficulty"))
    return tops.unionByName(ends).withColumn("slug", T.slugify("label"))


def prompt_items(replies: DataFrame) -> DataFrame:
    """Prompts of recorded batches (leaf_id, reply): items are strings or objects with a text."""
    body = json_part(F.coalesce("reply", F.lit("")))
    items = F.from_json(F.when(body.startswith("["), body).otherwise(F.get_json_object(body, "$.prompts")), "array<string>")
    out = replies.select("leaf_id", F.posexplode(items).alias("k", "item"))
    said = F.when(F.col("item").startswith("{"), F.coalesce(F.get_json_object("item", "$.text"), F.get_json_object("item", "$.prompt"))).otherwise(F.col("item"))
    return out.select("leaf_id", "k", T.strip(said).alias("text")).where("text <> ''")


def response_rows(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of recorded answers (prompt_id, leaf_id, negative, system, prompt, first, reply), and the rejects.

    An empty reply is an error and no row. If the first or the final answer refuses and the leaf is
    not a negative one, the row is a refusal.
    """
    empty = T.strip("reply") == ""
    refused = (T.is_refusal("prompt", F.coalesce("first", "reply")) | T.is_refusal("prompt", "reply")) & ~F.coalesce("negative", F.lit(False))
    turns = F.filter(F.array(F.when(F.coalesce("system", F.lit("")) != "", message(F.lit("system"), F.col("system"))), message(F.lit("user"), F.col("prompt")), message(F.lit("assistant"), F.col("reply"))), lambda m: m.isNotNull())
    rows = replies.where(~empty).select("prompt_id", "leaf_id", rstrip_assistant(turns).alias("messages"), F.when(refused, "refusal").otherwise("draft").alias("status"), F.when(refused, F.array(F.lit("refusal"))).otherwise(F.array().cast("array<string>")).alias("flags"), T.answer_line("reply").alias("answer"))
    return rows, replies.where(empty).select("prompt_id", F.lit("empty reply").alias("error"))


def preference_pairs(attempts: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from the first usable recorded attempt of each row, and rows whose attempts are all unusable."""
    pairs = first_acceptable(attempts)
    return pairs, rows.join(pairs.select(F.col("row_id").alias("id")), "id", "left_anti").select("id", F.lit("no attempt differs enough").alias("error"))


def catalogue(models: DataFrame) -> DataFrame:
    """Model list: prices a million tokens and what each model accepts; an unknown list accepts all."""
    price = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) * 1e6
    has = lambda p: (F.coalesce(F.size("supported_parameters"), F.lit(0)) <= 0) | F.array_contains("supported_parameters", p)
    return models.select("id", "name", price("pricing.prompt").alias("price_in"), price("pricing.completion").alias("price_out"), has("tools").alias("tools"), has("structured_outputs").alias("structured"), has("temperature").alias("temperature"))


def search_models(models: DataFrame, q: str) -> DataFrame:
    """Models whose id or name holds ``q`` in any case, by id."""
    return models.where(F.lower("id").contains(q.lower()) | F.lower("name").contains(q.lower())).orderBy("id")


def calls_per_item(turns_min: int, turns_max: int, tools: bool) -> int:
    """Calls that one item takes: 1, of several turns twice their mean less 1, 2 more with tools."""
    mean = (turns_min + turns_max) // 2
    return (1 if mean <= 1 else 2 * mean - 1) + (2 if tools else 0)


def tool_result(content: Column) -> Column:
    """A tool's result as JSON; what is no JSON is wrapped."""
    fine = F.try_parse_json(content).isNotNull()
    return F.when(fine, content).otherwise(F.to_json(F.struct(content.alias("result"))))


def trajectories(turns: DataFrame, most_hops: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations from recorded turns (prompt_id, turn, message), and those that end badly.

    Turns are put in order. One that calls tools more than ``most_hops`` times, or whose last turn
    is not an assistant's reply with content, is an error.
    """
    held = F.transform(F.sort_array(F.collect_list(F.struct("turn", "message"))), lambda t: t["message"])
    whole = turns.groupBy("prompt_id").agg(held.alias("messages"))
    hops = F.size(F.filter("messages", lambda m: F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0))
    end = F.get("messages", F.size("messages") - 1)
    fine = (end["role"] == "assistant") & (T.strip(end["content"]) != "") & (F.coalesce(F.size(end["tool_calls"]), F.lit(0)) <= 0)
    error = F.when(hops > most_hops, F.lit("too many tool calls")).when(~F.coalesce(fine, F.lit(False)), F.lit("no final reply"))
    judged = whole.withColumn("error", error)
    return judged.where("error is null").select("prompt_id", rstrip_assistant(F.col("messages")).alias("messages")), judged.where("error is not null").select("prompt_id", "error")
