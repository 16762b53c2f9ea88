"""Training formats: each is a projection of rows or pairs to one line of JSON.

Lines are compact, keys keep their order, text is UTF-8 as it is. Optional keys of a message
appear only where set; its content always does, null or not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.messages import calls, content, last, last_assistant, rstrip_assistant
from weftline.functions.text import strip

KINDS = {"sft": ("sft",), "alpaca": ("sft",), "tools": ("tools",), "grpo": ("grpo",)}
LABELS = {"user": "User", "assistant": "Assistant", "tool": "Tool", "system": "System"}


def quoted(x: Column) -> Column:
    """A string as JSON, null as null."""
    whole = F.to_json(F.struct(x.alias("x")))
    return F.when(x.isNull(), F.lit("null")).otherwise(F.substr(whole, F.lit(6), F.length(whole) - 6))


def shown(x: Column) -> Column:
    """An array, map or number as JSON; a null stays null in the text."""
    whole = F.to_json(F.struct(x.alias("x")), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def message_json(m: Column) -> Column:
    call = F.when(calls(m) > 0, F.concat(F.lit(',"tool_calls":'), F.to_json(m["tool_calls"]))).otherwise(F.lit(""))
    extra = lambda k: F.when(m[k].isNotNull(), F.concat(F.lit(f',"{k}":'), quoted(m[k]))).otherwise(F.lit(""))
    return F.concat(F.lit('{"role":'), quoted(m["role"]), F.lit(',"content":'), quoted(m["content"]), call, extra("tool_call_id"), extra("name"), F.lit("}"))


def messages_json(messages: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(messages, message_json), ","), F.lit("]"))


def metadata_json(meta: Column) -> Column:
    judge = meta["judge"]
    score = F.concat(F.lit('{"score":'), shown(judge["score"]), F.lit(',"criteria":'), F.coalesce(F.to_json(judge["criteria"]), F.lit("{}")), F.lit(',"rationale":'), quoted(judge["rationale"]), F.lit(',"verdict":'), quoted(judge["verdict"]), F.lit("}"))
    return F.concat(
        F.lit('{"leaf_path":'), F.to_json(F.coalesce(meta["leaf_path"], F.array().cast("array<string>"))),
        F.lit(',"difficulty":'), quoted(F.coalesce(meta["difficulty"], F.lit("medium"))),
        F.lit(',"task_type":'), quoted(F.coalesce(meta["task_type"], F.lit("EXPLAIN"))),
        F.lit(',"models":'), F.coalesce(F.to_json(meta["models"]), F.lit("{}")),
        F.lit(',"judge":'), F.when(judge.isNull(), F.lit("null")).otherwise(score),
        F.lit(',"flags":'), F.to_json(F.coalesce(meta["flags"], F.array().cast("array<string>"))), F.lit("}"),
    )


def _line(meta: Column, body: Column, with_metadata: bool) -> Column:
    tail = F.concat(F.lit(',"metadata":'), metadata_json(meta)) if with_metadata else F.lit("")
    return F.concat(F.lit('{"id":'), quoted(meta["id"]), F.lit(","), body, tail, F.lit("}"))


def sft(rows: DataFrame, with_metadata: bool = False) -> Column:
    return _line(F.col("metadata"), F.concat(F.lit('"messages":'), messages_json(rstrip_assistant(F.col("messages")))), with_metadata)


def tools(rows: DataFrame, with_metadata: bool = False) -> Column:
    """Messages and the tool schemas, whose JSON is passed through byte for byte."""
    body = F.concat(F.lit('"messages":'), messages_json(rstrip_assistant(F.col("messages"))), F.lit(',"tools":'), F.coalesce(F.col("tools"), F.lit("[]")))
    return _line(F.col("metadata"), body, with_metadata)


def alpaca_parts(messages: Column) -> tuple[Column, Column, Column]:
    """Instruction, input and output of a conversation: first user turn, middle turns, final reply."""
    clean = rstrip_assistant(messages)
    first = F.get(clean, F.lit(0))
    led = first["role"] == "system"
    rest = F.when(led, F.slice(clean, F.lit(2), F.greatest(F.size(clean) - 1, F.lit(0)))).otherwise(clean)
    asked = content(F.get(rest, F.lit(0)))
    instruction = F.when(led, F.concat(F.lit("System: "), content(first), F.lit("\n\n"), asked)).otherwise(asked)
    middle = F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 2, F.lit(0)))
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    said = F.array_join(F.transform(middle, lambda m: F.concat(F.element_at(label, m["role"]), F.lit(": "), content(m))), "\n\n")
    return instruction, said, content(last(clean))


def alpaca(rows: DataFrame, with_metadata: bool = False) -> Column:
    instruction, said, output = alpaca_parts(F.col("messages"))
    return _line(F.col("metadata"), F.concat(F.lit('"instruction":'), quoted(instruction), F.lit(',"input":'), quoted(said), F.lit(',"output":'), quoted(output)), with_metadata)


def dpo(pairs: DataFrame, with_metadata: bool = False) -> Column:
    """Prompt without a trailing reply; the last assistant turn of each side."""
    prompt = F.col("prompt")
    prompt = F.when(last(prompt)["role"] == "assistant", F.slice(prompt, F.lit(1), F.size(prompt) - 1)).otherwise(prompt)
    one = lambda side: message_json(last_assistant(rstrip_assistant(F.col(side))))
    body = F.concat(F.lit('"prompt":'), messages_json(prompt), F.lit(',"chosen":['), one("chosen"), F.lit('],"rejected":['), one("rejected"), F.lit("]"))
    return _line(F.col("metadata"), body, with_metadata)


def grpo_answer(text: Column) -> Column:
    """What follows the last closing think mark, or all."""
    return strip(F.substring_index(text, "</think>", -1))


def grpo(rows: DataFrame, with_metadata: bool = False, with_reasoning: bool = True) -> Column:
    clean = rstrip_assistant(F.col("messages"))
    said = content(last(clean))
    answer = F.coalesce(F.col("metadata.answer"), grpo_answer(said))
    reason = F.when(said.contains("<think>"), F.concat(F.lit(',"reasoning":'), quoted(said))).otherwise(F.lit("")) if with_reasoning else F.lit("")
    body = F.concat(F.lit('"prompt":'), messages_json(F.slice(clean, F.lit(1), F.greatest(F.size(clean) - 1, F.lit(0)))), F.lit(',"answer":'), quoted(answer), reason)
    return _line(F.col("metadata"), body, with_metadata)


FORMATS: dict[str, Callable[..., Column]] = {"sft": sft, "alpaca": alpaca, "dpo": dpo, "tools": tools, "grpo": grpo}


def formatted(items: DataFrame, name: str, with_metadata: bool = False) -> DataFrame:
    """id and the line of each row (or pair, for dpo) in a format of the registry."""
    if name not in FORMATS:
        raise ValueError(f"unknown format {name!r}; choose of {sorted(FORMATS)}")
    if name == "dpo" and "chosen" not in items.columns or name != "dpo" and "messages" not in items.columns:
        raise TypeError(f"{name} takes {'pairs' if name == 'dpo' else 'rows'}")
    return items.select(F.col("metadata.id").alias("id"), FORMATS[name](items, with_metadata).alias("line"))
