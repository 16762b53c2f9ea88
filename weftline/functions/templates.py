"""Chat templates as column expressions: the rendered text, and why a conversation cannot be rendered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.messages import calls, content, fold_system
from weftline.functions.text import strip

CHATML_SYSTEM = "You are a helpful assistant."
CHATML_TOOLS = "\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\n<tools>"


def _role(messages: Column, i: Column | int) -> Column:
    return F.get(messages, F.lit(i) if isinstance(i, int) else i)["role"]


def _joined(messages: Column, turn) -> Column:  # noqa: ANN001
    return F.array_join(F.transform(messages, turn), "")


def chatml(messages: Column, tools: Column | None = None) -> Column:
    """Turns between im_start and im_end; a system turn always leads; tool results are a user turn."""

    def turn(m: Column, i: Column) -> Column:
        call = F.array_join(F.transform(m["tool_calls"], lambda c: F.concat(F.lit('\n<tool_call>\n{"name": "'), c["function"]["name"], F.lit('", "arguments": '), c["function"]["arguments"], F.lit("}\n</tool_call>"))), "")
        plain = F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), content(m), F.lit("<|im_end|>\n"))
        calling = F.concat(F.lit("<|im_start|>assistant"), F.when(content(m) != "", F.concat(F.lit("\n"), content(m))).otherwise(F.lit("")), call, F.lit("<|im_end|>\n"))
        opens, closes = F.coalesce(_role(messages, i - 1) != "tool", F.lit(True)), F.coalesce(_role(messages, i + 1) != "tool", F.lit(True))
        result = F.concat(F.when(opens, F.lit("<|im_start|>user")).otherwise(F.lit("")), F.lit("\n<tool_response>\n"), F.coalesce(m["content"], F.lit("None")), F.lit("\n</tool_response>"), F.when(closes, F.lit("<|im_end|>\n")).otherwise(F.lit("")))
        return F.when(m["role"] == "system", F.lit("")).when(m["role"] == "tool", result).when(calls(m) > 0, calling).otherwise(plain)

    first = F.when(_role(messages, 0) == "system", content(F.get(messages, F.lit(0)))).otherwise(F.lit(CHATML_SYSTEM))
    offered = F.lit("") if tools is None else F.when(F.size(tools) > 0, F.concat(F.lit(CHATML_TOOLS), _joined(tools, lambda t: F.concat(F.lit("\n"), t)), F.lit("\n</tools>"))).otherwise(F.lit(""))
    return F.concat(F.lit("<|im_start|>system\n"), first, offered, F.lit("<|im_end|>\n"), _joined(messages, turn))


def llama(messages: Column, tools: bool = False) -> Column:
    """Turns under header marks; one system header always leads; tool results come from ipython."""

    def turn(m: Column) -> Column:
        head = lambda r: F.concat(F.lit("<|start_header_id|>"), r, F.lit("<|end_header_id|>\n\n"))
        call = F.get(m["tool_calls"], F.lit(0))["function"]
        calling = F.concat(head(F.lit("assistant")), F.lit('{"name": "'), call["name"], F.lit('", "parameters": '), call["arguments"], F.lit("}<|eot_id|>"))
        result = F.concat(head(F.lit("ipython")), F.coalesce(m["content"], F.lit("None")), F.lit("<|eot_id|>"))
        return F.when(m["role"] == "system", F.lit("")).when(calls(m) > 0, calling).when(m["role"] == "tool", result).otherwise(F.concat(head(m["role"]), strip(content(m)), F.lit("<|eot_id|>")))

    system = F.when(_role(messages, 0) == "system", strip(content(F.get(messages, F.lit(0))))).otherwise(F.lit(""))
    return F.concat(F.lit("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n" + ("Environment: ipython\n" if tools else "")), system, F.lit("<|eot_id|>"), _joined(messages, turn))


def gemma(messages: Column) -> Column:
    """User and model turns; a leading system turn is folded into the first user turn."""
    name = lambda m: F.when(m["role"] == "assistant", F.lit("model")).otherwise(m["role"])
    return F.concat(F.lit("<bos>"), _joined(fold_system(messages), lambda m: F.concat(F.lit("<start_of_turn>"), name(m), F.lit("\n"), strip(content(m)), F.lit("<end_of_turn>\n"))))


def template_issue(messages: Column, template: str) -> Column:
    """Why a template cannot render a conversation (its first reason), or null."""
    late = F.exists(F.transform(messages, lambda m, i: (m["role"] == "system") & (i > 0)), lambda x: x)
    known = lambda m, *roles: m["role"].isin(*roles)
    strange = F.get(F.filter(messages, lambda m: ~known(m, "system", "user", "assistant", "tool")), F.lit(0))["role"]
    unknown = F.when(strange.isNotNull(), F.concat(F.lit("Unknown role: "), strange))
    first = F.when(late, F.lit("System message must be the first message"))
    if template == "chatml":
        return F.coalesce(first, unknown)
    if template == "llama-3.1":
        return F.coalesce(
            first,
            F.when(F.exists(messages, lambda m: known(m, "user", "assistant") & (calls(m) == 0) & m["content"].isNull()), F.lit("Message content must not be null unless tool_calls are present")),
            F.when(F.exists(messages, lambda m: (calls(m) > 0) & (m["role"] != "assistant")), F.lit("Only assistant messages may carry tool_calls")),
            F.when(F.exists(messages, lambda m: calls(m) > 1), F.lit("This model only supports single tool-calls at once!")),
            unknown,
        )
    if template == "gemma":
        folded = fold_system(messages)
        wrong = F.exists(F.transform(folded, lambda m, i: (m["role"] == "user") != (i % 2 == 0)), lambda x: x)
        return F.coalesce(
            F.when(_role(folded, 0) == "system", F.lit("System role not supported")),
            F.when(wrong, F.lit("Conversation roles must alternate user/assistant/user/assistant/...")),
            F.when(F.exists(folded, lambda m: ~known(m, "user", "assistant")), F.lit("Gemma supports only user/assistant roles")),
            F.when(F.exists(folded, lambda m: calls(m) > 0), F.lit("Gemma has no tool-calling format")),
            F.when(F.exists(folded, lambda m: m["content"].isNull()), F.lit("Message content must not be null")),
        )
    raise ValueError(f"unknown chat template {template!r}")


RENDER = {"chatml": chatml, "llama-3.1": llama, "gemma": gemma}
