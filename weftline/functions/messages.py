"""Column expressions on conversations: an array of messages (schema.MESSAGES)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import rstrip, strip

TAKES = Callable[[Column], Column]


def content(m: Column) -> Column:
    return F.coalesce(m["content"], F.lit(""))


def _said(messages: Column, role: str) -> Column:
    return F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == role), content), "\n")


def user_text(messages: Column) -> Column:
    return F.coalesce(_said(messages, "user"), F.lit(""))


def assistant_text(messages: Column) -> Column:
    return F.coalesce(_said(messages, "assistant"), F.lit(""))


def first_user_text(messages: Column) -> Column:
    return F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["content"], F.lit(""))


def conversation_text(messages: Column) -> Column:
    """User turns, then assistant turns; system and tool turns take no part."""
    return F.concat(user_text(messages), F.lit("\n"), assistant_text(messages))


def last(messages: Column) -> Column:
    return F.get(messages, F.size(messages) - 1)


def last_assistant(messages: Column) -> Column:
    """The last assistant message anywhere, or null."""
    return last(F.filter(messages, lambda m: m["role"] == "assistant"))


def calls(m: Column) -> Column:
    return F.coalesce(F.size(m["tool_calls"]), F.lit(0))


def has_content(m: Column) -> Column:
    return (strip(content(m)) != "") | (calls(m) > 0)


def rstrip_assistant(messages: Column) -> Column:
    """Assistant contents without trailing white space."""
    return F.transform(messages, lambda m: F.when((m["role"] == "assistant") & m["content"].isNotNull(), m.withField("content", rstrip(m["content"]))).otherwise(m))


def fold_system(messages: Column) -> Column:
    """A leading system turn joined to the user turn after it by a blank line."""
    first, second = F.get(messages, F.lit(0)), F.get(messages, F.lit(1))
    folded = second.withField("content", F.concat(content(first), F.lit("\n\n"), content(second)))
    rest = F.slice(messages, F.lit(3), F.greatest(F.size(messages) - 2, F.lit(0)))
    return F.when((first["role"] == "system") & (second["role"] == "user"), F.concat(F.array(folded), rest)).otherwise(messages)


def _listed(ids: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(ids, lambda i: F.concat(F.lit("'"), i, F.lit("'"))), ", "), F.lit("]"))


def _without_first(ids: Column, one: Column) -> Column:
    at = F.array_position(ids, one).cast("int")
    return F.concat(F.slice(ids, F.lit(1), at - 1), F.slice(ids, at + 1, F.size(ids) - at))


def _when(*pairs: tuple[Column, Column]) -> Column:
    """The texts whose conditions hold, in order."""
    return F.filter(F.array(*[F.when(c, t) for c, t in pairs]), lambda x: x.isNotNull())


NO_TEXT = "array<string>"


def validate_row(messages: Column) -> Column:
    """Structural issues of a conversation, none for a valid one.

    One fold over the turns with the state (expected role, open tool calls, turn number, issues):
    an optional system turn first, then user and assistant in turn, tool results only for open
    calls and all of them, contents that are not empty or trailed by white space, and an
    assistant's plain reply last. After a wrong role the fold goes on from what it saw.
    """
    empty = F.array().cast(NO_TEXT)
    starts = F.get(messages, F.lit(0))["role"] == "system"
    head = F.when(starts & ~has_content(F.get(messages, F.lit(0))), F.array(F.lit("turn 0: empty system content"))).otherwise(empty)
    state = F.struct(F.lit("user").alias("expect"), empty.alias("open"), F.lit(0).alias("i"), head.alias("issues"))

    def step(s: Column, m: Column) -> Column:
        tag = lambda *t: F.concat(F.lit("turn "), s["i"].cast("string"), F.lit(": "), *[F.lit(x) if isinstance(x, str) else x for x in t])
        role, tool = m["role"], m["role"] == "tool"
        common = _when(
            ((calls(m) > 0) & (role != "assistant"), tag("tool_calls only allowed on assistant turns")),
            (m["tool_call_id"].isNotNull() & ~tool, tag("tool_call_id only allowed on tool turns")),
            (~has_content(m), tag("empty content (and no tool_calls)")),
        )
        named = F.coalesce(m["tool_call_id"], F.lit("")) != ""
        known = named & F.array_contains(s["open"], F.coalesce(m["tool_call_id"], F.lit("")))
        expected = s["expect"] == "tool"
        tool_issue = _when(
            (tool & ~expected, tag("tool turn must directly follow an assistant turn with tool_calls")),
            (tool & expected & ~named, tag("tool turn is missing tool_call_id")),
            (tool & expected & named & ~known, tag("tool_call_id '", F.coalesce(m["tool_call_id"], F.lit("")), "' does not match a pending tool call")),
        )
        left = F.when(known, _without_first(s["open"], m["tool_call_id"])).otherwise(s["open"])
        after_tool = F.struct(F.when(expected & (F.size(left) == 0), F.lit("assistant")).otherwise(s["expect"]).alias("expect"), F.when(expected, left).otherwise(s["open"]).alias("open"), (s["i"] + 1).alias("i"), F.concat(s["issues"], common, tool_issue).alias("issues"))
        wanted = F.when(expected, F.lit("assistant")).otherwise(s["expect"])
        said = _when(
            (expected & (role == "assistant") & (F.size(s["open"]) > 0), tag("tool call(s) ", _listed(s["open"]), " have no tool result")),
            (role != wanted, tag("roles must alternate — expected ", wanted, ", got ", role)),
            ((role == "assistant") & (content(m) != rstrip(content(m))), tag("trailing whitespace in assistant content")),
        )
        speaks = role == "assistant"
        open_now = F.when(speaks & (calls(m) > 0), F.transform(m["tool_calls"], lambda c: c["id"])).when(expected, empty).otherwise(s["open"])
        nxt = F.when(speaks & (calls(m) > 0), F.lit("tool")).when(speaks, F.lit("user")).otherwise(F.lit("assistant"))
        after_turn = F.struct(nxt.alias("expect"), open_now.alias("open"), (s["i"] + 1).alias("i"), F.concat(s["issues"], common, said).alias("issues"))
        skip = F.struct(s["expect"].alias("expect"), s["open"].alias("open"), (s["i"] + 1).alias("i"), F.when(s["i"] > 0, F.concat(s["issues"], F.array(tag("system turn must be the single first message")))).otherwise(s["issues"]).alias("issues"))
        return F.when(role == "system", skip).when(tool, after_tool).otherwise(after_turn)

    end = last(messages)
    tail = _when(
        (end["role"] != "assistant", F.concat(F.lit("final turn must be assistant, got "), end["role"])),
        ((end["role"] == "assistant") & (calls(end) > 0), F.lit("final turn must be an assistant reply with content, not unanswered tool_calls")),
    )
    return F.when(F.coalesce(F.size(messages), F.lit(0)) <= 0, F.array(F.lit("no messages"))).otherwise(F.concat(F.aggregate(messages, state, step, lambda s: s["issues"]), tail))


def validate_pair(prompt: Column, chosen: Column, rejected: Column) -> Column:
    """Issues of a preference pair: its prompt, each side, both alike, and prompt with chosen as a conversation."""
    asks = last(prompt)["role"]
    parts = [F.when(F.size(prompt) <= 0, F.array(F.lit("prompt is empty"))).when(asks != "user", F.array(F.concat(F.lit("prompt must end with a user turn, got "), asks))).otherwise(F.array().cast(NO_TEXT))]
    for name, side in (("chosen", chosen), ("rejected", rejected)):
        m = F.get(side, F.lit(0))
        parts.append(
            F.when(F.size(side) != 1, F.array(F.concat(F.lit(f"{name} must be exactly one assistant message, got "), F.size(side).cast("string")))).otherwise(
                _when(
                    (m["role"] != "assistant", F.concat(F.lit(f"{name} must be an assistant message, got "), m["role"])),
                    (calls(m) > 0, F.lit(f"{name} must be a plain assistant reply, not tool_calls")),
                    (~has_content(m), F.lit(f"{name}: empty content")),
                    (content(m) != rstrip(content(m)), F.lit(f"{name}: trailing whitespace in assistant content")),
                )
            )
        )
    single = (F.size(chosen) == 1) & (F.size(rejected) == 1)
    parts.append(_when((single & (F.to_json(F.get(chosen, F.lit(0))) == F.to_json(F.get(rejected, F.lit(0)))), F.lit("chosen and rejected are identical"))))
    whole = F.filter(validate_row(F.concat(prompt, chosen)), lambda i: ~i.contains("final turn"))
    parts.append(F.when((F.size(prompt) > 0) & (F.size(chosen) == 1), F.transform(whole, lambda i: F.concat(F.lit("prompt+chosen: "), i))).otherwise(F.array().cast(NO_TEXT)))
    return F.concat(*parts)


def validate_messages(messages: Column) -> Column:
    """The looser check at edit time: roles and order only, no ids and no white space."""
    empty = F.array().cast(NO_TEXT)
    state = F.struct(F.lit("user").alias("expect"), F.lit(False).alias("called"), F.lit(0).alias("i"), empty.alias("issues"))

    def step(s: Column, m: Column) -> Column:
        role = m["role"]
        tag = lambda *t: F.concat(F.lit("message "), s["i"].cast("string"), F.lit(": "), *[F.lit(x) if isinstance(x, str) else x for x in t])
        skipped, plain = role.isin("system", "tool"), role.isin("user", "assistant")
        speaks, calling = role == "assistant", calls(m) > 0
        found = _when(
            ((role == "system") & (s["i"] > 0), tag("system only allowed as the first message")),
            ((role == "tool") & ~s["called"], tag("tool turn must follow an assistant turn with tool_calls")),
            (~skipped & (role != s["expect"]), tag("expected ", s["expect"], ", got ", role)),
            (speaks & ~calling & (strip(content(m)) == ""), tag("empty assistant content")),
            (~skipped & ~plain, tag("unknown role '", role, "'")),
        )
        expect = F.when(speaks & ~calling, F.lit("user")).when(plain, F.lit("assistant")).otherwise(s["expect"])
        called = F.when(speaks, calling).when(role == "user", F.lit(False)).otherwise(s["called"])
        return F.struct(expect.alias("expect"), called.alias("called"), (s["i"] + 1).alias("i"), F.concat(s["issues"], found).alias("issues"))

    end = last(messages)
    tail = _when((end["role"] != "assistant", F.lit("last message must be assistant")), ((end["role"] == "assistant") & (calls(end) > 0), F.lit("last assistant message must not carry tool_calls")))
    return F.when(F.coalesce(F.size(messages), F.lit(0)) <= 0, F.array(F.lit("messages is empty"))).otherwise(F.concat(F.aggregate(messages, state, step, lambda s: s["issues"]), tail))


def _named_calls(m: Column, word: str) -> Column:
    names = F.array_join(F.transform(m["tool_calls"], lambda c: c["function"]["name"]), ", ")
    return F.when(calls(m) > 0, F.concat(content(m), F.lit(f" [{word}: "), names, F.lit("]"))).otherwise(content(m))


def turns_without_system(messages: Column) -> Column:
    """Role and content of all turns but system ones, the names of called tools added."""
    kept = F.filter(messages, lambda m: m["role"] != "system")
    return F.transform(kept, lambda m: F.struct(m["role"].alias("role"), _named_calls(m, "calls").alias("content")))


def transcript(messages: Column, full: bool = False) -> Column:
    """Bold role names and contents, joined by blank lines; with ``full``, system turns and tool names too."""
    kept = messages if full else F.filter(messages, lambda m: m["role"] != "system")
    said = (lambda m: _named_calls(m, "tool calls")) if full else content
    return F.array_join(F.transform(kept, lambda m: F.concat(F.lit("**"), m["role"], F.lit(":** "), said(m))), "\n\n")
