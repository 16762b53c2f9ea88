"""Reading exports back: lines of the five formats become rows and pairs again, and stored records canonical ones.

A line that is no record of its format is kept with the reason. What a format does not hold (a row's status, its tools in
sft) comes back as its default; what it holds comes back so that exporting again gives the same line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.messages import last, last_assistant
from weftline.operators.formats import LABELS
from weftline.schema import JUDGE, MESSAGE, MESSAGES, METADATA

OWN = f"struct<leaf_path:array<string>,difficulty:string,task_type:string,models:map<string,string>,judge:{JUDGE},flags:array<string>>"
#: Keys that a line must have, by format, and the schema of the line; tools keep their text.
NEEDED = {"sft": ("messages",), "tools": ("messages", "tools"), "alpaca": ("instruction", "input", "output"), "dpo": ("prompt", "chosen", "rejected"), "grpo": ("prompt", "answer")}
LINE = f"id string, messages {MESSAGES}, tools string, instruction string, input string, output string, prompt {MESSAGES}, chosen {MESSAGES}, rejected {MESSAGES}, answer string, reasoning string, metadata {OWN}"
ROW = ["id", "kind", "messages", "tools", "metadata", "format"]
PAIR = ["id", "prompt", "chosen", "rejected", "metadata"]


def format_of(line: Column) -> Column:
    """The format that a line's keys tell of; null for none."""
    keys = F.json_object_keys(line)
    has = lambda *names: F.forall(F.array(*map(F.lit, names)), lambda k: F.array_contains(keys, k))
    return F.when(has("prompt", "chosen", "rejected"), "dpo").when(has("prompt", "answer"), "grpo").when(has("instruction", "output"), "alpaca").when(has("messages", "tools"), "tools").when(has("messages"), "sft")


def _text(role: str, content: Column) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(role).alias("role"), content.alias("content"), none.alias("tool_calls"), none.alias("tool_call_id"), none.alias("name")).cast(MESSAGE)


def from_alpaca(instruction: Column, said: Column, output: Column) -> Column:
    """The conversation of an alpaca record: the system turn that the instruction begins with, the first user turn, the
    turns that the input labels by role, the reply."""
    led = instruction.startswith("System: ") & instruction.contains("\n\n")
    first = F.substring_index(instruction, "\n\n", 1)
    head = F.when(led, F.array(_text("system", F.substr(first, F.lit(9))), _text("user", F.substr(instruction, F.length(first) + 3)))).otherwise(F.array(_text("user", instruction)))
    names = "|".join(LABELS.values())
    turns = F.when(F.coalesce(said, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(said, rf"\n\n(?=(?:{names}): )"))
    role = F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (v, k)])
    middle = F.transform(turns, lambda t: _text("user", F.substr(t, F.instr(t, ": ") + 2)).withField("role", F.element_at(role, F.substring_index(t, ": ", 1))))
    return F.concat(head, middle, F.array(_text("assistant", output)))


def fault_of(fmt: Column, line: Column, parsed: Column) -> Column:
    """Why a line is no record of its format; null if it is one."""
    keys = F.json_object_keys(line)
    missing = F.lit(None).cast("string")
    for name, need in NEEDED.items():
        for k in need:
            missing = F.coalesce(missing, F.when((fmt == name) & ~F.coalesce(F.array_contains(keys, k), F.lit(False)), F.lit(f"no {k}")))
    labels = "|".join(LABELS.values())
    empty = F.when(fmt.isin("sft", "tools") & (F.coalesce(F.size(parsed["messages"]), F.lit(0)) <= 0), "no messages").when((fmt == "dpo") & ((F.coalesce(F.size(parsed["chosen"]), F.lit(0)) <= 0) | (F.coalesce(F.size(parsed["rejected"]), F.lit(0)) <= 0)), "a side has no reply")
    foreign = F.when((fmt == "alpaca") & (parsed["input"] != "") & ~parsed["input"].rlike(rf"^(?:{labels}): "), "the input names no role")
    return F.when(F.try_parse_json(line).isNull() | keys.isNull(), "no JSON object").when(fmt.isNull(), "no known format").otherwise(F.coalesce(missing, F.when(F.coalesce(parsed["id"], F.lit("")) == "", "no id"), empty, foreign))


def tools_text(line: Column, parsed: Column) -> Column:
    """The tools of a line as they stand in it, byte for byte, where the line is laid out as this library writes it; else as parsed."""
    mark, end = ',"tools":', ',"metadata":{"leaf_path":'
    rest = F.substr(line, F.instr(line, mark) + len(mark))
    tail = F.substring_index(rest, end, -1)
    own = F.when(rest.contains(end), F.substr(rest, F.lit(1), F.length(rest) - F.length(tail) - len(end))).otherwise(F.substr(rest, F.lit(1), F.length(rest) - 1))
    same = F.to_json(F.try_parse_json(own)) == F.to_json(F.try_parse_json(parsed))
    return F.when(line.contains(mark) & F.coalesce(same, F.lit(False)), own).otherwise(parsed)


def parsed_lines(lines: DataFrame, fmt: str | None = None, line: str = "value") -> DataFrame:
    """line, format, reason (null for a record) and _r, the record: of one format, or of whichever each line's keys tell of."""
    own = F.lit(fmt) if fmt else format_of(F.col(line))
    rows = lines.select(F.col(line).alias("line"), own.alias("format"), F.from_json(F.col(line), LINE).alias("_r"))
    return rows.withColumn("reason", fault_of(F.col("format"), F.col("line"), F.col("_r")))


def _metadata(r: Column) -> Column:
    m = r["metadata"]
    none, empty = F.lit(None), F.array().cast("array<string>")
    parts = {
        "id": r["id"], "leaf_id": F.lit(""), "leaf_path": F.coalesce(m["leaf_path"], empty), "difficulty": F.coalesce(m["difficulty"], F.lit("medium")), "task_type": F.coalesce(m["task_type"], F.lit("EXPLAIN")), "persona": none, "style": none, "adversarial": F.lit(False),
        "models": F.coalesce(m["models"], F.create_map().cast("map<string,string>")), "judge": m["judge"].cast(JUDGE), "flags": F.coalesce(m["flags"], empty), "answer": r["answer"], "strategy": none, "flaw": none,
    }
    return F.struct(*[v.alias(k) for k, v in parts.items()]).cast(METADATA)


def rows_of(parsed: DataFrame) -> DataFrame:
    """Rows (ROW) of the records of all formats but dpo."""
    r, fmt = F.col("_r"), F.col("format")
    reply = F.array(_text("assistant", F.coalesce(r["reasoning"], r["answer"])))
    messages = F.when(fmt == "alpaca", from_alpaca(r["instruction"], r["input"], r["output"])).when(fmt == "grpo", F.concat(F.coalesce(r["prompt"], F.array().cast(MESSAGES)), reply)).otherwise(r["messages"])
    kind = F.when(fmt.isin("tools", "grpo"), fmt).otherwise("sft")
    return parsed.where("reason IS NULL AND format <> 'dpo'").select(r["id"].alias("id"), kind.alias("kind"), messages.alias("messages"), F.when(fmt == "tools", tools_text(F.col("line"), r["tools"])).alias("tools"), _metadata(r).alias("metadata"), "format")


def pairs_of(parsed: DataFrame) -> DataFrame:
    """Pairs (PAIR) of the dpo records."""
    r = F.col("_r")
    return parsed.where("reason IS NULL AND format = 'dpo'").select(r["id"].alias("id"), r["prompt"].alias("prompt"), r["chosen"].alias("chosen"), r["rejected"].alias("rejected"), _metadata(r).alias("metadata"))


def rejected_of(parsed: DataFrame) -> DataFrame:
    """line, format and reason of what is no record."""
    return parsed.where("reason IS NOT NULL").select("line", "format", "reason")


def canonical_rows(rows: DataFrame) -> DataFrame:
    """Stored rows with metadata complete: its id and leaf_id are the row's where it has none of its own."""
    meta = F.col("metadata")
    meta = F.when(meta.isNull(), F.struct(*[F.lit(None).alias(f) for f in rows.schema["metadata"].dataType.names]).cast(METADATA)).otherwise(meta)
    filled = meta.withField("id", F.coalesce(meta["id"], F.col("id"))).withField("leaf_id", F.coalesce(meta["leaf_id"], F.col("leaf_id"), F.lit("")))
    return rows.withColumns({"metadata": filled, "messages": F.coalesce("messages", F.array().cast(MESSAGES))})


def canonical_pairs(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs with the rows they were made of: prompt, chosen, rejected and metadata, and reason where the chosen row has no reply.

    Rejected is the last assistant turn, else the last of any role; the pair's strategy, flaw and judge replace the row's.
    """
    own = canonical_rows(rows).select(F.col("id").alias("_row"), "messages", "metadata")
    side = F.coalesce("rejected_messages", F.array().cast(MESSAGES))
    rejected = F.when(F.size(side) == 0, side).otherwise(F.array(F.coalesce(last_assistant(side), last(side))))
    both = pairs.select(F.col("id").alias("pair_id"), "row_id", F.col("strategy").alias("_s"), F.col("flaw").alias("_f"), F.col("judge").alias("_j"), rejected.alias("rejected")).join(own, F.col("row_id") == F.col("_row"))
    n = F.size("messages")
    meta = F.col("metadata").withField("strategy", F.col("_s")).withField("flaw", F.col("_f")).withField("judge", F.coalesce("_j", F.col("metadata.judge")))
    reason = F.when((n == 0) | (last(F.col("messages"))["role"] != "assistant"), "chosen row does not end with an assistant turn")
    return both.select("pair_id", "row_id", F.slice("messages", F.lit(1), F.greatest(n - 1, F.lit(0))).alias("prompt"), F.slice("messages", F.greatest(n, F.lit(1)), F.lit(1)).alias("chosen"), "rejected", meta.alias("metadata"), reason.alias("reason"))
