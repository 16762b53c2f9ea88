"""Error text out of nested JSON, findings and redaction at any depth, and exports read back."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import formats, nested as N, records

LONG = "m" * 900
BODIES = [
    ('{"error": {"message": "Provider returned error", "metadata": {"provider_name": "Acme", "raw": "{\\"error\\": {\\"message\\": \\"quota\\"}}"}}}', "Provider returned error (Acme): quota"),
    ('{"error": {"message": "bad", "metadata": {"raw": "  plain text "}}}', "bad (provider): plain text"),
    ('{"error": {"message": "bad", "metadata": {"provider_name": "Acme", "raw": {"error": {"message": "inner"}}}}}', "bad (Acme): inner"),
    ('{"error": {"message": "bad", "metadata": {"raw": {"x": 1}}}}', 'bad (provider): {"x":1}'),
    ('{"error": {"message": "bad", "metadata": {"provider_name": "Acme"}}}', "bad (Acme)"),
    ('{"error": {"message": "bad", "metadata": {"provider_name": "Acme", "raw": "[1, 2]"}}}', "bad (Acme): [1, 2]"),
    ('{"error": {"message": "bad", "metadata": "odd"}}', "bad"),
    ('{"error": {"code": 400}}', '{"code":400}'),
    ('{"error": "text", "message": "outer"}', "outer"),
    ('{"message": "only"}', "only"),
    ('{"error": "text"}', "fallback"),
    ("no json", "fallback"),
    ("[]", "fallback"),
    (None, "fallback"),
    (json.dumps({"error": {"message": LONG}}), LONG[:800]),
]


def test_error_text(spark):
    df = spark.createDataFrame([(k, b) for k, (b, _) in enumerate(BODIES)], "k int, body string")
    got = {r["k"]: r["e"] for r in df.select("k", N.error_text("body", F.lit("fallback")).alias("e")).collect()}
    assert [got[k] for k in range(len(BODIES))] == [w for _, w in BODIES]


def test_deepest_error(spark):
    body = json.dumps({"error": {"message": "root cause"}})
    for k in range(6):
        body = json.dumps({"error": {"message": f"layer {k}", "metadata": {"raw": body if k % 2 else json.loads(body)}}})
    df = spark.createDataFrame([(1, body), (2, '{"message": "flat"}'), (3, None), (4, "text"), (5, '{"error": {"message": "outer", "metadata": {"raw": "inner text"}}}')], "k int, body string")
    assert {r["k"]: r["root_cause"] for r in N.deepest_error(df, "body").collect()} == {1: "root cause", 2: "flat", 3: None, 4: None, 5: "inner text"}


def walk(value, path="", name=None):
    kind = {dict: "OBJECT", list: "ARRAY"}.get(type(value))
    if path or not kind:
        yield path, name, kind
    if kind:
        for k, v in value.items() if kind == "OBJECT" else enumerate(value):
            yield from walk(v, f"{path}.{k}" if path else str(k), k if kind == "OBJECT" else name)


DOCS = [{"a": {"b": [1, {"c": None, "d": [[True]]}]}, "e": "x"}, [], {}, [[[[["deep"]]]]], "s", {"api_Key": {"Token": "sk-" + "a" * 20}, "list": ["hf_" + "b" * 16, "fine"]}]


def test_walk_of_any_depth(spark):
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(DOCS)] + [(90, None), (91, "{")], "k int, body string")
    got = sorted(((r["k"], r["path"], r["name"], r["kind"] if r["kind"] in ("OBJECT", "ARRAY") else None) for r in N.walked(df, "k", "body").collect()), key=repr)
    assert got == sorted(((k, *w) for k, d in enumerate(DOCS) for w in walk(d)), key=repr)


def test_findings(spark):
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(DOCS)], "k int, body string")
    got = {(r["k"], r["path"], r["reason"]) for r in N.secret_findings(df, "k", "body").collect()}
    assert got == {(5, "api_Key", "key"), (5, "api_Key.Token", "key"), (5, "api_Key.Token", "value"), (5, "list.0", "value")}


def redact(value):
    import re

    if isinstance(value, str):
        return re.sub(N.CREDENTIAL, "[redacted]", value)
    if isinstance(value, dict):
        return {k: redact(v) for k, v in value.items()}
    return [redact(v) for v in value] if isinstance(value, list) else value


def test_redaction_leaves_keys_and_bytes(spark):
    key = "sk-or-abcdefgh12"
    docs = [*DOCS, {key: key, "z": 1, "a": [key + " and " + key, {'q"uote': f'say \\"{key}\\" : '}]}, f"{key}: not a key", {"k": f'x": {key}'}]
    texts = [json.dumps(d) for d in docs] + ['{ "b" : "' + key + '" , "a":1.50 }']
    df = spark.createDataFrame(list(enumerate([*texts, f"plain {key}", None])), "k int, body string")
    got = {r["k"]: r["t"] for r in df.select("k", N.redacted_json("body").alias("t")).collect()}
    for k, d in enumerate(docs):
        assert json.loads(got[k]) == redact(d)
    assert got[len(docs)] == '{ "b" : "[redacted]" , "a":1.50 }' and got[len(texts)] == "plain [redacted]" and got[len(texts) + 1] is None


# --- exports read back --------------------------------------------------------------------------

MESSAGES = {
    "full": [("system", "be\n\nkind"), ("user", "hi\n\nUser: not a turn? it reads as one"), ("assistant", "yes "), ("tool", "out"), ("user", ""), ("assistant", 'é "q" \n')],
    "two": [("user", "System: odd"), ("assistant", "ok")],
    "think": [("user", "sum"), ("assistant", "<think>a</think> 4")],
}


def rows_of(spark):
    from weftline.schema import METADATA

    data = []
    for k, turns in MESSAGES.items():
        messages = [(r, c, [("c1", "function", ("f", '{"a": 1}'))] if k == "full" and i == 2 else None, "c1" if r == "tool" else None, None) for i, (r, c) in enumerate(turns)]
        meta = (k, "l", ["A", "b c"], "hard", None, None, None, False, {"z": "1", "a": "2"}, (4.5, {"x": 5, "b": 1}, "why", None) if k == "full" else None, ["f"], None, None, None)
        data.append((k, "sft", messages, '[{"type":"function",  "n":1.0}]', meta))
    from weftline.schema import MESSAGES as KIND

    return spark.createDataFrame(data, f"id string, kind string, messages {KIND}, tools string, metadata {METADATA}")


def lines_of(df, fmt):
    return {r["id"]: r["line"] for r in formats.formatted(df, fmt, True).collect()}


@pytest.mark.parametrize("fmt", ["sft", "tools", "alpaca", "grpo"])
@pytest.mark.parametrize("told", [True, False])
def test_rows_exported_read_and_exported_again_are_the_same_bytes(spark, fmt, told):
    want = lines_of(rows_of(spark), fmt)
    parsed = records.parsed_lines(spark.createDataFrame([(x,) for x in want.values()], "value string"), fmt if told else None)
    assert records.rejected_of(parsed).count() == 0
    assert lines_of(records.rows_of(parsed), fmt) == want


def test_pairs_exported_read_and_exported_again_are_the_same_bytes(spark):
    rows = rows_of(spark)
    last = F.slice("messages", F.size("messages"), F.lit(1))
    pairs = rows.select("metadata", F.slice("messages", F.lit(1), F.size("messages") - 1).alias("prompt"), last.alias("chosen"), F.transform(last, lambda m: m.withField("content", F.lit("no"))).alias("rejected"))
    want = lines_of(pairs, "dpo")
    parsed = records.parsed_lines(spark.createDataFrame([(x,) for x in want.values()], "value string"))
    assert lines_of(records.pairs_of(parsed), "dpo") == want and records.rows_of(parsed).count() == 0


def test_lines_that_are_no_records_are_kept_with_their_reason(spark):
    bad = {"{": "no JSON object", "[1]": "no JSON object", '{"id":"1"}': "no known format", '{"id":"1","messages":[]}': "no messages", '{"messages":[{"role":"user","content":"x"}]}': "no id", '{"id":"1","instruction":"a","output":"b"}': "no input", '{"id":"1","instruction":"a","input":"raw","output":"b"}': "the input names no role", '{"id":"1","prompt":[],"chosen":[],"rejected":[]}': "a side has no reply"}
    parsed = records.parsed_lines(spark.createDataFrame([(x,) for x in bad], "value string"))
    assert {r["line"]: r["reason"] for r in records.rejected_of(parsed).collect()} == bad
    assert records.rows_of(parsed).count() == 0 and records.pairs_of(parsed).count() == 0


def test_canonical_records(spark):
    from weftline.schema import PAIRS, ROWS

    rows = spark.createDataFrame([("r1", None, None, "leaf", *[None] * 4, None, None, [("user", "q", None, None, None), ("assistant", "a", None, None, None)], None, None, None, None, None), ("r2", *[None] * 9, None, None, None, None, None, None)], ROWS)
    got = {r["id"]: r for r in records.canonical_rows(rows).collect()}
    assert (got["r1"]["metadata"]["id"], got["r1"]["metadata"]["leaf_id"], got["r2"]["metadata"]["leaf_id"], got["r2"]["messages"]) == ("r1", "leaf", "", [])
    side = [("user", "u", None, None, None), ("assistant", "bad", None, None, None), ("user", "v", None, None, None)]
    pairs = spark.createDataFrame([("a", None, "r1", None, "weak", "vague", None, None, side, (1.0, None, "w", None), None), ("b", None, "r2", None, None, None, None, None, side[:1], None, None)], PAIRS)
    got = {r["pair_id"]: r for r in records.canonical_pairs(pairs, rows).collect()}
    assert [m["content"] for m in got["a"]["rejected"]] == ["bad"] and [m["content"] for m in got["b"]["rejected"]] == ["u"]
    assert (got["a"]["metadata"]["strategy"], got["a"]["metadata"]["judge"]["score"], got["a"]["reason"]) == ("weak", 1.0, None) and [m["content"] for m in got["a"]["prompt"]] == ["q"]
    assert got["b"]["reason"] == "chosen row does not end with an assistant turn"
