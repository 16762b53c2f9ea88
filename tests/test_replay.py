"""Recorded outputs and settings."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import replay, settings


def test_taxonomy(spark):
    reply = 'Sure:\n```json\n{"topics":[{"label":"Net","negative":true,"leaves":[{"label":" DNS ","task_type":"fix"},{"label":""}]},{"label":" "}]}\n```'
    nodes = {r["id"]: r for r in replay.taxonomy_nodes(spark.createDataFrame([("p", reply), ("q", "no")], "project_id string, reply string"), ["EXPLAIN", "DEBUG"]).collect()}
    assert set(nodes) == {"p-0", "p-0-0"} and nodes["p-0-0"]["slug"] == "dns" and nodes["p-0-0"]["is_negative"] and nodes["p-0-0"]["task_type"] == "EXPLAIN"


def test_prompts(spark):
    df = spark.createDataFrame([("l", '["a", {"text": "b"}, ""]'), ("m", '{"prompts": [{"prompt": "c"}]}'), ("n", "none")], "leaf_id string, reply string")
    assert {(r["leaf_id"], r["text"]) for r in replay.prompt_items(df).collect()} == {("l", "a"), ("l", "b"), ("m", "c")}


def test_responses(spark):
    df = spark.createDataFrame(
        [("1", "l", False, "sys", "q", None, "fine answer with words "), ("2", "l", False, None, "q", None, " "), ("3", "l", False, None, "q", None, "I cannot help."), ("4", "l", True, None, "q", None, "I cannot help.")],
        "prompt_id string, leaf_id string, negative boolean, system string, prompt string, first string, reply string",
    )
    rows, errors = replay.response_rows(df)
    got = {r["prompt_id"]: (r["status"], len(r["messages"])) for r in rows.collect()}
    assert got == {"1": ("draft", 3), "3": ("refusal", 2), "4": ("draft", 2)} and [r["prompt_id"] for r in errors.collect()] == ["2"]


def test_pairs_and_catalogue(spark):
    attempts = spark.createDataFrame([("r", 1, "same", "same "), ("r", 2, "same", "other text"), ("s", 1, "x", "x")], "row_id string, attempt int, chosen string, rejected string")
    pairs, errors = replay.preference_pairs(attempts, spark.createDataFrame([("r",), ("s",)], "id string"))
    assert [(r["row_id"], r["attempt"]) for r in pairs.collect()] == [("r", 2)] and [r["id"] for r in errors.collect()] == ["s"]
    models = spark.createDataFrame([("a/b", "B", ("0.000003", "x"), ["tools"]), ("c", "D", (None, "0.00001"), [])], "id string, name string, pricing struct<prompt:string,completion:string>, supported_parameters array<string>")
    got = {r["id"]: (round(r["price_in"], 6), round(r["price_out"], 6), r["structured"]) for r in replay.catalogue(models).collect()}
    assert got == {"a/b": (3.0, 0.0, False), "c": (0.0, 10.0, True)}
    assert [r["id"] for r in replay.search_models(models, "d").collect()] == ["c"]
    assert [r["x"] for r in spark.createDataFrame([('{"a":1}',), ("no",)], "c string").select(replay.tool_result(F.col("c")).alias("x")).collect()] == ['{"a":1}', '{"result":"no"}']


def test_settings():
    assert settings.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert settings.known({"a": 1}, {"a": 2, "z": 3}) == {"a": 2}
    assert settings.stages("1,3-5,judge") == [1, 3, 4, 5]
    with pytest.raises(ValueError):
        settings.stages("9")
    assert settings.rebalanced({"a": 50, "b": 30, "c": 20}, "a", 80) == {"a": 80, "b": 12, "c": 8}
    assert settings.planned_rows(6, 4, 3, 7) == 504
    assert replay.calls_per_item(1, 1, True) == 3
