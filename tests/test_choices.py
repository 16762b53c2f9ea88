"""Choices of replies, teachers, slots, flaws and attempts against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import choices as C
from weftline.operators.sampling import drawn_choice
from weftline.operators.scoring import seeded

SLOTS = [C.Slot("a/x", 3.0, 0.1, "p1"), C.Slot("b/y", 1.0, 0.9), C.Slot("a/x", 9.0, 0.5, "late")]


def test_structured_outcomes(spark):
    good, bad = '```json\n{"n": 1}\n```', "no json"
    calls = [
        ("first", "json_schema", None, good, 0.1),
        ("down", "json_schema", 400, None, 0.0), ("down", "json_object", 400, None, 0.0), ("down", "plain", 200, '{"n": 2}', 0.2),
        ("fixed", "json_object", 200, bad, 0.3), ("fixed", "repair", 200, '{"n": 3}', 0.4),
        ("broken", "plain", 200, bad, 0.3), ("broken", "repair", 200, bad, 0.4),
        ("no repair", "plain", 200, bad, 0.3), ("repair fails", "plain", 200, bad, 0.3), ("repair fails", "repair", 500, None, None),
        ("limit", "json_schema", 429, None, 0.0), ("limit", "plain", 200, good, 0.1),
        ("all refused", "json_schema", 400, None, 0.0), ("all refused", "plain", 400, None, 0.0),
        ("unused", "plain", 200, good, 0.1), ("unused", "repair", 200, '{"n": 9}', 5.0),
    ]
    random.Random(1).shuffle(calls)
    got = {r["target_id"]: (r["value"] and r["value"]["n"], r["mode"], r["repaired"], round(r["cost_usd"], 6), r["error"]) for r in C.structured_outcomes(spark.createDataFrame(calls, "target_id string, mode string, status int, reply string, cost_usd double"), "struct<n:int>").collect()}
    assert got == {
        "first": (1, "json_schema", False, 0.1, None), "down": (2, "plain", False, 0.2, None), "fixed": (3, "json_object", True, 0.7, None),
        "broken": (None, "plain", False, 0.7, "did not validate after repair"), "no repair": (None, "plain", False, 0.3, "did not validate"), "repair fails": (None, "plain", False, 0.3, "repair: status 500"),
        "limit": (None, None, False, 0.0, "status 429"), "all refused": (None, None, False, 0.0, "status 400"), "unused": (1, "plain", False, 0.1, None),
    }


def test_teachers_by_turns_and_by_weight(spark):
    prompts = [(f"p{k:02d}", float(k % 5)) for k in range(40)]
    df = spark.createDataFrame(prompts, "id string, created_at double").repartition(4)
    order = sorted(prompts, key=lambda p: (p[1], p[0]))
    assert {r["id"]: r["teacher"] for r in C.teachers(df, SLOTS, "p").collect()} == {p[0]: SLOTS[k % 3].slug for k, p in enumerate(order)}
    want = {p[0]: drawn_choice(seeded("p", p[0]), [(s.slug, s.weight) for s in SLOTS]) for p in prompts}
    assert {r["id"]: r["teacher"] for r in C.teachers(df, SLOTS, "p", True).collect()} == want
    assert {r["teacher"] for r in C.teachers(df, [], "p").collect()} == {C.DEFAULT_TEACHER}


def test_slots_and_defaults(spark):
    df = spark.createDataFrame([("a/x",), ("b/y",), ("c/z",), (None,)], "teacher string")
    got = {r["teacher"]: tuple(r["slot"]) for r in C.with_slot(df, SLOTS).collect()}
    assert got == {"a/x": ("a/x", 0.1, "p1"), "b/y": ("b/y", 0.9, None), "c/z": ("c/z", 0.7, None), None: ("a/x", 0.1, "p1")}
    assert C.with_slot(df, []).where("teacher IS NULL").first()["slot"]["slug"] == C.DEFAULT_TEACHER
    assert [C.stage_slug(s, SLOTS, "weak") for s in ("corruptor", "weaker", "hightemp")] == ["a/x", "weak", "a/x"] and C.stage_slug("weaker", [], None) == C.DEFAULT_TEACHER


def test_draws_of_items(spark):
    df = spark.createDataFrame([(f"i{k}",) for k in range(400)], "id string").repartition(3)
    flaws = [("vague", 1.0), ("wrong", 3.0), ("none", 0.0)]
    got = df.select("id", C.flaw_of(F.col("id"), flaws, "p").alias("flaw"), C.system_prompt_shown("random", F.col("id"), "p", 25.0).alias("shown"), C.system_prompt_shown("never", F.col("id"), "p").alias("never")).collect()
    assert {r["id"]: r["flaw"] for r in got} == {f"i{k}": drawn_choice(seeded("p", f"i{k}"), flaws) for k in range(400)}
    assert {r["id"]: r["shown"] for r in got} == {f"i{k}": seeded("p", f"i{k}").random() * 100 < 25 for k in range(400)} and not any(r["never"] for r in got)
    assert 230 < sum(r["flaw"] == "wrong" for r in got) < 370 and 60 < sum(r["shown"] for r in got) < 140


def test_tool_schema_by_name(spark):
    tools = '[{"type":"function","function":{"name":"f","x":1}},{"name":"g","y":[2]},{"type":"function","function":{"name":"f","x":2}}]'
    df = spark.createDataFrame([(tools, n) for n in ("f", "g", "h")] + [(None, "f"), ("{", "f")], "t string, n string")
    assert [r["s"] for r in df.select(C.tool_schema(F.col("t"), F.col("n")).alias("s")).collect()] == ['{"type":"function","function":{"name":"f","x":1}}', '{"name":"g","y":[2]}', "{}", "{}", "{}"]


@pytest.mark.parametrize("strategy", ["corruptor", "weaker", "hightemp"])
def test_pairs_from_attempts(spark, strategy):
    rows = [("r1", "The answer is forty two, by the usual sum. "), ("r2", "Another one that is quite long as well."), ("r3", "Third"), ("r4", "Fourth")]
    attempts = [("r1", 1, rows[0][1], 0.1), ("r1", 2, "Something else entirely", 0.2), ("r1", 3, "late", 0.4), ("r2", 1, "", 0.1), ("r2", 2, None, None), ("r2", 3, "only the third differs", 0.3), ("r3", 1, "Third  ", 0.5)]
    got = {r["row_id"]: tuple(r)[1:] for r in C.pairs_from_attempts(spark.createDataFrame(rows, "id string, chosen string"), spark.createDataFrame(attempts, "row_id string, attempt int, rejected string, cost_usd double"), strategy, [("vague", 1.0)], "p").collect()}
    flaw, none = ("vague" if strategy == "corruptor" else None), (None, None, None)
    assert got["r1"] == ("Something else entirely", strategy, flaw, 2, 0.3, None)
    assert got["r2"] == (("only the third differs", "corruptor+hightemp", flaw, 3, 0.4, None) if strategy == "corruptor" else (*none, 2, 0.1, "no attempt differs enough"))
    assert got["r3"] == (*none, 1, 0.5, "no attempt differs enough") and got["r4"] == (*none, 0, 0.0, "no attempt differs enough")


def test_blind_order_and_specs_are_the_generators_draws(spark):
    from weftline.operators import sampling, scoring

    df = spark.createDataFrame([(f"p{k % 3}", f"t{k}") for k in range(60)], "p string, t string").repartition(3)
    got = {(r["p"], r["t"]): r["a"] for r in df.select("p", "t", scoring.chosen_is_a(F.col("p"), F.col("t")).alias("a")).collect()}
    assert got == {(f"p{k % 3}", f"t{k}"): seeded(f"p{k % 3}", f"t{k}").random() < 0.5 for k in range(60)} and len(set(got.values())) == 2
    personas, styles = [("Ann", 2.0), ("Bob", 1.0), ("Nil", 0.0)], [("question", 1.0), ("command", 3.0)]
    want = []
    for leaf, n in (("l1", 4), ("l2", 0), ("l3", 9)):
        rng = seeded("p", leaf)
        want += [(leaf, k, drawn_choice(rng, personas), drawn_choice(rng, styles), rng.random() * 100 < 40) for k in range(n)]
    leaves = spark.createDataFrame([("l1", 4), ("l2", 0), ("l3", 9)], "leaf_id string, n int")
    assert sorted(tuple(r) for r in sampling.specs(leaves, "p", personas, styles, 40.0).collect()) == sorted(want)
