"""Edits, pending work, trees and figures on small fixtures."""

from pyspark.sql import functions as F

from tests.test_core import A, U, call, full_rows, said
from weftline import schema
from weftline.operators import ledger, replay, stats, taxonomy
from weftline.operators import rows as R


def test_patch_and_bulk(spark):
    rows = full_rows(spark, [{"messages": [U("q"), A("x")]} for _ in range(4)])
    patches = spark.createDataFrame([("r0", [U("q"), A("new ")], None), ("r1", [U("q")], "accepted"), ("r2", None, "flagged")], f"id string, messages {schema.MESSAGES}, status string")
    got = {r["id"]: (r["status"], r["messages"][-1]["content"], r["metadata"]["flags"]) for r in R.patched(rows, patches).collect()}
    assert got == {"r0": ("edited", "new", ["edited"]), "r1": ("draft", "x", []), "r2": ("flagged", "x", []), "r3": ("draft", "x", [])}
    ids = spark.createDataFrame([("r0",), ("r1",), ("zz",)], "id string")
    assert {r["status"] for r in R.bulk(rows, ids, "accept").where("id in ('r0', 'r1')").collect()} == {"accepted"}
    assert R.bulk(rows, ids, "delete").count() == 2
    assert spark.range(1).select(R.set_flags(F.array(F.lit("a"), F.lit("b")), ["c", "a"], ["b"]).alias("f")).first()["f"] == ["a", "c"]


def test_pending(spark):
    rows = full_rows(spark, [{"messages": [U("q"), A("x")]}, {"messages": [U("q"), A("x")], "status": "filtered"}])
    pairs = spark.createDataFrame([("p1", None), ("p2", None)], "id string, judge struct<verdict:string>")
    assert {tuple(r) for r in R.judge_pending(rows, pairs).collect()} == {("row", "r0"), ("pair", "p1"), ("pair", "p2")}
    prompts = spark.createDataFrame([("1", "active", "l"), ("2", "active", "l"), ("3", "rejected_dup", "l")], "id string, status string, leaf_id string")
    done = spark.createDataFrame([("1",), (None,)], "prompt_id string")
    assert [r["id"] for r in R.prompts_pending(prompts, done).collect()] == ["2"]
    nodes = spark.createDataFrame([("l", True, 5), ("m", True, 2)], "id string, is_leaf boolean, rows_per_leaf int")
    assert {r["leaf_id"]: r["n"] for r in taxonomy.needed_prompts(nodes, prompts).collect()} == {"l": 3, "m": 2}


def test_pair_export(spark):
    rows = full_rows(spark, [{"messages": [U("q"), A("x")]} for _ in range(5)])
    pairs = spark.createDataFrame([(f"p{k}", f"r{k}", s, (4.0 if k != 4 else 1.0, v)) for k, (s, v) in enumerate([("judged", "chosen"), ("tie", "tie"), ("judged", "tie"), ("judged", "rejected"), ("draft", None)])], "id string, row_id string, status string, judge struct<score:double,verdict:string>")
    assert {r["id"] for r in R.selected_pairs(pairs, rows).collect()} == {"p0", "p4"}
    assert {r["id"] for r in R.selected_pairs(pairs, rows, drop_ties=False).collect()} == {"p0", "p1", "p2", "p4"}
    assert {r["id"] for r in R.selected_pairs(pairs, rows, gate=True).collect()} == {"p0"}
    summed = {(r["kind"], r["key"]): r["n"] for r in stats.pair_summary(pairs.withColumns({"flaw": F.lit("x"), "strategy": F.lit(None).cast("string")})).collect()}
    assert summed[("status", "judged")] == 3 and summed[("flaw", "x")] == 5 and not any(k == "strategy" for k, _ in summed)


def test_tree_edits(spark):
    nodes = spark.createDataFrame([("1", None, 5, False), ("2", "1", 3, False), ("3", "2", 9, None), ("4", "1", 1, False)], "id string, parent_id string, `order` int, is_negative boolean")
    got = {r["id"]: r["is_negative"] for r in taxonomy.marked_negative(nodes, spark.createDataFrame([("2",)], "id string")).collect()}
    assert got == {"1": False, "2": True, "3": True, "4": False}
    assert {r["id"]: r["order"] for r in taxonomy.renumbered(nodes).collect()} == {"1": 0, "4": 0, "2": 1, "3": 0}


def test_run_figures(spark):
    events = spark.createDataFrame(
        [("r", 1, "progress", 1, 4, None, None), ("r", 2, "worker", None, None, "busy", 1), ("r", 3, "progress", 3, 4, None, None), ("r", 4, "worker", None, None, "idle", 1), ("r", 5, "log", None, None, None, None), ("r", 6, "done", None, None, "done", None)],
        "run_id string, seq long, type string, done int, total int, state string, worker_id int",
    )
    r = stats.progress(events).first()
    assert (r["done"], r["total"], r["status"], r["logs"], r["percent"], r["workers"][0]["state"]) == (3, 4, "done", 1, 75.0, "idle")
    one = spark.range(1).select(ledger.rows_per_min(F.lit(30), F.lit(0.0), F.lit(90.0)).alias("a"), ledger.empty_completion_note(F.lit(" "), F.lit(None).cast("array<string>"), F.lit("length"), F.lit('{"completion_tokens_details":{"reasoning_tokens":9}}')).alias("b"), *[c.alias(k) for k, c in stats.card_figures(F.lit(5), F.lit(10), F.lit(8.0), F.lit(10.0)).items()]).first()
    assert one["a"] == 20.0 and one["b"] == "empty completion (finish_reason=length, 9 reasoning tokens); billed but unusable" and (one["rows_pct"], one["tone"]) == (50.0, "warn")


def test_trajectories(spark):
    turns = [("a", 0, U("q")), ("a", 1, said("assistant", None, [call("1")])), ("a", 2, said("tool", "r", call_id="1")), ("a", 3, A("done ")), ("b", 0, U("q"))]
    fine, bad = replay.trajectories(spark.createDataFrame(turns, f"prompt_id string, turn int, message {schema.MESSAGE}"))
    assert [m["content"] for m in fine.first()["messages"]] == ["q", None, "r", "done"]
    assert [tuple(r) for r in bad.collect()] == [("b", "no final reply")]
