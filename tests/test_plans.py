"""Planners and views against plain loops over small tables."""

import random

import pytest
from pyspark.sql import functions as F

from weftline import schema
from weftline.operators import ledger, planners as P, settings, views as V
from weftline.operators.scoring import family

SLUG = "openai/gpt-4o"
PRICE = ledger.PRICES[SLUG]


def frame(spark, ddl, rows):
    kinds = [c.split()[0].strip("`") for c in ddl.split(", ")] if "struct" not in ddl else None
    return spark.createDataFrame([tuple(r.get(c) for c in kinds) for r in rows], ddl)


def turns(*texts):
    return [("user" if k % 2 == 0 else "assistant", t, None, None, None) for k, t in enumerate(texts)]


def nested(spark, ddl, rows):
    """Rows of a schema with structs: by field names of the parsed schema."""
    names = spark.createDataFrame([], ddl).columns
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], ddl)


def tables(spark):
    meta = lambda judge=None: (None,) * 9 + (judge,) + (None,) * 4
    judge = (4.0, {"x": 4}, "why", "chosen")
    rows = [{"id": f"r{k}", "kind": ("sft", "tools")[k % 5 == 4], "status": ("draft", "accepted", "filtered", "edited")[k % 4], "prompt_id": f"p{k}" if k % 3 else None, "leaf_id": f"l{k % 3}", "model_slug": "m" if k % 2 else None, "messages": turns("q" * k, "a" * 2 * k), "metadata": meta(judge if k % 6 == 1 else None), "score": [None, 4.5, 2.0][k % 3], "created_at": float(100 - k)} for k in range(20)]
    pairs = [{"id": f"x{k}", "row_id": f"r{k}", "status": ("tie", "judged", "draft")[k % 3], "rejected_messages": turns("u", "b" * k), "judge": [None, (1.0, None, "w", "rejected"), (3.0, None, "w", "tie")][k % 3]} for k in range(1, 8)]
    nodes = [{"id": f"l{k}", "label": f"Leaf {k}", "is_leaf": k > 0, "rows_per_leaf": [None, 0, 9][k], "order": k} for k in range(3)]
    prompts = [{"id": f"p{k}", "leaf_id": f"l{k % 4}", "text": "t" * k, "status": "active" if k % 5 else "rejected_dup", "created_at": float(50 - k % 7), "adversarial": k % 2 == 0} for k in range(30)]
    return nested(spark, schema.ROWS, rows), nested(spark, schema.PAIRS, pairs), frame(spark, schema.TOPIC_NODES, nodes), frame(spark, schema.PROMPTS, prompts), rows, pairs, nodes, prompts


def cost(calls, chars, tokens):
    tin, tout = int(chars / 4), int(tokens * 0.6)
    return calls, tin * calls, tout * calls, round((tin / 1e6 * PRICE[0] + tout / 1e6 * PRICE[1]) * calls, 6)


def told(estimate):
    (r,) = estimate.collect()
    return r["calls"], r["est_tokens_in"], r["est_tokens_out"], pytest.approx(r["est_usd"], abs=1.01e-6)


BUDGET = P.Budget("a brief", 1.0, 5.0)


def test_tree_and_prompt_plans(spark):
    _, _, nodes, prompts, _, _, n, p = tables(spark)
    items, est = P.tree_plan(spark.createDataFrame([("one",)], "id string"), 3, 7, 3, SLUG, 4000, BUDGET)
    assert [r["target_id"] for r in items.collect()] == ["one"] and told(est) == cost(1 + 7 + 21, 7 + 900, 1200)
    for force in (False, True):
        want = {}
        for node in n:
            if node["is_leaf"]:
                have = sum(x["leaf_id"] == node["id"] and x["status"] == "active" for x in p)
                k = (node["rows_per_leaf"] or 4) - (0 if force else have)
                want |= {node["id"]: k} if k > 0 else {}
        items, est = P.prompt_plan(nodes, prompts, SLUG, 500, BUDGET, 4, force)
        assert {r["target_id"]: r["n"] for r in items.collect()} == want
        assert told(est) == (cost(len(want), int(sum(7 + 1200 + k * 160 for k in want.values()) / len(want)), int(sum(min(500, k * 120) for k in want.values()) / len(want))) if want else (0, 0, 0, 0.0))


@pytest.mark.parametrize("regenerate", [False, True])
def test_response_plan(spark, regenerate):
    rows, _, _, prompts, r, _, _, p = tables(spark)
    used = {x["prompt_id"] for x in r}
    want = sorted((x for x in p if x["status"] == "active" and (regenerate or x["id"] not in used)), key=lambda x: (x["created_at"], x["id"]))
    items, est = P.response_plan(prompts, rows, SLUG, 1000, BUDGET, "sys", (2, 5), True, regenerate)
    assert [x["target_id"] for x in items.orderBy("index").collect()] == [x["id"] for x in want]
    assert told(est) == cost(len(want) * (3 + 2 + 2), int(sum(len(x["text"]) for x in want) / len(want) + 3 + 600 + 400), 1000)


def test_pair_and_judge_plans(spark):
    rows, pairs, _, _, r, p, _, _ = tables(spark)
    said = lambda ms, role=None: sum(len(m[1]) for m in ms if role in (None, m[0]))
    paired = {x["row_id"] for x in p}
    want = [x for x in r if x["status"] in schema.EXPORTABLE and x["kind"] != "tools" and x["id"] not in paired]
    items, est = P.pair_plan(rows, pairs, SLUG, 700, BUDGET)
    assert sorted(x["target_id"] for x in items.collect()) == sorted(x["id"] for x in want)
    assert told(est) == cost(len(want), int(sum(said(x["messages"], "assistant") + said(x["messages"]) for x in want) / len(want) + 500), 700)
    own = [x for x in r if x["status"] in schema.CANDIDATE and x["metadata"][9] is None]
    two = [x for x in p if x["judge"] is None]
    for only, mine, theirs in ((None, own, two), ("rows", own, []), ("pairs", [], two)):
        items, est = P.judge_plan(rows, pairs, SLUG, 9000, BUDGET, only)
        assert sorted((x["type"], x["target_id"]) for x in items.collect()) == sorted([("row", x["id"]) for x in mine] + [("pair", x["id"]) for x in theirs])
        chars = [said(x["messages"]) for x in mine] + [said(x["rejected_messages"]) * 2 + 800 for x in theirs]
        assert told(est) == cost(len(chars), int(sum(chars) / len(chars) + 900 + 7), 400)


def test_embedding_plan(spark):
    rows, *_, r, _, _, _ = tables(spark)
    many = rows
    for k in range(1, 8):
        many = many.unionByName(rows.withColumn("id", F.concat("id", F.lit(f"-{k}"))))
    vectors = spark.createDataFrame([("r0",), ("r1-3",)], "id string")
    every = sorted(((x["created_at"], x["id"] + s, 2 * len(x["messages"][0][1])) for x in r if x["status"] in schema.CANDIDATE for s in ["", *(f"-{k}" for k in range(1, 8))] if x["id"] + s not in ("r0", "r1-3")))
    items, est = P.embedding_plan(many, vectors, "openai/text-embedding-3-small", BUDGET)
    got = {x["target_id"]: x["row_ids"] for x in items.collect()}
    assert got == {f"emb-{k // 64}": [i for _, i, _ in every[k : k + 64]] for k in range(0, len(every), 64)}
    tokens = int(sum(c for *_, c in every) / 4)
    assert told(est) == (len(got), tokens, 0, round(tokens / 1e6 * 0.02, 6))


def test_estimates_of_nothing_and_over_the_cap(spark):
    rows, pairs, *_ = tables(spark)
    _, est = P.pair_plan(rows.limit(0), pairs, SLUG, 700, P.Budget("", 10.0, 1.0))
    assert tuple(est.first()) == (0, 0, 0, 0.0, False)
    _, est = P.embedding_plan(rows.limit(0), rows.select("id").limit(0), SLUG, P.Budget("", 10.0, 1.0))
    assert tuple(est.first()) == (0, 0, 0, 0.0, False)
    assert P.pair_plan(rows, pairs, SLUG, 700, P.Budget("", 10.0, 1.0))[1].first()["over_cap"] and not P.pair_plan(rows, pairs, SLUG, 700, BUDGET)[1].first()["over_cap"]


def test_views(spark):
    rows, pairs, nodes, prompts, r, p, n, q = tables(spark)
    assert V.row_view(rows.withColumn("metadata", F.lit(None).cast(schema.METADATA))).where("metadata IS NULL").count() == 0 and len(V.row_view(rows).columns) == 16
    got = {x["id"]: x["leaf_label"] for x in V.prompt_view(prompts, nodes).collect()}
    assert got == {x["id"]: {m["id"]: m["label"] for m in n}.get(x["leaf_id"]) for x in q} and "embedding" not in V.prompt_view(prompts).columns
    assert {x["id"]: x["chosen_row"] and x["chosen_row"]["id"] for x in V.pair_view(pairs, rows.where("id <> 'r1'")).collect()} == {x["id"]: None if x["row_id"] == "r1" else x["row_id"] for x in p}
    runs = frame(spark, schema.RUNS, [{"id": "1", "stage": 5}, {"id": "2", "stage": 9}])
    assert {x["id"]: x["stage_name"] for x in V.run_view(runs).collect()} == {"1": "judge", "2": None}
    assert [x["id"] for x in V.prompts_of(prompts, nodes, "l3", "TTT").orderBy("id").collect()] == sorted(x["id"] for x in q if x["leaf_id"] == "l3" and len(x["text"]) >= 3)
    table = [(x["leaf_id"], x["leaf_label"], x["count"]) for x in V.rows_by_leaf(rows.unionByName(rows.limit(1).withColumn("leaf_id", F.lit("gone"))), nodes).collect()]
    assert table == [("l0", "Leaf 0", 7), ("l1", "Leaf 1", 7), ("l2", "Leaf 2", 6), ("gone", None, 1)]
    refused = rows.withColumn("status", F.when(F.col("status") == "filtered", "refusal").otherwise(F.col("status")))
    assert sum(x["count"] for x in V.refusals_by_leaf(refused, nodes).collect()) == sum(x["status"] == "filtered" for x in r)


def test_judge_summary_and_totals(spark):
    rows, pairs, *_ = tables(spark)
    teachers = spark.createDataFrame([("meta-llama/x",), ("OpenAI/y",), (None,)], "slug string")
    (got,) = V.judge_summary(rows, pairs, teachers, "meta/z").collect()
    assert (got["ties"], got["flipped"], got["judged_pairs"], got["judged_rows"], got["low_count"], got["same_family_warning"], got["judge_family"]) == (2, 3, 5, 13, 6, True, "meta")
    assert got["teacher_families"] == ["", "meta", "openai"] and sum(got["histogram"]) == 13
    assert not V.judge_summary(rows, pairs, teachers, "qwen/q").first()["same_family_warning"]
    assert tuple(V.judged_totals(pairs, spark.createDataFrame([(3,), (2,)], "weight int")).first()) == (2, 5, 5)
    assert tuple(V.used(rows, "model_slug", "leaf_id").first()) == (2, 3) and tuple(V.used(rows.limit(0), "leaf_id").first()) == (0,)
    projects = spark.createDataFrame([("a", 1.5, ["sft"]), ("b", 2.0, ["dpo", "sft"]), ("c", None, None)], "id string, spend_usd double, data_types array<string>")
    assert tuple(V.projects_total(projects).first()) == (3.5, 3, ["dpo", "sft"])
    assert spark.range(1).select(family(F.lit("mistralai/x"))).first()[0] == "mistral"


def test_figures_as_shown(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(V.money(F.lit(x))) for x in (0.0, 0.0012, 0.01, 12.3456)] == ["$0.00", "$0.0012", "$0.01", "$12.35"]
    assert [one(V.relative_time(F.lit(1000.0 - d), F.lit(1000.0))) for d in (0, 59, 60, 7199, 90000)] == ["just now", "just now", "1m ago", "1h ago", "1d ago"]
    assert [one(V.truncated(F.lit(t), 4)) for t in ("abcd", "abcde")] == ["abcd", "abc…"]
    assert [one(V.thousands(F.lit(x))) for x in (128_000, 1_048_576, 500)] == ["128k", "1.0M", "1k"]
    assert [one(V.eval_rows(F.lit(n), F.lit(0.05))) for n in (10, 9, 31)] == [1, 0, 2]
    df = spark.createDataFrame([([0.5, -1.25],), (None,)], "v array<float>")
    assert [r["u"] for r in df.select(V.unpacked_vector(V.packed_vector(F.col("v"))).alias("u")).collect()] == [[0.5, -1.25], None]


def test_presets():
    assert {k: settings.preset_rows(v) for k, v in settings.PRESETS.items()} == {"quick-sft": 504, "dpo-corruptor": 432, "tool-calling-200": 200, "reasoning-traces": 300}
    assert settings.preset("quick-sft", {"taxonomy": {"topics": 1}})["taxonomy"]["topics"] == 1 and settings.PRESETS["quick-sft"]["taxonomy"]["topics"] == 7
    with pytest.raises(KeyError):
        settings.preset("none")


def test_budget_replay_of_a_hot_project_equals_a_loop(spark):
    rng = random.Random(2)
    calls = [(f"c{k}", "hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), rng.choice([None, -1.0, rng.random()]), float(rng.randint(0, 99))) for k in range(900)]
    df = spark.createDataFrame(calls, "id string, project_id string, cost_usd double, created_at double").repartition(7)
    got = {r["project_id"]: (r["calls"], round(r["total"], 6), r["stopped_after"], r["stopped_by"]) for r in ledger.budget_replay(df, 20.0, 90).collect()}
    want = {}
    for p in {c[1] for c in calls}:
        spend, stop = 0.0, (None, None)
        own = sorted((c for c in calls if c[1] == p), key=lambda c: (c[3], c[0]))
        for n, c in enumerate(own, 1):
            spend += max(0.0, c[2] or 0.0)
            stop = (n, c[0]) if stop[0] is None and spend + 1e-9 >= 18 else stop
        want[p] = (len(own), round(spend, 6), *stop)
    assert got == want


@pytest.mark.parametrize("shuffled", [10, 100, 10**6])
def test_large_strata_are_split_by_a_permutation(spark, shuffled):
    from weftline.operators import sampling

    sizes = {"a": 7, "b": 60, "c": 333, "": 12}
    items = [(f"{k or 'none'}{i:04d}", k or None) for k, n in sizes.items() for i in range(n)]
    random.Random(3).shuffle(items)
    df = spark.createDataFrame(items, "id string, stratum string").repartition(5)
    got = sampling.stratified_split(df, 0.15, 7, shuffled=shuffled).where("split = 'eval'").collect()
    wanted = sampling.quotas(sizes, 0.15, 7)
    assert {k: sum((r["stratum"] or "") == k for r in got) for k in sizes} == wanted
    for name, n in sizes.items():
        if n <= shuffled:
            order = list(range(n))
            random.Random(f"7:{name}").shuffle(order)
            assert {r["id"] for r in got if (r["stratum"] or "") == name} == {f"{name or 'none'}{i:04d}" for i in order[: wanted[name]]}
    again = sampling.stratified_split(df.repartition(2), 0.15, 7, shuffled=shuffled).where("split = 'eval'").collect()
    assert sorted(r["id"] for r in again) == sorted(r["id"] for r in got)
