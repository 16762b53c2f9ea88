"""Operators on small fixtures."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline import schema
from weftline.functions import messages as M
from weftline.functions import templates as P
from weftline.functions import text as T
from weftline.operators import curation, dedup, export, formats, ledger, preferences, sampling, scoring, taxonomy
from weftline.operators import rows as R
from weftline.plans.sql import HOST, KINDS
from weftline.sources import files
from weftline.sources.adapters import metadata


def said(role, content, calls=None, call_id=None, name=None):
    return {"role": role, "content": content, "tool_calls": calls, "tool_call_id": call_id, "name": name}


def call(id_, name="f", arguments="{}"):
    return {"id": id_, "type": "function", "function": {"name": name, "arguments": arguments}}


U, A, S = (lambda c: said("user", c)), (lambda c: said("assistant", c)), (lambda c: said("system", c))


def talks(spark, *conversations, **columns):
    rows = [{"id": f"r{k}", "messages": m, **{n: v[k] for n, v in columns.items()}} for k, m in enumerate(conversations)]
    extra = "".join(f", {n} string" for n in columns)
    return spark.createDataFrame(rows, f"id string, messages {schema.MESSAGES}{extra}")


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "ips"),
    [
        ("255.255.255.0 0.0.0.0 169.254.1.1 v1.2.3.4 100.64.0.1 224.0.0.5 10.1.2.3 172.31.0.1", []),
        ("1.1.1.1 then 51.15.22.9 and 185.199.108.153", ["51.15.22.9", "185.199.108.153"]),
        ("release 5.6.7.8; 5.6.7.9 beta; version 5.6.7.1", []),
        ("8.8.8.8 and 172.32.0.1", ["172.32.0.1"]),
        ("version 1.2.3.4.5", []),
        ("v        51.15.22.9", []),
        ("51.15.22.9        release", ["51.15.22.9"]),
        ("51.15.22.9     releases", []),
        ("v1.2.3.4, version 2.3.4.5, release 3.4.5.6 and 4.5.6.7 release", []),
        ("netmask 255.255.255.0 default 0.0.0.0 ver 1.2.3.4 cgnat 100.64.0.1", []),
        ("51.15.22.951.15.22.9", []),
    ],
)
def test_public_ips(spark, text, ips):
    assert one(spark, text, T.public_ips) == ips


@pytest.mark.parametrize(
    ("text", "kinds"),
    [("mail a.b@c.org now", ["email"]), ("AB123456C", ["ni"]), ("AB 12 34 56 C", ["ni"]), ("AO123456C", []), ("QA123456C", []), ("AB123456E", []), ("999.1.1.1", []), (None, [])],
)
def test_pii_kinds(spark, text, kinds):
    assert one(spark, text, T.pii_kinds) == kinds


@pytest.mark.parametrize(
    ("prompt", "answer", "refuses"),
    [
        ("q", "", True),
        ("q", None, True),
        ("q", "I can't help with that request.", True),
        ("q", "I’m sorry, but I can not do this.", True),
        ("x" * 60, "No.", True),
        ("hi", "No.", False),
        ("q", "I won't go into history here, but the cause is the cache.", False),
        ("q", "Use `ipconfig /flushdns`.", False),
        ("q", "The steps below work well for most people who try them at home. As an AI I like it.", False),
        ("q", "I am unable to see it. 1 thing", True),
        ("q", "I cannot help.\n1. Restart\n2. Wait", False),
    ],
)
def test_is_refusal(spark, prompt, answer, refuses):
    df = spark.createDataFrame([(prompt, answer)], "p string, a string")
    assert df.select(T.is_refusal(F.col("p"), F.col("a")).alias("y")).first()["y"] is refuses


@pytest.mark.parametrize(
    ("text", "english"),
    [("The cat is on the mat and it is fine with you", True), ("Le chat dort ici toujours pendant que nous mangeons tous ensemble dehors sous un grand soleil", False), ("1234 {}", True), ("Это русский текст", False)],
)
def test_looks_english(spark, text, english):
    assert one(spark, text, T.looks_english) is english


def test_text_helpers(spark):
    assert one(spark, "  A  b\n", T.normalise) == "a b"
    assert one(spark, "!!", T.slugify) == "node"
    assert one(spark, "Hello, World", T.slugify) == "hello-world"
    assert one(spark, "x\nANSWER: 4\nANSWER:  5 \n", T.answer_line) == "5"
    assert one(spark, "One. Two! Three", T.drop_last_sentence) == "One. Two!"
    assert one(spark, "Since noon, it fails.", T.strip_leading_clause) == "It fails."
    assert one(spark, "token hf_abcdefghijklmnopqrst end", T.redact_secrets) == "token [redacted] end"


CASES = [
    ([U("a"), A("b")], []),
    ([], ["no messages"]),
    ([S("s"), U("a"), A("b")], []),
    ([S(" "), U("a"), A("b")], ["turn 0: empty system content"]),
    ([U("a"), S("s"), A("b")], ["turn 1: system turn must be the single first message"]),
    ([U("a"), U("b"), A("c")], ["turn 1: roles must alternate — expected assistant, got user"]),
    ([U("a"), A("b ")], ["turn 1: trailing whitespace in assistant content"]),
    ([U("a")], ["final turn must be assistant, got user"]),
    ([U(""), A("b")], ["turn 0: empty content (and no tool_calls)"]),
    ([U("a"), said("assistant", None, [call("1"), call("2")]), said("tool", "x", call_id="1"), said("tool", "y", call_id="2"), A("z")], []),
    ([U("a"), said("assistant", None, [call("1"), call("2")]), said("tool", "x", call_id="1"), A("z")], ["turn 3: tool call(s) ['2'] have no tool result"]),
    ([U("a"), said("assistant", None, [call("1")]), said("tool", "x", call_id="9"), A("z")], ["turn 2: tool_call_id '9' does not match a pending tool call", "turn 3: tool call(s) ['1'] have no tool result"]),
    ([U("a"), said("tool", "x", call_id="1"), A("b")], ["turn 1: tool turn must directly follow an assistant turn with tool_calls"]),
    ([U("a"), said("assistant", None, [call("1")])], ["final turn must be an assistant reply with content, not unanswered tool_calls"]),
]


def test_validate_row(spark):
    got = talks(spark, *[c for c, _ in CASES]).select("id", M.validate_row(F.col("messages")).alias("i")).collect()
    assert {r["id"]: r["i"] for r in got} == {f"r{k}": i for k, (_, i) in enumerate(CASES)}


def test_validate_messages_is_looser(spark):
    df = talks(spark, [U("a"), A("b ")], [U("a"), said("assistant", None, [call("1")]), said("tool", "x", call_id="9"), A("z")], [U("a"), said("bot", "x")])
    got = [r["i"] for r in df.orderBy("id").select(M.validate_messages(F.col("messages")).alias("i")).collect()]
    assert got[:2] == [[], []]
    assert got[2] == ["message 1: expected assistant, got bot", "message 1: unknown role 'bot'", "last message must be assistant"]


def test_validate_pair(spark):
    df = spark.createDataFrame([([U("a")], [A("b")], [A("b")]), ([A("x")], [A("b")], [])], f"p {schema.MESSAGES}, c {schema.MESSAGES}, r {schema.MESSAGES}")
    got = [r["i"] for r in df.select(M.validate_pair(F.col("p"), F.col("c"), F.col("r")).alias("i")).collect()]
    assert got[0] == ["chosen and rejected are identical"]
    assert got[1][:2] == ["prompt must end with a user turn, got assistant", "rejected must be exactly one assistant message, got 0"]


def test_fold_and_templates(spark):
    df = talks(spark, [S("s"), U("a"), A("b")], [U("a"), said("assistant", None, [call("1", "f", '{"x":1}')]), said("tool", "r", call_id="1"), A("b")])
    rows = df.orderBy("id").select(M.fold_system(F.col("messages")).alias("f"), P.chatml(F.col("messages")).alias("c"), P.llama(F.col("messages")).alias("l"), P.gemma(F.col("messages")).alias("g"), P.template_issue(F.col("messages"), "gemma").alias("i")).collect()
    assert [m["content"] for m in rows[0]["f"]] == ["s\n\na", "b"]
    assert rows[0]["c"] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert rows[0]["g"] == "<bos><start_of_turn>user\ns\n\na<end_of_turn>\n<start_of_turn>model\nb<end_of_turn>\n" and rows[0]["i"] is None
    assert '<tool_call>\n{"name": "f", "arguments": {"x":1}}\n</tool_call><|im_end|>\n<|im_start|>user\n<tool_response>\nr\n</tool_response><|im_end|>' in rows[1]["c"]
    assert "ipython" in rows[1]["l"] and rows[1]["i"] is not None


def test_exact_dup(spark):
    rows = [("a", 1.0, "One text"), ("b", 2.0, "One text"), ("c", 3.0, "other"), ("d", 4.0, " ONE  TEXT ")]
    df = spark.createDataFrame(rows, "id string, t double, text string")
    assert {tuple(r) for r in dedup.exact_dup(df, "text", ["t", "id"]).collect()} == {("b", "a"), ("d", "a")}
    assert dedup.exact_dup(df.limit(0), "text", ["t", "id"]).count() == 0


def greedy(vectors, threshold):
    import numpy as np

    m = np.array(vectors, float)
    m = m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    gone, out = set(), {}
    for i in range(len(m)):
        for j in range(i + 1, len(m)):
            if i not in gone and j not in gone and m[i] @ m[j] >= threshold:
                gone.add(j)
                out[j] = i
    return out


def test_near_dup_equals_the_scan(spark):
    import random

    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(60)] + [[0.0] * 4]
    df = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<double>")
    for threshold in (0.5, 0.9):
        got = {r["id"]: r["partner_id"] for r in dedup.near_dup(df, threshold, ["id"]).collect()}
        assert got == greedy(vectors, threshold)


def full_rows(spark, rows):
    df = talks(spark, *[r["messages"] for r in rows], status=[r.get("status", "draft") for r in rows])
    base = df.withColumns({"id": F.col("id"), "metadata": metadata(F.col("id"), F.lit("leaf"), F.array(F.lit("leaf"))), "created_at": F.expr("double(substr(id, 2))"), "prev_status": F.lit(None).cast("string"), "filter_reason": F.lit(None).cast("string"), "kind": F.lit("sft"), "score": F.lit(None).cast("double"), "tools": F.lit(None).cast("string")})
    return base


GOOD = "The answer is that you restart the service and then it works for all of you."


def test_cascade_and_restore(spark):
    rows = full_rows(
        spark,
        [
            {"messages": [U("q"), A(GOOD)]},
            {"messages": [U("q"), A(GOOD)]},
            {"messages": [U("q"), A(GOOD + " Mail me at a@b.org.")], "status": "accepted"},
            {"messages": [U("q"), A("I cannot help you with any of this at all, and that is it.")]},
            {"messages": [U("q"), A("short")]},
            {"messages": [U("q"), A(GOOD + "!")], "status": "filtered"},
        ],
    )
    removed = curation.removals(rows)
    got = {r["id"]: (r["rule"], r["reason"]) for r in removed.collect()}
    assert got == {"r1": ("exact_dup", "identical to r0"), "r2": ("pii", "contains email"), "r3": ("refusal", "assistant refused"), "r4": ("length", "5 chars, minimum 40")}
    marked = curation.marked(rows, removed)
    state = {r["id"]: (r["status"], r["prev_status"], r["metadata"]["flags"]) for r in marked.collect()}
    assert state["r2"] == ("filtered", "accepted", ["pii"]) and state["r3"] == ("refusal", "draft", ["refusal"]) and state["r5"][0] == "filtered"
    assert curation.removals(marked).count() == 0
    back = {r["id"]: (r["status"], r["metadata"]["flags"]) for r in curation.restored(marked, removed.select("id")).collect()}
    assert back["r2"] == ("accepted", []) and back["r3"] == ("draft", [])


def test_cascade_with_vectors(spark):
    """Near duplicates go after exact ones and before the other rules, and again when vectors come later."""
    texts = [GOOD, GOOD, GOOD + " Or not.", GOOD + " Mail me at a@b.org.", "short", GOOD + " Then wait for it."]
    rows = full_rows(spark, [{"messages": [U("q"), A(t)]} for t in texts])
    vectors = spark.createDataFrame([("r1", [1.0, 0.0]), ("r2", [0.0, 1.0]), ("r3", [0.1, 1.0]), ("r5", [0.0, 2.0]), ("r9", [0.0, 1.0])], "id string, v array<double>")
    got = {r["id"]: (r["rule"], r["reason"]) for r in curation.removals(rows, vectors=vectors).collect()}
    assert got == {"r1": ("exact_dup", "identical to r0"), "r3": ("near_dup", "cosine 0.995 with r2"), "r4": ("length", "5 chars, minimum 40"), "r5": ("near_dup", "cosine 1.000 with r2")}
    first = curation.marked(rows, curation.removals(rows))
    later = curation.removals(first, vectors=vectors, rules=("near_dup",))
    assert {r["id"]: r["rule"] for r in later.collect()} == {"r5": "near_dup"}


def test_dup_mask_equals_the_scan(spark):
    rng = random.Random(9)
    vector = lambda: [rng.gauss(0, 1) for _ in range(3)]
    groups = ["hot"] * 40 + ["b"] * 8 + [None] * 6
    old = [(k, g, vector()) for k, g in enumerate(rng.sample(groups, 20))] + [(90, "old", vector())]
    new = [(k, g, vector() if k % 11 else None) for k, g in enumerate(groups)] + [(99, "new", [0.0] * 3)]
    want, kept = {}, {}
    unit = lambda v: [x / (sum(y * y for y in v) ** 0.5 or 1) for x in v]
    for _, g, v in old:
        kept.setdefault(g, []).append(unit(v))
    for n, g, v in new:
        want[n] = v is not None and any(sum(x * y for x, y in zip(unit(v), u)) >= 0.8 for u in kept.get(g, []))
        if v is not None and not want[n]:
            kept.setdefault(g, []).append(unit(v))
    table = lambda rows: spark.createDataFrame(rows, "n long, label string, v array<double>")
    got = dedup.dup_mask(table(new), table(old), 0.8, "label", block=7)
    assert got.columns == ["n", "label", "v", "dup"] and {r["n"]: r["dup"] for r in got.collect()} == want and 5 < sum(want.values()) < 50
    assert dedup.dup_mask(table(new).limit(0), table(old), 0.8, "label").count() == 0
    assert dedup.dup_mask(table(new), table(old).limit(0), 2.0, "label").where("dup").count() == 0


def test_cost_mean_of_a_long_run(spark):
    calls = spark.range(3000).select("id", F.lit("r").alias("run_id"), F.col("id").cast("double").alias("created_at"), F.when(F.col("id") % 7 != 3, F.col("id") % 13).cast("double").alias("cost_usd"))
    for alpha in (0.5, 0.01, 1.0):
        ema = None
        for c in (k % 13 for k in range(3000) if k % 7 != 3):
            ema = c if ema is None else alpha * c + (1 - alpha) * ema
        assert ledger.cost_ema(calls, alpha=alpha).first()["ema"] == pytest.approx(ema, rel=1e-12)
    with pytest.raises(ValueError):
        ledger.cost_ema(calls, alpha=0)


def test_formats(spark):
    rows = full_rows(spark, [{"messages": [S("be ü"), U("a"), A("b"), U('c "q"'), A("<think>x</think> d ")]}])
    line = lambda f, **k: json.loads(formats.formatted(rows, f, **k).first()["line"])
    assert line("sft")["messages"][0] == {"role": "system", "content": "be ü"}
    assert line("alpaca") == {"id": "r0", "instruction": "System: be ü\n\na", "input": 'Assistant: b\n\nUser: c "q"', "output": "<think>x</think> d"}
    assert line("grpo")["answer"] == "d" and line("grpo")["reasoning"] == "<think>x</think> d"
    assert list(line("tools", with_metadata=True)) == ["id", "messages", "tools", "metadata"]
    with pytest.raises(TypeError):
        formats.formatted(rows, "dpo")


def test_scores(spark):
    df = spark.createDataFrame([({"correctness": "5", " ACTIONABILITY": "3", "style adherence": "4", "safety": "2"},), ({"correctness": "6"},)], "c map<string,string>")
    got = [r["s"] for r in df.select(scoring.weighted_score(scoring.normalised_criteria(F.col("c"))).alias("s")).collect()]
    assert got == [3.85, None]
    row = scoring.summary(spark.createDataFrame([(2.35,), (4.4,)], "score double")).first()
    assert (row["mean"], row["median"], row["low_count"]) == (3.38, 3.38, 1) and row["histogram"][4] == row["histogram"][8] == 1


@pytest.mark.parametrize(
    ("sizes", "share", "want"),
    [({"a": 40, "b": 40, "c": 20}, 0.05, {"a": 2, "b": 2, "c": 1}), ({"a": 1, "b": 1, "c": 1, "d": 5}, 0.5, {"a": 0, "b": 0, "c": 0, "d": 4})],
)
def test_quotas(sizes, share, want):
    assert sampling.quotas(sizes, share, 42) == want


def test_quotas_take_from_the_largest():
    rng = random.Random(7)
    for _ in range(300):
        sizes = {f"s{k}": rng.choice((1, 1, 2, 3, rng.randint(1, 60))) for k in range(rng.randint(1, 8))}
        share, got = rng.choice((0.05, 0.1, 0.33, 0.5, 0.9)), None
        got = sampling.quotas(sizes, share, 1)
        left, lack = {k: n - min(int(n * share), n - 1) for k, n in sizes.items()}, round(sum(sizes.values()) * share)
        lack -= sum(sizes[k] - n for k, n in left.items())
        while lack > 0 and max(left.values()) > 1:
            left[max(sorted(left), key=left.get)] -= 1
            lack -= 1
        assert {k: sizes[k] - n for k, n in left.items() if sizes[k] > 1} == {k: n for k, n in got.items() if sizes[k] > 1}
        assert sum(got.values()) == sum(sizes[k] - n for k, n in left.items()) + min(max(lack, 0), sum(n == 1 for n in sizes.values()))


def test_typos_swap_inner_neighbours():
    text = "  Hello, (world)! abc four 'quoted' ... a.b.c.d x"
    assert sampling.typos(text, random.Random(1), 0) == text
    got = sampling.typos(text, random.Random(1), 1.0)
    assert got != text and len(got) == len(text)
    for old, new in zip(text.split(" "), got.split(" ")):
        assert sorted(old) == sorted(new) and old[:1] == new[:1] and old[-1:] == new[-1:]
    assert "fuor" in got and "abc" in got.split(" ")


def test_prices_of_variants(spark):
    df = spark.createDataFrame([("openai/gpt-4o:free",), ("openai/gpt-4o",), ("own:x",)], "model_slug string")
    got = {r["model_slug"]: (r["price_in"], r["price_out"]) for r in ledger.with_prices(df).collect()}
    assert got == {"openai/gpt-4o:free": (2.5, 10.0), "openai/gpt-4o": (2.5, 10.0), "own:x": (1.0, 3.0)}


def test_split(spark):
    df = spark.createDataFrame([(f"{s}{k:03d}", s) for s, n in (("a", 40), ("b", 40), ("c", 20)) for k in range(n)], "id string, stratum string")
    got = {r["id"] for r in sampling.stratified_split(df, 0.05, 42).where("split = 'eval'").collect()}
    ids = [f"a{k:03d}" for k in range(40)]
    random.Random("42:a").shuffle(ids)
    assert len(got) == 5 and set(ids[:2]) == {i for i in got if i[0] == "a"}
    assert sum(sampling.quotas({f"s{k}": 1 for k in range(20)}, 0.1, 1).values()) == 2


def test_weighted_choice(spark):
    df = spark.createDataFrame([(0.0,), (0.29,), (0.31,), (0.99,)], "u double")
    assert [r["c"] for r in df.select(sampling.weighted_choice(F.col("u"), [("a", 3), ("z", 0), ("b", 7)]).alias("c")).collect()] == ["a", "a", "b", "b"]


def test_ledger(spark):
    calls = spark.createDataFrame([(k, "p", float(k), 0.3) for k in range(5)], "id long, project_id string, created_at double, cost_usd double")
    stop = ledger.budget_replay(calls, 1.0, 90).first()
    assert (stop["stopped_after"], stop["stopped_by"]) == (3, 2)
    plan = spark.createDataFrame([("p", k, 0.3, 0.3) for k in range(12)], "project_id string, n long, est double, cost double")
    admitted = ledger.reserved_replay(plan, 1.0, 100, 8).where("admitted").count()
    assert admitted * 0.3 <= 1.0 and admitted == 3
    items = spark.createDataFrame([(k, "r", float(k), "error" if k % 4 else "done") for k in range(12)], "id long, run_id string, finished_at double, status string")
    assert tuple(ledger.early_abort(items).first()) == ("r", 11, 8)
    assert ledger.cost_ema(calls.withColumn("run_id", F.lit("r"))).first()["ema"] == pytest.approx(0.3)


def test_words_end_at_letters_of_other_scripts(spark):
    """As in the SQL, whose word characters are ASCII."""
    texts = ["äver. 22.144.239.132", "22.144.239.131é", "é22.144.239.130 7", "ver. 22.144.239.129", "éAB123456Cé", "éa@b.comé", "٢٢.144.239.128", "22.144.239.127 beta²"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(T.public_ips("text").alias("ips"), T.pii_kinds("text").alias("kinds")).collect()
    assert [r["ips"] for r in got] == [[], ["22.144.239.131"], ["22.144.239.130"], [], [], [], [], []]
    assert [r["kinds"] for r in got] == [[], ["ip"], ["ip"], [], ["ni"], ["email"], [], []]
    con = duckdb.connect()
    con.execute("CREATE TABLE d AS SELECT unnest(?) AS t", [texts])
    assert [tuple(x) for x in con.sql(f"SELECT {HOST}, {KINDS} FROM d").fetchall()] == [(r["ips"], ", ".join(r["kinds"])) for r in got]


def test_selection(spark):
    rows = full_rows(spark, [{"messages": [U("q"), A("x")]} for _ in range(10)]).withColumn("score", F.when(F.expr("int(substr(id, 2)) % 5 = 0"), 2.0).otherwise(4.0))
    assert R.selected_rows(rows, 3.0, True).count() == 8
    off = R.selected_rows(rows, 3.0, False)
    assert off.count() == 10 and off.where(F.array_contains("metadata.flags", "low_score")).count() == 2


def test_too_similar(spark):
    df = spark.createDataFrame([("same words here", "same words here "), ("a" * 100, "a" * 99 + "b"), ("abc", "xyz"), ("a", "a" * 10)], "a string, b string")
    assert [r["s"] for r in df.select(preferences.too_similar(F.col("a"), F.col("b")).alias("s")).collect()] == [True, True, False, False]


def test_paths_and_slugs(spark):
    nodes = spark.createDataFrame([("1", None, "a"), ("2", "1", "b"), ("3", "2", "c"), ("x", "y", "l"), ("y", "x", "m")], "id string, parent_id string, label string")
    assert {r["id"]: r["path"] for r in taxonomy.paths(nodes).where("NOT cyclic").collect()} == {"1": ["a"], "2": ["a", "b"], "3": ["a", "b", "c"]}
    named = spark.createDataFrame([("1", "a", 0), ("2", "a", 1), ("3", "a-2", 2), ("4", "a", 3)], "id string, slug string, `order` int")
    assert {r["id"]: r["slug"] for r in taxonomy.unique_slugs(named).collect()} == {"1": "a", "2": "a-2", "3": "a-2-2", "4": "a-3"}


def plain_slugs(rows):
    taken, out = set(), {}
    for at, k, slug in sorted((at, k, slug) for k, slug, at in rows):
        name, n = slug, 2
        while name in taken:
            name, n = f"{slug}-{n}", n + 1
        taken.add(name)
        out[k] = name
    return out


def test_slugs_are_unique_as_one_after_the_other(spark):
    rng = random.Random(5)
    rows = []
    for family in range(40):
        pool = [f"f{family}", *[f"f{family}" + "".join(f"-{rng.choice((0, 2, 3, 4, 5, 7, 12, '02'))}" for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 9))]]
        weights = [rng.choice((1, 3, 10)) for _ in pool]
        rows += [(slug, rng.randrange(30)) for slug in rng.choices(pool, weights, k=rng.randint(2, 30))]
    rows = [(f"k{k}", slug, at) for k, (slug, at) in enumerate(rows)]
    got = {r["id"]: r["slug"] for r in taxonomy.unique_slugs(spark.createDataFrame(rows, "id string, slug string, `order` int")).collect()}
    assert got == plain_slugs(rows) and len(set(got.values())) == len(rows)


def test_a_slug_of_many_rows_is_numbered_at_once(spark):
    """One after the other, from 2 on for each, these would take 800 million looks."""
    nodes = spark.range(40_000).select(F.col("id"), F.lit("same").alias("slug"), (-F.col("id")).alias("order"))
    from time import monotonic

    started = monotonic()
    got = taxonomy.unique_slugs(nodes).agg(F.count_distinct("slug").alias("n"), F.max(F.when(F.col("id") == 0, F.col("slug"))).alias("last")).first()
    assert (got["n"], got["last"]) == (40_000, "same-40000") and monotonic() - started < 30


def test_bundle(spark, tmp_path):
    rows = full_rows(spark, [{"messages": [U(f"q{k}"), A(f"answer {k}")]} for k in range(20)])
    path, counts = export.bundle(rows, None, f"{tmp_path}/set", "set", export.ExportConfig(formats=("sft", "alpaca"), eval_share=0.1))
    assert counts == {"sft": {"train": 18, "eval": 2}, "alpaca": {"train": 18, "eval": 2}}
    listed = json.loads((tmp_path / "set" / "manifest.json").read_text())
    assert {x["path"] for x in listed} >= {"sft/train.jsonl", "sft/eval.jsonl"}
    lines = (tmp_path / "set" / "sft" / "train.jsonl").read_text().splitlines()
    assert [json.loads(x)["id"] for x in lines] == sorted(json.loads(x)["id"] for x in lines)
    again, _ = export.bundle(rows, None, f"{tmp_path}/set", "set", export.ExportConfig())
    assert again.endswith("set-2")
    bad = full_rows(spark, [{"messages": [U("q")]}])
    with pytest.raises(export.ExportError):
        export.bundle(bad, None, f"{tmp_path}/bad", "bad", export.ExportConfig())
    assert not list(tmp_path.glob("bad*"))


def test_secret_stops_a_write(spark, tmp_path):
    items = spark.createDataFrame([("1", "sk-or-abc")], "id string, line string")
    with pytest.raises(Exception, match="secret"):
        files.write_lines(items, f"{tmp_path}/x.jsonl")


def test_rules_look_at_texts_once(spark):
    """The plan of what is removed reads written ids and reasons, not the rows and their texts again."""
    rows = full_rows(spark, [{"messages": [U("q"), A(f"answer {k}")]} for k in range(4)] + [{"messages": [U("q"), A("answer 1")]}])
    removed = curation.removals(rows)
    assert {r["id"]: r["rule"] for r in removed.collect()}["r4"] == "exact_dup"
    plan = removed._jdf.queryExecution().optimizedPlan().toString()
    assert "messages" not in plan and "Join" not in plan


def test_noise_holds_few_texts_at_once(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        docs = spark.createDataFrame([(k, f"Some words, number {k}, that may change." if k else None) for k in range(30)], "id int, text string")
        assert sampling.noisy(docs, "p", 0.5).count() == 30 and int(spark.conf.get(name)) <= sampling.BATCH
    finally:
        spark.conf.set(name, before)
