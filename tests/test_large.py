"""What queries do once however large their tables are."""

from pyspark.sql import Row, functions as F

from weftline import schema
from weftline.operators import taxonomy
from weftline.plans import stateful
from weftline.sources.tables import table
from weftline.streaming import runs


def test_lines_are_parsed_once(spark):
    d = "/root/testdata/sf0.001"
    found = stateful.reread_exports(spark, d)
    assert "from_json" not in found._jdf.queryExecution().optimizedPlan().toString()
    talks = table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("ended"), F.count_if(F.col("role") == "assistant").alias("replies"))
    n, ended, pairs = talks.count(), talks.where("ended = 'assistant'").count(), talks.where("ended = 'assistant' AND replies > 1").count()
    want = {"sft": n, "tools": n, "alpaca": ended, "grpo": ended, "dpo": pairs}
    assert {r["format"]: (r["lines"], r["same"], r["rejected"]) for r in found.collect()} == {k: (v, v, 0) for k, v in want.items() if v}


def test_a_fold_reads_and_writes_its_state_once():
    calls = []

    class State:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802
            return State()

    fold = runs.ItemFold()
    fold.init(Handle())
    item = Row(*[c.split()[0] for c in runs.ITEM.split(", ")])
    for k in range(3):
        rows = [item("r", f"{k}{n:02d}", float(n), "error" if n % 2 else "done", 1, 0.5, f"E{k}{n}") for n in range(40)]
        got = list(fold.handleInputRows(("r",), iter(rows), None))
        assert [(r["done"], r["errors"], r["spend_usd"], r["state"]) for r in got] == [(40 * k + 40, 20 * k + 20, 20.0 * k + 20, "running")]
    assert calls == ["get", "update"] * 3


def test_a_replaced_tree_is_walked_once(spark, monkeypatch):
    walks = []
    chains = taxonomy.chains
    monkeypatch.setattr(taxonomy, "chains", lambda *a, **k: walks.append(a) or chains(*a, **k))
    new = spark.createDataFrame([("a", None, None, "A", None, True, 1, None, None, None), ("b", "a", None, "B", None, False, 0, None, None, 2), ("c", None, None, "B", None, False, 0, None, None, None)], taxonomy.TREE)
    out = {r["label"] + str(r["depth"]): (r["slug"], r["is_negative"], r["is_leaf"]) for r in taxonomy.replacement(spark.createDataFrame([], schema.TOPIC_NODES), new, "p", 4).collect()}
    assert out == {"A0": ("a", True, False), "B1": ("b-2", True, True), "B0": ("b", False, True)}
    assert len(walks) == 1
