"""Appends that happen once, tables that change together, and trees replaced with all that hangs on them."""

import pytest
from pyspark.sql import functions as F

from weftline import schema
from weftline.operators import taxonomy as T
from weftline.sources import commitlog as C

CALL = "id string, cost_usd double"


class Killed(Exception):
    pass


def die():
    raise Killed


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.fixture
def log(spark, tmp_path):
    return C.BatchLog(spark, f"file://{tmp_path}/ledger", CALL)


def test_a_batch_is_added_once(spark, log):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], CALL)
    assert ids(log.read()) == []
    assert log.append(rows, "w", 0) and not log.append(rows, "w", 0)
    assert log.append(rows, "other", 0)
    assert ids(log.read()) == ["a", "a", "b", "b"]
    assert ids(log.read(since=log.key("other", 0))) == ["a", "b"]


def test_a_killed_batch_is_invisible_and_can_be_written_again(spark, log):
    rows = spark.createDataFrame([("a", 1.0)], CALL)
    with pytest.raises(Killed):
        log.append(rows, "w", 3, die)
    assert ids(log.read()) == []
    assert log.append(rows, "w", 3)
    assert ids(log.read()) == ["a"]
    assert log.swept(0.0) == 0 and log.swept(1e12) == 1
    assert ids(log.read()) == ["a"]


def test_of_two_writers_of_a_batch_one_is_seen(spark, log):
    rows = spark.createDataFrame([("a", 1.0)], CALL)
    assert not log.append(rows, "w", 1, lambda: log.append(rows, "w", 1))
    assert ids(log.read()) == ["a"]


def test_put_if_absent(spark, tmp_path):
    path = f"file://{tmp_path}/x.json"
    C.put_if_absent(spark, path, "one")
    with pytest.raises(C.AlreadyCommitted):
        C.put_if_absent(spark, path, "two")
    assert (tmp_path / "x.json").read_text() == "one" and not list(tmp_path.glob("*.tmp"))


def test_a_stream_that_fails_between_batches_adds_each_row_once(spark, tmp_path, log):
    for k in range(4):
        spark.createDataFrame([(f"i{k}", float(k))], CALL).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(CALL).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    sink, seen = log.sink("stream"), []

    def failing(df, n):
        sink(df, n)
        seen.append(n)
        if len(seen) in (2, 4):  # after the commit, before Spark has noted the batch
            raise Killed

    for _ in range(3):
        q = source.writeStream.foreachBatch(failing).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception:  # noqa: BLE001
            pass
    assert ids(log.read()) == ["i0", "i1", "i2", "i3"] and len(seen) > 4


def test_ledger_rows(spark):
    ddl = "id string, project_id string, run_id string, target_id string, model_slug string, provider string, error string, stage int, latency_ms int, request string, response string, usage string, cost_usd double, created_at double, estimated boolean"
    row = lambda **k: tuple({**dict.fromkeys([c.split()[0] for c in ddl.split(", ")]), **k}.values())
    rows = [row(id="1", error="boom", request='{"a": 1}'), row(id="2", usage='{"x": 1}', estimated=True, cost_usd=0.5, response="not \"json\"", latency_ms=7), row(id="3", estimated=True)]
    got = {r["id"]: r for r in C.ledger_rows(spark.createDataFrame(rows, ddl)).collect()}
    assert (got["1"]["error"], got["1"]["cost_usd"], got["1"]["request"], got["1"]["latency_ms"]) == ("boom", 0.0, '{"a": 1}', 0)
    assert got["2"]["usage"] == '{"x": 1,"cost_estimated":true}' and got["2"]["response"] == '"not \\"json\\""'
    assert got["3"]["usage"] == '{"cost_estimated":true}'
    assert [f.name for f in C.ledger_rows(spark.createDataFrame(rows, ddl)).schema] == [c.split()[0] for c in schema.RAW_CALLS.split(", ")]


def test_record_of_an_export(spark, tmp_path):
    log = C.BatchLog(spark, f"file://{tmp_path}/exports", C.EXPORTS)
    assert C.record_export(log, "e1", "p", "/x", ["sft"], {"sft": {"train": 3, "eval": 1}}, 1.0)
    assert not C.record_export(log, "e1", "p", "/x", ["sft"], {}, 2.0)
    assert [(r["id"], r["counts"]["sft"]["train"]) for r in log.read().collect()] == [("e1", 3)]


# --- trees --------------------------------------------------------------------------------------


def node(id_, parent, label, project="p", **k):
    base = {"id": id_, "project_id": project, "parent_id": parent, "label": label, "slug": label.lower(), "difficulty": None, "task_type": None, "depth": 0, "rows_per_leaf": None, "order": 0, "is_negative": False, "is_leaf": False} | k
    return tuple(base[c] for c in ("id", "project_id", "parent_id", "label", "slug", "difficulty", "task_type", "depth", "rows_per_leaf", "order", "is_negative", "is_leaf"))


def store_of(spark, tmp_path):
    one = lambda kind, *rows: spark.createDataFrame([tuple(r.get(c.split()[0].strip("`")) for c in kind.split(", ")) for r in rows], kind)
    nodes = [node("t", None, "Top"), node("l1", "t", "One", is_leaf=True), node("l2", "t", "Two", is_leaf=True), node("u", None, "Up"), node("l3", "u", "Three", is_leaf=True), node("q", None, "Other", project="z", is_leaf=True)]
    store = C.Snapshots(spark, f"file://{tmp_path}/store")
    tables = {
        "projects": spark.createDataFrame([("p",), ("z",)], "id string"),
        "topic_nodes": spark.createDataFrame(nodes, schema.TOPIC_NODES),
        "prompts": one(schema.PROMPTS, *({"id": f"p{k}", "project_id": "p", "leaf_id": leaf, "status": "active"} for k, leaf in enumerate(("l1", "l1", "l2", "l3")))),
        "rows": spark.createDataFrame([("r0", "p", "p0"), ("r3", "p", "p3"), ("r9", "p", None)], "id string, project_id string, prompt_id string"),
        "pairs": spark.createDataFrame([("a0", "r0"), ("a3", "r3")], "id string, row_id string"),
    }
    assert store.commit(0, tables) == 1
    return store


def tree(spark, *rows):
    full = [{"key": None, "parent_key": None, "id": None, "label": None, "slug": None, "is_negative": None, "order": None, "difficulty": None, "task_type": None, "rows_per_leaf": None} | r for r in rows]
    return spark.createDataFrame([tuple(r.values()) for r in full], T.TREE)


def test_replacing_a_tree_keeps_ids_and_cascades(spark, tmp_path):
    store = store_of(spark, tmp_path)
    new = tree(
        spark,
        {"key": "a", "id": "t", "label": " Top again ", "order": 1, "is_negative": True},
        {"key": "b", "parent_key": "a", "id": "l1", "label": "", "difficulty": "hard"},
        {"key": "c", "parent_key": "a", "label": "One", "order": 5, "rows_per_leaf": 9},
        {"key": "d", "label": "One", "order": 0, "difficulty": "easy"},
        {"key": "e", "parent_key": "a", "id": "unknown", "label": "", "order": 7},
    )
    assert T.replace_tree(store, "p", new, 4) == 2
    tables = store.read()
    got = {r["label"] + "/" + r["slug"]: r for r in tables["topic_nodes"].where("project_id = 'p'").collect()}
    # The walk goes by order: d first, then a, b, c, e.
    assert set(got) == {"One/one", "Top again/top", "One/one-2", "One/one-3", "Untitled/untitled"}
    assert got["One/one"]["difficulty"] == "easy" and got["One/one"]["depth"] == 0 and got["One/one"]["is_leaf"] and got["One/one"]["rows_per_leaf"] == 4
    assert got["Top again/top"]["id"] == "t" and not got["Top again/top"]["is_leaf"] and got["Top again/top"]["rows_per_leaf"] is None
    assert got["One/one-2"]["id"] == "l1" and got["One/one-2"]["is_negative"] and got["One/one-2"]["parent_id"] == "t" and got["One/one-2"]["depth"] == 1
    assert got["One/one-3"]["rows_per_leaf"] == 9 and got["Untitled/untitled"]["id"] != "unknown"
    assert ids(tables["topic_nodes"].where("project_id = 'z'")) == ["q"]
    assert ids(tables["prompts"]) == ["p0", "p1"]  # those of l2 and l3 go
    assert {r["id"]: r["prompt_id"] for r in tables["rows"].collect()} == {"r0": "p0", "r3": None, "r9": None}
    assert ids(tables["pairs"]) == ["a0", "a3"]
    assert ids(store.read(1)["prompts"]) == ["p0", "p1", "p2", "p3"]  # the old version is whole


def test_no_reader_sees_half_and_the_second_writer_has_a_conflict(spark, tmp_path):
    store, new = store_of(spark, tmp_path), tree(spark, {"key": "a", "label": "Only"})
    with pytest.raises(Killed):
        T.replace_tree(store, "p", new, 4, die)
    assert store.version()[0] == 1 and len(ids(store.read()["prompts"])) == 4
    with pytest.raises(C.Conflict):
        T.replace_tree(store, "p", new, 4, lambda: T.replace_tree(store, "p", new))
    assert store.version()[0] == 2
    with pytest.raises(C.Conflict):
        store.commit(1, {})


def test_trees_with_a_fault_are_refused(spark, tmp_path):
    store = store_of(spark, tmp_path)
    for rows in ([{"key": "a", "parent_key": "b"}, {"key": "b", "parent_key": "a"}], [{"key": "a"}, {"key": "a"}], [{"key": "a", "id": "t"}, {"key": "b", "id": "t"}]):
        with pytest.raises(ValueError, match="cycle"):
            T.replace_tree(store, "p", tree(spark, *rows))
    assert store.version()[0] == 1


def test_deleting_a_project_and_resampling_a_leaf(spark, tmp_path):
    store = store_of(spark, tmp_path)
    assert T.resample_leaf(store, "l1") == 2
    assert ids(store.read()["prompts"]) == ["p0", "p2", "p3"]  # p1 alone has no row
    assert T.delete_project(store, "p") == 3
    left = store.read()
    assert {k: ids(v) for k, v in left.items()} == {"projects": ["z"], "topic_nodes": ["q"], "prompts": [], "rows": [], "pairs": []}


def test_chains_of_any_depth_and_cycles(spark):
    chain = [(str(k), str(k - 1) if k else None, f"n{k}") for k in range(1000)]
    cycle = [("x", "y", "X"), ("y", "z", "Y"), ("z", "x", "Z"), ("below", "x", "B"), ("lower", "below", "L"), ("self", "self", "S"), ("orphan", "nowhere", "O")]
    got = {r["id"]: (r["path"], r["cyclic"]) for r in T.paths(spark.createDataFrame([*chain, *cycle], "id string, parent_id string, label string").repartition(4)).collect()}
    assert len(got) == 1007
    for k in range(1000):
        assert got[str(k)] == ([f"n{i}" for i in range(k + 1)], False)
    assert got["x"] == (["Z", "Y", "X"], True) and got["below"] == (["Z", "Y", "X", "B"], True) and got["lower"] == (["Z", "Y", "X", "B", "L"], True)
    assert got["self"] == (["S"], True) and got["orphan"] == (["O"], False)
    assert T.paths(spark.createDataFrame([], "id string, parent_id string, label string")).count() == 0


def test_negative_goes_down_at_any_depth(spark):
    nodes = spark.createDataFrame([(str(k), str(k - 1) if k else None, False) for k in range(40)], "id string, parent_id string, is_negative boolean")
    got = T.marked_negative(nodes, spark.createDataFrame([("20",)], "id string"))
    assert {int(r["id"]) for r in got.where("is_negative").collect()} == set(range(20, 40))
    assert got.columns == nodes.columns and F.col("id") is not None
