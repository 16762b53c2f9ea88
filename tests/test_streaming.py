"""Streams over small files, run to their end."""

from pyspark.sql import functions as F

from weftline.streaming import events as E


def source(spark, tmp_path, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(ddl).parquet(f"{tmp_path}/in")


def run(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_progress(spark, tmp_path):
    items = source(spark, tmp_path, [("r", "done"), ("r", "error"), ("r", "partial"), ("s", "refusal")], "run_id string, status string")
    got = {tuple(r) for r in run(E.progress_counts(items), "progress", "complete").collect()}
    assert got == {("r", 2, 1, 0), ("s", 1, 0, 1)}


def test_budget_guard(spark, tmp_path):
    calls = source(spark, tmp_path, [("p", 0.5), ("p", 0.5), ("q", 0.1)], "project_id string, cost_usd double")
    got = {(r["project_id"], r["calls"], r["stopped"]) for r in run(E.budget_guard(calls, 1.0, 90), "guard", "update").collect()}
    assert got == {("p", 2, True), ("q", 1, False)}


def test_replay_and_first_seen(spark, tmp_path):
    ddl = "seq long, k string, ts timestamp"
    events = source(spark, tmp_path, [(1, "a", None), (2, "a", None), (3, "b", None)], ddl).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert run(E.first_seen(E.replay(events, 0), "k"), "first", "append").count() == 2
    assert run(E.replay(events, 1), "after", "append").count() == 2


def test_spend_by_window(spark, tmp_path):
    ddl = "project_id string, cost_usd double, ts string"
    rows = [("p", 1.0, "2024-01-01 00:10:00"), ("p", 2.0, "2024-01-01 00:20:00"), ("p", 4.0, "2024-01-01 02:00:00")]
    calls = source(spark, tmp_path, rows, ddl).withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r["spend"] for r in run(E.spend_by_window(calls), "spend", "append").collect()} >= {3.0}
