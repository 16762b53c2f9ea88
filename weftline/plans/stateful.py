"""Queries of the run folds, reservations, logs of commits, trees, nested JSON and re-read exports, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import schema
from weftline.operators import admission, choices, formats, nested, planners, records, reservations, taxonomy, views
from weftline.operators.dedup import ensure_checkpoints
from weftline.plans import sql
from weftline.sources import commitlog
from weftline.sources.adapters import conversation_rows, documents_as_rows
from weftline.sources.tables import table
from weftline.streaming import runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    ensure_checkpoints(spark)
    sc = spark.sparkContext
    return f"{(sc.getConf().get('spark.checkpoint.dir', None) or sc.getCheckpointDir()).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _stream(df: DataFrame, folder: str, files: int = 6) -> DataFrame:
    """``df`` as a stream of its rows in no order: some files, two a micro-batch."""
    df.repartition(files, F.xxhash64(*df.columns)).write.parquet(f"{folder}/in")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")


def _items(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind.isin("click", "view"), "error").when(kind == "error", "skipped").when(kind == "purchase", "refusal").otherwise("done")
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("finished_at"),
        status.alias("status"), (F.col("event_id") % 3).cast("int").alias("calls"), F.round("value", 2).alias("cost_usd"), F.when(status == "error", F.concat(F.lit("E"), F.col("event_id").cast("string"))).alias("error"),
    )


RUN_SQL = """
    WITH i AS (SELECT user_id::VARCHAR AS run_id, event_id, ts, value,
                      CASE WHEN event_type IN ('click', 'view') THEN 'error' WHEN event_type = 'error' THEN 'skipped'
                           WHEN event_type = 'purchase' THEN 'refusal' ELSE 'done' END AS status,
                      event_type = 'error' AND event_id % 3 > 0 AS short FROM events),
         t AS (SELECT run_id, count_if(NOT short)::BIGINT AS done, count_if(status = 'error')::BIGINT AS errors, count_if(status = 'refusal')::BIGINT AS refusals,
                      count_if(short)::BIGINT AS partial, (sum(round(value * 100))::BIGINT) AS spend_cents FROM i GROUP BY run_id),
         o AS (SELECT run_id, event_id, status, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS n FROM i WHERE NOT short),
         c AS (SELECT *, count_if(status = 'error') OVER (PARTITION BY run_id ORDER BY n) AS bad FROM o WHERE n <= 20),
         m AS (SELECT run_id, min(n) AS n FROM c WHERE bad >= 8 AND bad >= n * 0.6 GROUP BY run_id)
    SELECT t.*, c.n AS aborted_at, c.bad::BIGINT AS abort_errors, CASE WHEN c.status = 'error' THEN 'E' || c.event_id END AS last_error,
           CASE WHEN c.n IS NULL THEN 'running' ELSE 'aborted' END AS state
    FROM t LEFT JOIN m ON m.run_id = t.run_id LEFT JOIN c ON c.run_id = m.run_id AND c.n = m.n
"""


def _in_cents(folds: DataFrame) -> DataFrame:
    return folds.withColumn("spend_cents", F.round(F.col("spend_usd") * 100).cast("long")).drop("spend_usd")


@query(RUN_SQL)
def run_fold(spark, d):
    return _in_cents(runs.folded_items(_items(spark, d)))


@query(RUN_SQL)
def run_fold_live(spark, d):
    """The same from a stream of the items in no order, through state."""
    folder = _folder(spark, "run-fold")
    before = spark.conf.get(runs.STATE_STORE[0])
    spark.conf.set(*runs.STATE_STORE)
    try:
        folds = runs.live_items(_stream(_items(spark, d), folder))
        out = commitlog.BatchLog(spark, f"{folder}/out", f"{runs.FOLDED}, batch long")
        q = folds.writeStream.outputMode("update").foreachBatch(lambda df, n: (out.append(df.withColumn("batch", F.lit(n)), "fold", n), None)[1]).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(runs.STATE_STORE[0], before)
    last = out.read().groupBy("run_id").agg(F.max_by(F.struct(*[c.split()[0] for c in runs.FOLDED.split(", ")[1:]]), "batch").alias("r"))
    return _in_cents(last.select("run_id", "r.*"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events of the table as a monitor's: the value of props names the worker, one kind of event in five ends nothing."""
    n = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("progress", "worker", "log", "log", "item"))), (n % 5 + 1).cast("int"))
    body = F.when(kind == "worker", F.to_json(F.struct((n % 7).alias("worker_id"), F.concat(F.lit("s"), n).alias("status")))).otherwise(F.to_json(F.struct(n.alias("n"))))
    return table(spark, d, "events").select((F.col("user_id") % 10).cast("string").alias("run_id"), (n + 1).alias("seq"), kind.alias("type"), body.alias("payload"))


@query("""
    WITH e AS (SELECT (user_id % 10)::VARCHAR AS run_id, event_id + 1 AS seq, event_id AS n FROM events),
         l AS (SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS k FROM e WHERE n % 5 IN (2, 3))
    SELECT e.run_id, max(e.seq) AS seq, '{"n":' || max(CASE WHEN n % 5 = 0 THEN n END) || '}' AS progress, 'running' AS status,
           least(count(*), 500)::BIGINT AS events, any_value(g.logs)::BIGINT AS logs, any_value(g.first_log) AS first_log
    FROM e JOIN (SELECT run_id, count(*) AS logs, min(seq) AS first_log FROM l WHERE k <= 300 GROUP BY run_id) g ON g.run_id = e.run_id GROUP BY e.run_id
""")
def run_monitor(spark, d):
    return runs.snapshots(_events(spark, d))


@query("""
    WITH e AS (SELECT (user_id % 10)::VARCHAR AS run_id, event_id + 1 AS seq, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id DESC) AS k FROM events)
    SELECT run_id, seq FROM e WHERE k <= 500 AND seq > 8000
""")
def run_replay(spark, d):
    return runs.replayed(_events(spark, d), 8000).select("run_id", "seq")


def _reservations(spark: SparkSession, d: str) -> DataFrame:
    """Each event as a call: reserved at its own time, recorded (or released, one in ten) when two more have come."""
    events = table(spark, d, "events").select(F.col("user_id").cast("string").alias("project_id"), F.col("event_id").alias("n"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")
    call, kind = F.col("n").cast("string"), F.when(F.col("n") % 10 == 0, "release").otherwise("record")
    asks = events.select("project_id", (F.col("at") * 2).alias("seq"), F.lit("reserve").alias("kind"), call.alias("call_id"), F.lit(None).cast("double").alias("amount"), (F.col("value") * 0.8).alias("est"))
    ends = events.select("project_id", (F.col("at") * 2 + 20_000_000_001).alias("seq"), kind.alias("kind"), call.alias("call_id"), F.when(kind == "record", F.col("value")).alias("amount"), F.lit(None).cast("double").alias("est"))
    return asks.unionByName(ends)


@query()
def reservation_guard(spark, d):
    """Every project's calls under a cap; held against a plain loop by tests, a state machine has no SQL."""
    return reservations.guard_summary(reservations.decided(_reservations(spark, d), 400.0, 90))


@query("""
    SELECT user_id::VARCHAR AS project_id, count(*) AS calls, count_if(event_type = 'error')::BIGINT AS failed, sum(round(value * 100))::BIGINT AS spend_cents,
           count_if(event_id % 4 = 0)::BIGINT AS estimated
    FROM events GROUP BY user_id
""")
def ledger_sink(spark, d):
    """A stream of calls appended to a ledger once, though every batch is handed over twice; then read back."""
    folder, n = _folder(spark, "ledger"), F.col("event_id")
    null = F.lit(None).cast("string")
    calls = table(spark, d, "events").select(
        n.cast("string").alias("id"), F.col("user_id").cast("string").alias("project_id"), null.alias("run_id"), F.lit("t").alias("target_id"), F.lit("m").alias("model_slug"), null.alias("provider"), F.when(F.col("event_type") == "error", "failed").alias("error"),
        F.lit(3).alias("stage"), F.lit(10).alias("latency_ms"), F.col("props").alias("request"), null.alias("response"), F.lit('{"prompt_tokens": 1}').alias("usage"), F.col("value").alias("cost_usd"), F.lit(0.0).alias("created_at"), (n % 4 == 0).alias("estimated"),
    )
    log = commitlog.BatchLog(spark, f"{folder}/ledger", schema.RAW_CALLS)
    sink = log.sink("calls")
    q = _stream(calls, folder).writeStream.foreachBatch(lambda df, b: (sink(commitlog.ledger_rows(df), b), sink(commitlog.ledger_rows(df), b), None)[2]).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    marked = F.get_json_object("usage", "$.cost_estimated") == "true"
    return log.read().groupBy("project_id").agg(F.count(F.lit(1)).alias("calls"), F.count("error").alias("failed"), F.sum(F.round(F.col("cost_usd") * 100).cast("long")).alias("spend_cents"), F.count_if(marked).alias("estimated"))


@query("""
    WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, min(o_orderkey) OVER (PARTITION BY o_custkey) AS root FROM orders)
    SELECT o_orderkey AS id, n AS depth, root, false AS cyclic FROM o
""")
def deep_chains(spark, d):
    """Each order hangs on its customer's order before it: chains as deep as a customer has orders."""
    from pyspark.sql import Window

    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    found = taxonomy.chains(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), before.alias("parent_id")))
    return found.select("id", F.size("chain").cast("long").alias("depth"), F.element_at("chain", -1).alias("root"), "cyclic")


@query("""
    WITH s AS (SELECT s_suppkey, s_nationkey, s_suppkey % 3 <> 0 AS kept FROM supplier),
         p AS (SELECT c_custkey, (SELECT max(kept) FROM s WHERE s_suppkey = c_custkey % (SELECT count(*) FROM supplier) + 1) AS kept FROM customer)
    SELECT 'topic_nodes' AS name, ((SELECT count(*) FROM nation) + (SELECT count_if(kept) FROM s) + 1)::BIGINT AS n, 0::BIGINT AS forgotten
    UNION ALL SELECT 'prompts', count_if(coalesce(kept, true))::BIGINT, 0 FROM p
    UNION ALL SELECT 'rows', count(*), count_if(NOT kept)::BIGINT FROM p
""")
def tree_replace(spark, d):
    """A tree of nations and suppliers loses a third of its leaves in one commit; their prompts go, rows forget them."""
    store = commitlog.Snapshots(spark, _folder(spark, "store"))
    nation, supplier, customer = (table(spark, d, t) for t in ("nation", "supplier", "customer"))
    names = [c.split()[0].strip("`") for c in schema.TOPIC_NODES.split(", ")]
    kinds = dict(c.replace("`", "").split() for c in schema.TOPIC_NODES.split(", "))
    node = lambda df, **k: df.select(*[(k[c] if c in k else F.lit(None)).cast(kinds[c]).alias(c) for c in names])
    tops = node(nation, id=F.concat(F.lit("n"), "n_nationkey"), project_id=F.lit("p"), label=F.col("n_name"), slug=F.lower("n_name"), is_leaf=F.lit(False))
    leaf = F.concat(F.lit("s"), "s_suppkey")
    leaves = node(supplier, id=leaf, project_id=F.lit("p"), parent_id=F.concat(F.lit("n"), "s_nationkey"), label=F.col("s_name"), slug=leaf, is_leaf=F.lit(True))
    prompt = customer.select(F.concat(F.lit("p"), "c_custkey").alias("id"), F.lit("p").alias("project_id"), F.concat(F.lit("s"), (F.col("c_custkey") % supplier.count() + 1).cast("string")).alias("leaf_id"), F.lit("active").alias("status"))
    rows = customer.select(F.concat(F.lit("r"), "c_custkey").alias("id"), F.lit("p").alias("project_id"), F.concat(F.lit("p"), "c_custkey").alias("prompt_id"))
    store.commit(0, {"topic_nodes": tops.unionByName(leaves), "prompts": prompt, "rows": rows})
    kept = tops.unionByName(leaves.where(F.substr("id", F.lit(2)).cast("long") % 3 != 0))
    tree = kept.select(F.col("id").alias("key"), F.col("parent_id").alias("parent_key"), "id", "label", F.lit(None).cast("string").alias("slug"), F.lit(False).alias("is_negative"), F.lit(None).cast("int").alias("order"), F.lit(None).cast("string").alias("difficulty"), F.lit(None).cast("string").alias("task_type"), F.lit(None).cast("int").alias("rows_per_leaf"))
    tree = tree.unionByName(spark.createDataFrame([("new", None, None, "New", None, False, None, None, None, None)], tree.schema))
    taxonomy.replace_tree(store, "p", tree)
    tables = store.read()
    counted = [t.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"), (F.count_if(F.col("prompt_id").isNull()) if n == "rows" else F.lit(0).cast("long")).alias("forgotten")) for n, t in sorted(tables.items())]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("""
    SELECT event_id, CASE event_id % 4
             WHEN 0 THEN 'Provider returned error (' || event_type || '): quota ' || user_id
             WHEN 1 THEN 'bad request (provider): ' || props
             WHEN 2 THEN 'bad request (' || event_type || ')'
             ELSE 'status ' || user_id END AS error,
           CASE event_id % 4 WHEN 0 THEN 'quota ' || user_id WHEN 1 THEN 'bad request' WHEN 2 THEN 'bad request' END AS root_cause
    FROM events WHERE event_type = 'error'
""")
def error_texts(spark, d):
    """Error text out of response bodies of several shapes, and the innermost message."""
    null, n = F.lit(None), F.col("event_id") % 4
    raw = F.to_json(F.struct(F.struct(F.concat(F.lit("quota "), F.col("user_id").cast("string")).alias("message")).alias("error")))
    body = lambda message, provider, own: F.to_json(F.struct(F.struct(F.lit(message).alias("message"), F.struct(provider.alias("provider_name"), own.alias("raw")).alias("metadata")).alias("error")))
    kind, none = F.col("event_type"), null.cast("string")
    made = F.when(n == 0, body("Provider returned error", kind, raw)).when(n == 1, body("bad request", none, F.col("props"))).when(n == 2, body("bad request", kind, none)).otherwise(F.lit("<html>"))
    bodies = table(spark, d, "events").where("event_type = 'error'").select("event_id", made.alias("body"), F.concat(F.lit("status "), F.col("user_id").cast("string")).alias("plain"))
    return nested.deepest_error(bodies.withColumn("error", nested.error_text("body", "plain")), "body").select("event_id", "error", "root_cause")


@query("""
    SELECT c_custkey, unnest(['settings.api_key', 'settings.list.1', 'settings.deep.more.Password', 'settings.deep.more.Password']) AS path,
           unnest(['key', 'value', 'key', 'value']) AS reason FROM customer WHERE c_custkey % 5 = 0
    UNION ALL SELECT c_custkey, 'settings.api_key', 'key' FROM customer WHERE c_custkey % 5 <> 0
""")
def secret_paths(spark, d):
    """Where settings of customers hold what looks like a secret, at any depth."""
    token = F.concat(F.lit("sk-or-v1-abcdef"), F.col("c_custkey").cast("string"))
    odd = F.col("c_custkey") % 5 == 0
    more = F.when(odd, F.struct(token.alias("Password"))).otherwise(F.lit(None))
    body = F.to_json(F.struct(F.struct(F.lit("none").alias("api_key"), F.array(F.col("c_name"), F.when(odd, token).otherwise("plain")).alias("list"), F.struct(more.alias("more")).alias("deep")).alias("settings")))
    return nested.secret_findings(table(spark, d, "customer").select("c_custkey", body.alias("body")), "c_custkey", "body")


@query("""
    WITH l AS (SELECT conv_id, arg_max(role, turn) AS ended, count_if(role = 'assistant') AS replies FROM conversations GROUP BY conv_id)
    SELECT f.format, count(*) AS lines, count(*) AS same, 0::BIGINT AS rejected
    FROM l JOIN (VALUES ('sft'), ('tools'), ('alpaca'), ('grpo'), ('dpo')) f(format)
      ON f.format IN ('sft', 'tools') OR ended = 'assistant' AND (f.format <> 'dpo' OR replies > 1) GROUP BY f.format
""")
def reread_exports(spark, d):
    """Conversations exported in five formats into one table of lines, read back and exported again: lines, equal ones, rejected ones."""
    folder = _folder(spark, "reread")

    def step(df: DataFrame, name: str, *by: str) -> DataFrame:
        # Written out, as Spark puts an expression in place of every use of its column, and these are used many times.
        df.write.option("compression", "zstd").partitionBy(*by).parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    talks = step(conversation_rows(table(spark, d, "conversations")).select("messages", "metadata", "tools"), "talks")
    ended = talks.where(F.get("messages", F.size("messages") - 1)["role"] == "assistant")
    own = F.filter("messages", lambda m: m["role"] == "assistant")
    pairs = ended.withColumn("_own", own).where("size(_own) > 1").select("metadata", F.slice("messages", F.lit(1), F.size("messages") - 1).alias("prompt"), F.slice("_own", F.size("_own"), F.lit(1)).alias("chosen"), F.slice("_own", 1, 1).alias("rejected"))
    lines = None
    for fmt, items in (("sft", talks), ("tools", talks), ("alpaca", ended), ("grpo", ended), ("dpo", pairs)):
        made = formats.formatted(items, fmt, True).select("line")
        lines = made if lines is None else lines.unionByName(made)
    parsed = step(records.parsed_lines(step(lines, "lines"), None, "line"), "parsed", "format")
    rows = step(records.rows_of(parsed).select("messages", "tools", "metadata", "format"), "rows", "format")
    again = formats.formatted(records.pairs_of(parsed), "dpo", True).select(F.lit("dpo").alias("format"), "line")
    for fmt in ("sft", "tools", "alpaca", "grpo"):
        again = again.unionByName(formats.formatted(rows.where(F.col("format") == fmt), fmt, True).select(F.lit(fmt).alias("format"), "line"))
    # Lines meet by their SHA-256, so no text is shuffled.
    of = F.sha2("line", 256).alias("of")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    told = parsed.select("format", of, one.alias("n"), F.when(F.col("reason").isNotNull(), one).otherwise(none).alias("bad"), none.alias("again"))
    both = told.unionByName(again.select("format", of, none.alias("n"), none.alias("bad"), one.alias("again"))).groupBy("format", "of").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "again")])
    return both.groupBy("format").agg(F.sum("n").alias("lines"), F.sum(F.least("n", "again")).alias("same"), F.sum("bad").alias("rejected"))


@query()
def prompt_rounds(spark, d):
    """Admission rounds over recorded replies: vectors are replies of ten leaves, three calls each; held against a loop by tests."""
    vectors = table(spark, d, "embeddings").select(F.concat(F.lit("l"), F.col("vec_id") % 10).alias("leaf_id"), F.col("vec_id").alias("k"), F.col("embedding").cast("array<double>").alias("v"))
    existing = vectors.where("k < 50").select("leaf_id", "v")
    replies = vectors.where("k >= 50").select("leaf_id", (F.floor(F.col("k") / 10) % 3 + 1).cast("int").alias("call"), F.col("k").cast("int").alias("k"), F.concat(F.lit("Since then, prompt number "), "k").alias("text"), "v")
    leaves = vectors.select("leaf_id").distinct().withColumn("n", F.lit(12))
    settings = admission.Admission("p", [("Ann", 2.0), ("Bob", 1.0)], [("question", 1.0), ("command", 1.0)], 10.0, 0.2, 0.3)
    return admission.admitted(leaves, existing, replies, settings)[1]


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as rows that answer every second of as many prompts, pairs of every seventh, nodes of three of the four languages."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = documents_as_rows(docs, labels).withColumn("prompt_id", F.when(F.col("id").cast("long") % 2 == 0, F.col("id")))
    n = F.col("id").cast("long")
    verdict = F.element_at(F.array(*map(F.lit, ("chosen", "rejected", "tie"))), (n % 3 + 1).cast("int"))
    none = F.lit(None)
    judge = F.when(n % 5 > 0, F.struct((n % 5).cast("double").alias("score"), none.alias("criteria"), F.lit("").alias("rationale"), verdict.alias("verdict"))).cast(schema.JUDGE)
    pairs = rows.where(n % 7 == 0).select("id", "project_id", F.col("id").alias("row_id"), none.cast("string").alias("run_id"), F.lit("weaker").alias("strategy"), F.concat(F.lit("f"), n % 4).alias("flaw"), "model_slug", F.when(n % 3 == 2, "tie").otherwise("judged").alias("status"), F.col("messages").alias("rejected_messages"), judge.alias("judge"), "created_at")
    nodes = docs.select(F.col("lang").alias("id")).distinct().where("id <> 'es'").select("id", F.upper("id").alias("label"))
    return rows, pairs, nodes


@query("""
    WITH r AS (SELECT lang, source, CASE WHEN toxic = 1 THEN 'refusal' ELSE '' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
    SELECT 'rows' AS kind, NULL AS model_slug, lang AS leaf_id, CASE WHEN lang <> 'es' THEN upper(lang) END AS leaf_label, count(*) AS n FROM r GROUP BY lang
    UNION ALL
    SELECT 'refusals', source, lang, CASE WHEN lang <> 'es' THEN upper(lang) END, count(*) FROM r WHERE status = 'refusal' GROUP BY source, lang
""")
def counts_by_leaf(spark, d):
    """Rows, and refusals by model, of every leaf with its label; a leaf that is gone keeps its rows and has none."""
    rows, _, nodes = _stored(spark, d)
    own = views.rows_by_leaf(rows, nodes).select(F.lit("rows").alias("kind"), F.lit(None).cast("string").alias("model_slug"), "leaf_id", "leaf_label", F.col("count").alias("n"))
    return own.unionByName(views.refusals_by_leaf(rows, nodes).select(F.lit("refusals").alias("kind"), "model_slug", "leaf_id", "leaf_label", F.col("count").alias("n")))


@query("""
    WITH r AS (SELECT d.doc_id AS n, CASE WHEN quality = 1 THEN 4.5 WHEN quality = 0 THEN 1.5 END AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
         p AS (SELECT n, n % 3 = 2 AS tie, n % 5 > 0 AS judged FROM r WHERE n % 7 = 0)
    SELECT (SELECT count(score) FROM r)::BIGINT AS judged_rows, (SELECT count_if(score < 3) FROM r)::BIGINT AS low_count, count_if(tie)::BIGINT AS ties,
           count_if(judged AND n % 3 = 1)::BIGINT AS flipped, count_if(judged)::BIGINT AS judged_pairs, true AS same_family_warning, 'meta' AS judge_family FROM p
""")
def judge_board(spark, d):
    rows, pairs, _ = _stored(spark, d)
    teachers = spark.createDataFrame([("meta-llama/llama-3.1-8b-instruct",), ("openai/gpt-4o",)], "slug string")
    return views.judge_summary(rows, pairs, teachers, "meta/judge").select("judged_rows", "low_count", "ties", "flipped", "judged_pairs", "same_family_warning", "judge_family")


@query("""
    WITH d AS (SELECT d.doc_id AS n, length(text) AS c, CASE WHEN toxic = 1 THEN 'refusal' WHEN quality = 0 THEN 'flagged' WHEN quality = 1 THEN 'accepted' ELSE 'draft' END AS status,
                      quality IS NULL AS unjudged FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
         a AS (SELECT 'responses' AS stage, count(*) AS calls, floor(avg(c) + 3)::BIGINT AS chars, 600 AS out FROM d WHERE n % 2 = 1
               UNION ALL SELECT 'preferences', count(*), floor(avg(2 * c) + 500)::BIGINT, 600 FROM d WHERE status IN ('draft', 'accepted') AND n % 7 <> 0
               UNION ALL SELECT 'judge', count(*), floor(avg(c) + 900 + 5)::BIGINT, 400
                         FROM (SELECT c FROM d WHERE unjudged AND status <> 'refusal' UNION ALL SELECT 2 * c + 800 FROM d WHERE n % 7 = 0 AND n % 5 = 0))
    SELECT stage, calls, (calls * (chars // 4))::BIGINT AS est_tokens_in, (calls * floor(out * 0.6))::BIGINT AS est_tokens_out, calls > 0 AS over_cap FROM a
    UNION ALL
    SELECT 'filters', ceil(count(*) / 64)::BIGINT, floor(sum(c) / 4)::BIGINT, 0, count(*) > 0 FROM d WHERE status IN ('draft', 'accepted', 'edited', 'flagged') AND n % 9 <> 0
""")
def stage_plans(spark, d):
    """Work and estimates of four stages over documents as stored rows."""
    rows, pairs, _ = _stored(spark, d)
    prompts = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("leaf_id"), "text", F.lit("active").alias("status"), F.col("doc_id").cast("double").alias("created_at"))
    budget, slug = planners.Budget("brief", 1.0, 1.0), "openai/gpt-4o"
    plans = {
        "responses": planners.response_plan(prompts, rows, slug, 600, budget, "sys"),
        "preferences": planners.pair_plan(rows, pairs, slug, 600, budget),
        "judge": planners.judge_plan(rows, pairs, slug, 600, budget),
        "filters": planners.embedding_plan(rows, rows.where(F.col("id").cast("long") % 9 == 0).select("id"), slug, budget),
    }
    out = None
    for stage, (_, estimate) in plans.items():
        row = estimate.select(F.lit(stage).alias("stage"), "calls", "est_tokens_in", "est_tokens_out", "over_cap")
        out = row if out is None else out.unionByName(row)
    return out


@query("""
    SELECT p_partkey AS id, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS place FROM part
""")
def collated_order(spark, d):
    """The place of every part by its name as a reader sorts it (names of one case, so SQL's order is the same)."""
    from weftline.operators.dedup import numbered

    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.collate(F.lower("p_name"), "UNICODE").alias("name"))
    return numbered(parts, ["name", "id"]).select("id", (F.col("n") + 1).alias("place"))


@query("""
    WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders)
    SELECT o_orderkey AS id, ['a/x', 'b/y', 'c/z'][n % 3 + 1] AS teacher, CASE WHEN n % 3 = 1 THEN 'east' END AS provider FROM o
""")
def teachers_in_turn(spark, d):
    """A teacher for each order as a prompt, in turns by age and id, with the slot that serves it."""
    ensemble = [choices.Slot("a/x"), choices.Slot("b/y", provider="east"), choices.Slot("c/z")]
    prompts = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_at"))
    return choices.with_slot(choices.teachers(prompts, ensemble, "p"), ensemble).select("id", "teacher", F.col("slot.provider").alias("provider"))


@query("""
    SELECT event_id AS target_id, CASE WHEN event_id % 6 < 3 THEN user_id WHEN event_id % 6 = 3 THEN event_id END AS n,
           CASE event_id % 6 WHEN 0 THEN 'json_schema' WHEN 5 THEN NULL ELSE 'plain' END AS mode, event_id % 6 = 3 AS repaired,
           CASE event_id % 6 WHEN 3 THEN 3 WHEN 4 THEN 3 WHEN 5 THEN 0 ELSE 1 END::BIGINT AS cost,
           CASE event_id % 6 WHEN 4 THEN 'did not validate after repair' WHEN 5 THEN 'status 500' END AS error
    FROM events
""")
def structured_replies(spark, d):
    """Recorded calls for structured replies: some refused in a mode, some repaired, some beyond repair."""
    n, user = F.col("event_id"), F.col("user_id")
    call = lambda mode, status, reply, cost: F.struct(F.lit(mode).alias("mode"), F.lit(status).cast("int").alias("status"), reply.alias("reply"), F.lit(cost).cast("double").alias("cost_usd"))
    told, none = F.concat(F.lit('Here it is: {"n": '), user, F.lit("}")), F.lit(None).cast("string")
    own = F.concat(F.lit('{"n": '), n, F.lit("}"))
    calls = (
        F.when(n % 6 == 0, F.array(call("json_schema", 200, told, 1)))
        .when(n % 6 < 3, F.array(call("plain", None, told, 1), call("json_schema", 400, none, 0)))
        .when(n % 6 == 3, F.array(call("plain", 200, F.lit("n is this"), 1), call("repair", 200, own, 2)))
        .when(n % 6 == 4, F.array(call("plain", 200, F.lit("n is this"), 1), call("repair", 200, F.lit("still"), 2)))
        .otherwise(F.array(call("json_schema", 500, none, 0), call("plain", 200, told, 1)))
    )
    rows = table(spark, d, "events").select(n.alias("target_id"), F.explode(calls).alias("c")).select("target_id", "c.*")
    out = choices.structured_outcomes(rows, "struct<n:bigint>")
    return out.select("target_id", F.col("value.n").alias("n"), "mode", "repaired", F.col("cost_usd").cast("long").alias("cost"), "error")


# --- the cascade where every rule fires ---------------------------------------------------------

#: Answers that stand in for the texts of some documents: by doc_id modulo 17, so that refusals, hedged and solid ones occur.
ANSWERS = (
    "I can't help with that request because it asks for things that go well beyond what is allowed here today.",
    "I'm sorry, but I can not say more on this matter to you here. However, the rest of the plan is fine and works for all.",
    "I cannot assist with this, but here is what you can do instead: read the manual with care and try it again.",
    "I won't; run `ls` in that folder and see what it shows you then.",
    "As an AI",
    "Sure. I am unable to do it. But fine.",
    "The plan is this. I'm not able to see it, and that is for the best of all of us in the end.",
)


def _answered(docs: DataFrame) -> DataFrame:
    n = F.col("doc_id") % 17
    text = F.col("text")
    for k, answer in enumerate(ANSWERS):
        text = F.when(n == k, F.concat(F.lit(answer), F.lit("" if k == 4 else " Case "), F.lit("") if k == 4 else F.col("doc_id").cast("string"))).otherwise(text)
    return docs.withColumn("text", text)


_QUOTED = [a.replace("'", "''") for a in ANSWERS]
#: The whole rule of refusals: the first pattern in order, in the first sentence or in a short answer anywhere, no hedge after it, no substance.
_FIRST = [f"WHEN regexp_matches({{0}}, '(?i){p}') THEN substr({{0}}, strpos({{0}}, regexp_extract({{0}}, '(?i){p}')) + length(regexp_extract({{0}}, '(?i){p}')))" for p in sql.REFUSES]
_AFTER = f"CASE {' '.join(_FIRST)} END"
_BASE = f"""
    a AS (SELECT doc_id, CASE doc_id % 17 {' '.join(f"WHEN {k} THEN '{q}'" + ('' if k == 4 else " || ' Case ' || doc_id") for k, q in enumerate(_QUOTED))} ELSE coalesce(text, '') END AS t FROM documents),
    s AS (SELECT doc_id, t, trim(t) AS u, len(regexp_extract_all(t, '\\S+')) AS words,
                 nullif(regexp_extract(trim(t), '(?s)^(.*?[.!?])\\s', 1), '') AS by_mark, nullif(regexp_extract(trim(t), '(?s)^(.*?)\\n', 1), '') AS by_line FROM a),
    f AS (SELECT *, CASE WHEN by_mark IS NULL THEN coalesce(by_line, u) WHEN by_line IS NULL OR length(by_mark) < length(by_line) THEN by_mark ELSE by_line END AS one FROM s),
    g AS (SELECT *, coalesce({_AFTER.format("one")}, CASE WHEN words < 12 THEN {_AFTER.format("u")} END) AS after FROM f),
    b AS (SELECT doc_id, doc_id::VARCHAR AS id, t, u = '' OR after IS NOT NULL AND NOT regexp_matches(after, '(?i)\\b(but|however|though|although|that said|instead)\\b') AND NOT {sql.SOLID} AS refused FROM g)
"""
_ALL_RULES = sql.removals(_BASE, 0.35, "refused")


@query(f"WITH RECURSIVE {_ALL_RULES} SELECT id, rule, reason FROM removed")
def cascade_all_rules(spark, d):
    """The cascade over documents some of which refuse, with vectors at a threshold that has pairs: all six rules remove rows."""
    from weftline.operators import curation

    rows = documents_as_rows(_answered(table(spark, d, "documents")))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return curation.removals(rows, curation.FilterConfig(near_dup_threshold=0.35), vectors)
