"""The core queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.messages import assistant_text, conversation_text, first_user_text, last, transcript, user_text, validate_messages, validate_row
from weftline.functions.templates import chatml, gemma, llama, template_issue
from weftline.operators import curation, dedup, formats, ledger, preferences, rows as R, sampling, scoring, stats, taxonomy
from weftline.sources.adapters import conversation_rows, documents_as_rows, event_calls
from weftline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return documents_as_rows(_docs(spark, d), table(spark, d, "labels"))


def _talks(spark: SparkSession, d: str) -> DataFrame:
    return conversation_rows(table(spark, d, "conversations"))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return event_calls(table(spark, d, "events"))


# --- curation ---------------------------------------------------------------------------------


@query
def exact_dup(spark, d):
    docs = _docs(spark, d).select("doc_id", "text")
    return dedup.exact_dup(docs, "text", ["doc_id"], "doc_id").withColumn("reason", F.concat(F.lit("identical to "), F.col("first_id").cast("string")))


@query
def pii_scan(spark, d):
    kinds = T.pii_kinds("text")
    return _docs(spark, d).select("doc_id", F.array_join(kinds, ", ").alias("kinds")).where("kinds <> ''")


@query
def public_ip_list(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(T.public_ips("text")).alias("ip"))


@query
def length_bounds(spark, d):
    n = F.length(F.coalesce("text", F.lit("")))
    return _docs(spark, d).select("doc_id", n.cast("long").alias("chars")).where((F.col("chars") < 40) | (F.col("chars") > 12_000))


@query
def language_en(spark, d):
    return _docs(spark, d).where(~T.looks_english("text")).select("doc_id", "lang")


@query
def refusal_scan(spark, d):
    return _docs(spark, d).select("doc_id", T.is_refusal(F.lit("Tell me all that you know about this subject, please, in order."), F.col("text")).alias("refused")).where("refused").select("doc_id")


@query
def secret_scan(spark, d):
    return _docs(spark, d).agg(F.count_if(T.has_secret("text")).alias("with_secret"), F.count(F.lit(1)).alias("docs"))


def _removed(spark, d):
    rows = documents_as_rows(_docs(spark, d))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows, curation.removals(rows, vectors=vectors)


@query
def filter_cascade(spark, d):
    return _removed(spark, d)[1]


@query
def filter_summary(spark, d):
    return curation.summary(_removed(spark, d)[1])


@query
def filter_marked(spark, d):
    rows, removed = _removed(spark, d)
    return stats.counts(curation.marked(rows, removed).select("status", F.coalesce("prev_status", F.lit("")).alias("prev_status"), F.array_join("metadata.flags", ",").alias("flags")), "status", "prev_status", "flags")


@query
def filter_restored(spark, d):
    rows, removed = _removed(spark, d)
    marked = curation.marked(rows, removed)
    return stats.status_counts(curation.restored(marked, removed.where("rule = 'length'").select("id")))


@query
def near_dup(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return dedup.near_dup(vectors, 0.35, ["id"]).select("id", "partner_id")


@query
def prompt_dup_mask(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    old, new = vectors.where("n % 2 = 0"), vectors.where("n % 2 = 1")
    return dedup.dup_mask(new, old, 0.35, "label").select("n", "label", "dup")


@query
def embedding_batches(spark, d):
    rows = documents_as_rows(_docs(spark, d))
    have = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"))
    return curation.embedding_plan(rows, have).select("batch", F.size("ids").cast("long").alias("rows"), "tokens")


@query
def compact_vectors(spark, d):
    v = dedup.compact(F.col("embedding"), 16, 4)
    return table(spark, d, "embeddings").select("vec_id", F.size(v).cast("long").alias("dims"), F.size(F.filter(v, lambda x: F.abs(x) > 0.10005)).cast("long").alias("large"))


# --- conversations ----------------------------------------------------------------------------


@query
def conversation_assemble(spark, d):
    m = F.col("messages")
    return _talks(spark, d).select("conv_id", F.size(m).cast("long").alias("turns"), user_text(m).alias("user_text"), assistant_text(m).alias("assistant_text"), first_user_text(m).alias("first_user"))


@query
def conversation_hash(spark, d):
    return _talks(spark, d).select("conv_id", T.fingerprint(conversation_text(F.col("messages"))).alias("sha"))


@query
def validate_structure(spark, d):
    return _talks(spark, d).select("conv_id", F.array_join(validate_row(F.col("messages")), "; ").alias("issues"))


@query
def validate_edit(spark, d):
    return _talks(spark, d).select("conv_id", F.size(validate_messages(F.col("messages"))).cast("long").alias("issues"))


def _ended(spark, d):
    return _talks(spark, d).where((last(F.col("messages"))["role"] == "assistant"))


@query
def format_alpaca(spark, d):
    instruction, said, output = formats.alpaca_parts(F.col("messages"))
    return _ended(spark, d).select("conv_id", instruction.alias("instruction"), said.alias("input"), output.alias("output"))


@query
def format_sft(spark, d):
    return formats.formatted(_talks(spark, d), "sft")


@query
def format_tools(spark, d):
    return formats.formatted(_talks(spark, d), "tools")


@query
def format_grpo(spark, d):
    return formats.formatted(_ended(spark, d), "grpo")


@query
def format_dpo(spark, d):
    """Pairs of a conversation's first and last reply."""
    own = F.filter("messages", lambda m: m["role"] == "assistant")
    pairs = _ended(spark, d).withColumn("_own", own).where("size(_own) > 1")
    pairs = pairs.select("metadata", F.slice("messages", F.lit(1), F.size("messages") - 1).alias("prompt"), F.slice("_own", F.size("_own"), F.lit(1)).alias("chosen"), F.slice("_own", 1, 1).alias("rejected"))
    return formats.formatted(pairs, "dpo")


@query
def template_chatml(spark, d):
    return _talks(spark, d).select("conv_id", F.sha2(chatml(F.col("messages")), 256).alias("rendered"))


@query
def template_llama(spark, d):
    return _talks(spark, d).select("conv_id", F.sha2(llama(F.col("messages")), 256).alias("rendered"))


@query
def template_gemma(spark, d):
    return _talks(spark, d).select("conv_id", F.sha2(gemma(F.col("messages")), 256).alias("rendered"), template_issue(F.col("messages"), "gemma").isNull().alias("fine"))


@query
def transcripts(spark, d):
    return _talks(spark, d).select("conv_id", transcript(F.col("messages")).alias("shown"))


@query
def conversation_shares(spark, d):
    rows = _talks(spark, d).withColumn("model_slug", F.lit("m"))
    return stats.conversation_stats(rows).select("rows", "multi_turn", "multi_share")


# --- rows -------------------------------------------------------------------------------------


@query
def rows_page(spark, d):
    return R.page(_rows(spark, d), 3, 50, "-score").select("id", "status", "score")


@query
def rows_search(spark, d):
    return R.search(_rows(spark, d), status="draft,accepted", q="license", text=F.col("messages")[0]["content"]).select("id", "status")


@query
def rows_flagged(spark, d):
    return R.search(_rows(spark, d), flag="low_quality", max_score=3.0).select("id", "score")


@query
def status_counts(spark, d):
    return stats.status_counts(_rows(spark, d))


@query
def flag_counts(spark, d):
    return stats.flag_counts(_rows(spark, d))


@query
def leaf_counts(spark, d):
    return stats.counts(_rows(spark, d), "leaf_id").orderBy(F.desc("n"), "leaf_id")


@query
def refusal_rollups(spark, d):
    return stats.refusal_rollups(_rows(spark, d))


@query
def refusal_matrix(spark, d):
    return stats.refusal_matrix(_rows(spark, d), "model_slug", "leaf_id")


@query
def review_totals(spark, d):
    return stats.review_totals(_rows(spark, d))


@query
def export_gate(spark, d):
    rows = _rows(spark, d)
    on, off = R.selected_rows(rows, 3.0, True), R.selected_rows(rows, 3.0, False)
    return on.agg(F.count(F.lit(1)).alias("kept_on")).join(F.broadcast(off.agg(F.count(F.lit(1)).alias("kept_off"), F.count_if(F.array_contains("metadata.flags", "low_score")).alias("low"))))


@query
def breakdown(spark, d):
    items = _docs(spark, d).select(F.col("doc_id").alias("id"), F.col("lang").alias("leaf"), F.col("source").alias("difficulty"))
    return stats.breakdown(items.unionByName(items))


@query
def removed_counts(spark, d):
    rows, removed = _removed(spark, d)
    return stats.removed_by_rule(curation.marked(rows, removed))


@query
def anti_join_pending(spark, d):
    return _docs(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "lang")


@query
def semi_join_partial(spark, d):
    items = table(spark, d, "customer").select(F.lit("r").alias("run_id"), F.col("c_custkey").alias("target_id"), F.lit("pending").alias("status"))
    calls = table(spark, d, "orders").where("o_totalprice > 200000").select(F.lit("r").alias("run_id"), F.col("o_custkey").alias("target_id"))
    return stats.counts(ledger.crashed(items, calls), "status")


@query
def row_numbers(spark, d):
    rows = _docs(spark, d).select(F.concat_ws("-", "lang", F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("id")).where("right(id, 1) <> '7'")
    new = _docs(spark, d).select(F.col("lang").alias("prefix"), F.col("doc_id").alias("k"))
    return R.next_numbers(rows, new).select("id", "k")


@query
def teacher_round_robin(spark, d):
    names = ["a/one", "b/two", "c/three"]
    return _docs(spark, d).select("doc_id", preferences.teacher(F.col("doc_id"), names).alias("teacher"))


# --- scoring ----------------------------------------------------------------------------------


def _criteria(spark, d):
    value = lambda k: (F.pmod(F.col("o_orderkey"), F.lit(k)) % 5 + 1).cast("string")
    raw = F.create_map(*[x for i, (name, _) in enumerate(scoring.RUBRIC) for x in (F.lit(f" {name.upper()} "), value(5 + 2 * i))])
    return table(spark, d, "orders").select("o_orderkey", scoring.normalised_criteria(raw).alias("criteria"))


@query
def weighted_score(spark, d):
    return _criteria(spark, d).select("o_orderkey", scoring.weighted_score(F.col("criteria")).alias("score"))


@query
def judge_summary(spark, d):
    out = scoring.summary(weighted_score(spark, d))
    return out.select(*[F.col("histogram")[k].alias(f"b{k}") for k in range(10)], "low_count", "judged_rows", F.round("mean", 1).alias("mean"), "median")


@query
def pair_verdicts(spark, d):
    value = lambda k: (F.pmod(F.col("o_orderkey"), F.lit(k)) % 5 + 1).cast("string")
    side = lambda s: F.create_map(*[x for i, (name, _) in enumerate(scoring.RUBRIC) for x in (F.lit(name), value(s + 2 * i))])
    none = F.lit(None).cast("map<string,string>")
    pairs = table(spark, d, "orders").select("o_orderkey", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("TIE")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("verdict_ab"), (F.col("o_orderkey") % 2 == 0).alias("chosen_first"), side(5).alias("a"), side(6).alias("b"), none.alias("criteria"), F.lit(None).cast("double").alias("row_score"))
    return scoring.judged_pairs(pairs).select("o_orderkey", "verdict", "status", "score", "rejected_score", "tie_broken_by_scores")


@query
def pair_blind_order(spark, d):
    return _docs(spark, d).select("doc_id", scoring.chosen_is_a(F.lit("p"), F.col("doc_id").cast("string")).alias("chosen_first"))


@query
def split_counts(spark, d):
    split = sampling.stratified_split(_docs(spark, d).select(F.col("doc_id").alias("id"), F.col("lang").alias("stratum")), 0.05, 42)
    return stats.counts(split, "stratum", "split")


@query
def split_members(spark, d):
    return sampling.stratified_split(_docs(spark, d).select(F.col("doc_id").alias("id"), F.col("lang").alias("stratum")), 0.05, 42)


@query
def prompt_noise(spark, d):
    return sampling.noisy(_docs(spark, d).select("doc_id", "text"), "p", 0.5, "doc_id").select("doc_id", F.sha2("noisy", 256).alias("noisy"), "noise")


@query
def prompt_specs(spark, d):
    leaves = _docs(spark, d).groupBy(F.col("source").alias("leaf_id")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return sampling.specs(leaves, "p", [("admin", 3), ("novice", 1)], [("question", 60), ("command", 40)], 20.0)


# --- ledger -----------------------------------------------------------------------------------


@query
def budget_replay(spark, d):
    out = ledger.budget_replay(_calls(spark, d), 200.0, 90)
    return out.select("project_id", "calls", "stopped_after", "stopped_by")


@query
def early_abort(spark, d):
    items = _calls(spark, d).select("id", F.col("project_id").alias("run_id"), F.col("created_at").alias("finished_at"), F.when(F.col("kind").isin("click", "view"), "error").otherwise("done").alias("status"))
    return ledger.early_abort(items)


@query
def cost_ema(spark, d):
    return ledger.cost_ema(_calls(spark, d), "project_id").select("project_id", F.round("ema", 6).alias("ema"))


@query
def resume_plan(spark, d):
    items = _calls(spark, d).select("id", F.element_at(F.array(*map(F.lit, ("done", "error", "skipped", "partial", "pending"))), (F.col("id") % 5 + 1).cast("int")).alias("status"))
    return stats.counts(ledger.resume_plan(items), "status", "requeued")


@query
def latest_per_key(spark, d):
    return ledger.latest(_calls(spark, d), "project_id", "created_at", "id").select("project_id", "id", "kind")


@query
def last_events(spark, d):
    return ledger.latest(_calls(spark, d), "kind", "created_at", "id", 500).select("kind", "id")


@query
def stage_status(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("project_id"), (F.col("o_orderkey") % 6 + 1).cast("int").alias("stage"), F.element_at(F.array(*map(F.lit, ("done", "failed", "paused", "cancelled", "running"))), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("status"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_at"))
    return stats.stage_status(runs).withColumn("stage", F.col("stage").cast("long"))


@query
def next_stage(spark, d):
    return stats.next_stage(stage_status(spark, d))


@query
def price_lookup(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey"), F.when(F.col("p_partkey") % 6 == 0, "openai/gpt-4o:free").when(F.col("p_partkey") % 3 == 0, "openai/gpt-4o").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("own/"), F.col("p_size").cast("string"))).otherwise("unknown").alias("model_slug"))
    catalogue = table(spark, d, "part").groupBy("p_size").agg(F.lit(2.0).alias("price_in"), F.lit(8.0).alias("price_out")).where("p_size < 25").select(F.concat(F.lit("own/"), F.col("p_size").cast("string")).alias("id"), "price_in", "price_out")
    return ledger.with_prices(parts, catalogue)


@query
def cost_estimate(spark, d):
    plan = price_lookup(spark, d).select("p_partkey", F.lit(1234).alias("prompt_chars"), F.lit(600).alias("max_tokens"), (F.col("p_partkey") % 7).alias("calls"), "price_in", "price_out")
    return ledger.estimates(plan).select("p_partkey", "est_tokens_in", "est_tokens_out", "est_usd")


@query
def project_summary(spark, d):
    projects = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.lit(1.23456).alias("spend_usd"), F.lit(10.0).alias("budget_cap_usd"))
    nodes = table(spark, d, "supplier").select(F.col("s_nationkey").alias("project_id"), F.lit(True).alias("is_leaf"), F.lit(3).alias("rows_per_leaf"))
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("project_id"), F.when(F.col("c_acctbal") < 0, "refusal").when(F.col("c_acctbal") > 9000, "accepted").when(F.col("c_acctbal") > 8000, "filtered").otherwise("draft").alias("status"))
    pairs = table(spark, d, "supplier").select(F.col("s_nationkey").alias("project_id"))
    return stats.project_summary(projects, nodes, rows, pairs)


# --- taxonomy and text ------------------------------------------------------------------------


def _nodes(spark, d):
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    none = F.lit(None).cast("string")
    return region.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), none.alias("parent_id"), F.col("r_name").alias("label")).unionByName(nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent_id"), F.col("n_name").alias("label")))


@query
def tree_path(spark, d):
    return taxonomy.paths(_nodes(spark, d)).select("id", F.array_join("path", " / ").alias("path"))


@query
def slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slugify("p_name").alias("slug"))


@query
def unique_slugs(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.slugify("p_brand").alias("slug"), F.col("p_partkey").alias("order"))
    return taxonomy.unique_slugs(nodes).select("id", "slug")


@query
def first_sentences(spark, d):
    return _docs(spark, d).select("doc_id", F.length(T.first_sentence("text")).cast("long").alias("chars"), T.has_substance("text").alias("solid"))


@query
def similar_answers(spark, d):
    docs = _docs(spark, d).select("doc_id", "text")
    later = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return docs.join(later, "doc_id").select("doc_id", preferences.too_similar(F.col("text"), F.col("other")).alias("alike"))


@query
def event_usage(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query
def row_kinds(spark, d):
    types = F.filter(F.array(F.when(F.col("p_size") % 2 == 0, "sft"), F.when(F.col("p_size") % 3 == 0, "grpo"), F.when(F.col("p_size") % 5 == 0, "tools")), lambda t: t.isNotNull())
    return stats.counts(table(spark, d, "part").select(R.kind_of_types(types).alias("kind")), "kind")


@query
def kept_rows(spark, d):
    parts = table(spark, d, "part")
    return parts.select("p_partkey", stats.kept_count(F.col("p_size").cast("long"), F.when(F.col("p_partkey") % 4 != 0, F.lit(25).cast("long"))).alias("kept"))


@query
def adversarial_prompts(spark, d):
    prompts = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") < 0).alias("adversarial"))
    return stats.adversarial_share(prompts, "segment")


@query
def active_runs(spark, d):
    status = F.element_at(F.array(*map(F.lit, ("done", "failed", "running", "cancelled", "queued"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("project_id"), (F.col("o_orderkey") % 6 + 1).cast("long").alias("stage"), status.alias("status"), F.col("o_orderdate").alias("created_at"))
    return ledger.active_runs(runs)
