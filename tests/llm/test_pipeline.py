"""The corpus pipeline, stage by stage, against the plain versions."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm import fixtures as X
from tests.llm.test_copies import survivors
from weftline.llm import pii
from weftline.llm.common import written


def test_stages(spark):
    docs = X.table(spark, X.corpus()).select("doc_id", "text", "lang", "source", "n_chars")
    held = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns = docs.columns
    for name, stage in P.STAGES:
        new = written(stage(spark, docs, ""), name)
        rows = {r["doc_id"]: r.asDict() for r in new.collect()}
        if name != "packing":
            assert new.columns == columns
            assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
        if name == "language":
            assert set(rows) == {k for k, t in held.items() if t and any(c.isalpha() for c in t)}
        elif name == "near_duplicates":
            assert set(rows) == {k for k, _ in survivors(list(held.items()))}
        elif name == "repeated_passages":
            want = X.removed_bytes(list(held.items()), 256)
            assert set(rows) == set(held)
            assert all(r["text"] == held[k] for k, r in rows.items() if want[k][1] == 0)
            assert all(len(r["text"].encode()) <= want[k][0] - want[k][1] for k, r in rows.items())
        elif name == "personal_data":
            assert all(not pii.base_spans(r["text"]) for r in rows.values())
        else:
            assert set(rows) == set(held)
        held = {k: r.get("text") for k, r in rows.items()}
        docs = new


def test_empty_table(spark, tmp_path):
    X.table(spark, [(1, "x")]).select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


CLASHES = ("score", "known", "lang_pred", "base", "spans", "fp", "_k", "_hash", "_id", "_left", "_text", "_kept", "_lang", "_found", "kept", "node", "n", "wide", "id", "grp", "a.b", "_column_0")


def test_columns_of_any_name_come_out_unchanged(spark):
    rows = [r for r in X.corpus() if r[1]]
    docs = X.table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.select("*", *[F.concat(F.lit(f"{c} of "), "doc_id").alias(c) for c in CLASHES])
    for name, stage in P.STAGES[:-1]:
        new = written(stage(spark, docs, ""), name)
        assert new.columns == docs.columns
        assert new.count() and all(r[c] == f"{c} of {r['doc_id']}" for r in new.collect() for c in CLASHES)
        docs = new
