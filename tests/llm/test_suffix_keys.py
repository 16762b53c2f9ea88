"""Repeated strings where doc_id names no text: several null ids, and ids with several texts."""

import random

import pytest
from tests.llm import fixtures as X
from weftline.llm import suffix

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def cases(*ids):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("abcdefghij", k=n))
    passage, other = text(600), text(450)
    texts = [text(2000) + passage, passage[:450] + text(30), text(900) + other + text(700), text(500), text(50) + other, text(3000), passage[100:] + text(200), text(20)]
    return [(ids[i % len(ids)], t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("ids", [(None,), (None, 4, 4), (None, LEAST, MOST), (LEAST, 3, MOST), (7, MOST)])
@pytest.mark.parametrize("large", [suffix.LARGE, 2])
def test_rows_with_the_same_id(spark, ids, large):
    rows = cases(*ids)
    want = X.removed_bytes(list(enumerate(t for _, t in rows)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix.deduplicated(docs, digests=True, group_bytes=1 << 12, large=large).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((k, *want[i])) for i, (k, _) in enumerate(rows))


def test_rows_keep_their_own_columns(spark):
    rows = [(k, t, f"s{i}") for i, (k, t) in enumerate(cases(None, 4, 4))]
    rows += [(*rows[3][:2], "again"), (9, "short", "x"), (9, "short", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["source"]: (r["doc_id"], len(r["text"])) for r in suffix.deduplicated_texts(docs).collect()}
    want = X.removed_bytes(list(enumerate(t for _, t, _ in rows)))
    assert got == {s: (k, want[i][0] - want[i][1]) for i, (k, _, s) in enumerate(rows)}
