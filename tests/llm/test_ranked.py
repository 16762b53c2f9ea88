"""Ranked search against scoring every document, whatever the segments, blocks and short lists."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures as X
from weftline.llm import ranked


def plain(items, docs, top=10):
    counts = [(d, Counter(ranked.terms_of(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(ranked.terms_of(text)) if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=repr)


DOCS = [*X.corpus(), (None, "alpha beta"), (None, "alpha"), (5000, "Alpha alpha BETA-beta é"), (5000, "Alpha alpha BETA-beta é")]


def items():
    rng = random.Random(4)
    words = [w for _, t in DOCS for w in (t or "").split()[:30]]
    return [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for k in range(25)] + [(90, None), (91, ""), (92, "zzzz qqqq"), (93, "ALPHA beta; alpha"), (93, "é"), (94, "日本語")]


@pytest.mark.parametrize(("segment_bytes", "short", "block", "query_bytes"), [(8 << 20, 256, 128, 4 << 20), (3000, 2, 4, 4 << 20), (20_000, 0, 8, 500), (3000, 1000, 4, 1500)])
def test_ranked_equals_scoring_all(spark, segment_bytes, short, block, query_bytes):
    clash = {c: F.lit("x") for c in ("item_id", "query", "rank", "score", "terms", "part", "lengths")}
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns(clash).repartition(3)
    asked = spark.createDataFrame(items(), "item_id long, text string").withColumns({c: F.lit("x") for c in ("doc_id", "part", "size", "query_text")})
    want = plain(items(), DOCS)
    assert rows(ranked.ranked(asked, docs, segment_bytes=segment_bytes, short=short, block=block, query_bytes=query_bytes)) == want


def test_ties_and_nothing(spark):
    docs = spark.createDataFrame([(40 - k, "same words here") for k in range(30)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "words same")], "item_id long, text string")
    assert [r[2] for r in sorted(rows(ranked.ranked(asked, docs)), key=lambda r: r[1])] == list(range(11, 21))
    more = docs.union(spark.createDataFrame([(k, "other") for k in range(100, 200)], docs.schema))
    got = sorted(rows(ranked.ranked(asked, more, segment_bytes=60, short=2, block=2)), key=lambda r: r[1])
    assert [r[2] for r in got] == list(range(11, 21)) and [r[1] for r in got] == list(range(1, 11))
    assert ranked.ranked(asked, docs.limit(0)).count() == 0 and ranked.ranked(asked.limit(0), docs).count() == 0
    assert ranked.ranked(asked, docs.limit(0)).dtypes == ranked.ranked(asked, more).dtypes
