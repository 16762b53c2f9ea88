"""The filter audit against a plain count over all orders, and its pieces on awkward bytes."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm import fixtures as X
from weftline.llm import audit
from weftline.llm.common import utf8


def plain(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    facts = []
    for d, t, lang in rows:
        t = t or ""
        w = X.WORDS.findall(t)
        caps = sum("A" <= c <= "Z" for c in t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * caps > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > least[t]}
        facts.append((lang or "", {x for x, f in fails.items() if f}, d in good, d in toxic))
    out, value = {}, {}
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                redundant = sum(x in f[1] for f in own) - len(gone)
                left = [f for f in left if x not in f[1]]
                out[part, order, step] = [len(left), len(gone), redundant, sum(f[1] == {x} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                value[part, x] = value.get((part, x), 0) + len(gone)
    return {(p, o, s): (*v, value[p, o[s - 1]]) for (p, o, s), v in out.items()}


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


def test_audit_equals_plain_counts(spark):
    rng = random.Random(5)
    rows = [(d, t, rng.choice(["en", "de", None])) for d, t in X.corpus()]
    rows += [(None, rows[9][1], "en"), (None, None, "de"), (rows[9][0], rows[9][1], "en"), (900, "Ab CD# " * 60, "en"), (901, "Ab CD# " * 60, "fr"), (902, "ÀÉ " * 120, "")]
    labels = [(d, rng.randint(0, 1), rng.randint(0, 1)) for d, _, _ in rows if d and rng.random() < 0.6] + [(10**9, 1, 1), (None, 1, 1), (900, 0, 0), (900, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("part", "digest", "mask", "n", "good", "toxic", "first", "_id", "_measured", "quality")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit("x") for c in ("part", "lang", "n", "text")})
    assert found(audit.audited(docs, marks)) == plain(rows, labels)


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audited(docs, labels).count() == 0
    one = found(audit.audited(spark.createDataFrame([(1, "a b", "en")], docs.schema), labels))
    assert len(one) == 600 and one == plain([(1, "a b", "en")], [])


def measures_of(texts):
    import pyarrow as pa

    return audit.measures(*utf8(pa.array(texts, pa.string()))).tolist()


def test_measures_of_awkward_texts():
    rng = random.Random(3)
    texts = [None, "", " ", "\x0b\x0c", "a", "a a", "ab" * 2000 + " " + "ab" * 2000, "é É 🎉 🎉|", "x" * 8 + " " + "x" * 9 + " " + "x" * 8, "\x00 \x00\x00 \x00", ""]
    texts += ["".join(rng.choice("aAbB é🎉\t\n#|\x1f ") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    want = []
    for t in texts:
        t = t or ""
        w = X.WORDS.findall(t)
        want.append([len(w), len(set(w)), sum("A" <= c <= "Z" for c in t), len(t), sum(c in "#$%&*|" for c in t)])
    assert measures_of(texts) == want


def test_equal_hashes_are_verified():
    data = np.frombuffer(b"aa bb aa cc bb aa", np.uint8)
    starts = np.arange(0, 17, 3)
    for hashes in (np.zeros(6, np.uint64), None):
        assert audit.distinct_words(data, starts, starts + 2, np.array([0, 0, 0, 1, 1, 1]), 3, hashes).tolist() == [2, 3, 0]
