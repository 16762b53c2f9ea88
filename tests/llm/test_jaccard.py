"""The Jaccard join against all pairs, whatever its blocks; overlaps derived from a similar set's answers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures as X
from weftline.llm import jaccard


def shingles(text, k=3):
    w = X.WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def plain(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            least[top(k)] = min(d, least.get(top(k), d))
    return sorted(((d, len(sets[k]), least.get(top(k)) if sets[k] else d) for k, (d, _) in enumerate(docs)), key=repr)


def near_copies(seed, base, copies, edits):
    """Copies of one text with a few words changed each, and strays with more changes."""
    rng = random.Random(seed)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(base)]
    out = []
    for _ in range(copies):
        own = list(words)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(base)] = f"e{rng.randint(0, 10**9)}"
        out.append(" ".join(own))
    return out


DOCS = [*X.corpus(), *((2000 + k, t) for k, t in enumerate(near_copies(1, 120, 60, 9) + near_copies(2, 40, 30, 3)))]
DOCS += [(3000, " ".join(f"v{k}" for k in range(11))), (3001, " ".join(f"v{k}" for k in range(12))), (3002, "V0 v1"), (3003, "v0  V1\n"), (3004, "v1 v0"), (None, "v0 v1"), (None, "alone once"), (3003, "v0  V1\n")]


def rows(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("block", "block_bytes"), [(512, 4 << 20), (6, 4 << 20), (512, 3000)])
def test_join_equals_all_pairs(spark, block, block_bytes):
    table = X.table(spark, DOCS, **{c: F.lit("x") for c in ("digest", "node", "root", "list", "n", "id")})
    assert rows(jaccard.joined(table.repartition(3), block=block, block_bytes=block_bytes)) == plain(DOCS)


def test_groups_and_buckets(spark, monkeypatch):
    """Many groups of texts and buckets of shingles give what one gives."""
    found = jaccard.described(X.table(spark, DOCS).repartition(4), 3, 90, 2000, 1500)
    whole = jaccard.described(X.table(spark, DOCS), 3, 90, 1 << 30, 1 << 30)
    key = lambda df: sorted((bytes(r["digest"]), bytes(r["node"]), r["n"], r["tokens"], r["places"], r["words"]) for r in df.collect())
    assert key(found) == key(whole)


def test_nothing(spark):
    df = jaccard.joined(spark.createDataFrame([], "doc_id long, text string"))
    assert df.count() == 0 and df.columns == ["doc_id", "n_shingles", "component_id"]
    assert rows(jaccard.joined(spark.createDataFrame([(4, None), (2, ""), (2, "a")], "doc_id long, text string"))) == [(2, 0, 2), (2, 1, 2), (4, 0, 4)]


@pytest.mark.parametrize("seed", range(6))
def test_forest_joins_what_all_pairs_join(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 60, 80, np.uint64)
    sets = []
    for k in range(70):
        own = base.copy() if k % 3 else rng.integers(0, 1 << 60, 80, np.uint64)
        at = rng.integers(0, 80, rng.integers(0, 8))
        own[at] = rng.integers(0, 1 << 60, len(at), np.uint64)
        sets.append(np.unique(own[: rng.integers(70, 81)]))
    sizes = np.array([len(s) + rng.integers(0, 2) for s in sets])
    left, right = (np.arange(70), np.arange(70)) if seed % 2 else (np.arange(40), np.arange(40, 70))
    root = {k: k for k in range(70)}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    want = {k: k for k in range(70)}
    for a in left.tolist():
        for b in right.tolist():
            both = len(np.intersect1d(sets[a], sets[b]))
            if a != b and 100 * both >= 90 * (sizes[a] + sizes[b] - both):
                root[top(a)] = top(b)
    want = {frozenset(x for x in range(70) if top(x) == top(k)) for k in range(70)}
    edges = jaccard.forest(np.arange(70), sizes, sets, left, right)
    root = {k: k for k in range(70)}
    for a, b in edges:
        assert top(a) != top(b)
        root[top(a)] = top(b)
    assert {frozenset(x for x in range(70) if top(x) == top(k)) for k in range(70)} == want


def test_shingle_hashes_are_equal_where_the_words_are():
    import pyarrow as pa

    texts = [t for _, t in DOCS] + ["a b", "A  B", "a\tb c", "a b\nC d", "", None, "ab c", "x" * 3000 + " y z", "X" * 3000 + " y z", "é É z", "a"]
    found = list(jaccard.shingle_sets(pa.array(texts, pa.string()), 3))
    names = {}
    for text, hashes in zip(texts, found):
        own = shingles(text)
        assert len(own) == len(hashes)
        if len(own) == 1:
            assert names.setdefault(next(iter(own)), hashes[0]) == hashes[0]
    for i, a in enumerate(texts):
        for j in range(i):
            assert len(np.intersect1d(found[i], found[j])) == len(shingles(a) & shingles(texts[j]))
