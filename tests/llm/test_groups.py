"""Large groups of near copies: few rows a node on the way, and every pair of nodes that share a key is looked at."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from tests.llm import fixtures as X
from tests.llm.test_copies import survivors
from weftline.llm import simhash


def test_a_large_group_makes_few_rows_a_node(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    docs = []
    for k in range(1, 241):
        own = list(base)
        for at in rng.sample(range(150), rng.randint(1, 7)):
            own[at] = word()
        docs.append((k, " ".join(own)))
    made, written = {}, simhash.written

    def counted(df, name, *more):
        out = written(df, name, *more)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "written", counted)
    got = {r["doc_id"] for r in simhash.without_copies(X.table(spark, docs)).collect()}
    assert got == {k for k, _ in survivors(docs)} and 1 < len(got) < 200
    # No list of keys with their nodes is among them.
    assert made["met"] < 10 * len(docs) and made["pairs"] < 5 * len(docs)


def test_reached():
    rng = np.random.default_rng(7)
    for n in (0, 1, 40):
        ids = np.sort(rng.choice(1000, n, replace=False))
        edges = rng.choice(ids, (n // 2, 2)) if n else np.zeros((0, 2), np.int64)
        root = dict(zip(ids.tolist(), ids.tolist()))
        for _ in range(n):
            for a, b in edges.tolist():
                root[a] = root[b] = min(root[a], root[b])
        assert simhash.reached(ids, edges).tolist() == [root[i] for i in ids.tolist()]
    chain = np.arange(500)
    assert not simhash.reached(chain, np.stack([chain[1:], chain[:-1]], axis=1)).any()


def grouped(seed=9):
    """Nodes of two groups of fingerprints some bits apart and of random ones, with components and tiles."""
    rng = np.random.default_rng(seed)
    wide = []
    for base, count, bits in ((rng.integers(0, 1 << 62, 2), 90, 4), (rng.integers(0, 1 << 62, 2), 30, 12), (None, 20, 0)):
        for _ in range(count):
            own = rng.integers(0, 1 << 62, 2) if base is None else base
            wide.append([int(w) ^ sum({1 << int(b) for b in rng.integers(0, 62, bits)}) for w in own])
    n = len(wide)
    return [(3 * i, int(r), int(s), int(t), x) for i, r, s, t, x in zip(range(n), rng.integers(0, 12, n), rng.integers(80, 130, n), rng.integers(-4, 4, n), wide)]


@pytest.mark.parametrize("entries, block", [(1 << 19, 1024), (200, 1024), (700, 20)])
def test_partners_are_all_that_share_a_key(spark, entries, block):
    """One group, hubs parted by keys, and keys that are compared block by block: the same rows as a plain look at all pairs."""
    rows, bits, words, least = grouped(), 6, 2, 0.8
    masks = simhash.covering_masks(simhash.RADIUS, 2 * bits)
    share = simhash.apart(least)
    limit = np.ceil(share * 128 + 5 * np.sqrt(share * (1 - share) * 128))
    want, keys = set(), defaultdict(set)
    for (a, ra, na, ta, wa), (b, rb, nb, tb, wb) in itertools.combinations(rows, 2):
        shared = [(w, k) for w, k in itertools.product(range(words), range(len(masks))) if not (wa[w] ^ wb[w]) & masks[k]]
        for w, k in shared:
            keys[w, k, wa[w] & masks[k]] |= {a, b}
        if shared and ra != rb and min(na, nb) >= least * max(na, nb) and sum((x ^ y).bit_count() for x, y in zip(wa, wb)) <= limit:
            want |= {(min(ta, tb), max(ta, tb), a), (min(ta, tb), max(ta, tb), b)}
    assert len(want) > 100 and max(map(len, keys.values())) > 40
    placed = spark.createDataFrame([(i, r, n, t, w, 5, len(rows)) for i, r, n, t, w in rows], "id long, root long, n int, tile long, wide array<long>, hub long, m long")
    got = [tuple(r) for r in simhash.partners(placed.repartition(3), bits, words, least, entries, block).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_are_left_to_the_groups_that_hold_both(spark):
    """Without lists of keys, each pair that shares a key is among the pairs or has both nodes in one group."""
    bits, words = 14, 2
    masks = simhash.covering_masks(simhash.RADIUS, 2 * bits)
    wide = {i: w for i, _, _, _, w in grouped(10)}
    nodes = spark.createDataFrame(list(wide.items()), "id long, wide array<long>").repartition(3)
    rows = simhash.met(nodes, bits, words, len(wide), listed=False).collect()
    assert {r["kind"] for r in rows} == {0, 2, 3}
    pairs = {(r["a"], r["b"]) for r in rows if r["kind"] == 0}
    hub = {r["b"]: r["a"] for r in rows if r["kind"] == 3}
    together = {(a, b) for a, b in itertools.combinations(wide, 2) if any(not (x ^ y) & m for x, y in zip(wide[a], wide[b]) for m in masks)}
    assert pairs and pairs < together
    assert all((a, b) in pairs or hub.get(a, -1) == hub.get(b, -2) for a, b in together)
    assert {r["b"] for r in rows if r["kind"] == 2} <= set(hub)
