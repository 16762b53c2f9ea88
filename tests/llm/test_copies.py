"""Near copies against a plain version, over planted copies of every similarity, null ids and repeated ids."""

import itertools
import random
from collections import defaultdict

import numpy as np

import corpus_pipeline as P
from tests.llm import fixtures as X
from weftline.llm import simhash


def plain_sets(docs):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words = [X.WORDS.findall(low(t)) for _, t in docs]
    return [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def alike(a, b):
    return 10 * len(a & b) >= 8 * len(a | b)


def survivors(docs):
    sets = plain_sets(docs)
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    root = list(range(len(docs)))
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if alike(sets[i], sets[j]):
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    first = {}
    for i in order:
        first.setdefault(root[i], docs[i])
    return first.values()


def planted(seed=3):
    """Originals and copies with words changed here and there, from almost equal to just too different."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs = []
    for k in range(24):
        own = [word() for _ in range(200)]
        docs.append((1000 + 10 * k, " ".join(own)))
        for j, changes in enumerate((1, 2, 3, 4, 5)):
            new = list(own)
            for at in rng.sample(range(200), changes):
                new[at] = word()
            docs.append((1001 + 10 * k + j, " ".join(new)))
    return docs


def test_planted_copies(spark):
    docs = planted()
    sets = plain_sets(docs)
    shares = [len(sets[i] & sets[i - i % 6]) / len(sets[i] | sets[i - i % 6]) for i in range(len(docs)) if i % 6]
    assert min(shares) < 0.8 and sum(0.8 <= s <= 0.97 for s in shares) > 60
    got = {r["doc_id"] for r in P.near_duplicate_stage(spark, X.table(spark, docs), "").collect()}
    assert got == {k for k, _ in survivors(docs)}


def test_large_group_and_strays_around_it(spark):
    """One text's many near copies and strays just too different, some of them like a single copy only."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))

    def changed(own, changes):
        new = list(own)
        for at in rng.sample(range(len(own)), changes):
            new[at] = word()
        return new

    base = [word() for _ in range(200)]
    copies = [changed(base, 1) for _ in range(300)]
    strays = [changed(base, rng.randint(4, 9)) for _ in range(120)] + [changed(rng.choice(copies), 4) for _ in range(60)]
    docs = [(k, " ".join(w)) for k, w in enumerate(rng.sample(copies + strays, len(copies + strays)), 1)]
    left = {k for k, _ in survivors(docs)}
    assert len(left) > 30
    got = {r["doc_id"] for r in simhash.without_copies(X.table(spark, docs)).collect()}
    assert got == left


def test_joined_sets_join_what_all_pairs_join():
    rng = random.Random(2)
    for _ in range(40):
        base = rng.sample(range(10_000), 60)
        sets = [np.array(sorted(set(rng.sample(base, rng.randint(40, 60))) | set(rng.sample(range(10_000), rng.randint(0, 6)))), np.uint64) for _ in range(30)] + [np.zeros(0, np.uint64)]
        roots = np.array([rng.randint(0, 25) for _ in sets])
        plain, got = ({r: {r} for r in roots.tolist()} for _ in range(2))

        def join(groups, a, b):
            if groups[a] is not groups[b]:
                groups[a] |= groups[b]
                for r in groups[b]:
                    groups[r] = groups[a]

        for i, j in itertools.combinations(range(len(sets)), 2):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if (a or b) and alike(a, b):
                join(plain, roots[i], roots[j])
        edges = simhash.joined_sets(np.arange(len(sets)), roots, sets, 0.8)
        for i, j in edges:
            assert alike(set(sets[i].tolist()), set(sets[j].tolist()))
            join(got, roots[i], roots[j])
        assert len(edges) < len(set(roots.tolist())) and plain == got


def test_awkward_documents(spark):
    docs = X.corpus()
    got = {r["doc_id"] for r in simhash.without_copies(X.table(spark, docs)).collect()}
    assert got == {k for k, _ in survivors(docs)}
    assert simhash.without_copies(X.table(spark, docs).limit(0)).count() == 0


def test_rows_without_an_id_stay_apart(spark):
    (_, a), (_, copy), *_ = planted()
    b, c = planted(4)[0][1], planted(5)[0][1]
    rows = [(None, a), (None, copy), (None, b), (5, b), (7, c), (7, a[::-1]), (None, b)]
    left = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.without_copies(X.table(spark, rows)).collect())
    assert len(left) == 4 and [k for k, _ in left] == [0, 5, 7, 7]
    assert {t for _, t in left} - {a, copy} == {b, c, a[::-1]}


def test_keys_lose_no_pair(spark):
    """All pairs of a key are either pairs at once or in a key kept for the second look; only keys of few nodes are not kept."""
    rng = random.Random(5)
    bits, words = 6, 2
    masks = simhash.covering_masks(simhash.RADIUS, 2 * bits)
    wide = {k: [rng.getrandbits(63) for _ in range(words)] for k in range(300)}
    nodes = spark.createDataFrame(list(wide.items()), "id long, wide array<long>").repartition(3)
    keys = defaultdict(set)
    for k, w in wide.items():
        for j, mask in itertools.product(range(words), range(len(masks))):
            keys[j, mask, w[j] & masks[mask]].add(k)
    together = {pair for own in keys.values() for pair in itertools.combinations(sorted(own), 2)}
    rows = simhash.met(nodes, bits, words, len(wide)).collect()
    pairs = {(r["a"], r["b"]) for r in rows if r["kind"] == 0}
    kept = defaultdict(set)
    for r in rows:
        if r["kind"] == 1:
            kept[r["a"]].add(r["b"])
    assert {len(own) for own in keys.values()} & set(range(2, simhash.FEW + 1))
    assert sorted(map(sorted, kept.values())) == sorted(sorted(own) for own in keys.values() if len(own) > simhash.FEW)
    assert pairs <= together == pairs | {pair for own in kept.values() for pair in itertools.combinations(sorted(own), 2)}
    assert pairs >= {pair for own in keys.values() if len(own) <= simhash.FEW for pair in itertools.combinations(sorted(own), 2)}


def test_a_node_of_large_keys_gives_one_pair_at_first(spark):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 2, dtype=np.int64)
    # 200 fingerprints a few bits apart share very many keys with very many different least ids.
    wide = [[int(w) ^ sum(1 << int(b) for b in rng.integers(0, 62, 6)) for w in base] for _ in range(200)]
    nodes = spark.createDataFrame([(i, x) for i, x in enumerate(wide)], "id long, wide array<long>")
    shared = simhash.met(nodes, 24, 2, len(wide))
    stars = [tuple(r) for r in simhash.starred(shared).collect()]
    large = {r["b"] for r in shared.where("kind = 1").collect()}
    assert len(stars) == len({b for _, b in stars}) and 100 < len(stars) < len(large) and all(a < b for a, b in stars)
    # All that share a large key are still to be looked at.
    keys: dict[int, list[int]] = {}
    for r in shared.where("kind = 1").collect():
        keys.setdefault(r["a"], []).append(r["b"])
    assert all(len(set(x)) == len(x) > simhash.FEW for x in keys.values())
    assert len(stars) < len({(min(x), b) for x in keys.values() for b in x if b != min(x)})
    pairs = shared.where("kind = 0").select("a", "b").distinct().count()
    assert pairs <= 1.5 * sum(1 for _ in wide) * 30
