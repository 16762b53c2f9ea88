"""Similar pairs of vectors by cells are exactly those of comparing all, and few comparisons where vectors cluster."""

import numpy as np
import pytest

from weftline.operators import dedup as D


def clustered(seed, clusters, each, spread, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dims))
    m = np.concatenate([c + spread * rng.standard_normal((each, dims)) for c in centres])
    m[::37] = m[0]  # copies
    m[5] = 0.0
    return m[rng.permutation(len(m))]


def table(spark, m, group=None):
    rows = [(k, v.tolist(), int(group[k]) if group is not None else 0) for k, v in enumerate(m)]
    return spark.createDataFrame(rows, "n long, v array<double>, grp int").repartition(3)


def plain(m, threshold, group=None):
    size = np.linalg.norm(m, axis=1, keepdims=True)
    u = m / np.where(size == 0, 1, size)
    sims = u @ u.T
    i, j = np.nonzero(np.triu(sims >= threshold, 1))
    return {(a, b) for a, b in zip(i.tolist(), j.tolist()) if group is None or group[a] == group[b]}, sims


@pytest.mark.parametrize(("threshold", "block", "spread"), [(0.9, 8, 0.2), (0.5, 20, 0.6), (0.92, 1000, 0.2), (0.0, 16, 0.4), (-0.5, 16, 0.4), (0.99, 3, 0.05)])
def test_cells_lose_and_add_no_pair(spark, threshold, block, spread):
    m = clustered(1, 6, 18, spread)
    want, sims = plain(m, threshold)
    got = D.similar_pairs(table(spark, m), threshold, block).collect()
    assert len(got) == len({(r["i"], r["j"]) for r in got})
    assert {(r["i"], r["j"]) for r in got} == want
    assert all(abs(r["sim"] - sims[r["i"], r["j"]]) < 1e-9 for r in got)


def test_pairs_of_groups(spark):
    m = clustered(2, 5, 14, 0.3)
    group = np.arange(len(m)) % 3
    got = D.similar_pairs(table(spark, m, group), 0.8, 6, "grp").collect()
    assert {(r["i"], r["j"]) for r in got} == plain(m, 0.8, group)[0]


def test_clusters_are_visited_rarely(spark):
    m = clustered(3, 12, 30, 0.05)
    rows = table(spark, m)
    dealt = D.cells(rows, 0.95, 20).count()
    assert len(m) <= dealt < 3 * len(m)  # comparing all would send each vector to each of 36 cells


@pytest.mark.parametrize("threshold", [0.3, 0.9, 1.0])
def test_scan_with_copies(spark, threshold):
    m = clustered(4, 8, 12, 0.4, 6)
    kept, want = [], {}
    u = m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    for k in range(len(m)):
        by = next((i for i in kept if float(u[i] @ u[k]) >= threshold), None)
        if by is None:
            kept.append(k)
        else:
            want[k] = by
    df = spark.createDataFrame([(f"id{k:03d}", v.tolist()) for k, v in enumerate(m)], "id string, v array<double>")
    got = {int(r["id"][2:]): int(r["partner_id"][2:]) for r in D.near_dup(df, threshold).collect()}
    if threshold == 1.0:
        assert set(got) <= {k for k in range(len(m)) if any(np.array_equal(m[i], m[k]) for i in range(k))}
    else:
        assert got == want


@pytest.mark.parametrize(("threshold", "look"), [(0.3, 8), (0.3, 40), (0.8, 8), (0.97, 24), (0.0, 16)])
def test_rounds_scan_as_one_after_the_other(spark, threshold, look):
    """Groups, vectors that are never dropped, copies and a zero vector; also with pairs left for the end."""
    m = clustered(6, 9, 22, 0.5)
    group, fixed = np.arange(len(m)) % 2, np.random.default_rng(6).random(len(m)) < 0.2
    u = m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    kept, want = [], {}
    for k in range(len(m)):
        by = next((i for i in kept if group[i] == group[k] and float(u[i] @ u[k]) >= threshold), None)
        if by is None or fixed[k]:
            kept.append(k)
        else:
            want[k] = by
    rows = spark.createDataFrame([(k, v.tolist(), str(group[k]), bool(fixed[k])) for k, v in enumerate(m)], "n long, v array<double>, g string, fixed boolean").repartition(3)
    got = D.greedy_scan(rows, threshold, 16, look).collect()
    assert {r["n"]: r["partner"] for r in got} == want and len(got) == len(want)
    assert all(abs(r["sim"] - u[r["n"]] @ u[r["partner"]]) < 1e-9 for r in got)


def test_pairs_send_each_vector_to_a_bounded_number_of_blocks(spark):
    """Vectors that do not cluster: their copies sent grow with their number, whatever the size of a block."""
    m = np.random.default_rng(7).standard_normal((600, 16))
    assert D.cells(table(spark, m), 0.9, 4).count() == len(m)
    got = D.similar_pairs(table(spark, m), 0.6, 4).collect()
    assert {(r["i"], r["j"]) for r in got} == plain(m, 0.6)[0] and got


def test_many_neighbours_are_not_listed(spark, monkeypatch):
    monkeypatch.setattr(D, "similar_pairs", lambda *a, **k: pytest.fail("neighbours were listed"))
    m = np.abs(np.random.default_rng(8).standard_normal((300, 8)))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "id long, v array<double>")
    assert D.near_dup(rows, 0.5).count() > 250
