"""A bucket of keys, gathered by ranges: as at once, in less memory."""

import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import simhash
from weftline.llm.windows import run_bytes, squeezed


def packed(keys, ids, slice_=2000):
    """Runs as the nodes of a slice give them: keys in order, ids from the first."""
    rows = []
    for a in range(0, int(ids.max()) + 1, slice_):
        at = np.flatnonzero((ids >= a) & (ids < a + slice_))
        at = at[np.argsort(keys[at], kind="stable")]
        rows.append((run_bytes(keys[at]), squeezed((ids[at] - a).astype(np.uint64)), a))
    return [pa.chunked_array([pa.array(c, t)]) for c, t in zip(zip(*rows), (pa.binary(), pa.binary(), pa.int64()))]


def plain(keys, ids):
    members, pairs, large, stars = defaultdict(list), set(), [], defaultdict(Counter)
    for k, i in zip(keys.tolist(), ids.tolist()):
        members[k].append(i)
    for k, own in members.items():
        own.sort()
        if len(own) <= simhash.FEW:
            pairs |= {(a, b) for n, a in enumerate(own) for b in own[n + 1 :]}
        else:
            large += [(np.uint64(k).astype(np.int64).item(), i) for i in own]
            for i in own[1:]:
                stars[i][own[0]] += 1
    best = [(min(c, key=lambda a: (-c[a], a)), i) for i, c in stars.items()]
    return sorted([(0, a, b, 1) for a, b in pairs] + [(1, k, i, 1) for k, i in large] + [(2, a, i, stars[i][a]) for a, i in best])


@pytest.mark.parametrize("entries", [1, 50, 1000, 1 << 18])
@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_give_what_the_bucket_gives(entries, seed):
    rng = np.random.default_rng(seed)
    pool = np.r_[rng.integers(0, 1 << 63, 900).astype(np.uint64) * np.uint64(2), np.repeat(rng.integers(0, 1 << 63, 3).astype(np.uint64), 200)]
    both = np.unique(np.stack([rng.choice(pool, 6000), rng.integers(0, 5000, 6000).astype(np.uint64)], axis=1), axis=0)
    keys, ids = both[:, 0].copy(), both[:, 1].astype(np.int64)
    got = simhash.gathered(*packed(keys, ids), entries)
    assert sorted(zip(*(x.tolist() for x in got))) == plain(keys, ids)
    assert {0, 1, 2} == set(got[0].tolist())


def test_a_bucket_takes_little_more_than_its_keys():
    rng = np.random.default_rng(3)
    n = 1_000_000
    runs = packed(rng.integers(0, 1 << 63, n).astype(np.uint64), rng.integers(0, 100_000, n))
    tracemalloc.start()
    simhash.gathered(*runs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 * n  # 12 bytes a key are held; sorting and comparing all at once took 100 and more
