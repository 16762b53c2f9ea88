"""Admission rounds against a plain loop; hashes of files by chunks; order of a locale."""

import hashlib
import random

import numpy as np
import pytest

from weftline.operators import admission as A, rows as R
from weftline.operators.sampling import drawn_choice
from weftline.operators.scoring import seeded
from weftline.sources import files

SETTINGS = A.Admission("p", [("Ann", 2.0), ("Bob", 1.0)], [("question", 1.0), ("command", 1.0)], 30.0, 0.0, 0.9)


def vectors(rng, n):
    """Vectors of which many are near copies of earlier ones."""
    out = []
    for _ in range(n):
        base = rng.standard_normal(8)
        out.append((np.array(out[rng.integers(len(out))]) + 0.01 * base if out and rng.random() < 0.4 else base).tolist())
    return out


def case(seed):
    rng, dice = np.random.default_rng(seed), random.Random(seed)
    leaves = [(f"l{k}", dice.choice([0, 1, 3, 8])) for k in range(7)]
    existing = [(leaf, v) for leaf, _ in leaves for v in vectors(rng, dice.choice([0, 0, 2]))]
    replies = []
    for leaf, _ in leaves:
        own = vectors(rng, 30)
        for call in (1, 2, 3):
            for k in range(dice.choice([0, 2, 5, 9])):
                replies.append((leaf, call, 2 * k, f"{leaf} {call} {k}", own.pop() if own else [1.0] * 8))
    return leaves, existing, replies


def near(a, b):
    a, b = np.array(a), np.array(b)
    return float(a @ b / max(np.linalg.norm(a), 1e-12) / max(np.linalg.norm(b), 1e-12)) >= SETTINGS.threshold


def plain(leaves, existing, replies):
    prompts, outcomes = [], []
    for leaf, n in leaves:
        pool = [v for other, v in existing if other == leaf]
        rng = seeded("p", leaf, len(pool))
        specs = [(drawn_choice(rng, SETTINGS.personas), drawn_choice(rng, SETTINGS.styles), rng.random() * 100 < 30) for _ in range(n)]
        calls = active = rejected = 0
        while specs and calls < 3:
            calls += 1
            said = sorted((k, t, v) for other, c, k, t, v in replies if other == leaf and c == calls)[: len(specs)]
            if not said:
                break
            again = []
            for place, (spec, (_, text, v)) in enumerate(zip(specs, said)):
                dup = any(near(v, p) for p in pool)
                prompts.append((leaf, calls, place, *spec, text, 0.0, "rejected_dup" if dup else "active"))
                if dup:
                    rejected += 1
                    again.append(spec)
                else:
                    active += 1
                    pool.append(v)
            specs = again + specs[len(said) :]
        outcomes.append((leaf, calls, active, rejected, n - active, "error" if n and not active else "done"))
    return sorted(prompts), sorted(outcomes)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds_equal_a_loop(spark, seed):
    leaves, existing, replies = case(seed)
    random.Random(seed).shuffle(replies)
    prompts, outcomes = A.admitted(spark.createDataFrame(leaves, "leaf_id string, n int"), spark.createDataFrame(existing, "leaf_id string, v array<double>"), spark.createDataFrame(replies, "leaf_id string, call int, k int, text string, v array<double>"), SETTINGS)
    want = plain(leaves, existing, replies)
    assert sorted(tuple(r) for r in prompts.collect()) == want[0]
    assert sorted(tuple(r) for r in outcomes.collect()) == want[1]


def test_cases_have_refused_prompts():
    assert sum(p[8] == "rejected_dup" for seed in (1, 2, 3) for p in plain(*case(seed))[0]) > 3


def test_noise_changes_text_alone(spark):
    leaves, existing, replies = case(1)
    frames = lambda: (spark.createDataFrame(leaves, "leaf_id string, n int"), spark.createDataFrame(existing, "leaf_id string, v array<double>"), spark.createDataFrame([(a, b, c, "Since then, many longer words. " + d, e) for a, b, c, d, e in replies], "leaf_id string, call int, k int, text string, v array<double>"))
    loud, _ = A.admitted(*frames(), A.Admission("p", SETTINGS.personas, SETTINGS.styles, 30.0, 1.0, 0.9))
    quiet, _ = A.admitted(*frames(), SETTINGS)
    a, b = ({tuple(r)[:6] + (r["status"],) for r in df.collect()} for df in (loud, quiet))
    assert a == b and loud.where("noise > 0").count() > 0


def test_files_are_hashed_in_chunks(spark, tmp_path):
    data = {"a b.bin": b"", "c%20.bin": b"x" * 1000, "sub/é.bin": bytes(range(256)) * 9, "sub/manifest.json": b"{}"}
    for name, body in data.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    for chunk in (1, 64, 1 << 20):
        got = {r["path"].rpartition("/")[2]: (r["length"], r["sha256"]) for r in files.file_hashes(files.listed_files(spark, str(tmp_path)), chunk).collect()}
        assert sorted(got.values()) == sorted((len(b), hashlib.sha256(b).hexdigest()) for b in data.values())
    assert sorted(r["sha256"] for r in files.manifest(spark, str(tmp_path)).collect()) == sorted(hashlib.sha256(b).hexdigest() for n, b in data.items() if "manifest" not in n)


def test_order_of_a_locale(spark):
    words = ["zebra", "Äpfel", "apple", "Zoo", "éclair", "eclair", None, "Apple", "10", "9"]
    df = spark.createDataFrame([(k, w, float(k % 3) if k % 4 else None) for k, w in enumerate(words)], "id int, w string, x double")
    order = [r["w"] for r in R.collated(df, "w").collect()]
    assert order == ["10", "9", "Äpfel", "apple", "Apple", "eclair", "éclair", None, "zebra", "Zoo"]
    assert [r["w"] for r in R.collated(df, "w", True).collect()] == order[::-1]
    assert [r["id"] for r in R.collated(df, "x").collect()] == [3, 6, 9, 1, 7, 2, 5, 0, 4, 8]
    assert [r["id"] for r in R.collated(df, "x", True).collect()] == [0, 4, 8, 2, 5, 1, 7, 3, 6, 9]
