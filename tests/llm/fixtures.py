"""Small documents with everything that is awkward, and plain versions of what operators compute."""

import hashlib
import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def corpus(seed=11):
    """(doc_id, text): nulls, empty and blank texts, copies, near copies, shared passages, one long text, periodic ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))
    base = [text(rng.randint(1, 300)) for _ in range(30)]
    passage = text(120)
    docs = [None, "", "   ", "\n\n", "x", "a" * 900, "ab " * 400, "日本語 テスト 🎉 " * 60, text(6000)]
    docs += base + base[:6] + [base[0]] * 5
    docs += [base[k][: len(base[k]) // 2] + " edit " + base[k][len(base[k]) // 2 :] for k in range(10)]
    docs += [text(rng.randint(0, 40)) + " " + passage + " " + text(rng.randint(0, 40)) for _ in range(12)]
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(7 * k + 3, docs[i]) for k, i in enumerate(order)]


def table(spark, rows, **extra):
    """Documents with the columns of the driver's, and clashing names beside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({"lang": F.lit("en"), "source": F.concat(F.lit("s"), F.col("doc_id") % 3), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit("clash") for c in ("grp", "bucket", "_text", "n_words", "fp", "host", "spans", "base", "key", "value", "words", "ids", "rows", "kept", "score", "lang_pred", "component_id")} | extra)


def removed_words(docs, size=13):
    first, words = {}, {k: WORDS.findall(t or "") for k, t in docs}
    for k in sorted(words):
        for i in range(len(words[k]) - size + 1):
            first.setdefault(tuple(words[k][i : i + size]), k)
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < k:
                gone[i : i + size] = [True] * size
        out[k] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def removed_bytes(docs, size=400):
    seen, data = {}, [(k, (t or "").encode()) for k, t in docs]
    for _, b in data:
        for i in range(len(b) - size + 1):
            seen[b[i : i + size]] = seen.get(b[i : i + size], 0) + 1
    out = {}
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out[k] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def fingerprints(docs):
    import xxhash

    out = {}
    for k, t in docs:
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        parts = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        out[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    return out


def components(fps, radius=3):
    root = {k: k for k in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}
