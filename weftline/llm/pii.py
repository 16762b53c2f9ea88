"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

The field is trained on the driver from a small labelled table (bounded by ``max_rows``) and
decoded inside tasks by Viterbi over padded numpy batches of lines.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import small_batches

# The patterns of the contract.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
# A look-behind stands where a match from inside a run of digits could not do better than one from its start.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) << (k & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping matches, found from each @ backwards to the start of its run."""
    end = 0
    at = text.find("@")
    while at >= 0:
        found = DOMAIN.match(text, at)
        if found:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield "email", start, found.end()
                end = found.end()
                at = end - 1
        at = text.find("@", at + 1)


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[Span]:
    """Spans of the four kinds that pass their checks, by start, then kind as listed."""
    out = list(emails(text)) if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def shown(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- the field ---------------------------------------------------------------------------------

#: Labels: outside, then begin and inside of each kind that the field knows.
FIELD_KINDS = ("email", "phone", "secret", "id")
LABELS = ("O", *(f"{p}-{k}" for k in FIELD_KINDS for p in "BI"))
#: A word of a line: what white space and the marks around it leave.
TOKEN = re.compile(r"[^\s,;|\"'<>]+|[,;|\"'<>]")
#: Words of a text, and the ends of its lines.
TOKENS = re.compile(r"\n|[^\s,;|\"'<>]+|[,;|\"'<>]")


def shape(word: str) -> str:
    """Letters as x and X, digits as d with their number, marks as they are; runs of letters fold."""
    if word.isalpha():
        return "x" if word.islower() else "X" if word.isupper() else "Xx" if word[1:].islower() else "XxX"
    body = word.rstrip(".:!?") or word
    out = re.sub(r"[A-Z]+", "X", re.sub(r"[^\W\dA-Z_]+", "x", body))
    out = re.sub(r"[0-9]+", lambda m: f"d{min(len(m.group()), 9)}", out)
    if len(body) >= 20 and re.fullmatch(r"[0-9a-f]+|[0-9A-Za-z_-]*[0-9][0-9A-Za-z_-]*", body) and re.search(r"[A-Za-z]", body) and re.search(r"[0-9]", body):
        return "long-mixed"
    return out if len(out) <= 16 and re.search(r"[0-9d@\[(+]", out) else "other"


def cues(word: str) -> str:
    """Words that announce or join parts of personal data; all others are one."""
    w = word.lower().rstrip(".:")
    return w if w in CUES else ""


CUES = frozenset(("token", "key", "secret", "password", "=", "ssn", "id", "tel", "phone", "call", "mobile", "[at]", "(at)", "[dot]", "(dot)", "version", "license", "page", "chapter", "cc"))


def features(words: Sequence[str]) -> list[tuple[str, ...]]:
    """Of each word: its shape and cue, and those of its neighbours."""
    own = [(shape(w), cues(w)) for w in words]
    edge = ("pad", "")
    out = []
    for k, (s, c) in enumerate(own):
        (ps, pc), (ns, nc) = own[k - 1] if k else edge, own[k + 1] if k + 1 < len(own) else edge
        out.append((f"s={s}", f"c={c}", f"ps={ps}", f"ns={ns}", f"pc={pc}", f"nc={nc}", "bias"))
    return out


@dataclass
class Field:
    """Weights: feature by label, label by label, and start."""

    names: dict[str, int]
    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray

    def scores(self, words: Sequence[str]) -> np.ndarray:
        get = self.names.get
        return np.array([sum((self.emit[k] for n in f if (k := get(n)) is not None), np.zeros(len(LABELS))) for f in features(words)])


def tags(words: Sequence[str], at: Sequence[tuple[int, int]], spans: Iterable[Span]) -> list[int]:
    """Labels of words from the spans that hold them."""
    out = [0] * len(words)
    for kind, a, b in spans:
        begun = False
        for k, (s, e) in enumerate(at):
            if s >= a and e <= b + 1 and s < b:
                out[k] = LABELS.index(f"{'I' if begun else 'B'}-{kind}")
                begun = True
    return out


def labelled(spark: SparkSession, seed: int = 7, each: int = 40) -> DataFrame:
    """The built-in labelled table: lines made from templates, with the spans of their personal data."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ka", "lo", "mi", "ten", "sur", "va", "ne", "or")) for _ in range(rng.randint(1, 4)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    made = {
        "email": (lambda: f"{word()} [at] {word()} [dot] com", lambda: f"{word()}(at){word()}(dot)org", lambda: f"{word()} (at) {word()} (dot) net"),
        "phone": (lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}"),
        "secret": (lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((32, 40, 64)))),),
        "id": (lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",),
    }
    lead = {"secret": ("token =", "key =", "secret ="), "phone": ("call", "tel", ""), "id": ("ssn", "id", ""), "email": ("", word())}
    plain = ("version {d}.0", "page {n}", "CC BY-NC {d}.0", "{y}", "{d} {w}", "v{d}.{d}.{d}", "{n}%", "${n}.00", "{w}({w})", "{y}-{n}-{n}", "{card}", "{ip}", "{mail}", "at", "dot", "token", "key", "({w})", "[{w}]", "id", "call")
    rows = []
    for k in range(each * (len(made) + 4)):
        line, spans = " ".join(word().capitalize() if rng.random() < 0.15 else word() for _ in range(rng.randint(0, 6))), []
        kind = (*made, None, None, None, None)[k % (len(made) + 4)]
        for _ in range(1 if kind else rng.randint(0, 2)):
            if kind:
                before = rng.choice(lead[kind])
                quote = '"' if kind == "secret" else ""
                value = rng.choice(made[kind])()
                line += f" {before} {quote}" if before else f" {quote}"
                spans.append([kind, len(line), len(line) + len(value)])
                line += value + quote
            else:
                line += " " + rng.choice(plain).format(d=digits(1), n=digits(2), y=f"20{digits(2)}", w=word(), card=digits(16), ip=".".join(str(rng.randint(0, 255)) for _ in range(4)), mail=f"{word()}.{digits(2)}@{word()}{digits(1)}.example.com")
        line += "".join(" " + word() for _ in range(rng.randint(0, 6))) + rng.choice(("", ".", ","))
        rows.append((k, line, shown(map(tuple, spans))))
    return spark.createDataFrame(rows, "line_id long, line string, spans string")


def fit(table: DataFrame, max_rows: int = 2_000, rounds: int = 100, decay: float = 0.01) -> Field:
    """A field from a labelled table (line_id, line, spans); its first ``max_rows`` rows by line_id.

    Maximum likelihood with weight decay by full-batch gradient steps; lines are padded to one
    length and all forward and backward sums run over the whole batch at once.
    """
    rows = table.orderBy("line_id").limit(max_rows).collect()
    lines = []
    for r in rows:
        words = [(m.group(), m.span()) for m in TOKEN.finditer(r["line"] or "")]
        if words:
            spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in (r["spans"] or "").split(",") if s)]
            lines.append((features([w for w, _ in words]), tags([w for w, _ in words], [s for _, s in words], spans)))
    names: dict[str, int] = {}
    for f, _ in lines:
        for word in f:
            for n in word:
                names.setdefault(n, len(names))
    L, n, longest = len(LABELS), len(lines), max((len(f) for f, _ in lines), default=1)
    per = 7
    ids = np.full((n, longest, per), len(names))
    gold, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest))
    for k, (f, t) in enumerate(lines):
        ids[k, : len(f)] = [[names[x] for x in w] for w in f]
        gold[k, : len(t)], mask[k, : len(t)] = t, 1
    emit, move, first = np.zeros((len(names) + 1, L)), np.zeros((L, L)), np.zeros(L)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in (emit, move, first)]
    one = np.eye(L)[gold] * mask[..., None]
    pairs = np.einsum("nti,ntj->ij", one[:, :-1], one[:, 1:])
    last = mask.sum(axis=1).astype(int) - 1
    lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    for step in range(1, rounds + 1):
        score = emit[ids].sum(axis=2)
        fwd, bwd = np.zeros((n, longest, L)), np.zeros((n, longest, L))
        fwd[:, 0] = score[:, 0] + first
        for t in range(1, longest):
            fwd[:, t] = np.where(mask[:, t, None] > 0, lse(fwd[:, t - 1, :, None] + move, 1) + score[:, t], fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            bwd[:, t] = np.where(mask[:, t + 1, None] > 0, lse((bwd[:, t + 1] + score[:, t + 1])[:, None, :] + move, 2), 0)
        total = lse(fwd[np.arange(n), last], 1)
        share = np.exp(fwd + bwd - total[:, None, None]) * mask[..., None]
        joint = np.exp(fwd[:, :-1, :, None] + move + (score[:, 1:] + bwd[:, 1:])[:, :, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        gap = (one - share) / n
        d_emit = np.zeros_like(emit)
        np.add.at(d_emit, ids.reshape(-1, per), np.repeat(gap.reshape(-1, 1, L), per, axis=1))
        grads = (d_emit - decay / n * emit, (pairs - joint.sum(axis=(0, 1))) / n - decay / n * move, gap[:, 0].sum(axis=0) - decay / n * first)
        for w, g, (m, v) in zip((emit, move, first), grads, moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w += 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        emit[-1] = 0
    return Field(names, emit[:-1], move, first)


class Decoder:
    """Decodes lines; word features are looked up once for each distinct shape and cue.

    A word is settled when no stretch of other labels over it can score above outside: the weights
    bound what each word of a stretch adds at most, and two running maxima give the best stretch over
    each word. Viterbi runs over what lies between settled words, in batches, and gives the best path
    of the whole line.
    """

    def __init__(self, field: Field) -> None:
        self.field = field
        self.kinds: dict[tuple[str, str], int] = {}
        self.edge = self.weights("pad", "")
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.table: tuple[np.ndarray, ...] = ()
        rest = field.move[0, 0]
        #: What a label adds over outside by the step into it, from outside, from another label and at a line's start, and the step out.
        self.enter, self.stay, self.begin = field.move[0, 1:] - rest, field.move[1:, 1:].max(axis=0) - rest, field.first[1:] - field.first[0]
        self.leave = float(field.move[1:, 0].max() - rest)
        self.forget()

    def forget(self) -> None:
        decoder = self

        class Seen(dict):
            def __missing__(self, word: str) -> int:
                found = self[word] = decoder.kind(word)
                return found

        self.seen = Seen({"\n": -1})

    def weights(self, s: str, c: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = lambda n: self.field.emit[k] if (k := self.field.names.get(n)) is not None else np.zeros(len(LABELS))
        return at(f"s={s}") + at(f"c={c}") + at("bias"), at(f"ps={s}") + at(f"pc={c}"), at(f"ns={s}") + at(f"nc={c}")

    def kind(self, word: str) -> int:
        key = shape(word), cues(word)
        if (found := self.kinds.get(key)) is None:
            found = self.kinds[key] = len(self.rows)
            self.rows.append(self.weights(*key))
        return found

    def kinds_of(self, words: list[str]) -> list[int]:
        """Kinds of words; -1 for the end of a line."""
        if len(self.seen) > 200_000:
            self.forget()
        return list(map(self.seen.__getitem__, words))

    def scores(self, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Score of each label at each word of lines laid end to end; ``starts`` and ``ends`` mark lines' first and last words."""
        if len(self.table) == 0 or len(self.table[0]) < len(self.rows):
            self.table = tuple(np.array(x) for x in zip(*self.rows))
        own, before, after = self.table
        score = own[kinds]
        score[1:] += np.where(starts[1:, None], self.edge[1], before[kinds[:-1]])
        score[0] += self.edge[1]
        score[:-1] += np.where(ends[:-1, None], self.edge[2], after[kinds[1:]])
        score[-1] += self.edge[2]
        return score

    def settled(self, score: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Words that are outside in the best path of their line."""
        gain = score[:, 1:] - score[:, :1]
        new = np.where(starts, (gain + self.begin).max(axis=1), (gain + self.enter).max(axis=1))
        more = np.where(starts, -1e4, (gain + self.stay).max(axis=1))
        total = np.cumsum(more)
        left = total + np.maximum.accumulate(new - total)
        after = np.where(ends, 0.0, self.leave) + total
        return left + np.maximum.accumulate(after[::-1])[::-1] - total < -1e-3

    def labels(self, kinds: np.ndarray, starts: np.ndarray, whole: bool = False) -> np.ndarray:
        """Labels of the best path of every line; ``whole``: without settling words first."""
        n = len(kinds)
        if not n:
            return np.zeros(0, np.int8)
        ends = np.r_[starts[1:], True]
        score = self.scores(kinds, starts, ends)
        open_ = np.ones(n, bool) if whole else ~self.settled(score, starts, ends)
        out = np.zeros(n, np.int8)
        at = np.flatnonzero(open_)
        if not len(at):
            return out
        cut = np.r_[True, (np.diff(at) > 1) | starts[at[1:]]]
        first = at[cut]
        size = np.diff(np.r_[np.flatnonzero(cut), len(at)])
        # A stretch begins at its line's start or after a settled word, and ends likewise.
        score[first] += np.where(starts[first][:, None], self.field.first, self.field.move[0])
        last = first + size - 1
        score[last] += np.where(ends[last][:, None], 0.0, self.field.move[:, 0])
        groups = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
        for g in np.unique(groups):
            members = np.flatnonzero(groups == g)
            room = max(1, 500_000 >> int(g))
            for a in range(0, len(members), room):
                block = members[a : a + room]
                longest = int(size[block].max())
                place = np.minimum(first[block] + np.arange(longest)[:, None], n - 1)
                live = np.arange(longest)[:, None] < size[block]
                out[place[live]] = best_paths(score[place], self.field.move, np.zeros(len(LABELS)), size[block])[live]
        return out


def viterbi(score: np.ndarray, move: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Best label paths of a padded batch; score is (time, line, label)."""
    path = best_paths(score, move, first, lengths)
    return [path[: lengths[k], k] for k in range(len(lengths))]


def best_paths(score: np.ndarray, move: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """viterbi() as one array (time, line)."""
    steps, n, labels = score.shape
    back = np.zeros((steps, n, labels), np.int8)
    best = score[0] + first
    ends = np.zeros((n, labels))
    ends[lengths == 1] = best[lengths == 1]
    for t in range(1, steps):
        reach = best[:, :, None] + move
        back[t] = reach.argmax(axis=1)
        best = reach.max(axis=1) + score[t]
        over = lengths == t + 1
        ends[over] = best[over]
    path = np.zeros((steps, n), np.int8)
    at, rows = ends.argmax(axis=1), np.arange(n)
    for t in range(steps - 1, -1, -1):
        live = t < lengths
        path[t, live] = at[live]
        step = live & (t > 0)
        at = np.where(step, back[t, rows, at], at)
    return path


#: Words of texts that are decoded at once.
DECODED = 200_000


def field_spans(decoder: Decoder, texts: Sequence[str]) -> list[list[Span]]:
    """Spans that the field finds, for each text; every line of it is decoded."""
    out: list[list[Span]] = [[] for _ in texts]
    held: list[tuple[int, list[int]]] = []
    size = 0

    def decode() -> None:
        kinds = np.array([-1, *(k for _, own in held for k in (*own, -1))])
        word = kinds >= 0
        labels = np.zeros(len(kinds), np.int8)
        labels[word] = decoder.labels(kinds[word], ~word[np.flatnonzero(word) - 1])
        at = 1
        for k, own in held:
            found = labels[at : at + len(own)]
            if found.any():
                out[k] = spans_of(texts[k], found.tolist())
            at += len(own) + 1
        held.clear()

    for k, text in enumerate(texts):
        if own := decoder.kinds_of(TOKENS.findall(text)):
            held.append((k, own))
            size += len(own)
        if size > DECODED:
            decode()
            size = 0
    if held:
        decode()
    return out


def spans_of(text: str, marks: list[int]) -> list[Span]:
    """Spans of a text from the labels of its words and line ends."""
    words = [(m.group(), m.start(), m.end()) for m in TOKENS.finditer(text)]
    out, j = [], 0
    while j < len(marks):
        if LABELS[marks[j]][0] == "B":
            kind, start = LABELS[marks[j]][2:], j
            while j + 1 < len(marks) and LABELS[marks[j + 1]] == f"I-{kind}":
                j += 1
            tail, end = words[j][0], words[j][2]
            out.append((kind, words[start][1], end - (len(tail) - len(tail.rstrip(".:!?")))))
        j += 1
    return out


def joined(base: list[Span], more: list[Span]) -> list[Span]:
    """Base spans all stay; of the field's, those that no base span touches."""
    held = sorted((a, b) for _, a, b in base)
    added, k = [], 0
    for kind, a, b in sorted(more, key=lambda s: s[1]):
        while k < len(held) and held[k][1] <= a:
            k += 1
        if not any(x < b and a < y for x, y in held[max(0, k - 4) : k + 4]):
            added.append((kind, a, b))
    rank = {k: i for i, k in enumerate((*KINDS, *(x for x in FIELD_KINDS if x not in KINDS)))}
    return sorted(base + added, key=lambda s: (s[1], rank[s[0]], s[2]))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def with_spans(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with ``base`` and ``spans`` (kind, start, end in code points) of every whole text.

    A null text counts as empty and has none; equal texts have equal spans; other columns pass
    through, those named base or spans are replaced.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf(f"base {SPANS}, spans {SPANS}")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(held.value)
        for texts in batches:
            texts = texts.fillna("").tolist()
            base, more = [base_spans(t) for t in texts], field_spans(decoder, texts)
            yield pd.DataFrame({"base": [_rows(b) for b in base], "spans": [_rows(joined(b, m)) for b, m in zip(base, more)]})

    out = docs.drop("base", "spans").withColumn("_found", found.asNondeterministic()(F.col("text")))
    return out.select(*[c for c in out.columns if c != "_found"], "_found.base", "_found.spans")


def _rows(spans: list[Span]) -> list[dict[str, object]]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def redacted(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; a null text stays null, other columns stay.

    Texts are searched and masked in one go, so they pass to Python once and one worker a task holds the field.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(held.value)
        for texts in batches:
            whole = texts.fillna("").tolist()
            spans = [joined(base_spans(t), more) for t, more in zip(whole, field_spans(decoder, whole))]
            yield pd.Series([None if gone else _masked(t, s) for t, s, gone in zip(whole, spans, texts.isna())], dtype=object)

    return docs.withColumn("text", masked.asNondeterministic()("text"))


def _masked(text: str, spans: Iterable[Span]) -> str:
    out, at = [], 0
    for kind, start, end in spans:
        if end > at:
            out += [text[at:start], f"[{kind}]"] if start >= at else []
            at = end
    return "".join(out) + text[at:]


def op1_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_spans(docs, fit(labelled(spark)))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))
