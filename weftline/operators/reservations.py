"""Budget reservations as a state machine over recorded events: reserve, record, release.

A call reserves what it is expected to cost, raised to the running mean of what calls have cost; it is admitted while
spend is under the stop threshold and spend, open reservations and its own stay within the cap. The first call of
a project finds out the price: others wait until it has settled. Recording or releasing drops the open reservation
of the closest amount (the oldest where no amount is named). Events of calls that were not admitted are ignored, so a
recorded run can be replayed under another cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.operators.ledger import EMA_ALPHA

EVENT = "project_id string, seq long, kind string, call_id string, amount double, est double"
DECISION = "project_id string, seq long, decided_seq long, kind string, call_id string, verdict string, amount double, spend double, reserved double, stopped boolean"
NAMES = [c.split()[0] for c in DECISION.split(", ")]


class Guard:
    """One project's state: spend, the mean of costs, open reservations by arrival, calls waiting for a price."""

    def __init__(self, cap: float, stop_at_pct: int, state: tuple | None = None) -> None:
        self.cap, self.threshold = cap, cap * stop_at_pct / 100.0
        self.spend, self.mean, self.probed, self.priced = state[:4] if state else (0.0, None, False, False)
        self.open: list[tuple[str, float]] = [tuple(x) for x in state[4]] if state else []
        self.waiting: list[tuple[int, str, float]] = [tuple(x) for x in state[5]] if state else []

    def state(self) -> tuple:
        return self.spend, self.mean, self.probed, self.priced, self.open, self.waiting

    @property
    def reserved(self) -> float:
        return sum(a for _, a in self.open)

    def _row(self, project: str, seq: int, now: int, kind: str, call: str, verdict: str, amount: float) -> tuple:
        return project, seq, now, kind, call, verdict, amount, round(self.spend, 9), round(self.reserved, 9), self.spend + 1e-9 >= self.threshold

    def _reserve(self, project: str, seq: int, now: int, call: str, est: float) -> tuple:
        amount = max(0.0, est, self.mean or 0.0)
        if self.spend + 1e-9 >= self.threshold:
            verdict = "stopped"
        elif self.spend + self.reserved + amount > self.cap + 1e-12:
            verdict = "over_cap"
        else:
            verdict = "admitted"
            self.open.append((call, amount))
        if verdict != "admitted":
            self.priced = True  # a refused probe keeps nobody waiting
        return self._row(project, seq, now, "reserve", call, verdict, amount)

    def __call__(self, project: str, seq: int, kind: str, call: str, amount: float | None, est: float | None) -> list[tuple]:
        """The decisions that an event brings about: its own, and those of calls that waited for it."""
        if kind == "reserve":
            if self.probed and not self.priced:
                self.waiting.append((seq, call, est or 0.0))
                return []
            self.probed = True
            out = [self._reserve(project, seq, seq, call, est or 0.0)]
        else:
            if call not in {c for c, _ in self.open}:
                return [self._row(project, seq, seq, kind, call, "ignored", 0.0)] if call not in {w[1] for w in self.waiting} else []
            at = 0 if est is None else min(range(len(self.open)), key=lambda i: abs(self.open[i][1] - est))
            taken = self.open[at]
            # The reservation of the closest amount goes; which call it was made for does not matter to the sums.
            del self.open[at]
            if taken[0] != call:
                self.open = [(taken[0] if c == call else c, a) for c, a in self.open]
            cost = max(0.0, amount or 0.0) if kind == "record" else 0.0
            if kind == "record":
                self.spend += cost
                self.mean = cost if self.mean is None else EMA_ALPHA * self.mean + (1 - EMA_ALPHA) * cost
            self.priced = True
            out = [self._row(project, seq, seq, kind, call, "settled", cost)]
        if self.priced and self.waiting:
            waiting, self.waiting = self.waiting, []
            out += [self._reserve(project, s, seq, c, e) for s, c, e in waiting]
        return out


def _value(x: object) -> float | None:
    return None if x is None or x != x else float(x)


def decided(events: DataFrame, cap: float, stop_at_pct: int) -> DataFrame:
    """What a guard with that cap decides on every recorded event (EVENT) of every project, in order of seq.

    Rows are dealt by project and sorted within tasks, and a task folds them as they stream by: it holds one
    project's state, never its events, however many there are. Rows of a null project are one project; null kinds are ignored.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, guard = object(), None
        for batch in batches:
            out = []
            for project, seq, kind, call, amount, est in zip(*(batch[c] for c in ("project_id", "seq", "kind", "call_id", "amount", "est"))):
                if guard is None or project != now:
                    now, guard = project, Guard(cap, stop_at_pct)
                if kind in ("reserve", "record", "release"):
                    out += guard(project, int(seq), kind, call, _value(amount), _value(est))
            yield pd.DataFrame(out, columns=NAMES)

    dealt = events.select("project_id", "seq", "kind", "call_id", "amount", "est").repartition("project_id").sortWithinPartitions("project_id", "seq", "call_id")
    return dealt.mapInPandas(fold, DECISION)


class LiveGuard(StatefulProcessor):
    """The same on a stream: events that come before their turn are held until all earlier ones (from ``first``) are in."""

    def __init__(self, cap: float, stop_at_pct: int, first: int = 1) -> None:
        self.cap, self.stop_at_pct, self.first = cap, stop_at_pct, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.guard = handle.getValueState("guard", "spend double, mean double, probed boolean, priced boolean, next long")
        self.open = handle.getListState("open", "call_id string, amount double")
        self.waiting = handle.getListState("waiting", "seq long, call_id string, est double")
        self.early = handle.getMapState("early", "seq long", "kind string, call_id string, amount double, est double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spend, mean, probed, priced, due = self.guard.get() if self.guard.exists() else (0.0, None, False, False, self.first)
        held = lambda state: [tuple(x) for x in state.get()] if state.exists() else []
        guard, out = Guard(self.cap, self.stop_at_pct, (spend, mean, probed, priced, held(self.open), held(self.waiting))), []
        for batch in rows:
            for seq, kind, call, amount, est in zip(*(batch[c] for c in ("seq", "kind", "call_id", "amount", "est"))):
                if int(seq) >= due:
                    self.early.updateValue((int(seq),), (kind, call, _value(amount), _value(est)))
        while self.early.containsKey((due,)):
            kind, call, amount, est = self.early.getValue((due,))
            self.early.removeKey((due,))
            out += guard(key[0], due, kind, call, amount, est)
            due += 1
        spend, mean, probed, priced, opened, waiting = guard.state()
        self.guard.update((spend, mean, probed, priced, due))
        for state, value in ((self.open, opened), (self.waiting, waiting)):
            if value:
                state.put([tuple(x) for x in value])
            elif state.exists():
                state.clear()
        yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def live_decisions(events: DataFrame, cap: float, stop_at_pct: int, first: int = 1) -> DataFrame:
    """decided() on a stream of events whose seq counts up from ``first`` in each project (append mode)."""
    return events.groupBy("project_id").transformWithStateInPandas(LiveGuard(cap, stop_at_pct, first), DECISION, "Append", "None")


def guard_summary(decisions: DataFrame) -> DataFrame:
    """By project: calls by verdict, spend, the most that was ever spent and reserved together, whether it stopped."""
    calls = lambda v: F.count_if((F.col("kind") == "reserve") & (F.col("verdict") == v)).alias(v)
    return decisions.groupBy("project_id").agg(calls("admitted"), calls("over_cap"), calls("stopped"), F.max("spend").alias("spend"), F.max(F.col("spend") + F.col("reserved")).alias("peak"), F.bool_or("stopped").alias("reached_stop"))
