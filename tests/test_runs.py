"""Live folds of runs and reservations: streams over shuffled arrivals equal the batch fold and a plain loop."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import reservations as V
from weftline.operators.ledger import should_abort
from weftline.streaming import runs as R


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set(*R.STATE_STORE)
    yield
    spark.conf.unset(R.STATE_STORE[0])


def streamed(spark, tmp_path, rows, ddl, parts, make, mode):
    """The rows in some files, one a micro-batch, through ``make``; what the sink holds in order of batches."""
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], ddl).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = []
    q = make(source).writeStream.outputMode(mode).foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def items(seed=1):
    rng = random.Random(seed)
    rows = []
    for run, share in (("bad", 0.9), ("late", 0.5), ("good", 0.05), ("few", 1.0)):
        for k in range(7 if run == "few" else 60):
            status = "error" if rng.random() < share else rng.choice(["done", "refusal", "skipped", "partial"])
            rows.append((run, f"{run}{k:03d}", float(k // 3), status, rng.choice([0, 2, None]), round(rng.random(), 3), f"E{k}" if status == "error" else None))
    return rows


def plain_fold(rows):
    """As items finish one by one, in order of time and id."""
    out = {}
    for run in {r[0] for r in rows}:
        done = errors = refusals = partial = 0
        spend, abort = 0.0, (None, None, None)
        for _, _, _, status, calls, cost, error in sorted((r for r in rows if r[0] == run), key=lambda r: (r[2], r[1])):
            short = status == "partial" or status == "skipped" and calls
            done, partial = done + (not short), partial + bool(short)
            errors, refusals, spend = errors + (status == "error"), refusals + (status == "refusal"), spend + cost
            if abort[0] is None and not short and should_abort(done, errors):
                abort = (done, errors, error)
        out[run] = (done, errors, refusals, partial, round(spend, 6), *abort, "aborted" if abort[0] else "running")
    return out


def folded(rows):
    return {r["run_id"]: tuple(r)[1:] for r in rows}


def test_batch_fold_equals_a_loop(spark):
    rows = items()
    assert folded(R.folded_items(spark.createDataFrame(rows, R.ITEM)).collect()) == plain_fold(rows)
    assert plain_fold(rows)["bad"][5] and not plain_fold(rows)["good"][5] and not plain_fold(rows)["few"][5]


@pytest.mark.parametrize("seed", [1, 2])
def test_live_fold_equals_the_batch_fold_on_shuffled_arrivals(spark, tmp_path, seed):
    rows = items()
    random.Random(seed).shuffle(rows)
    got = streamed(spark, tmp_path, rows, R.ITEM, 4, R.live_items, "update")
    assert folded(got) == plain_fold(rows)  # the last row of each run is its state


def test_idle_runs_are_stalled_by_a_timer(spark, tmp_path):
    ddl = R.ITEM + ", ts timestamp"
    rows = [("a", "1", 1000.0, "done", 0, 0.5, None), ("b", "1", 1050.0, "done", 0, 0.5, None), ("b", "2", 6000.0, "error", 0, 0.5, "x"), ("c", "1", 10000.0, "done", 0, 0.1, None)]
    for k, row in enumerate(rows):
        spark.createDataFrame([row], R.ITEM).withColumn("ts", F.timestamp_seconds("finished_at")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = []
    q = R.live_items(source, "1 seconds", 100_000).writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    states = [(r["run_id"], r["done"], r["state"]) for r in out]
    assert ("a", 1, "stalled") in states and ("b", 2, "stalled") in states and states.count(("a", 1, "running")) == 1
    assert ("c", 1, "stalled") not in states


def events(n=1200):
    rng = random.Random(7)
    rows = []
    for run, size in (("r", n), ("s", 40)):
        for seq in range(1, size + 1):
            kind = rng.choice(["progress", "worker", "log", "log", "item"])
            body = {"progress": {"done": seq}, "worker": {"worker_id": rng.randint(0, 11), "status": f"s{seq}"}, "log": {"msg": f"m{seq}"}, "item": {"status": "done"}}[kind]
            rows.append((run, seq, kind, json.dumps(body)))
        rows.append((run, size + 1, "done", json.dumps({"status": "failed" if run == "s" else "done"})))
    return rows


def plain_snapshot(rows):
    out = {}
    for run in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == run)
        last = {k: p for _, _, k, p in own}
        logs = [s for _, s, k, _ in own if k == "log"][-300:]
        workers = {}
        for _, _, k, p in own:
            if k == "worker":
                workers[json.loads(p)["worker_id"]] = json.loads(p)
        out[run] = (own[-1][1], last.get("progress"), json.loads(last["done"])["status"], [workers[w] for w in sorted(workers)], len(logs), logs[0], min(500, len(own)))
    return out


def test_monitor_equals_the_snapshot_whatever_the_order(spark, tmp_path):
    rows = events()
    random.Random(3).shuffle(rows)
    last = {r["run_id"]: r for r in streamed(spark, tmp_path, rows, R.EVENT, 5, R.live_runs, "update")}
    want = plain_snapshot(rows)
    assert {k: (r["seq"], r["progress"], r["status"], json.loads(r["workers"]), r["logs"], r["first_log"], r["events"]) for k, r in last.items()} == want
    table = spark.createDataFrame(rows, R.EVENT)
    got = {r["run_id"]: (r["seq"], r["progress"], r["status"], r["logs"], r["first_log"], r["events"]) for r in R.snapshots(table).collect()}
    assert got == {k: (*v[:3], *v[4:]) for k, v in want.items()}
    workers = {(r["run_id"], int(r["worker_id"])): json.loads(r["payload"]) for r in R.last_workers(table).collect()}
    assert workers == {(k, w["worker_id"]): w for k, v in want.items() for w in v[3]}


def test_replay_is_the_ring_past_an_id_up_to_the_end(spark):
    table = spark.createDataFrame([*events(), ("s", 99, "log", "{}")], R.EVENT)
    got = sorted((r["run_id"], r["seq"]) for r in R.replayed(table, 10).collect())
    assert got == [("r", s) for s in range(702, 1202)] + [("s", s) for s in range(11, 42)]
    assert R.replayed(table, 5000).count() == 0 and R.replayed(table).where("run_id = 's'").count() == 41


# --- reservations -------------------------------------------------------------------------------


class Loop:
    """The guard as a loop over one project's events, open reservations as a plain list of amounts."""

    def __init__(self, cap, pct):
        self.cap, self.stop, self.spend, self.mean, self.open, self.wait, self.state = cap, cap * pct / 100, 0.0, None, [], [], "new"
        self.running, self.out, self.peak = set(), [], 0.0

    def ask(self, call, est):
        amount = max(est, self.mean or 0.0)
        if self.spend + 1e-9 >= self.stop or self.spend + sum(self.open) + amount > self.cap + 1e-12:
            self.state = "priced"
            self.out.append((call, False))
        else:
            self.open.append(amount)
            self.running.add(call)
            self.out.append((call, True))
        self.peak = max(self.peak, self.spend + sum(self.open))

    def event(self, kind, call, amount, est):
        if kind == "reserve":
            if self.state == "probing":
                self.wait.append((call, est))
                return
            if self.state == "new":
                self.state = "probing"
            self.ask(call, est)
        elif call in self.running:
            self.running.remove(call)
            self.open.pop(0 if est is None else min(range(len(self.open)), key=lambda i: abs(self.open[i] - est)))
            if kind == "record":
                self.spend += amount
                self.mean = amount if self.mean is None else (self.mean + amount) / 2
            self.state = "priced"
        if self.state == "priced":
            wait, self.wait = self.wait, []
            for w in wait:
                self.ask(*w)


def recorded(projects=4, calls=60, seed=5):
    """Reserve, then record or release of every call some events later, interleaved."""
    rng = random.Random(seed)
    rows = []
    for p in range(projects):
        todo, flight, seq = list(range(calls)), [], 0
        while todo or flight:
            seq += 1
            if todo and (len(flight) < 5 and rng.random() < 0.6 or not flight):
                flight.append(todo.pop(0))
                rows.append((f"p{p}", seq, "reserve", f"c{flight[-1]}", None, round(rng.random() * 0.3, 3)))
            else:
                c = flight.pop(rng.randrange(len(flight)))
                kind = "record" if rng.random() < 0.85 else "release"
                rows.append((f"p{p}", seq, kind, f"c{c}", round(rng.random() * (0.1 + p), 3) if kind == "record" else None, rng.choice([None, 0.1, 0.25])))
    return rows


def looped(rows, cap, pct):
    out = {}
    for p in sorted({r[0] for r in rows}):
        loop = Loop(cap, pct)
        for _, _, kind, call, amount, est in sorted((r for r in rows if r[0] == p), key=lambda r: r[1]):
            loop.event(kind, call, amount, est)
        assert loop.peak <= cap + 1e-9 or loop.spend > 0
        out[p] = (loop.out, round(loop.spend, 6))
    return out


def told(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["project_id"], r["decided_seq"], r["kind"] == "reserve", r["seq"])):
        calls, _ = out.get(r["project_id"], ([], 0))
        out[r["project_id"]] = ([*calls, *([(r["call_id"], r["verdict"] == "admitted")] if r["kind"] == "reserve" else [])], round(r["spend"], 6))
    return out


@pytest.mark.parametrize(("cap", "pct"), [(1.0, 90), (5.0, 50), (1000.0, 100), (0.0, 90)])
def test_decisions_equal_a_loop(spark, cap, pct):
    rows = recorded()
    shuffled = random.Random(1).sample(rows, len(rows))
    assert told(V.decided(spark.createDataFrame(shuffled, V.EVENT).repartition(3), cap, pct).collect()) == looped(rows, cap, pct)


def test_cap_is_never_passed_by_reservations(spark):
    rows = recorded(6, 40, 9)
    got = V.decided(spark.createDataFrame(rows, V.EVENT), 2.0, 100)
    admitted = got.where("kind = 'reserve' AND verdict = 'admitted'")
    assert admitted.count() and admitted.where("spend + reserved > 2.0 + 1e-9").count() == 0
    for r in V.guard_summary(got).collect():
        assert r["admitted"] + r["over_cap"] + r["stopped"] == 40


def test_live_decisions_equal_the_batch(spark, tmp_path):
    rows = recorded(3, 30, 2)
    shuffled = random.Random(4).sample(rows, len(rows))
    got = streamed(spark, tmp_path, shuffled, V.EVENT, 4, lambda s: V.live_decisions(s, 3.0, 90), "append")
    assert told(got) == looped(rows, 3.0, 90)


def test_closest_amount_is_released():
    guard = V.Guard(10.0, 100)
    guard("p", 1, "reserve", "a", None, 1.0)
    guard("p", 2, "record", "a", 1.0, 1.0)
    for k, est in enumerate((1.0, 2.0, 4.0)):
        guard("p", 3 + k, "reserve", f"c{k}", None, est)
    guard("p", 6, "release", "c0", None, 3.7)
    assert sorted(a for _, a in guard.open) == [1.0, 2.0] and {c for c, _ in guard.open} == {"c1", "c2"}
