import datetime as dt
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from symloom.operators.incremental import OpenRuns, first_at_or_after, process_runs, run_deltas, succeeded_runs
from symloom.operators.ledger import StaleLease, WorkLedger
from symloom.session import scratch, shared_dir

M = "worktree_key string, rel_path string, content_hash string, generation long, loaded_at timestamp_ntz, extra int"
R = "run_id long, started_at timestamp_ntz, finished_at timestamp_ntz, status string"
KEYS = ["worktree_key", "rel_path"]


def at(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(hours=n)


def tables(spark):
    runs = spark.createDataFrame([(1, at(1), None, "succeeded"), (2, at(2), None, "failed"), (4, at(3), None, "succeeded"), (5, at(4), None, None), (6, at(5), None, "succeeded")], R)
    rows = [
        ("w", "a", "h1", 1, at(0), 0), ("w", "a", "h1", 2, at(2), 0),  # unchanged, written again
        ("w", "b", "h1", 1, at(0), 0), ("w", "b", "h2", 2, at(2), 0), ("w", "b", "h1", 3, at(3), 0),  # changed and back before run 4
        ("w", "c", "h1", 1, at(0), 0), ("w", "c", "h2", 2, at(1.5), 0), ("w", "c", "h2", 2, at(1.5), 0),  # sent twice
        ("w", "d", "h9", 5, at(1), 0), ("w", "d", "h8", 4, at(4), 0),  # a late row of an older generation
        ("w", "e", "h1", 1, at(9), 0), ("w", "f", None, 1, at(4), 0), ("w", "g", "h", 1, None, 0),
    ]
    return spark.createDataFrame(rows, M), runs


WANT = [(1, "w", "a"), (1, "w", "b"), (1, "w", "c"), (1, "w", "d"), (4, "w", "c"), (6, "w", "f")]


def test_deltas(spark):
    m, r = tables(spark)
    assert sorted(map(tuple, run_deltas(m, succeeded_runs(r), KEYS, F.col("content_hash")).collect())) == WANT


def test_process_is_restartable(spark):
    m, r = tables(spark)
    root = scratch(spark, "ledger")
    first = process_runs(spark, m, r.where("run_id < 6"), KEYS, F.col("content_hash"), root)
    assert sorted(map(tuple, first.collect())) == WANT[:5]
    # the run that is done is not touched again; the new one is added
    again = process_runs(spark, m, r, KEYS, F.col("content_hash"), root)
    assert sorted(map(tuple, again.collect())) == WANT
    assert set(WorkLedger(spark, root).states().values()) == {"done"}
    assert sorted(map(tuple, process_runs(spark, m, r, KEYS, F.col("content_hash"), root).collect())) == WANT


def test_no_runs(spark):
    m, r = tables(spark)
    assert run_deltas(m, [], KEYS, F.col("content_hash")).collect() == []
    assert process_runs(spark, m, r.where("false"), KEYS, F.col("content_hash"), scratch(spark, "none")).collect() == []
    assert process_runs(spark, m.where("false"), r, KEYS, F.col("content_hash"), scratch(spark, "none")).collect() == []


@pytest.mark.parametrize("batch", [1, 2, 256])
def test_batches_and_late_rows_against_brute_force(spark, batch):
    rng = random.Random(batch)
    rows = [("w", rng.choice("abcdefg"), rng.choice(["h1", "h2", None]), rng.randint(1, 9), at(rng.randint(0, 40)), 0) for _ in range(150)]
    runs = [(k, at(3 * k + 1), None, "succeeded") for k in range(1, 12)]
    want, before = set(), {}
    for k, start, *_ in runs:
        state = {}
        for w, p, h, g, t, _ in rows:
            if t <= start:
                state[w, p] = max(state.get((w, p), (0, at(-1), "")), (g, t, h or ""))
        want |= {(k, *key) for key, row in state.items() if key not in before or before[key][2] != row[2]}
        before = state
    m, r = spark.createDataFrame(rows, M), spark.createDataFrame(runs, R)
    root = scratch(spark, "ledger")
    # in two calls: the second starts from the state that the first one left, and sees only rows loaded since
    process_runs(spark, m.where(F.col("loaded_at") <= F.lit(at(16))), r.where("run_id <= 5"), KEYS, F.col("content_hash"), root, batch=batch)
    rest = m.where(F.col("loaded_at") > F.lit(at(16)))
    assert sorted(map(tuple, process_runs(spark, rest, r, KEYS, F.col("content_hash"), root, batch=batch).collect())) == sorted(want)


def test_a_run_that_turns_up_late(spark):
    m, r = tables(spark)
    root = scratch(spark, "ledger")
    process_runs(spark, m, r.where("run_id <> 4"), KEYS, F.col("content_hash"), root)
    got = process_runs(spark, m, r, KEYS, F.col("content_hash"), root)
    assert sorted(x[1:] for x in map(tuple, got.where("run_id = 4").collect())) == [("w", "c")]


def test_a_crash_at_any_step_loses_and_doubles_nothing(spark, monkeypatch):
    m, r = tables(spark)
    for fail_at in range(4):
        root = scratch(spark, "ledger")
        real, calls = WorkLedger.commit, [0]

        def commit(self, lease, place, real=real, calls=calls, fail_at=fail_at):
            calls[0] += 1
            if calls[0] > fail_at:
                raise OSError("gone")
            return real(self, lease, place)

        monkeypatch.setattr(WorkLedger, "commit", commit)
        try:
            process_runs(spark, m, r, KEYS, F.col("content_hash"), root, worker="A", lease_seconds=0.2)
        except OSError:
            pass
        monkeypatch.setattr(WorkLedger, "commit", real)
        # the leases of the dead worker expire, and another one takes over
        got = process_runs(spark, m, r, KEYS, F.col("content_hash"), root, worker="B", lease_seconds=5)
        assert sorted(map(tuple, got.collect())) == WANT
        assert set(WorkLedger(spark, root).states().values()) == {"done"}


def test_runs_held_by_another_are_waited_for_or_reported(spark):
    m, r = tables(spark)
    root = scratch(spark, "ledger")
    WorkLedger(spark, root).add(["run_id=4"])
    assert WorkLedger(spark, root).lease("run_id=4", "other")
    with pytest.raises(OpenRuns):
        process_runs(spark, m, r, KEYS, F.col("content_hash"), root, patience=0)


def test_leases_expire_and_stale_writers_are_fenced(spark):
    now = [100.0]
    root = f"{shared_dir(spark)}/l-{uuid.uuid4().hex}"
    ledger = WorkLedger(spark, root, 10, lambda: now[0])
    ledger.add(["x", "y"])
    a = ledger.lease("x", "A")
    assert ledger.state("x") == "leased" and ledger.lease("x", "B") is None and ledger.state("y") == "pending"
    now[0] = 109
    ledger.renew(a)
    now[0] = 118
    assert ledger.state("x") == "leased"
    now[0] = 120
    assert ledger.state("x") == "pending"
    b = ledger.lease("x", "B")
    assert (a.token, b.token) == (1, 2)
    for late in (lambda: ledger.commit(a, "one"), lambda: ledger.renew(a)):
        with pytest.raises(StaleLease):
            late()
    assert ledger.commit(b, "two") and ledger.state("x") == "done" and ledger.result("x") == "two"
    assert ledger.lease("x") is None
    # a retry of the commit, or a stale one, keeps what is there
    assert not ledger.commit(b, "two") and not ledger.commit(a, "one") and ledger.result("x") == "two"


def test_two_writers_behind_the_fence_at_once(spark, monkeypatch):
    now = [100.0]
    ledger = WorkLedger(spark, scratch(spark, "race"), 10, lambda: now[0])
    ledger.add(["x"])
    a = ledger.lease("x", "A")
    assert not ledger._create(a)
    now[0] = 200
    b = ledger.lease("x", "B")
    monkeypatch.setattr(WorkLedger, "fence", lambda self, lease: None)  # A looked before B took over
    assert sorted([ledger.commit(b, "two"), ledger.commit(a, "one")]) == [False, True] and ledger.result("x") == "two"


def test_leases_are_renewed_while_work_goes_on(spark):
    ledger = WorkLedger(spark, scratch(spark, "beat"), 0.6)
    ledger.add(["x"])
    a = ledger.lease("x", "A")
    with ledger.held([a]):
        time.sleep(1.5)
        assert ledger.state("x") == "leased"
    time.sleep(1)
    assert ledger.state("x") == "pending"


@pytest.mark.parametrize("n", [0, 1, 7, 256])
def test_search_tree(spark, n):
    bounds = list(range(0, 2 * n, 2))
    df = spark.range(-2, 2 * n + 3).select("id", first_at_or_after(F.col("id"), bounds).alias("k")).collect() if n else []
    for r in df:
        want = next((i for i, b in enumerate(bounds) if b >= r["id"]), None)
        assert r["k"] == want
