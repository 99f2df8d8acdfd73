import random

from symloom.operators.snapshots import snapshot_changes
from pyspark.sql import functions as F

SCHEMA = "snapshot_id int, worktree_key string, rel_path string, content_hash string, git_oid binary, generation long, k string"
KEYS = ["worktree_key", "rel_path"]


def changes(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in snapshot_changes(df, "snapshot_id", KEYS, [F.col("content_hash"), F.col("git_oid")], "generation").collect())


def brute(rows):
    state = {}
    for s, w, p, h, o, g in rows:
        old = state.setdefault(s, {}).get((w, p))
        if old is None or (g if g is not None else -1) > old[0]:
            state[s][(w, p)] = (g if g is not None else -1, h, o)
    out, ids = [], sorted(state)
    for a, b in zip(ids, ids[1:]):
        for k in {*state[a], *state[b]}:
            x, y = state[a].get(k), state[b].get(k)
            kind = "added" if x is None else "removed" if y is None else "changed" if x[1:] != y[1:] else None
            if kind:
                out.append((b, *k, kind))
    return sorted(out, key=str)


def test_events_of_each_kind(spark):
    rows = [
        (1, "w", "a", "h1", b"1", 1), (1, "w", "b", "h1", None, 1), (1, "w", "c", "h1", b"1", 1), (1, "w", "d", "h", b"", 1),
        (3, "w", "a", "h2", b"1", 1), (3, "w", "b", "h1", b"1", 1), (3, "w", "d", "h", b"", 2), (3, "w", "d", "old", b"", 1),
        (7, "w", "a", "h2", b"1", 1), (7, "w", "c", "h1", b"1", 1), (7, "w", "d", "h", b"", 5), (7, "w", "d", "h", b"", 5), (7, "w", "b", "h1", b"1", 9),
    ]
    assert changes(spark, rows) == [(3, "w", "a", "changed"), (3, "w", "b", "changed"), (3, "w", "c", "removed"), (7, "w", "c", "added")]


def test_against_brute_force_with_nulls_and_repeats(spark):
    rng = random.Random(5)
    rows = []
    for s in (2, 3, 5, 9):
        for p in [*"abcdefghij", None]:
            for g in rng.sample(range(5), rng.randint(0, 3)):
                rows.append((s, rng.choice(["w", "v"]), p, rng.choice(["h", "i", None]), rng.choice([None, b"x"]), g))
    seen, once = set(), []
    for r in rows:
        if (k := (*r[:3], r[5])) not in seen:
            seen.add(k)
            once.append(r)
    got = sorted(changes_any(spark, once + once), key=str)
    assert got == brute(once)


def changes_any(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return [tuple(r) for r in snapshot_changes(df, "snapshot_id", KEYS, [F.col("content_hash"), F.col("git_oid")], "generation").collect()]


def test_empty_and_single(spark):
    assert changes(spark, []) == []
    assert changes(spark, [(1, "w", "a", "h", None, 1)]) == []
