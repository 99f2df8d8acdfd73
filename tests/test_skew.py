from collections import defaultdict
import random

from pyspark.sql import functions as F

from symloom.operators import skew

P = "word_hash long, worktree_key string, rel_path string, generation long"
U = "content_hash string, word_hashes array<long>"


def test_states_and_join_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.4 else rng.randint(2, 9), rng.choice("ab"), rng.choice("xyz"), rng.randint(1, 5)) for _ in range(300)] + [(None, "a", "x", 1), (7, None, None, None)]
    units = [("h1", [1, 1, 2]), ("h2", None), ("h3", []), ("h4", [1, None, 9])]
    got = {r["word_hash"]: tuple(r)[1:] for r in skew.eager_join(skew.posting_states(spark.createDataFrame(rows, P)), skew.unit_states(spark.createDataFrame(units, U)), "word_hash", ["units", "occurrences"], {"pairs": ("n_rows", "units")}).collect()}
    by = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            by[r[0]].append(r[1:])
    for w, rs in by.items():
        units_with = sum(w in (a or []) for _, a in units)
        occ = sum((a or []).count(w) for _, a in units)
        gens = [g for *_, g in rs if g is not None]
        assert got[w] == (len({r[:2] for r in rs}), len({r[0] for r in rs}), len(rs), max(gens) if gens else None, units_with, occ, len(rs) * units_with)
    assert set(got) == set(by)


def test_heavy(spark):
    s = spark.createDataFrame([(1, 98), (2, 1), (3, 1)], "k long, w long")
    assert [r[0] for r in skew.heavy_keys(s, "k", "w", F.lit(0.01)).collect()] == [1]


def test_empty(spark):
    e = skew.posting_states(spark.createDataFrame([], P))
    assert skew.eager_join(e, skew.unit_states(spark.createDataFrame([], U)), "word_hash", ["units"], {}).count() == 0
