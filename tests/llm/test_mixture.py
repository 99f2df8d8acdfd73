import random

import pytest
from pyspark.sql import functions as F

from symloom.llm import mixture as M


def filled(spark, total, *rows):
    df = spark.createDataFrame(list(rows), "source string, target double, cap double")
    return {r["source"]: (r["give"], r["clamped"]) for r in M.water_fill(df, total).collect()}


def brute(total, rows):
    clamped = set()
    while True:
        free = sum(t for n, t, c in rows if n not in clamped)
        rest = total - sum(c for n, t, c in rows if n in clamped)
        if not free:
            return {n: c if n in clamped else 0.0 for n, t, c in rows}
        give = {n: c if n in clamped else max(0, rest) * t / free for n, t, c in rows}
        over = {n for n, t, c in rows if n not in clamped and give[n] > c}
        if not over:
            return give
        clamped |= over


def test_water_fill_clamps_and_redistributes(spark):
    got = filled(spark, 1000, ("a", 0.5, 100.0), ("b", 0.3, 2000.0), ("c", 0.2, 1000.0))
    assert {k: v[0] for k, v in got.items()} == pytest.approx({"a": 100, "b": 540, "c": 360}) and [got[k][1] for k in "abc"] == [True, False, False]
    assert {k: v[0] for k, v in filled(spark, 1000, ("a", 0.9, 10.0), ("b", 0.1, 20.0)).items()} == {"a": 10, "b": 20}  # more than all can give
    assert filled(spark, 5, ("a", 0.0, 10.0))["a"] == (0, False)
    assert M.water_fill(spark.createDataFrame([], "source string, target double, cap double"), 5).collect() == []


def test_many_sources_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"s{k}", rng.random(), float(rng.choice([0, 1, 10, 100]) * rng.random())) for k in range(12_000)]
    got = filled(spark, 50_000.0, *rows)
    assert {k: v[0] for k, v in got.items()} == pytest.approx(brute(50_000.0, rows))


def test_a_large_source_is_cut_to_a_document(spark):
    z = spark.range(60_000).select("id", F.lit("one").alias("source"), (F.col("id") % 5 + 1).alias("n_tokens"))
    w = spark.createDataFrame([("one", 1.0, 3)], "source string, target_share double, max_repeats int")
    for total in (0.0, 1.0, 12_345.0, 179_999.0, 180_000.0, 400_001.0):
        mix = M.sample(z, M.plan(z, w, total), 5, "id").agg(F.sum(F.col("copies") * F.col("n_tokens")), F.max("copies")).first()
        assert abs((mix[0] or 0) - total) <= 5 and (mix[1] or 0) <= 3


def sizes(spark):
    rows = [(i, "big", 10 + i % 7) for i in range(2000)] + [(5000 + i, "small", 10) for i in range(20)] + [(9000, "big", 0), (9001, None, 10), (9002, "other", 10)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def test_sample_meets_plan_and_caps(spark):
    z = sizes(spark)
    w = spark.createDataFrame([("Big ", 0.8, 1), ("SMALL", 0.2, 4), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    plan = M.plan(z, w)
    by = {s["source"]: s for s in plan.collect()}
    assert by["small"].give == 800 and by["small"].clamped
    mix = M.sample(z, plan, 1, "doc_id")
    got = {r["source"]: r for r in M.report(mix, plan).collect()}
    assert got["small"]["tokens"] == 800 and got["small"]["most_copies"] == 4
    assert abs(got["big"]["tokens"] - by["big"].give) <= 17 and got["big"]["most_copies"] == 1
    assert sum(r["actual_share"] for r in got.values()) == pytest.approx(1)
    assert got["none"]["tokens"] == 0 and mix.where("doc_id >= 9000").count() == 0
    # the same seed gives the same sample, another gives another
    key = lambda m: {tuple(r) for r in m.select("doc_id", "copies").collect()}
    half = M.plan(z, w, 10_000)
    a, b, c = (key(M.sample(z, half, s, "doc_id")) for s in (1, 1, 2))
    assert a == b != c
    assert abs(M.sample(z, half, 1, "doc_id").where("source = 'big'").agg(F.sum(F.col("copies") * F.col("n_tokens"))).first()[0] - 9200) <= 17


def test_spellings_and_empty(spark):
    df = spark.createDataFrame([(" API-docs ",), ("api docs",), ("API_DOCS",), (None,)], "s string")
    assert {r[0] for r in df.select(M.plain_source(F.col("s"))).collect()} == {"api_docs", None}
    z = sizes(spark).where("doc_id < 0")
    w = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    plan = M.plan(z, w)
    assert M.sample(z, plan, 1, "doc_id").count() == 0 and M.report(M.sample(z, plan, 1, "doc_id"), plan).first()["actual_share"] == 0
