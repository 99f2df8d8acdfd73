"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.session import scratch

#: A cut is found bucket by bucket, each time among as many; what is left in the last one is sorted.
BUCKET_BITS, LEVELS = 12, 2


def plain_source(source: Column) -> Column:
    """One spelling per source: lower case, outer blanks gone, runs of blanks and separators as one `_`; null stays null."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_.\-]+", "_")


def _written(rows: DataFrame, purpose: str) -> DataFrame:
    """A small table, written once to the shared folder, as several steps read it."""
    spark = rows.sparkSession
    path = scratch(spark, purpose)
    rows.write.parquet(path)
    return spark.read.parquet(path)


def water_fill(sources: DataFrame, total: float) -> DataFrame:
    """`give` and `clamped` for sources (target, cap, ...): divides `total` by the targets; a source beyond its cap is
    clamped, and its excess goes to the others in proportion to their targets, until all fit or all are clamped.

    Each round is one aggregate over the table of sources, of which only two sums come back: what the clamped give and
    the targets of the others, which make the level that a target of 1 would get. The level only rises, so a source once
    clamped stays so, and there are no more rounds than sources that get clamped at different levels.
    """
    level, clamped = 0.0, -1
    while True:
        over = F.col("cap") < F.lit(level) * F.col("target")
        fixed, free, n = sources.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("target"))), F.sum(over.cast("int"))).first()
        if not free or n == clamped:  # all are clamped or have no target, or none came to it
            break
        level, clamped = max(0.0, total - fixed) / free, n
    over = F.col("cap") < F.lit(level) * F.col("target")
    return sources.withColumn("give", F.when(over, F.col("cap")).otherwise(F.lit(level) * F.col("target"))).withColumn("clamped", over)


def plan(sizes: DataFrame, weights: DataFrame, total: float | None = None) -> DataFrame:
    """How many tokens each weighted source gives: (source, target, size, cap, give, clamped). Without `total` as many
    as the weighted sources hold once.

    A source without documents gives nothing; null or negative weights and repeats count as 0. A source that is given
    several rows of weights counts with the sum of its shares and its largest number of repeats.
    """
    wanted = (
        weights.where(F.col("source").isNotNull())
        .groupBy(plain_source(F.col("source")).alias("source"))
        .agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("_r"))
    )
    held = sizes.groupBy("source").agg(F.sum("n_tokens").alias("size"))
    both = wanted.join(held, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    sources = _written(both.select("source", "target", "size", (F.col("size") * F.col("_r")).cast("double").alias("cap")), "sources")
    every = sources.agg(F.sum("size")).first()[0] or 0
    return _written(water_fill(sources, float(every) if total is None else total), "plan")


def _edge(docs: DataFrame, level: int) -> DataFrame:
    """(source, _b, _before): of each source, the bucket of this level where the tokens reach its part, and those before."""
    upto = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = docs.groupBy("source", _bucket(level).alias("_b")).agg(F.sum("n_tokens").alias("_n"), F.max("part").alias("part"), F.max("_before").alias("_base"))
    sums = sums.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    first = sums.where(F.col("_before") + F.col("_n") > F.col("part")).groupBy("source").agg(F.min(F.struct("_b", "_before")).alias("e"))
    return _written(first.select("source", "e._b", "e._before"), "edge")


def _bucket(level: int) -> Column:
    return F.shiftrightunsigned("_h", 64 - BUCKET_BITS * (level + 1)).bitwiseAND(F.lit((1 << BUCKET_BITS) - 1).cast("long"))


def sample(sizes: DataFrame, shares: DataFrame, seed: int, key: str) -> DataFrame:
    """(key, source, n_tokens, copies): every document of a source as often as whole repetitions fit, and a seeded
    part of them once more, so that the source gives its tokens to within one document.

    The part is cut exactly without sorting a source: documents fall by seeded hash into 4096 buckets, whose token sums
    show the one where the cut lies, and those of that one into 4096 again; only what is left there, a row in 16 million,
    is sorted. Documents without tokens or without a weighted source are in no mixture.
    """
    goal = shares.where("size > 0").select("source", F.floor(F.col("give") / F.col("size")).cast("int").alias("whole"), (F.col("give") - F.col("size") * F.floor(F.col("give") / F.col("size"))).alias("part"))
    docs = sizes.where(F.col("n_tokens") > 0).join(goal, "source").withColumn("_h", F.xxhash64(F.lit(seed), F.col(key), F.col("source"))).withColumn("_before", F.lit(0).cast("long"))
    picked, there = None, [key, "source", "n_tokens", "whole", "_more"]
    for level in range(LEVELS):
        edge = _edge(docs, level)
        at = docs.drop("_before").withColumn("_at", _bucket(level)).join(edge, "source", "left")
        # a source whose part is never reached gives all; one at its edge bucket goes on to the next level
        sure = at.where(F.col("_b").isNull() | (F.col("_at") != F.col("_b"))).withColumn("_more", F.coalesce(F.col("_at") < F.col("_b"), F.lit(True))).select(there)
        picked = sure if picked is None else picked.unionAll(sure)
        docs = at.where(F.col("_at") == F.col("_b")).drop("_at", "_b")
    run = Window.partitionBy("source").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = docs.withColumn("_more", F.col("_before") + F.sum("n_tokens").over(run) - F.col("n_tokens") / 2 <= F.col("part")).select(there)
    out = picked.unionAll(cut).select(key, "source", "n_tokens", (F.col("whole") + F.col("_more").cast("int")).alias("copies"))
    return out.where(F.col("copies") > 0)


def report(mix: DataFrame, shares: DataFrame) -> DataFrame:
    """Per weighted source: target and actual share, tokens there are and given, copies and the largest repetition."""
    goal = shares.select("source", F.col("target").alias("target_share"), F.col("size").alias("available_tokens"), F.col("give").alias("planned_tokens"), F.col("clamped").alias("capped"))
    got = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    both = goal.join(got, "source", "left").fillna(0, ["tokens", "copies", "most_copies"])
    every = F.sum("tokens").over(Window.partitionBy())  # a row per source
    return both.withColumn("actual_share", F.when(every > 0, F.col("tokens") / every).otherwise(0.0))
