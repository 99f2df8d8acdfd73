"""Per-key results when a few keys hold most rows: aggregate before joining, in steps that spread a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def posting_states(postings: DataFrame) -> DataFrame:
    """Per word_hash: `files`, `worktrees`, `n_rows`, `latest_generation`.

    Rows are first folded to distinct (word, worktree, path), which spreads a hot word over all tasks, then to
    (word, worktree), then to the word; each step combines before its shuffle. Null words are left out; a null path or
    worktree counts as one value.
    """
    entry = (
        postings.where(F.col("word_hash").isNotNull())
        .groupBy("word_hash", "worktree_key", "rel_path")
        .agg(F.count(F.lit(1)).alias("n"), F.max("generation").alias("g"))
    )
    per_tree = entry.groupBy("word_hash", "worktree_key").agg(F.count(F.lit(1)).alias("f"), F.sum("n").alias("n"), F.max("g").alias("g"))
    return per_tree.groupBy("word_hash").agg(
        F.sum("f").alias("files"), F.count(F.lit(1)).alias("worktrees"), F.sum("n").alias("n_rows"), F.max("g").alias("latest_generation")
    )


def unit_states(units: DataFrame) -> DataFrame:
    """Per word_hash of the unit arrays: `units` with the word and its `occurrences`. Null arrays and words count nothing."""
    per_unit = units.select(F.explode("word_hashes").alias("word_hash"))
    # `units` needs distinct words per unit: repeats inside one array are folded in place, without a shuffle
    distinct = units.select(F.explode(F.array_distinct("word_hashes")).alias("word_hash")).select("word_hash", F.lit(1).alias("u"), F.lit(0).alias("o"))
    both = per_unit.select("word_hash", F.lit(0).alias("u"), F.lit(1).alias("o")).unionAll(distinct)
    return both.where(F.col("word_hash").isNotNull()).groupBy("word_hash").agg(F.sum("u").alias("units"), F.sum("o").alias("occurrences"))


def eager_join(left: DataFrame, right: DataFrame, key: str, right_zero: list[str], products: dict[str, tuple[str, str]]) -> DataFrame:
    """Join two compact states that each hold one row per key, and combine them algebraically.

    `products` names columns that the unaggregated join would have counted: the product of a column of either side.
    Columns in `right_zero` are 0 where the right side lacks the key. No group is ever expanded: a key with a rows left
    and b rows right costs one row, not a x b.
    """
    joined = left.join(right, key, "left").select(*left.columns, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in right_zero])
    return joined.withColumns({name: F.col(a) * F.col(b) for name, (a, b) in products.items()})


def heavy_keys(states: DataFrame, key: str, weight: str, share: Column) -> DataFrame:
    """Keys whose weight is more than `share` of the sum of all weights."""
    total = states.agg(F.sum(weight)).scalar()
    return states.where(F.col(weight) > total * share).select(key)
