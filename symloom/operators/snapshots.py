"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_states(rows: DataFrame, snapshot: str, keys: list[str], values: list[Column], newest: str) -> DataFrame:
    """One row (keys, snapshot, _state) per key and snapshot: the row with the largest `newest` holds.

    `_state` is a 64-bit hash of `values`; hashes are only ever compared within one key. A null value is a value of its
    own. Among rows of equal `newest` the largest state holds, so repeated rows and retries give the same result; a
    null `newest` ranks lowest. The maximum is combined before the shuffle, so a key that is repeated any number of
    times sends one row per task.
    """
    # nulls are skipped by xxhash64, so their places are hashed too
    state = F.xxhash64(*values, F.concat(*[F.when(v.isNull(), "0").otherwise("1") for v in values]))
    return (
        rows.where(F.col(snapshot).isNotNull())
        .select(*keys, snapshot, F.struct(F.col(newest).alias("n"), state.alias("s")).alias("_top"))
        .groupBy(*keys, snapshot)
        .agg(F.max("_top").alias("_top"))
        .select(*keys, snapshot, F.col("_top.s").alias("_state"))
    )


def validity_intervals(states: DataFrame, snapshot: str, keys: list[str]) -> DataFrame:
    """Gaps and islands: maximal runs of consecutive snapshots in which a key has one state.

    Columns: keys, `first`, `last` (positions of snapshots in their order, from 0), `_state`, `_final` (position of the
    last snapshot of all). The list of snapshots is a table with one row per delivery.
    """
    order = (
        states.select(snapshot).distinct()
        .select(snapshot, (F.row_number().over(Window.orderBy(snapshot)) - 1).alias("_at"), (F.count(F.lit(1)).over(Window.partitionBy()) - 1).cast("int").alias("_final"))
    )
    by_key = Window.partitionBy(*keys).orderBy("_at")
    before = F.lag(F.struct("_at", "_state")).over(by_key)
    starts = before.isNull() | (before["_at"] != F.col("_at") - 1) | (before["_state"] != F.col("_state"))
    return (
        states.join(order, snapshot)
        .withColumn("_start", F.when(starts, 1).otherwise(0))
        .withColumn("_island", F.sum("_start").over(by_key))
        .groupBy(*keys, "_island")
        .agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.first("_state").alias("_state"), F.first("_final").alias("_final"))
    )


def interval_changes(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Change events (keys, `_at`, `change`) from the starts, ends and adjacencies of intervals.

    A start that touches the end of the interval before is `changed`, any other start is `added`; an end that nothing
    touches is `removed`, at the snapshot after it. The first snapshot has no events.
    """
    by_key = Window.partitionBy(*keys).orderBy("_island")
    touches = F.lag("last").over(by_key) == F.col("first") - 1
    touched = F.lead("first").over(by_key) == F.col("last") + 1
    start = F.when(F.col("first") > 0, F.struct(F.col("first").alias("_at"), F.when(touches, "changed").otherwise("added").alias("change")))
    end = F.when((F.col("last") < F.col("_final")) & ~F.coalesce(touched, F.lit(False)), F.struct((F.col("last") + 1).alias("_at"), F.lit("removed").alias("change")))
    return (
        intervals.select(*keys, start.alias("_a"), end.alias("_b"))
        .where(F.col("_a").isNotNull() | F.col("_b").isNotNull())
        .select(*keys, F.explode(F.array("_a", "_b")).alias("_e"))
        .where(F.col("_e").isNotNull())
        .select(*keys, "_e._at", "_e.change")
    )


def snapshot_changes(rows: DataFrame, snapshot: str, keys: list[str], values: list[Column], newest: str) -> DataFrame:
    """Which keys were added, removed or changed against the snapshot before: (snapshot, keys, change).

    `rows` may hold repeated and superseded rows and any other columns. Keys that are null are keys like any other; an
    empty table and a single snapshot give no rows.
    """
    kept = rows.select(*keys, snapshot, newest, *[v.alias(f"_v{i}") for i, v in enumerate(values)])
    states = snapshot_states(kept, snapshot, keys, [F.col(f"_v{i}") for i in range(len(values))], newest)
    events = interval_changes(validity_intervals(states, snapshot, keys), keys)
    ids = rows.select(snapshot).where(F.col(snapshot).isNotNull()).distinct().select(F.col(snapshot), (F.row_number().over(Window.orderBy(snapshot)) - 1).alias("_at"))
    return events.join(ids, "_at").select(snapshot, *keys, "change")
