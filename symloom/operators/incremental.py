"""Only new or changed records, run by run."""

from __future__ import annotations

import time
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.operators.ledger import Lease, WorkLedger

#: Where a batch keeps the state after its last run, beside its runs.
STATE = -1
#: Runs that are worked out together. More make more batches, each of which starts from the state of the one before.
BATCH = 256


class OpenRuns(RuntimeError):
    """Other workers hold runs and were not done in time."""


def succeeded_runs(runs: DataFrame) -> list[tuple]:
    """(started_at, run_id) of the runs that count, in their order; a run without start or id can't be placed and is left
    out. One small row per run of a job that runs some times a day."""
    return [
        tuple(r)
        for r in runs.where((F.col("status") == "succeeded") & F.col("started_at").isNotNull() & F.col("run_id").isNotNull())
        .select("started_at", "run_id").distinct().orderBy("started_at", "run_id").collect()
    ]


def first_at_or_after(value: Column, bounds: list) -> Column:
    """Position of the first bound >= value, by a search tree of comparisons; null beyond the last or for a null value."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo if lo < len(bounds) else None).cast("int")
        mid = (lo + hi) // 2
        return F.when(value <= F.lit(bounds[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return F.when(value.isNotNull(), search(0, len(bounds)))


def seen_rows(manifest: DataFrame, runs: list[tuple], keys: list[str], content: Column, after: object = None) -> DataFrame:
    """(keys, _run, _row): per key and run the newest row (generation, then loaded_at, then content) among those that the
    run is the first to see. Only rows loaded after `after` and up to the last run are read, and the newest are found before the
    shuffle."""
    loaded = F.col("loaded_at")
    window = (loaded <= F.lit(runs[-1][0])) if after is None else (loaded > F.lit(after)) & (loaded <= F.lit(runs[-1][0]))
    at = first_at_or_after(loaded, [r[0] for r in runs])
    row = F.struct(F.col("generation").alias("g"), loaded.alias("t"), content.alias("c")).alias("_row")
    return manifest.where(window).select(*keys, at.alias("_run"), row).groupBy(*keys, "_run").agg(F.max("_row").alias("_row"))


def _states(newest: DataFrame, keys: list[str]) -> DataFrame:
    """States of each key at each run where it has rows, whether it is a case there, and whether it is the key's last;
    run -1 is the state before the first."""
    by_key = Window.partitionBy(*keys).orderBy("_run")
    states = newest.select(*keys, "_run", F.max("_row").over(by_key.rowsBetween(Window.unboundedPreceding, 0)).alias("_state"), F.lead("_run").over(by_key).isNull().alias("_last"))
    before = F.lag(F.struct(F.col("_state.c").alias("c"))).over(by_key)
    return states.withColumn("_case", (F.col("_run") >= 0) & (before.isNull() | ~before["c"].eqNullSafe(F.col("_state.c"))))


def _ids(runs: list[tuple]) -> Column:
    return F.element_at(F.array(*[F.lit(r[1]).cast("long") for r in runs]), F.col("_run") + 1)


def run_deltas(manifest: DataFrame, runs: list[tuple], keys: list[str], content: Column, base: DataFrame | None = None, after: object = None) -> DataFrame:
    """Per run the keys it must process: (run_id, keys).

    Each row belongs to the first run that sees it; the running maximum over a key's runs is its state at each run, and
    a case is a state whose content differs from that at the run before, or the first. Resent, late and repeated rows
    fall out by themselves. A null content is a content of its own; a null generation ranks lowest. Rows without
    loaded_at are never seen. A key has at most one row per run after the first aggregation. With `base` (keys, _row),
    the state at a run that started at `after`, only later rows are read.
    """
    if not runs:
        return manifest.select(F.lit(None).cast("long").alias("run_id"), *keys).where(F.lit(False))
    newest = seen_rows(manifest, runs, keys, content, after)
    if base is not None:
        newest = newest.unionByName(base.select(*keys, F.lit(-1).alias("_run"), "_row"))
    return _states(newest, keys).where("_case").select(_ids(runs).alias("run_id"), *keys)


def _place(lease: Lease) -> str:
    """Where a batch's result lies: it follows from its first item and the token."""
    return f"batch={lease.item}.{lease.token}"


def process_runs(
    spark: SparkSession, manifest: DataFrame, runs: DataFrame, keys: list[str], content: Column, root: str, worker: str | None = None, batch: int = BATCH, patience: float | None = None, lease_seconds: float = 3600.0
) -> DataFrame:
    """Bring the ledger below `root` up to date with `runs` and return all results (run_id, keys).

    Every succeeded run is one item. Pending runs are taken in order, up to `batch` at a time. A batch starts from the
    state that the last done batch left, one row per key, and reads only rows loaded since; it writes its result and its
    own state to folders of its token, and then commits run by run in order. Its leases are renewed while it works. Called
    again after a failure at any point, or with further runs, it works out only what is not done. Runs that another
    worker holds are waited for, at most for `patience` seconds (two terms of a lease unless given); then OpenRuns is
    raised, as the rows would not be whole. A run that turns up later than a done run after it is worked out from all rows,
    and the done one keeps its result. Without succeeded runs there are no rows.
    """
    todo = succeeded_runs(runs)
    if not todo:
        return run_deltas(manifest, [], keys, content)
    ledger = WorkLedger(spark, root, lease_seconds)
    item = lambda run: f"run_id={run[1]}"
    ledger.add([item(r) for r in todo])
    deadline = ledger.clock() + (2 * lease_seconds if patience is None else patience)
    while True:
        states = ledger.states()
        if all(states[item(r)] == "done" for r in todo):
            break
        first = next(k for k, r in enumerate(todo) if states[item(r)] != "done")
        leases: list[tuple[int, Lease]] = []
        for k in range(first, len(todo)):  # a stretch of runs, so that one state stands before it
            lease = ledger.lease(item(todo[k]), worker) if states[item(todo[k])] == "pending" and len(leases) < batch else None
            if lease is None:
                break
            leases.append((k, lease))
        if leases:
            _work(spark, ledger, manifest, todo, leases, states, keys, content, item)
        elif ledger.clock() > deadline:
            raise OpenRuns(", ".join(i for i, s in states.items() if s == "leased"))
        else:
            time.sleep(min(5.0, lease_seconds / 10))
    return _results(spark, ledger, manifest, [item(r) for r in todo], keys)


def _work(spark: SparkSession, ledger: WorkLedger, manifest: DataFrame, todo: list[tuple], leases: list[tuple[int, Lease]], states: dict[str, str], keys: list[str], content: Column, item) -> None:
    """Work out and commit one batch."""
    low, high = leases[0][0], leases[-1][0]
    place, mine = _place(leases[0][1]), todo[low : high + 1]
    with ledger.held([lease for _, lease in leases]):
        base, old = None, None
        if low and states[item(todo[low - 1])] == "done":
            old = f"{ledger.root}/out/{ledger.result(item(todo[low - 1]))}/run_id={STATE}"
            # a batch that was cut short left the state of a later run
            base = spark.read.parquet(old).where(F.col("_upto") == F.lit(todo[low - 1][1])) if ledger.exists(old) else None
            base = None if base is None or base.isEmpty() else base
        if base is not None:
            newest = seen_rows(manifest, mine, keys, content, todo[low - 1][0]).unionByName(base.select(*keys, F.lit(-1).alias("_run"), "_row"))
        else:  # the run before is worked out too, as the state
            newest = seen_rows(manifest, todo[max(low - 1, 0) : high + 1], keys, content).withColumn("_run", F.col("_run") - (1 if low else 0))
        nothing = F.lit(None)
        case = F.when(F.col("_case"), F.struct(_ids(mine).alias("run_id"), nothing.cast(newest.schema["_row"].dataType).alias("_row"), nothing.cast("long").alias("_upto")))
        state = F.when(F.col("_last"), F.struct(F.lit(STATE).cast("long").alias("run_id"), F.col("_state").alias("_row"), F.lit(todo[high][1]).cast("long").alias("_upto")))
        out = _states(newest, keys).select(*keys, F.explode(F.array(case, state)).alias("_o")).where(F.col("_o").isNotNull()).select(*keys, "_o.*")
        # tasks write few files, and a run that holds most rows is divided
        out.hint("rebalance", "run_id").write.mode("overwrite").partitionBy("run_id").parquet(f"{ledger.root}/out/{place}")
        for _, lease in leases:
            ledger.commit(lease, place)
    if old and ledger.result(item(todo[low])) == place:
        ledger.delete(old)


def _results(spark: SparkSession, ledger: WorkLedger, manifest: DataFrame, items: list[str], keys: list[str]) -> DataFrame:
    """The rows of the items, each from the batch that committed it."""
    by_place: dict[str, list[int]] = defaultdict(list)
    for i in items:
        by_place[ledger.result(i)].append(int(i.partition("=")[2]))
    schema = T.StructType([*[manifest.schema[k] for k in keys], T.StructField("batch", T.StringType()), T.StructField("run_id", T.LongType())])
    rows = spark.read.schema(schema).option("basePath", f"{ledger.root}/out").parquet(*[f"{ledger.root}/out/{p}" for p in by_place])
    mine = F.lit(False)
    for place, ids in by_place.items():  # partitions of a place that another token committed are passed over
        mine = mine | ((F.col("batch") == place.partition("=")[2]) & F.col("run_id").isin(ids))
    return rows.where(mine).select("run_id", *keys)
