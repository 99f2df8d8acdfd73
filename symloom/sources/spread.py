"""Task layout for scans that feed heavy per-row Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tasks(spark: SparkSession, per_core: int = 4) -> int:
    """How many partitions a shuffle should make whose rows feed Python: as configured, but enough for all cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), per_core * spark.sparkContext.defaultParallelism)


def spread(rows: DataFrame, per_core: int = 4) -> DataFrame:
    """The same rows over enough tasks to occupy all cores.

    A scan of few files or row groups gives fewer tasks than cores; only then are the rows dealt out again. A large
    scan already has more splits than that and is left as it is, without a shuffle. Rows that come out of a shuffle are
    left as they are too: to ask for their number would run it.
    """
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        return rows
    least = per_core * rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= 4 * least else rows.repartition(least)
