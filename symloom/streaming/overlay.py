"""Unsaved edits as a stream: the last version of each path, folded into the overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symloom.operators.manifest import latest_events

EVENT = "seq bigint, op string, path string, version int, text string"


def fold(state: DataFrame | None, events: DataFrame) -> DataFrame:
    """The overlay (path, version, text, open) after a batch of events.

    The last event of a path holds, by version and then sequence. `close` drops the text and keeps the path's symbols,
    so the row stays with `open` false; `remove` deletes the row. Events without path are ignored.
    """
    last = latest_events(events.where(F.col("path").isNotNull()), "path", [F.col("version").desc_nulls_last(), F.col("seq").desc()])
    keep = last.where(F.col("op") != "remove").select("path", "version", F.when(F.col("op") != "close", F.col("text")).alias("text"), (F.col("op") != "close").alias("open"))
    if state is None:
        return keep
    return state.join(last.select("path"), "path", "left_anti").unionByName(keep)


def run(events: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keep the overlay up to date below `root`: each micro-batch writes the next generation; the newest one holds.

    A batch that is replayed after a failure writes the same generation again. State is one row per path. Of older
    generations the last one is kept, as it may still be read or be needed to replay.
    """
    spark = events.sparkSession

    def apply(batch: DataFrame, n: int) -> None:
        old = spark.read.parquet(f"{root}/{n - 1}") if n else None
        fold(old, batch).write.mode("overwrite").parquet(f"{root}/{n}")
        gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{n - 2}")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
