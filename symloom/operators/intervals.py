"""As-of join of points with the intervals that hold them, in one sweep over each key."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

_BATCH = 20_000


def innermost(points: DataFrame, intervals: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(point_id, depth, best): how many intervals of its key hold a point, and the one of these that is greatest in `order`.

    `points` has the keys, `at` and `point_id`; `intervals` the keys, `start`, `end` (null: open for good), the integer
    columns of `order` (null ranks lowest) and `value`. Both ends belong to an interval. Points that nothing holds, and
    rows with a null key, place or start, give no row; intervals given twice count twice.

    Points and intervals of a key are sorted together and swept once with the intervals that are open at the time, so the work grows
    with their number, not with that of pairs. Only open intervals are held in memory.
    """
    value, ident = intervals.schema["value"].dataType, points.schema["point_id"].dataType
    null = lambda t: F.lit(None).cast(t)
    ranks = F.array(*[F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 62))) for c in order])
    a = intervals.select(*keys, F.col("start").cast("long").alias("_at"), F.lit(0).alias("_what"), F.col("end").cast("long").alias("_end"), ranks.alias("_ranks"), F.col("value").alias("_value"), null(ident).alias("_id"))
    b = points.select(*keys, F.col("at").cast("long").alias("_at"), F.lit(1).alias("_what"), null("long").alias("_end"), null("array<bigint>").alias("_ranks"), null(value).alias("_value"), F.col("point_id").alias("_id"))
    rows = a.unionAll(b).where(F.col("_at").isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    # where an interval starts at a point, it holds it
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "_at", "_what")
    out = rows.select(F.col("_id").alias("point_id"), F.lit(0).cast("long").alias("depth"), F.col("_value").alias("best")).schema
    arrow = to_arrow_schema(out)
    n = len(keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ends, got = None, [], [], []
        count = 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if row[:n] != key:
                    key, held, ends = row[:n], [], []
                at, what, end, order_by, payload, ident_ = row[n:]
                while ends and ends[0] < at:
                    heapq.heappop(ends)
                if not what:
                    count += 1
                    until = end if end is not None else float("inf")
                    if until >= at:
                        heapq.heappush(ends, until)
                        heapq.heappush(held, ([-x for x in order_by], count, until, payload))
                    continue
                while held and held[0][2] < at:
                    heapq.heappop(held)
                if held:
                    got.append({"point_id": ident_, "depth": len(ends), "best": held[0][3]})
                if len(got) >= _BATCH:
                    yield pa.RecordBatch.from_pylist(got, arrow)
                    got = []
        yield pa.RecordBatch.from_pylist(got, arrow)

    return rows.mapInArrow(run, out)
