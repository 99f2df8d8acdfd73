"""The corpus as tables: current files, lines, identifier runs, symbols."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions import text
from symloom.schema import FAMILY_OF, LOCAL_KEYWORDS, SKIP_DIRS, lookup
from symloom.session import scratch
from symloom.sources.spread import spread, tasks


def newest(files: DataFrame) -> DataFrame:
    """(file_id, _at, _hash) of the newest delivery of each file; of equal times the larger content_hash."""
    return files.groupBy("file_id").agg(F.max(F.struct("mtime_ns", "content_hash")).alias("_r")).select("file_id", F.col("_r.mtime_ns").alias("_at"), F.col("_r.content_hash").alias("_hash"))


def same_delivery(a: str, b: str) -> Column:
    """Join condition of two aliased tables that have (file_id, _at, _hash)."""
    eq = lambda c: F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return (F.col(f"{a}.file_id") == F.col(f"{b}.file_id")) & eq("_at") & eq("_hash")


def current_files(files: DataFrame) -> DataFrame:
    """The newest row of each file. Rows of equal time are ordered by content_hash, so repeated rows change nothing.

    Where contents are asked for they are shuffled once, to a number of partitions that is not merged again, as Python
    often follows. What works row by row does better on all deliveries, with `newest` to drop what came from older ones.
    """
    order = Window.partitionBy("file_id").orderBy(F.col("mtime_ns").desc(), F.col("content_hash").desc())
    return files.repartition(tasks(files.sparkSession), "file_id").withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") == 1).drop("_rn")


def symbol_rows(symbols: DataFrame) -> DataFrame:
    """One row per (file_id, symbol_idx)."""
    return symbols.dropDuplicates(["file_id", "symbol_idx"])


def is_local() -> Column:
    """Inside a scope and a variable, parameter or field: of no interest to other files."""
    return (F.coalesce(F.col("depth"), F.lit(0)) > 0) & F.coalesce(F.col("def_keyword").isin(*LOCAL_KEYWORDS), F.lit(False))


def global_symbols(symbols: DataFrame) -> DataFrame:
    """The definitions index: named symbols other files may refer to."""
    return symbols.where(~is_local() & F.col("name").isNotNull())


def family(ext: Column) -> Column:
    return lookup(FAMILY_OF, ext)


def skipped_dir(path: Column) -> Column:
    """Whether a directory on the path (not the file itself) is one that scans pass over."""
    dirs = F.split(F.regexp_replace(path, r"/?[^/]*\z", ""), "/")
    return F.exists(dirs, lambda s: s.isin(*SKIP_DIRS) | s.startswith("."))


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """(keep, line, text) of every line; line ends are `\\n`, a `\\r` before it is dropped."""
    return files.select(*keep, F.posexplode(F.split("content", "\n", -1)).alias("line", "_t")).select(*keep, "line", F.regexp_replace("_t", r"\r\z", "").alias("text"))


#: Asked words of up to this many bytes in all are sent to the workers; more are joined.
WORDS_SENT = 32 << 20


def few(words: DataFrame) -> bool:
    """Whether words (word) are measured to be few enough to send to all workers."""
    return (words.agg(F.sum(F.octet_length("word") + 64)).first()[0] or 0) <= WORDS_SENT


def runs(files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(file_id, word, line, col, len) of every maximal run of letters, digits and `_` in the current contents; columns and
    lengths in bytes. `wanted` (word) keeps only these words.

    All deliveries are scanned where they are read, so contents are never shuffled; what older ones gave falls out by a
    join on (file_id, time, hash). The scan is linear in the text, also for a single endless line. Wanted words are
    measured first: if they are few, they go to the workers and only hits leave them; if not, all runs are joined.
    """
    find = re.compile(r"\w+|\n").finditer  # of str, \w is letters, digits and `_`
    names = ["file_id", "_at", "_hash", "word", "line", "col", "len"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
    spark = files.sparkSession
    words = None
    if wanted is not None:
        wanted = wanted.select("word").where(F.col("word").isNotNull()).distinct()
        if few(wanted):
            words = spark.sparkContext.broadcast(frozenset(r[0] for r in wanted.collect()))

    def batch(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None if words is None else words.value
        for b in batches:
            out: list[list] = [[] for _ in names]
            for i, when, digest, t in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                line = start = 0  # start: of the line, in characters
                plain = (t or "").isascii()
                for m in find(t or ""):
                    word = m[0]
                    if word == "\n":
                        line, start = line + 1, m.end()
                    elif asked is None or word in asked:
                        col = m.start() - start if plain else len(t[start : m.start()].encode("utf-8", "surrogatepass"))
                        for column, value in zip(out, (i, when, digest, word, line, col, len(word) if plain else len(word.encode("utf-8", "surrogatepass"))), strict=True):
                            column.append(value)
                if len(out[0]) >= 200_000:
                    yield batch(out)
                    out = [[] for _ in names]
            yield batch(out)

    rows = files.select("file_id", F.col("mtime_ns").alias("_at"), F.col("content_hash").alias("_hash"), "content")
    hits = spread(rows).mapInArrow(run, "file_id bigint, _at bigint, _hash string, word string, line int, col int, len int")
    if wanted is not None and words is None:
        hits = hits.join(wanted, "word")
    # a delivery that came twice gives each hit twice
    current = hits.alias("h").join(newest(files).alias("n"), same_delivery("h", "n"), "left_semi")
    return current.drop("_at", "_hash").dropDuplicates(["file_id", "line", "col", "word"]).select("file_id", "word", "line", "col", "len")


def word_hash_sets(files: DataFrame) -> DataFrame:
    """(file_id, words): sorted distinct identifiers of each file."""
    return files.select("file_id", F.array_sort(F.array_distinct(text.identifiers(F.col("content")))).alias("words"))


def dense_numbers(rows: DataFrame, group: str, key: str, number: str) -> DataFrame:
    """(group, key, number): the distinct keys of each group numbered from 1 in their order, null first.

    Keys are divided by range over all tasks, so a group that holds most rows is numbered by many: each task numbers
    its own part of a group, and begins where the parts before it end. The parts are written, so that they stay as they
    were divided; of them one small row per group and task is summed in order.
    """
    spark, place = rows.sparkSession, scratch(rows.sparkSession, "numbers")
    divided = rows.select(group, key).distinct().repartitionByRange(tasks(spark), group, key).withColumn("_p", F.spark_partition_id())
    divided.write.parquet(place)
    parts = spark.read.parquet(place)
    before = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = parts.withColumn("_k", F.row_number().over(Window.partitionBy(group, "_p").orderBy(key)))
    both = own.alias("o").join(starts.alias("s"), (F.col("o._p") == F.col("s._p")) & F.col(f"o.{group}").eqNullSafe(F.col(f"s.{group}")))
    return both.select(f"o.{group}", f"o.{key}", (F.col("_start") + F.col("_k")).alias(number))
