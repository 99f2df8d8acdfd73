"""Frequency of every distinct term, by recursive radix spilling with DuckDB."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.session import scratch

RADIX_BITS = 4
#: Rows that one aggregation takes; a partition with more is split by further hash bits.
PARTITION_ROWS = 2_000_000
MEMORY = "200MB"
SCHEMA = "field string, term string, occurrences bigint, records bigint"
_ARROW = pa.schema([("field", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])
_SUM = "select field, term, sum(occurrences)::bigint as occurrences, sum(records)::bigint as records from {} group by all"


#: Names a mounted folder that all executors share, where the shared folder itself can't be mounted.
SPILL_CONF = "symloom.spill.dir"


def spill_dir(spark: SparkSession) -> str:
    """Where tasks spill: a folder of this session in the shared folder, if that is a mounted path, or in the one that
    `symloom.spill.dir` names. DuckDB needs one of them; a machine's own folders are not used."""
    named = spark.conf.get(SPILL_CONF, None) or spark.sparkContext.getConf().get(SPILL_CONF)
    url = urlparse(named or scratch(spark, "radix"))
    if url.scheme not in ("", "file"):
        raise RuntimeError(f"{SPILL_CONF} must name a mounted folder shared by all executors, as {url.scheme}: is no path")
    return url.path


class RadixAggregator:
    """Sums of a stream of (field, term, occurrences, records), out of core.

    Batches are divided by the first hash bits into files. A division with more than `rows` rows is divided again by
    the next bits, after its equal terms were summed batch by batch, so even one term in all rows comes to an end.
    Each division is then summed by itself within `MEMORY`.
    """

    def __init__(self, folder: str, rows: int = PARTITION_ROWS, bits: int = RADIX_BITS):
        import duckdb

        os.makedirs(folder, exist_ok=True)
        self.folder = tempfile.mkdtemp(prefix="radix-", dir=folder)
        self.rows, self.bits, self.deepest = rows, bits, 0
        self.db = duckdb.connect()
        self.db.execute(f"set memory_limit='{MEMORY}'; set threads=1; set temp_directory='{self.folder}/tmp'; set preserve_insertion_order=false")

    def close(self) -> None:
        self.db.close()
        shutil.rmtree(self.folder, ignore_errors=True)

    def divide(self, batches: Iterable[pa.Table], level: int, to: str) -> dict[int, tuple[list[str], int]]:
        """Write each batch, summed, to files by the hash bits of this level; the files and rows of each division."""
        parts: dict[int, tuple[list[str], int]] = {}
        mask, shift = (1 << self.bits) - 1, 64 - self.bits * (level + 1)
        os.makedirs(to, exist_ok=True)
        for k, batch in enumerate(batches):
            self.db.register("batch", batch)
            self.db.execute(f"create or replace temp table divided as select *, ((hash(field, term) >> {shift}) & {mask})::int as p from ({_SUM.format('batch')})")
            self.db.unregister("batch")
            for p, n in self.db.execute("select p, count(*) from divided group by p").fetchall():
                path = f"{to}/{p}-{k}.parquet"
                self.db.execute(f"copy (select field, term, occurrences, records from divided where p = {p}) to '{path}' (format parquet)")
                files, rows = parts.get(p, ([], 0))
                parts[p] = ([*files, path], rows + n)
        self.db.execute("drop table if exists divided")
        return parts

    def sums(self, batches: Iterable[pa.Table], level: int = 0, to: str | None = None) -> Iterator[pa.RecordBatch]:
        to = to or f"{self.folder}/0"
        self.deepest = max(self.deepest, level)
        for p, (files, rows) in sorted(self.divide(batches, level, to).items()):
            if rows > self.rows and len(files) > 1 and self.bits * (level + 2) <= 64:
                yield from self.sums(self.read(files), level + 1, f"{to}-{p}")
            else:
                yield from self.db.sql(_SUM.format(f"read_parquet({files!r})")).to_arrow_reader(100_000)
            for f in files:
                os.remove(f)

    def read(self, files: list[str]) -> Iterator[pa.Table]:
        """The rows of several files in batches that take a share of `rows` each."""
        import pyarrow.parquet as pq

        held: list[pa.RecordBatch] = []
        n = 0
        for f in files:
            for b in pq.ParquetFile(f).iter_batches(100_000):
                held.append(b)
                n += b.num_rows
                if n >= max(1, self.rows // 2):
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
        if held:
            yield pa.Table.from_batches(held)


def _grouped(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def term_sums(counts: DataFrame, rows: int = PARTITION_ROWS) -> DataFrame:
    """(field, term, occurrences, records) summed per field and term.

    Each task first sums what it read, so a term in all rows leaves each task as one row; the shuffle then divides
    terms by hash, and each task sums its own terms out of core.
    """
    folder = spill_dir(counts.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radix = RadixAggregator(folder, rows)
        try:
            for b in radix.sums(_grouped(batches, max(1, rows // 4))):
                yield b.cast(_ARROW)
        finally:
            radix.close()

    summed = counts.select("field", "term", "occurrences", "records").mapInArrow(run, SCHEMA)
    return summed.repartition("field", "term").mapInArrow(run, SCHEMA)


def array_counts(records: DataFrame, array: str, field: str) -> DataFrame:
    """One row per record and distinct element of its array, with how often it stands there. Null elements are left out.

    An array is sorted, and its runs of equal elements are counted by where they begin, which takes no longer for
    arrays that repeat themselves; of one without repeats, each element counts once.
    """
    once = F.array_distinct("_a")
    n = F.size("_s")
    begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at("_s", i) != F.element_at("_s", F.greatest(i - 1, F.lit(1)))))
    runs = F.transform("_b", lambda at, k: F.struct(F.element_at("_s", at).alias("t"), (F.coalesce(F.get("_b", k + 1), n + 1) - at).alias("n")))
    plain = F.transform("_a", lambda x: F.struct(x.alias("t"), F.lit(1).alias("n")))
    sorted_ = records.select(F.filter(F.col(array), lambda x: x.isNotNull()).alias("_a")).where(F.size("_a") > 0).withColumn("_s", F.when(F.size(once) < F.size("_a"), F.array_sort("_a")))
    return (
        sorted_.withColumn("_b", F.when(F.col("_s").isNotNull(), begins)).select(F.explode(F.when(F.col("_s").isNull(), plain).otherwise(runs)).alias("p"))
        .select(F.lit(field).alias("field"), F.col("p.t").cast("string").alias("term"), F.col("p.n").cast("long").alias("occurrences"), F.lit(1).cast("long").alias("records"))
    )


def current_units(units: DataFrame) -> DataFrame:
    """One row per content_hash, whatever its letter case: that of the highest parser_version; among equals the larger
    array, so that repeated rows change nothing. Rows without content_hash are no records."""
    top = F.max(F.struct(F.col("parser_version").alias("v"), F.col("word_hashes").alias("a"))).alias("_top")
    return units.where(F.col("content_hash").isNotNull()).groupBy(F.lower("content_hash").alias("content_hash")).agg(top).select("content_hash", F.col("_top.a").alias("word_hashes"))


def name_counts(symbols: DataFrame) -> DataFrame:
    """One row per file and distinct name. Rows given twice count once; null names and rows without file are left out."""
    one = symbols.where(F.col("file_id").isNotNull()).groupBy("file_id", "symbol_idx").agg(F.max("name").alias("term")).where(F.col("term").isNotNull())
    per_file = one.groupBy("file_id", "term").agg(F.count(F.lit(1)).alias("occurrences"))
    return per_file.select(F.lit("name").alias("field"), "term", "occurrences", F.lit(1).cast("long").alias("records"))


def term_frequencies(units: DataFrame, symbols: DataFrame, rare: int = 2, common: float = 0.1) -> DataFrame:
    """(field, term, occurrences, records, mark) of every distinct word hash and name; `mark` is null in between.

    A term in at most `rare` records is `rare`, otherwise one in more than the share `common` of all records is `common`.
    """
    sums = term_sums(array_counts(current_units(units), "word_hashes", "word").unionAll(name_counts(symbols)))

    def records(rows: DataFrame, key: Column) -> Column:
        return rows.where(key.isNotNull()).select(key.alias("k")).distinct().agg(F.count(F.lit(1))).scalar()

    total = F.when(F.col("field") == "word", records(units, F.lower("content_hash"))).otherwise(records(symbols, F.col("file_id")))
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > total * common, "common")
    return sums.withColumn("mark", mark)
