"""A scan of a working directory, from its listing to the stored index, and the store it brings up to date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators import manifest, parse
from symloom.session import scratch
from symloom.sources import walk

KEYS = ["worktree_key", "rel_path"]
ROW = "worktree_key string, rel_path string, content_hash string, lang string, size bigint, mtime_ns bigint, generation bigint"
UNIT_KEYS = ["content_hash", "ext", "parser_version"]
SYMBOLS = "array<struct<symbol_idx:int,name:string,kind:string,line:int,col:int,def_keyword:string,doc_comment:string,signature:string,visibility:string,container:string,depth:int,scope_end_line:int>>"
UNIT = f"content_hash string, ext string, parser_version int, symbols {SYMBOLS}"


@dataclass
class ScanStats:
    """What a scan did. indexed: files with a row now; skipped: left to the overlay; errors: could not be listed or read."""

    indexed: int = 0
    skipped: int = 0
    errors: int = 0
    stat_calls: int = 0
    bytes_read: int = 0
    hashed: int = 0
    parsed: int = 0
    store_writes: int = 0
    store_hits: int = 0
    rows_copied: int = 0
    removed: int = 0


class CorpusStore:
    """Manifest, units and meta values below a folder of a shared file system.

    The manifest is written in full as the next generation, and the last generation whose write was completed holds, so
    a scan that dies leaves the one before. Units are appended and never change: one that is written twice is the same
    twice, and reads take it once.
    """

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self.spark, self.root = spark, root
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _complete(self, what: str) -> list[int]:
        folder = self._path(f"{self.root}/{what}")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit() and self._fs.exists(self._path(f"{self.root}/{what}/{n}/_SUCCESS")))

    # manifest

    def generation(self) -> int:
        return max(self._complete("manifest"), default=0)

    def all(self) -> DataFrame:
        g = self.generation()
        return self.spark.read.schema(ROW).parquet(f"{self.root}/manifest/{g}") if g else self.spark.createDataFrame([], ROW)

    def get(self, keys: DataFrame) -> DataFrame:
        return self.all().join(keys.select(*KEYS).distinct(), KEYS, "left_semi")

    def prefix(self, worktree_key: str, prefix: str) -> DataFrame:
        return self.all().where((F.col("worktree_key") == worktree_key) & F.col("rel_path").startswith(prefix))

    def count(self) -> int:
        return self.all().count()

    def replace(self, rows: DataFrame) -> int:
        """Write the next generation; its number."""
        g = self.generation() + 1
        rows.select(*[c.split()[0] for c in ROW.split(", ")]).write.mode("overwrite").parquet(f"{self.root}/manifest/{g}")
        for old in self._complete("manifest")[:-2]:  # a reader of the one before may still be at work
            self._fs.delete(self._path(f"{self.root}/manifest/{old}"), True)
        return g

    def upsert(self, rows: DataFrame) -> int:
        return self.replace(manifest.upsert(self.all(), rows, KEYS))

    def delete(self, keys: DataFrame) -> int:
        return self.replace(self.all().join(keys.select(*KEYS).distinct(), KEYS, "left_anti"))

    def clear(self, worktree_key: str) -> int:
        return self.replace(self.all().where(F.col("worktree_key") != worktree_key))

    # units

    def units(self) -> DataFrame:
        folder = f"{self.root}/units"
        if not self._fs.exists(self._path(folder)):
            return self.spark.createDataFrame([], UNIT)
        return self.spark.read.schema(f"{UNIT}, prefix string").parquet(folder).drop("prefix")

    def contains(self, keys: DataFrame) -> DataFrame:
        """Those of the keys that have a unit."""
        return keys.join(self.units().select(*UNIT_KEYS).distinct(), UNIT_KEYS, "left_semi")

    def unit(self, keys: DataFrame) -> DataFrame:
        """The units of the keys, each once."""
        return self.units().join(keys.select(*UNIT_KEYS).distinct(), UNIT_KEYS, "left_semi").dropDuplicates(UNIT_KEYS)

    def put(self, units: DataFrame) -> None:
        """Append what is not stored yet."""
        manifest.store_put(self.units(), units, UNIT_KEYS).withColumn("prefix", F.substring("content_hash", 1, 2)).write.mode("append").partitionBy("prefix").parquet(f"{self.root}/units")

    # meta values

    def meta(self) -> dict[str, str]:
        n = max(self._complete("meta"), default=0)
        return {r["key"]: r["value"] for r in self.spark.read.parquet(f"{self.root}/meta/{n}").collect()} if n else {}

    def set_meta(self, **values: str) -> None:
        n = max(self._complete("meta"), default=0) + 1
        self.spark.createDataFrame(list({**self.meta(), **values}.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/meta/{n}")


def scan(store: CorpusStore, worktree_key: str, root: str, parser_version: int = 1, overlays: set[str] = frozenset(), registry: DataFrame | None = None) -> ScanStats:
    """Bring the store up to date with the working directory and tell what it took.

    Files whose size and time are those of their manifest row, and whose unit is stored, are not read. Others are read and hashed
    where they are; of contents without a unit of this parser version each is parsed once, from one of its paths, and
    stored. Rows of files that are gone are removed. A directory that has no rows yet takes those of worktrees in
    `registry` (worktree_key, working_dir) above or below it, by their paths, and then only looks for what changed.
    Counters come from the written tables, so tasks that ran twice count once.
    """
    spark, place = store.spark, scratch(store.spark, "scan")
    walk.corpus_files(spark, root, overlays).withColumn("worktree_key", F.lit(worktree_key)).write.parquet(f"{place}/listed")
    listed = spark.read.parquet(f"{place}/listed")
    files, known = listed.where(F.col("ext") != ""), store.all()
    own, copied = known.where(F.col("worktree_key") == worktree_key), None
    if registry is not None and own.isEmpty():
        here = spark.createDataFrame([(worktree_key, root)], "here_key string, here_dir string")
        seen = manifest.subsume(known, here, registry).withColumn("worktree_key", F.lit(worktree_key)).drop("here_key")
        copied = seen.join(files.select(*KEYS), KEYS, "left_semi")
        copied.write.parquet(f"{place}/copied")
        own = copied = spark.read.parquet(f"{place}/copied")
    stored = store.units().where(F.col("parser_version") == parser_version).select("content_hash", "ext").distinct()
    old = own.select("rel_path", F.col("content_hash").alias("k_hash"), F.col("size").alias("k_size"), F.col("mtime_ns").alias("k_mtime"))
    with_old = files.join(old, "rel_path", "left").join(stored.withColumnRenamed("content_hash", "k_hash").withColumn("_has", F.lit(True)), ["k_hash", "ext"], "left")
    fresh = F.coalesce((F.col("size") == F.col("k_size")) & (F.col("mtime_ns") == F.col("k_mtime")) & F.col("_has") & F.col("error").isNull(), F.lit(False))
    with_old.withColumn("_fresh", fresh).drop("k_size", "k_mtime", "_has").write.parquet(f"{place}/compared")
    compared = spark.read.parquet(f"{place}/compared")
    stale = compared.where(~F.col("_fresh")).select(*[c.split()[0] for c in walk.FILE.split(", ")])
    read = walk.with_hash(walk.read_contents(stale)).select("file_id", "path", "rel_path", "ext", "lang", "size", "mtime_ns", "error", "content_hash")
    read.write.parquet(f"{place}/hashed")
    hashed = spark.read.parquet(f"{place}/hashed")
    good = hashed.where(F.col("content_hash").isNotNull())
    # one path for each content without a unit; it is read again, so that no content is shuffled
    todo = good.groupBy("content_hash", "ext").agg(F.min(F.struct("file_id", "path")).alias("r")).join(stored, ["content_hash", "ext"], "left_anti")
    todo.select("content_hash", "ext", "r.*").write.parquet(f"{place}/todo")
    chosen = spark.read.parquet(f"{place}/todo")
    texts = walk.read_contents(chosen.join(stale.drop("ext", "path"), "file_id").select(*[c.split()[0] for c in walk.FILE.split(", ")]))
    found = parse.parse_symbols(texts.select("file_id", "ext", "content"))
    fields = [f.split(":")[0] for f in SYMBOLS[len("array<struct<") : -2].split(",")]
    per_file = found.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("symbols"))
    units = chosen.join(per_file, "file_id", "left").select("content_hash", "ext", F.lit(parser_version).alias("parser_version"), F.coalesce("symbols", F.array().cast(SYMBOLS)).alias("symbols"))
    store.put(units)
    row = lambda rows, digest: rows.select(F.lit(worktree_key).alias("worktree_key"), "rel_path", digest.alias("content_hash"), "lang", "size", "mtime_ns")
    now = row(compared.where("_fresh"), F.col("k_hash")).unionByName(row(good, F.col("content_hash"))).withColumn("generation", F.lit(store.generation() + 1).cast("long"))
    removed = own.join(now.select("rel_path"), "rel_path", "left_anti").count()
    store.replace(known.where(F.col("worktree_key") != worktree_key).unionByName(now))
    total, n_fresh = compared.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("_fresh").cast("int")), F.lit(0))).first()
    n_hashed, read_bytes = good.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parsed = chosen.count()
    return ScanStats(
        indexed=n_fresh + n_hashed, skipped=len(overlays), errors=listed.where("error is not null").count() + hashed.where("error is not null").count() - listed.where("error is not null and ext <> ''").count(),
        stat_calls=total, bytes_read=read_bytes, hashed=n_hashed, parsed=parsed, store_writes=parsed, store_hits=n_fresh + n_hashed - parsed, rows_copied=copied.count() if copied is not None else 0, removed=removed,
    )
