"""Incremental corpus state: manifest, content store, subsumption, overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` replace those of `old` with equal keys; a key given twice keeps its row of highest generation."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col("_new").desc(), F.col("generation").desc_nulls_last(), "content_hash")
    return both.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "_new")


def classify(scanned: DataFrame, known: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """`status` of each scanned file: FRESH (size and mtime_ns as known, and its unit is stored), REUSE (its content has
    a stored unit), PARSE (it has none)."""
    k = known.select(*keys, F.col("size").alias("k_size"), F.col("mtime_ns").alias("k_mtime"), F.col("content_hash").alias("k_hash"))
    stored = units.select("content_hash").distinct()
    joined = (
        scanned.join(k, keys, "left")
        .join(stored.withColumn("_has", F.lit(True)), "content_hash", "left")
        .join(stored.select(F.col("content_hash").alias("k_hash"), F.lit(True).alias("_khas")), "k_hash", "left")
    )
    fresh = (F.col("size") == F.col("k_size")) & (F.col("mtime_ns") == F.col("k_mtime")) & F.col("_khas")
    status = F.when(F.coalesce(fresh, F.lit(False)), "FRESH").when(F.col("_has"), "REUSE").otherwise("PARSE")
    return joined.withColumn("status", status).drop("k_size", "k_mtime", "k_hash", "_has", "_khas")


def dead_rows(known: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    return known.join(live.select(*keys).distinct(), keys, "left_anti")


def store_put(units: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What a put of `new` has to write: units not stored yet, each once."""
    return new.dropDuplicates(keys).join(units.select(*keys).distinct(), keys, "left_anti")


def subsume(rows: DataFrame, here: DataFrame, others: DataFrame) -> DataFrame:
    """Manifest rows of other worktrees that lie below or above a directory, with their paths seen from it.

    `here` (here_key, here_dir) and `others` (worktree_key, working_dir) are registries: a row per worktree. They are
    related by joining the ancestors of each directory with the directories themselves, not all with all. Of equal
    paths the highest generation wins.
    """
    up = lambda key, directory: F.transform(F.sequence(F.lit(1), F.size(F.split(directory, "/"))), lambda k: F.array_join(F.slice(F.split(directory, "/"), 1, k), "/"))  # noqa: E731, ARG005
    h = here.select("here_key", "here_dir")
    o = others.select("worktree_key", "working_dir")
    below = o.select("worktree_key", "working_dir", F.explode(up(None, F.col("working_dir"))).alias("here_dir")).join(h, "here_dir").where(F.col("here_dir") != F.col("working_dir"))
    above = h.select("here_key", "here_dir", F.explode(up(None, F.col("here_dir"))).alias("working_dir")).join(o, "working_dir").where(F.col("here_dir") != F.col("working_dir"))
    rel = lambda longer, shorter: F.expr(f"substring({longer}, char_length({shorter}) + 2)")
    child = below.select("here_key", "worktree_key", rel("working_dir", "here_dir").alias("_add"), F.lit("").alias("_cut"))
    parent = above.select("here_key", "worktree_key", F.lit("").alias("_add"), F.concat(rel("here_dir", "working_dir"), F.lit("/")).alias("_cut"))
    pairs = child.unionAll(parent).where(F.col("here_key") != F.col("worktree_key"))
    seen = rows.join(pairs, "worktree_key").where(F.col("rel_path").startswith(F.col("_cut")))
    path = F.when(F.col("_add") != "", F.concat("_add", F.lit("/"), "rel_path")).otherwise(F.expr("substring(rel_path, char_length(_cut) + 1)"))
    moved = seen.withColumn("rel_path", path).drop("_add", "_cut")
    w = Window.partitionBy("here_key", "rel_path").orderBy(F.col("generation").desc(), "worktree_key", "content_hash")
    return moved.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def overlay(base: DataFrame, edits: DataFrame, key: str, value: str) -> DataFrame:
    """The value of each key: that of the overlay where it has one, else that of the base."""
    e = edits.select(key, F.col(value).alias("_v"), F.lit(True).alias("_edited"))
    return base.select(key, value).join(e, key, "full").select(key, F.when(F.col("_edited"), F.col("_v")).otherwise(F.col(value)).alias(value), F.coalesce("_edited", F.lit(False)).alias("edited"))


def latest_events(events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last event of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def scan_metrics(classified: DataFrame) -> DataFrame:
    """Counters of a scan, from its classified rows: retried tasks count nothing twice."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    read = F.col("status") != "FRESH"
    per_content = classified.groupBy("content_hash").agg(
        F.count(F.lit(1)).alias("stat"), F.coalesce(F.sum(F.when(read, F.col("size"))), F.lit(0)).alias("bytes"), one(read).alias("hashed"), F.max(F.when(F.col("status") == "PARSE", 1).otherwise(0)).alias("parsed"), one(F.col("status") != "PARSE").alias("hits")
    )
    total = per_content.agg(
        F.sum("stat").cast("long").alias("stat_calls"), F.sum("bytes").cast("long").alias("bytes_read"), F.sum("hashed").cast("long").alias("hashed"), F.sum("parsed").cast("long").alias("parsed"),
        F.sum("parsed").cast("long").alias("store_writes"), F.sum(F.col("stat") - F.col("parsed")).cast("long").alias("store_hits"),
    )
    return total.withColumn("reparse_ratio", F.col("parsed") / F.col("stat_calls")).withColumn("hash_savings", 1 - F.col("hashed") / F.col("stat_calls"))
