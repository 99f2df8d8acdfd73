"""Queries p1, p4 and p7, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions.paths import plain_path
from symloom.operators import incremental, skew, snapshots
from symloom.session import scratch, table

KEYS = ["worktree_key", "rel_path"]
HEAVY_SHARE = 0.01
RUNS_AT_A_TIME = 16


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest_snapshot").withColumn("rel_path", plain_path(F.col("rel_path")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Files added, removed or changed between consecutive snapshots."""
    changes = snapshots.snapshot_changes(_snapshots(spark, d), "snapshot_id", KEYS, [F.lower("content_hash"), F.col("git_oid")], "generation")
    return changes.select("snapshot_id", *KEYS, "change")


def p1_intervals(spark: SparkSession, d: str) -> DataFrame:
    """How many validity intervals there are by first and last snapshot position."""
    states = snapshots.snapshot_states(_snapshots(spark, d), "snapshot_id", KEYS, [F.lower("content_hash"), F.col("git_oid")], "generation")
    return snapshots.validity_intervals(states, "snapshot_id", KEYS).groupBy("first", "last").agg(F.count(F.lit(1)).alias("intervals"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The files each succeeded run must process, by way of a ledger in the shared folder.

    Runs are taken some at a time, as when they come in day by day: each batch reads the rows loaded since the one before.
    """
    manifest = table(spark, d, "manifest").withColumn("rel_path", plain_path(F.col("rel_path")))
    return incremental.process_runs(spark, manifest, table(spark, d, "scan_runs"), KEYS, F.lower("content_hash"), scratch(spark, "ledger"), batch=RUNS_AT_A_TIME)


def p7_words(spark: SparkSession, d: str) -> DataFrame:
    """Per word_hash the files, worktrees, rows and latest generation, and the pairs of rows and units it would join."""
    postings = table(spark, d, "postings").withColumn("rel_path", plain_path(F.col("rel_path")))
    return skew.eager_join(skew.posting_states(postings), skew.unit_states(table(spark, d, "file_units")), "word_hash", ["units", "occurrences"], {"row_unit_pairs": ("n_rows", "units")})


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The word_hash that hold more than a hundredth of the distinct entries, among the joined states of all words.

    The states are written once: the sum over all words and the choice of words both read them, and neither makes the
    aggregates and the join beneath run again.
    """
    place = scratch(spark, "words")
    p7_words(spark, d).write.parquet(place)
    return skew.heavy_keys(spark.read.parquet(place), "word_hash", "files", F.lit(HEAVY_SHARE))


def queries() -> dict:
    return {"p1_found": p1_found, "p1_intervals": p1_intervals, "p4_found": p4_found, "p7_found": p7_found, "p7_words": p7_words}


_PLAIN = "array_to_string(list_filter(string_split(replace(rel_path, '\\', '/'), '/'), lambda s: s <> '' and s <> '.'), '/')"

_STATES = f"""
with state as (
  select snapshot_id, worktree_key, path, h, o from (
    select snapshot_id, worktree_key, {_PLAIN} as path, lower(content_hash) as h, git_oid as o,
           row_number() over (partition by snapshot_id, worktree_key, {_PLAIN} order by generation desc) as rn
    from manifest_snapshot) where rn = 1),
snaps as (select snapshot_id, lag(snapshot_id) over (order by snapshot_id) as prev from (select distinct snapshot_id from manifest_snapshot))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _STATES + """,
cur as (select s.*, snaps.prev from state s join snaps using (snapshot_id) where snaps.prev is not null),
old as (select s.worktree_key, s.path, s.h, s.o, snaps.snapshot_id as next_id from state s join snaps on s.snapshot_id = snaps.prev)
select coalesce(cur.snapshot_id, old.next_id) as snapshot_id, coalesce(cur.worktree_key, old.worktree_key) as worktree_key,
       coalesce(cur.path, old.path) as rel_path,
       case when old.path is null then 'added' when cur.path is null then 'removed' else 'changed' end as change
from cur full outer join old on cur.snapshot_id = old.next_id and cur.worktree_key = old.worktree_key and cur.path = old.path
where old.path is null or cur.path is null or cur.h is distinct from old.h or cur.o is distinct from old.o""",
        "p1_intervals": _STATES + """,
pos as (select snapshot_id, row_number() over (order by snapshot_id) - 1 as p from snaps),
s as (select worktree_key, path, p, h, coalesce(hex(o), '-') as o from state join pos using (snapshot_id)),
i as (select *, p - row_number() over (partition by worktree_key, path, h, o order by p) as g from s)
select cast(first as int) as first, cast(last as int) as last, count(*) as intervals
from (select min(p) as first, max(p) as last from i group by worktree_key, path, h, o, g) group by all""",
        "p4_found": f"""
with runs as (select run_id, started_at, row_number() over (order by started_at, run_id) as k from scan_runs where status = 'succeeded'),
m as (select worktree_key, {_PLAIN} as path, lower(content_hash) as h, generation, loaded_at from manifest),
state as (select k, run_id, worktree_key, path, arg_max(h, (generation, loaded_at)) as h from m join runs on m.loaded_at <= runs.started_at group by all)
select a.run_id, a.worktree_key, a.path as rel_path from state a
left join state b on b.k = a.k - 1 and a.worktree_key = b.worktree_key and a.path = b.path
where b.path is null or a.h is distinct from b.h""",
        "p7_found": f"""
with e as (select distinct worktree_key, {_PLAIN} as path, word_hash from postings where word_hash is not null)
select word_hash from e group by word_hash having count(*) > 0.01 * (select count(*) from e)""",
        "p7_words": f"""
with p as (select word_hash, count(distinct (worktree_key, {_PLAIN})) as files, count(distinct worktree_key) as worktrees, count(*) as n_rows,
                  max(generation) as latest_generation from postings where word_hash is not null group by word_hash),
w as (select rowid as r, unnest(word_hashes) as word_hash from (select row_number() over () as rowid, word_hashes from file_units)),
u as (select word_hash, count(distinct r) as units, count(*) as occurrences from w where word_hash is not null group by word_hash)
select p.*, coalesce(units, 0) as units, coalesce(occurrences, 0) as occurrences, n_rows * coalesce(units, 0) as row_unit_pairs
from p left join u using (word_hash)""",
    }
