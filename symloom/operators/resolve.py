"""What a name under a cursor means: candidates by context, their precedence, and the best of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.operators import lookup
from symloom.operators.corpus import global_symbols
from symloom.session import scratch

SYMBOL = ["file_id", "symbol_idx", "name", "line", "col", "container"]
#: Which candidates hold where others are too: fields of the file, then the workspace, then its dependencies. The local
#: in scope comes first for a definition, and last for what a hover shows.
FIELD, WORKSPACE, DEPENDENCY, LOCAL_FIRST, LOCAL_LAST = 0, 1, 2, 0, 4


def _written(rows: DataFrame, purpose: str) -> DataFrame:
    place = scratch(rows.sparkSession, purpose)
    rows.write.parquet(place)
    return rows.sparkSession.read.parquet(place)


def _key() -> Column:
    """Null qualifiers join as such."""
    return F.coalesce("qualifier", F.lit(""))


def best_by_name(asked: DataFrame, index: DataFrame, opened: DataFrame) -> DataFrame:
    """The best definition in `index` for each (here, name, qualifier), by file and qualifier (`lookup.rank`).
    `opened` are the `lookup.openers` of the files.

    The file only lifts its own definitions, so the best of all is found once per name and qualifier, not per file,
    and competes with those of the asking file: no name is joined with all its definitions for each file that asks.
    """
    asked = asked.select("here", "name", "qualifier").distinct()

    def first(defs: DataFrame) -> DataFrame:
        return lookup.rank(defs, lookup.qualifier_in_source(defs, opened)).where("rank = 1").drop("rank", "query_id", "current_file")

    pairs = asked.select("name", "qualifier").distinct().join(index, "name")
    far = first(pairs.withColumn("query_id", F.struct("name", "qualifier")).withColumn("current_file", F.lit(None).cast("long")))
    far = asked.withColumn("_k", _key()).join(far.withColumn("_k", _key()).drop("qualifier", "score"), ["name", "_k"]).drop("_k")
    own = asked.join(index.withColumn("here", F.col("file_id")), ["name", "here"])
    both = far.unionByName(own.select(far.columns)).distinct()
    return first(both.withColumn("query_id", F.struct("here", "name", "qualifier")).withColumn("current_file", F.col("here")))


def resolve(cursors: DataFrame, symbols: DataFrame, dependencies: DataFrame, opened: DataFrame, local_first: bool = True) -> DataFrame:
    """(query_id, priority, file_id, symbol_idx, line): the definition meant at each cursor (query_id, here, at, name,
    qualifier, context).

    FieldAccess: fields of that name in the cursor's file, else definitions of the workspace. TypeRef: definitions of the
    workspace. FunctionCall and Plain: the local in scope at the cursor, then definitions of the workspace, then those
    of `dependencies` (file_id); without `local_first`, the local comes last. Candidates of the first kind that has any
    are ranked by file and qualifier. Cursors without a name, and names without a definition, give no row.
    """
    # written once: each kind of candidate reads a part of it, and no plan repeats what stands before
    in_deps = dependencies.select("file_id").distinct().withColumn("_dep", F.lit(True))
    slim = _written(symbols.select(*SYMBOL, "def_keyword", "depth", "scope_end_line").join(in_deps, "file_id", "left"), "symbols")
    g = global_symbols(slim).select(*SYMBOL, "_dep")
    workspace, deps = g.where("_dep is null").drop("_dep"), g.where("_dep").drop("_dep")
    plain = cursors.where(F.col("context").isin("FunctionCall", "Plain"))
    keys = ["here", "name", "_k"]

    def of(rows: DataFrame, found: DataFrame, priority: int) -> DataFrame:
        per = rows.withColumn("_k", _key()).join(found.withColumn("_k", _key()).select(*keys, "file_id", "symbol_idx", "line"), keys)
        return per.select("query_id", F.lit(priority).alias("priority"), "file_id", "symbol_idx", "line")

    fields = slim.where((F.coalesce("depth", F.lit(0)) > 0) & (F.col("def_keyword") == "field")).select(*SYMBOL)
    inside = cursors.where("context = 'FieldAccess'")
    in_file = inside.select("here", "name", "qualifier").distinct().join(fields.withColumn("here", F.col("file_id")), ["here", "name"])
    in_file = in_file.withColumn("query_id", F.struct("here", "name", "qualifier")).withColumn("current_file", F.col("here"))
    field = lookup.rank(in_file, lookup.qualifier_in_source(in_file, opened)).where("rank = 1")
    points = plain.select(F.col("here").alias("file_id"), "name", F.col("at").alias("cursor_line"), F.struct("query_id", "here").alias("cursor_id"))
    local = lookup.local_definition_at(points, slim).select(
        "cursor_id.query_id", F.lit(LOCAL_FIRST if local_first else LOCAL_LAST).alias("priority"), F.col("cursor_id.here").alias("file_id"), "symbol_idx", "line"
    )
    found = (
        of(cursors, _written(best_by_name(cursors, workspace, opened), "best"), WORKSPACE)
        .unionByName(of(plain, _written(best_by_name(plain, deps, opened), "best"), DEPENDENCY))
        .unionByName(of(inside, field, FIELD)).unionByName(local)
    )
    return found.groupBy("query_id").agg(F.min(F.struct("priority", "file_id", "symbol_idx", "line")).alias("r")).select("query_id", "r.*")
