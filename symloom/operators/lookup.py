"""Definitions, scopes, ranking and references as joins over batches of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions import text
from symloom.operators.corpus import few, is_local, newest, runs, same_delivery
from symloom.operators.intervals import innermost
from symloom.schema import VISIBILITY_RANK, lookup
from symloom.session import scratch
from symloom.sources.spread import spread, tasks

LOOK_BACK = 30
#: Definitions of a name, and files that ask for it, meet in blocks of so many of each; matches of a block are bits in words of `_WORD`.
BLOCK, _WORD = 512, 32


def visibility_rank(visibility: Column) -> Column:
    return F.coalesce(lookup(VISIBILITY_RANK, visibility), F.lit(1))


def definitions(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Definitions of each asked name: an equi-join; letter case counts."""
    return index.join(queries, "name")


def local_definition_at(cursors: DataFrame, symbols: DataFrame) -> DataFrame:
    """(cursor_id, line, symbol_idx): the innermost local definition whose scope holds the cursor's line.

    As-of: among a file's symbols of that name that begin at or before the cursor and end at or after it, the deepest,
    then the latest, then the last in symbol order. One sweep per (file, name).
    """
    scoped = symbols.where(F.col("depth") > 0).select("file_id", "name", F.col("line").alias("start"), F.col("scope_end_line").alias("end"), "depth", "line", "symbol_idx", F.struct("line", "symbol_idx").alias("value"))
    points = cursors.select("file_id", "name", F.col("cursor_line").alias("at"), F.col("cursor_id").alias("point_id"))
    found = innermost(points, scoped, ["file_id", "name"], ["depth", "line", "symbol_idx"])
    return found.select(F.col("point_id").alias("cursor_id"), "best.line", "best.symbol_idx")


def enclosing_scopes(points: DataFrame, scopes: DataFrame) -> DataFrame:
    """(point_id, depth, container, end): how many scopes (file_id, start, end, scope, and as `last` what decides between
    equal ones) enclose a point (point_id, file_id, at), and the innermost: that which begins last, then ends first. One sweep per
    file."""
    held = scopes.select("file_id", "start", "end", "last", F.negative("end").alias("_early"), F.struct("scope", "end").alias("value")).where(F.col("end").isNotNull())
    found = innermost(points, held, ["file_id"], ["start", "_early", "last"])
    return found.select("point_id", "depth", F.col("best.scope").alias("container"), F.col("best.end").alias("end"))


def same_position_once(symbols: DataFrame, order: str) -> DataFrame:
    """One symbol per (file, line, col): one with a container if there is any, of those the later."""
    w = Window.partitionBy("file_id", "line", "col").orderBy(F.col("container").isNotNull().desc(), F.col(order).desc())
    return symbols.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


_OPENER = rf"^\s*(?:impl|struct|class|trait|enum|interface|object)\s*(?:<[^>]*>\s*)?({text.RUN})"


def openers(files: DataFrame) -> DataFrame:
    """(file_id, _line, qualifier) of the lines of current contents that open a type: `impl`, `struct`, ... , an optional `<...>`,
    and the name as a whole word. Found in all deliveries where they are read; only these few lines are shuffled."""
    lines = files.select("file_id", F.col("mtime_ns").alias("_at"), F.col("content_hash").alias("_hash"), F.posexplode(F.split("content", "\n", -1)).alias("_line", "_t"))
    found = lines.select("file_id", "_at", "_hash", "_line", F.regexp_extract("_t", _OPENER, 1).alias("qualifier")).where(F.col("qualifier") != "")
    return found.alias("o").join(newest(files).alias("n"), same_delivery("o", "n"), "left_semi").select("file_id", "_line", "qualifier").distinct()


def qualifier_in_source(defs: DataFrame, opened: DataFrame) -> DataFrame:
    """(query_id, file_id, symbol_idx) of definitions without container that stand at most 30 lines below a line that
    opens their qualifier (`openers`)."""
    asked = defs.where(F.col("container").isNull() & F.col("qualifier").isNotNull())
    # joined on the file and the qualifier; the distance only filters what one file holds of one name
    near = asked.join(opened, ["file_id", "qualifier"]).where((F.col("_line") < F.col("line")) & (F.col("_line") >= F.col("line") - LOOK_BACK))
    return near.select("query_id", "file_id", "symbol_idx").distinct()


def rank(defs: DataFrame, from_source: DataFrame | None = None, extra: Column | None = None) -> DataFrame:
    """`score` and `rank` of the definitions of each query: two for the query's own file, four for its qualifier.

    `defs` has query_id, current_file, qualifier and the symbol. Ties are broken by file, line, column and index.
    """
    matches = F.when(F.col("qualifier").isNotNull() & F.col("container").isNotNull(), F.col("container") == F.col("qualifier"))
    if from_source is not None:
        defs = defs.join(from_source.withColumn("_src", F.lit(True)), ["query_id", "file_id", "symbol_idx"], "left")
        matches = F.coalesce(matches, F.col("_src"))
    score = F.when(F.col("file_id") == F.col("current_file"), 2).otherwise(0) + F.when(F.coalesce(matches, F.lit(False)), 4).otherwise(0)
    if extra is not None:
        score = score + extra
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "file_id", "line", "col", "symbol_idx")
    return defs.withColumn("score", score).withColumn("rank", F.row_number().over(order)).drop("_src")


def rank_all(asked: DataFrame, index: DataFrame, opened: DataFrame) -> DataFrame:
    """(here, name, file_id, symbol_idx, score, rank): all definitions of each asked (here, name, qualifier), one per (here, name),
    with score and rank as by `rank` and `qualifier_in_source`; a null place comes last.

    These are as many rows as definitions times files that ask, so nothing of that size is sorted or shuffled. Without the
    asking file, the order of a name's definitions is the same for all; a rank follows from the place there, how many
    that match the qualifier stand before, and how many the file itself has. All of these are counted beside, in rows that grow with the
    tables, and meet in blocks that give their rows as they are.
    """
    spark = index.sparkSession

    def once(rows: DataFrame, purpose: str) -> DataFrame:
        place = scratch(spark, purpose)
        rows.write.parquet(place)
        return spark.read.parquet(place)

    order = Window.partitionBy("name").orderBy(*[F.col(c).asc_nulls_last() for c in ("file_id", "line", "col", "symbol_idx")])
    asked = asked.select("here", "name", "qualifier")
    defs = index.join(asked.select("name").distinct(), "name", "left_semi").select("file_id", "symbol_idx", "name", "line", "col", "container")
    defs = once(defs.withColumn("_p", (F.row_number().over(order) - 1).cast("long")), "places")

    # what matches a qualifier: the container, or without one a line above that opens it
    near = opened.select("file_id", "_line", "qualifier", F.floor(F.col("_line") / LOOK_BACK).alias("_part"))
    part = F.floor(F.col("line") / LOOK_BACK)
    bare = defs.where(F.col("container").isNull()).select("name", "file_id", "line", "_p", F.explode(F.array(part, part - 1)).alias("_part"))
    bare = bare.join(near, ["file_id", "_part"]).where((F.col("_line") < F.col("line")) & (F.col("_line") >= F.col("line") - LOOK_BACK))
    both = defs.select("name", F.col("container").alias("qualifier"), "file_id", "_p").unionByName(bare.select("name", "qualifier", "file_id", "_p").distinct())
    both = both.join(asked.select("name", "qualifier").distinct(), ["name", "qualifier"], "left_semi")
    before = Window.partitionBy("name", "qualifier").orderBy("_p")
    matches = once(both.withColumn("_c", (F.row_number().over(before) - 1).cast("long")), "matches")

    # of each block of places: matches before it, and as bits those within, with how many stand before each word
    words = matches.groupBy("name", "qualifier", F.floor(F.col("_p") / BLOCK).alias("_d"), F.floor(F.col("_p") % BLOCK / _WORD).cast("int").alias("_w"))
    words = words.agg(F.bit_or(F.expr(f"shiftleft(1L, cast(_p % {_WORD} as int))")).alias("_bits"), F.min("_c").alias("_first"), F.count(F.lit(1)).alias("_n"))
    held = words.groupBy("name", "qualifier", "_d").agg(F.sort_array(F.collect_list(F.struct("_w", "_bits", "_n"))).alias("_l"), F.min("_first").alias("_first"), F.sum("_n").alias("_n"))
    sizes = defs.groupBy("name").agg(F.floor((F.max("_p")) / BLOCK).alias("_ds")).join(asked.groupBy("name").agg(F.floor((F.count(F.lit(1)) - 1) / BLOCK).alias("_qs")), "name")
    blocks = lambda c, name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c))).alias(name)
    grid = held.select("name", "qualifier").distinct().join(sizes, "name").select("name", "qualifier", blocks("_ds", "_d")).join(held.drop("_first"), ["name", "qualifier", "_d"], "left")
    of_all = Window.partitionBy("name", "qualifier")
    earlier = of_all.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select(
        "name", "qualifier", "_d", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_c0"), F.sum("_n").over(of_all).alias("_m"),
        F.expr(f"transform(sequence(0, {BLOCK // _WORD - 1}), w -> coalesce(get(filter(_l, x -> x._w = w), 0)._bits, 0L))").alias("_bits"),
        F.expr(f"transform(sequence(0, {BLOCK // _WORD - 1}), w -> aggregate(_l, 0L, (n, x) -> n + if(x._w < w, x._n, 0L)))").alias("_before"),
    )

    # of each asking file: where its own definitions begin, how many it has, and how many of them match
    own = asked.join(defs.withColumnRenamed("file_id", "here").select("here", "name", "_p"), ["here", "name"], "left").groupBy("here", "name").agg(F.min("_p").alias("_from"), F.count("_p").alias("_own"))
    own_m = asked.join(matches.withColumnRenamed("file_id", "here"), ["here", "name", "qualifier"]).groupBy("here", "name").agg(F.count(F.lit(1)).alias("_own_m"), F.min("_c").alias("_from_m"))
    number = F.floor((F.row_number().over(Window.partitionBy("name").orderBy("here")) - 1) / BLOCK).alias("_q")
    left = asked.join(own, ["here", "name"]).join(own_m, ["here", "name"], "left").select("*", number).join(sizes, "name").withColumn("_d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ds"))))
    left = left.join(grid, ["name", "qualifier", "_d"], "left").drop("qualifier", "_ds", "_qs")
    right = defs.join(sizes, "name").select("name", "file_id", "symbol_idx", "_p", F.floor(F.col("_p") / BLOCK).alias("_d"), blocks("_qs", "_q"))
    # the blocks are few bytes but many rows when joined, so their number is given and not merged
    n, keys = 4 * tasks(spark), ["name", "_d", "_q"]
    pairs = left.repartition(n, *keys).join(right.repartition(n, *keys), keys)
    w, bit = (F.col("_p") % BLOCK / _WORD).cast("int"), F.expr(f"shiftleft(1L, cast(_p % {_WORD} as int))")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    here, bits = F.coalesce(F.col("file_id") == F.col("here"), F.lit(False)), F.get("_bits", w)
    pairs = pairs.select(
        "here", "name", "file_id", "symbol_idx", "_p", "_from", "_from_m", here.alias("_here"), zero(F.col("_m")).alias("_m"), zero(F.col("_own_m")).alias("_own_m"), F.col("_own"),
        (zero(bits.bitwiseAND(bit)) != 0).alias("_match"), (zero(F.col("_c0")) + zero(F.get("_before", w) + F.bit_count(bits.bitwiseAND(bit - 1)))).alias("_c"),
    )
    c, first = F.col("_c"), F.coalesce(F.col("_p") < F.col("_from"), F.lit(False))
    matching = F.when(F.col("_here"), c - F.col("_from_m")).otherwise(c + F.when(first, F.col("_own_m")).otherwise(0))
    # where the file has no match of its own, as many stand before each of its definitions
    other = F.when(F.col("_here"), F.col("_p") - F.col("_from") - zero(c - F.col("_from_m"))).otherwise(F.col("_p") - c + F.when(first, F.col("_own") - F.col("_own_m")).otherwise(0))
    place = F.when(F.col("_match"), matching).otherwise(F.col("_m") + other) + 1
    score = F.when(F.col("_here"), 2).otherwise(0) + F.when(F.col("_match"), 4).otherwise(0)
    return pairs.select("here", "name", "file_id", "symbol_idx", score.alias("score"), place.alias("rank"))


def by_precedence(candidates: list[DataFrame]) -> DataFrame:
    """The candidates of the first list that has any for a query: (query_id, ..., priority)."""
    out = None
    for k, c in enumerate(candidates):
        c = c.withColumn("priority", F.lit(k))
        out = c if out is None else out.unionByName(c)
    best = Window.partitionBy("query_id")
    return out.withColumn("_best", F.min("priority").over(best)).where(F.col("priority") == F.col("_best")).drop("_best")


def top(rows: DataFrame, per: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("rank") <= n)


def outline(symbols: DataFrame) -> DataFrame:
    """What an outline shows: all but locals."""
    return symbols.where(~is_local())


def references(queries: DataFrame, files: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """(word, file_id, line, col, len) of each asked word in the current contents of files.

    With `postings` (file_id, word) only files whose postings hold an asked word are scanned for words that have
    postings; a word that no postings hold is searched in all files.
    """
    asked = queries.select("word").where(F.col("word").isNotNull()).distinct()
    if postings is None:
        return runs(files, asked).select("word", "file_id", "line", "col", "len")
    # written once: which words have postings, which files to scan, and which hits hold all ask it
    place = scratch(files.sparkSession, "postings")
    # few words, as measured, go to the postings; postings are not shuffled to meet them
    postings.join(F.broadcast(asked) if few(asked) else asked, "word").select("word", "file_id").distinct().write.parquet(place)
    known = files.sparkSession.read.parquet(place)
    listed = known.select("word").distinct()
    hits = runs(spread(files).join(known.select("file_id").distinct(), "file_id", "left_semi"), listed).join(known, ["word", "file_id"], "left_semi")
    rest = asked.join(listed, "word", "left_anti")
    if not rest.isEmpty():
        hits = hits.unionByName(runs(files, rest))
    return hits.select("word", "file_id", "line", "col", "len")
