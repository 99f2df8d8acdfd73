"""Typo-tolerant and prefix search over names."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions.text import ascii_lower, trigrams
from symloom.session import scratch
from symloom.sources.spread import tasks

DISTANCE = 2


def trigram_index(names: DataFrame) -> DataFrame:
    """(gram, name), one row per entry of a name, repeats kept."""
    return names.select(F.explode(trigrams(F.col("name"))).alias("gram"), "name")


#: Names and queries meet in blocks of so many of each, of which so many queries are looked up at a time, and give batches of so
#: many bytes at most.
BLOCK_NAMES, BLOCK_QUERIES, _AT_ONCE, _BATCH_BYTES = 4096, 2048, 64, 8 << 20


def candidates(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, name) that share a trigram; for a query that is shorter than three bytes or shares none, the names whose
    length differs by at most two bytes. Each pair once; nulls have none.

    The result is a good part of all pairs, so pairs are neither made twice nor shuffled: names and queries are dealt to
    blocks, and in a block the postings of a query's trigrams are marked in a row of bits, one for each name. What is
    shuffled is each name once per block of queries and each query once per block of names.
    """
    spark = names.sparkSession

    def once(rows: DataFrame, purpose: str) -> DataFrame:
        place = scratch(spark, purpose)
        rows.write.parquet(place)
        return spark.read.parquet(place)

    names = once(names.select("name").where(F.col("name").isNotNull()).distinct(), "names")
    queries = queries.select("query").where(F.col("query").isNotNull()).distinct()
    grams = queries.where(F.octet_length("query") >= 3).select("query", F.explode(trigrams(F.col("query"))).alias("gram"))
    some = grams.join(trigram_index(names).select("gram").distinct(), "gram", "left_semi").select("query").distinct()
    queries = once(queries.join(some.withColumn("_shares", F.lit(True)), "query", "left"), "queries")
    parts = lambda rows, n: max(1, -(-rows.count() // n))
    per_name, per_query = parts(queries, BLOCK_QUERIES), parts(names, BLOCK_NAMES)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # kinds in the order of their use: names, queries by trigrams, queries by length
    kind = F.when(F.col("_shares"), 1).otherwise(2)
    a = names.select(every(per_name).alias("_q"), F.pmod(F.xxhash64("name"), F.lit(per_query)).alias("_n"), F.lit(0).alias("_kind"), F.col("name").cast("binary").alias("_text"))
    b = queries.select(F.pmod(F.xxhash64("query"), F.lit(per_name)).alias("_q"), every(per_query).alias("_n"), kind.alias("_kind"), F.col("query").cast("binary").alias("_text"))
    rows = a.unionAll(b).select((F.col("_q") * per_query + F.col("_n")).alias("_block"), "_kind", "_text")
    n = min(per_name * per_query, 4 * tasks(spark))
    rows = rows.repartition(n, "_block").sortWithinPartitions("_block", "_kind")
    return rows.mapInArrow(_pairs, "query binary, name binary").select(F.col("query").cast("string"), F.col("name").cast("string"))


_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _lengths(texts: pa.Array) -> np.ndarray:
    return np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset))


def _windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of all texts as numbers, and which text each stands in, in the order of texts; as `trigrams`."""
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    lengths, data = np.diff(ends), texts.buffers()[2]
    d = _LOWER[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]].astype(np.int32) if data is not None else np.zeros(0, np.int32)
    of = np.repeat(np.arange(len(texts)), lengths)
    gram = np.zeros(max(0, len(d) - 2), np.int32)
    if len(gram):
        gram = d[:-2] << 16 | d[1:-1] << 8 | d[2:]
    whole = np.arange(len(gram)) + 3 <= ends[1:][of[: len(gram)]] - ends[0]
    short = np.flatnonzero(lengths < 3)
    return np.concatenate([gram[whole], lengths[short]]), np.concatenate([of[: len(gram)][whole], short])


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, name) of each block, of rows (_block, _kind, _text) that are sorted by block and kind."""
    block, held, index = None, [], None
    for batch in batches:
        key = batch.column(0).to_numpy() * 3 + batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            if key[start] // 3 != block:
                block, held, index = key[start] // 3, [], None
            texts = batch.column(2).slice(start, end - start)
            if key[start] % 3 == 0:
                held.append(texts)
            elif held:
                if index is None:
                    names = pa.concat_arrays(held)
                    gram, name = _windows(names)
                    order = np.argsort(gram, kind="stable")
                    index = names, _lengths(names), gram[order], name[order]
                for k in range(0, len(texts), _AT_ONCE):
                    yield from _met(texts.slice(k, _AT_ONCE), *index, key[start] % 3 == 2)


def _met(queries: pa.Array, names: pa.Array, name_lengths: np.ndarray, gram: np.ndarray, name: np.ndarray, by_length: bool) -> Iterator[pa.RecordBatch]:
    lengths = _lengths(queries)
    if by_length:
        met = np.abs(lengths[:, None] - name_lengths[None, :]) <= DISTANCE
    else:
        asked, query = _windows(queries)
        low = np.searchsorted(gram, asked, "left")
        many = np.searchsorted(gram, asked, "right") - low
        at = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
        met = np.zeros((len(queries), len(names)), bool)
        met[np.repeat(query, many), name[at]] = True
    q, n = np.nonzero(met)
    part = np.cumsum(lengths[q] + name_lengths[n], dtype=np.int64) // _BATCH_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(q)]
    for start, end in zip(cuts, cuts[1:]):
        if start < end:
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(q[start:end])), names.take(pa.array(n[start:end]))], names=["query", "name"])


#: An edit touches at most three of a text's trigrams: of seven, two edits leave one.
SURE_GRAMS = 3 * DISTANCE + 1


def _rarest(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(query, gram): of each ASCII query as many of its rarest trigrams as two edits can't all touch; of others, where an edit
    may touch more bytes, all of them. Frequencies are those in `entries` (gram, name)."""
    grams = queries.select("query", F.explode(F.array_distinct(trigrams(F.col("query")))).alias("gram"))
    counts = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("query").orderBy(F.coalesce("_n", F.lit(0)), "gram")
    ranked = grams.join(counts, "gram", "left").withColumn("_k", F.row_number().over(order))
    # a trigram that stands more than once in a query is one entry: so many edits may touch that all are kept
    plain = (F.octet_length("query") == F.char_length("query")) & (F.size(F.array_distinct(trigrams(F.col("query")))) == F.size(trigrams(F.col("query"))))
    return ranked.where(~plain | (F.col("_k") <= SURE_GRAMS)).select("query", "gram")


def fuzzy_matches(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, name, distance) within two edits, letter case counting and a transposition counting two, among `candidates`.

    Not all candidates are made: a name within two edits shares one of any seven trigrams of the query, so only the
    query's seven rarest are looked up, together with the length, which differs by two characters at most. A common
    trigram thus pairs only names and queries of like lengths that have nothing rarer.
    """
    index = trigram_index(names).distinct()
    long = queries.where(F.octet_length("query") >= 3)
    band = F.explode(F.sequence(F.char_length("query") - DISTANCE, F.char_length("query") + DISTANCE))
    asked = _rarest(long, index).withColumn("n", band)
    near = asked.join(index.withColumn("n", F.char_length("name")), ["gram", "n"]).select("query", "name").distinct()
    # queries that share no trigram with any name: their length alone decides
    grams = long.select("query", F.explode(trigrams(F.col("query"))).alias("gram"))
    some = grams.join(index.select("gram").distinct(), "gram", "left_semi").select("query").distinct()
    rest = queries.join(some, "query", "left_anti")
    lengths = rest.select("query", F.explode(F.sequence(F.octet_length("query") - DISTANCE, F.octet_length("query") + DISTANCE)).alias("n"))
    alike = lengths.join(names.select("name", F.octet_length("name").alias("n")), "n").select("query", "name")
    return near.unionAll(alike).select("query", "name", F.levenshtein("query", "name", DISTANCE).alias("distance")).where(F.col("distance") >= 0)


def completions(prefixes: DataFrame, names: DataFrame) -> DataFrame:
    """(query, name): names that begin with the query, letter case of ASCII apart; for a query without any, what the
    fuzzy search gives.

    A name is cut at each length that occurs among the queries, however long (an equi-join on lengths), and the cuts
    join the queries. An empty
    query has no completions.
    """
    prefixes = prefixes.where(F.col("query") != "")
    keyed = prefixes.select("query", ascii_lower(F.col("query")).alias("k"))
    lengths = prefixes.select(F.char_length("query").alias("n")).distinct()
    counted = names.where(F.col("name") != "").select("name", F.explode(F.sequence(F.lit(1), F.char_length("name"))).alias("n"))
    cut = counted.join(lengths, "n").select("name", ascii_lower(F.substring("name", F.lit(1), F.col("n"))).alias("k"))
    hits = keyed.join(cut, "k").select("query", "name")
    fuzzy = fuzzy_matches(prefixes.join(hits.select("query").distinct(), "query", "left_anti"), names).select("query", "name")
    return hits.unionAll(fuzzy)
