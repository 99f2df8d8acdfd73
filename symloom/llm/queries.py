"""Queries on text for training data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm import bpe, docpairs, handwritten, mixture, repetition, syntax, terms
from symloom.session import scratch, table

VOCABULARY = f"{bpe.DEFAULT_TOKENIZERS}/byte_bpe_50k.tiktoken"
SEED = 17


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that are not hand-written source of their project."""
    return handwritten.not_handwritten(table(spark, d, "source_files"), table(spark, d, "worktrees")).select("file_id")


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The same files and what shows it."""
    return handwritten.not_handwritten(table(spark, d, "source_files"), table(spark, d, "worktrees"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods whose documentation tells something."""
    return docpairs.documented_functions(table(spark, d, "symbols"), table(spark, d, "source_files")).select("file_id", "symbol_idx")


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each such function with its description and where it stands."""
    return docpairs.documented_functions(table(spark, d, "symbols"), table(spark, d, "source_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Files whose current content does not parse."""
    return syntax.syntax_failures(table(spark, d, "source_files"), explain=False).where(~F.col("ok")).select("file_id")


def p5_failures(spark: SparkSession, d: str) -> DataFrame:
    """The same files, the line of the furthest failure and its cause."""
    return syntax.syntax_failures(table(spark, d, "source_files")).where(~F.col("ok")).select("file_id", "worktree_key", "rel_path", "language", "fail_line", "cause")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of such files per repository and language."""
    return syntax.failure_rates(syntax.syntax_failures(table(spark, d, "source_files")), table(spark, d, "worktrees"))


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct term with its counts and mark."""
    return terms.term_frequencies(table(spark, d, "file_units"), table(spark, d, "symbols"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms too rare or too common."""
    return p6_terms(spark, d).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.token_ids(table(spark, d, "documents"), "doc_id", "text", VOCABULARY)


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").withColumn("source", mixture.plain_source(F.col("source")))
    # written once: the plan needs the sums, the sample the single sizes
    path = scratch(spark, "sizes")
    bpe.token_counts(docs, ["doc_id", "source"], "text", VOCABULARY).write.parquet(path)
    sizes = spark.read.parquet(path)
    shares = mixture.plan(sizes, table(spark, d, "source_weights"))
    return mixture.sample(sizes, shares, SEED, "doc_id"), shares


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used."""
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixture.report(*_mix(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that mostly repeat themselves."""
    return repetition.repetitive(table(spark, d, "documents"), "doc_id", "text")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """The repeated share of every document."""
    return repetition.repetition(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict:
    return {"p2_found": p2_found, "p2_reasons": p2_reasons, "p3_found": p3_found, "p3_pairs": p3_pairs, "p5_found": p5_found, "p5_failures": p5_failures, "p5_rates": p5_rates, "p6_found": p6_found, "p6_terms": p6_terms, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_shares": p10_shares}


_TERMS = """
with u as (select lower(content_hash) as r, arg_max(coalesce(word_hashes, []::bigint[]), parser_version) as a from file_units where content_hash is not null group by 1),
w as (select r, unnest(a) as t from u),
s as (select distinct file_id, symbol_idx, name from symbols where name is not null),
c as (select 'word' as field, cast(t as varchar) as term, count(*) as occurrences, count(distinct r) as records, (select count(*) from u) as total from w where t is not null group by t
      union all
      select 'name', name, count(*), count(distinct file_id), (select count(distinct file_id) from symbols) from s group by name),
m as (select *, case when records <= 2 then 'rare' when records > 0.1 * total then 'common' end as mark from c)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": _TERMS + "select field, term, mark from m where mark is not null",
        "p6_terms": _TERMS + "select field, term, occurrences, records, mark from m",
    }
