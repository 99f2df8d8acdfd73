"""Symbols and occurrences of source files, and what is asked of them."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from symloom.functions import enrich, lexer
from symloom.operators.corpus import newest, same_delivery
from symloom.schema import FAMILY_OF, OCCURRENCE, PARSED
from symloom.sources.spread import spread


def _arrow(ddl: str) -> pa.Schema:
    kind = _parse_datatype_string(ddl)
    assert isinstance(kind, StructType)
    return to_arrow_schema(kind)


def _lines(source: str) -> tuple[list[str], list[int]]:
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    return [x.removesuffix("\r") for x in source.split("\n")], starts


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows in the order of the schema's columns."""
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def parse_symbols(files: DataFrame) -> DataFrame:
    """Symbols of each file (file_id, ext, content), one row each, with documentation at the top level and signatures.

    Files of unknown ending, null and empty contents have none. A content is parsed once per ending wherever it stands:
    `distinct_contents` does that before this operator.
    """
    schema = _arrow(PARSED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, ext, source in zip(*(b.column(n).to_pylist() for n in ("file_id", "ext", "content")), strict=True):
                family = FAMILY_OF.get(ext or "")
                if not family or not source:
                    continue
                lines, starts = _lines(source)
                for k, s in enumerate(lexer.symbols(source, family)):
                    line = bisect_right(starts, s.at) - 1
                    end = None if s.end_at is None or s.depth == 0 else bisect_right(starts, s.end_at) - 1
                    doc = enrich.doc_comment(lines, line, family) if s.depth == 0 else None
                    col = len(source[starts[line] : s.at].encode())
                    rows.append((i, k, s.name, s.kind, line, col, s.def_keyword, doc, enrich.signature(lines, line, family), s.visibility, s.container, s.depth, end, s.type_text))
            yield _batch(rows, schema)

    return spread(files.select("file_id", "ext", "content")).mapInArrow(run, PARSED).dropDuplicates(["file_id", "symbol_idx"])


def parse_occurrences(files: DataFrame) -> DataFrame:
    """Identifiers in code, not in comments or texts, with their place, 32-bit hash and role."""
    schema = _arrow(OCCURRENCE)

    def fnv(word: str) -> int:
        h = 0x811C9DC5
        for byte in word.encode():
            h = (h ^ byte) * 0x01000193 & 0xFFFFFFFF
        return h

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[str, int] = {}
        for b in batches:
            rows = []
            for i, ext, source in zip(*(b.column(n).to_pylist() for n in ("file_id", "ext", "content")), strict=True):
                family = FAMILY_OF.get(ext or "")
                if not family or not source:
                    continue
                _, starts = _lines(source)
                defined = {s.at for s in lexer.symbols(source, family)}
                for word, at in enrich.occurrences(source, family):
                    line = bisect_right(starts, at) - 1
                    if len(hashes) > 200_000:
                        hashes.clear()
                    h = hashes.get(word) or hashes.setdefault(word, fnv(word))
                    rows.append((i, word, h, line, len(source[starts[line] : at].encode()), len(word.encode()), "Definition" if at in defined else "Reference"))
            yield _batch(rows, schema)

    return spread(files.select("file_id", "ext", "content")).mapInArrow(run, OCCURRENCE).dropDuplicates(["file_id", "line", "col"])


def counters(files: DataFrame) -> DataFrame:
    """(ext, files, bytes, comment_bytes, string_bytes, ident_ascii, ident_unicode) per ending with a lexer; each file
    (file_id) counts once."""
    names = ["bytes", "comment_bytes", "string_bytes", "ident_ascii", "ident_unicode"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, ext, source in zip(*(b.column(n).to_pylist() for n in ("file_id", "ext", "content")), strict=True):
                if family := FAMILY_OF.get(ext or ""):
                    found = lexer.counters(source or "", family)
                    rows.append((i, ext, *(found[n] for n in names)))
            types = (pa.int64(), pa.string(), *[pa.int64()] * len(names))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["file_id", "ext", *names])

    counted = spread(files.select("file_id", "ext", "content")).mapInArrow(run, "file_id bigint, ext string, " + ", ".join(f"{n} bigint" for n in names))
    return counted.dropDuplicates(["file_id"]).groupBy("ext").agg(F.count(F.lit(1)).alias("files"), *[F.sum(n).alias(n) for n in names])


def distinct_contents(files: DataFrame) -> DataFrame:
    """Of all delivered rows those of one file for each (content, ending) that is current anywhere, the one of smallest
    file_id, so that equal contents are parsed once.

    Which ones is found from hashes and times alone; contents meet only the list of the chosen, which Spark broadcasts
    if it is small. A row that was delivered again as it was stays twice: what is parsed from it folds.
    """
    last = newest(files)
    ext = files.groupBy("file_id", F.col("mtime_ns").alias("_at"), F.col("content_hash").alias("_hash")).agg(F.min("ext").alias("ext"))
    chosen = (
        ext.alias("e").join(last.alias("l"), same_delivery("e", "l"), "left_semi")
        .groupBy(F.lower("_hash").alias("h"), "ext").agg(F.min(F.struct("file_id", "_at", "_hash")).alias("c")).select("c.*")
    )
    # spread before the join, as its plan then tells nothing about the scan
    rows = spread(files).withColumn("_at", F.col("mtime_ns")).withColumn("_hash", F.col("content_hash"))
    return rows.alias("r").join(chosen.alias("c"), same_delivery("r", "c"), "left_semi").drop("_at", "_hash")


def call_sites(lines: DataFrame) -> DataFrame:
    """(file_id, line, col, callee, qualifier, active): for each line (file_id, line, text) and each column in it from which
    on another call, or another parameter of one, is active."""
    names, types = ["file_id", "line", "col", "callee", "qualifier", "active"], (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, line, *site) for i, line, t in zip(*(b.column(n).to_pylist() for n in ("file_id", "line", "text")), strict=True) if t for site in enrich.call_sites(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    with_calls = lines.where(F.contains("text", F.lit("(")))
    return with_calls.select("file_id", "line", "text").mapInArrow(run, "file_id bigint, line int, col int, callee string, qualifier string, active int")
