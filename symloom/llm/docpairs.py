"""Functions paired with their documentation."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.llm.doctext import description
from symloom.llm.syntax import ENDINGS, LITERALS
from symloom.sources.spread import spread

#: How a definition of a function begins, by language family; the group that is not null is its name. No two
#: repetitions that follow each other can share characters in more than one way, so a line takes time in proportion to its length.
_KEYWORD_DEF = {
    "python": r"^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)",
    "ruby": r"^[ \t]*def[ \t]+(?:self\.)?(\w+[?!=]?)",
    "go": r"^func[ \t]*(?:\([^)\n]*\)[ \t]*)?(\w+)",
    "rust": r"^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?(?:(?:default|const|async|unsafe|extern(?:[ \t]+\"[^\"\n]*\")?)[ \t]+)*fn[ \t]+(\w+)",
    "javascript": r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?(?:function[ \t]*\*?[ \t]*(\w+)|(?:(?:static|async|get|set|public|private|protected|readonly)[ \t]+)*\*?#?((?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|with\b|await\b|new\b|typeof\b)\w+)[ \t]*\((?=[^;\n]*+$)(?:[^{\n]*+\{(?![ \t]*$))*+[^{\n]*\)[ \t]*(?::[^{\n]+)?\{[ \t]*$|(?:const|let|var)[ \t]+(\w+)[ \t]*=[ \t]*(?:async[ \t]*)?(?:function\b|\([^;\n]*\)[ \t]*=>|\w+[ \t]*=>))",
    "c": r"^[ \t]*+(?!return\b|else\b|if\b|for\b|while\b|switch\b|do\b|case\b|goto\b|typedef\b|delete\b|throw\b|new\b|using\b)[\w:<>,~*&\[\]][\w:<>,~*&\[\] \t]*[ \t*&]((?:\w+::)*~?\w+)[ \t]*\([^;=\n]*+$",
}
_KEYWORD_DEF["java"] = r"^[ \t]*+(?!return\b|else\b|if\b|for\b|while\b|switch\b|do\b|case\b|throw\b|new\b|using\b|catch\b|assert\b|await\b|yield\b)(?:[\w<>,.?\[\]@]+[ \t]+)*(\w+)[ \t]*\([^;\n]*+$"
_KEYWORD_DEF["csharp"] = _KEYWORD_DEF["java"]
#: One of these words is in a line that begins a definition.
_NEEDED = {"python": ("def",), "ruby": ("def",), "go": ("func",), "rust": ("fn",), "javascript": ("(", "=>", "function"), "c": ("(",), "java": ("(",), "csharp": ("(",)}
#: C's characters in time that follows the line: after an escape, what is no quote belongs to the literal in one way only.
_C_CHAR = (r"'(?:[^'\\\n\r]|\\.[^'\n\r]*)+'", r"'(?!')[^'\\\n\r]*+(?:\\.(?:[^'\\\n\r]|\\\r?)*+)?'")
#: Text in which no comment or literal begins, by language; it is passed over at once.
_PLAIN = {
    "c": r"(?:[^/\"'uULR]++|u(?!8?[\"'])|[ULR](?![\"']))*+", "java": r"[^/\"'@$]*+", "csharp": r"[^/\"'@$]*+", "javascript": r"[^/\"'`]*+", "go": r"[^/\"'`]*+", "rust": r"(?:[^/\"'#bcr]++|[bcr]++(?![#\"']))*+",
    "python": r"(?:[^#\"'rRbBuUfF]++|[rRbBuUfF]++(?![\"']))*+", "ruby": r"(?:[^#\"'`%/=_]++|=(?!begin)|_(?!_END__))*+",
}
_CLOSED = r"/\*[\s\S]*?\*/|"
_CONFLICT = tuple(c * 7 for c in "<=>|")
#: Lines that may stand between a comment and its function: attributes, annotations, templates, modifiers.
_BETWEEN = re.compile(r"^\s*(?:@[\w.]+(?:\(.*\))?|#!?\[.*\]|\[\[?[\w:. ,()\"=]+\]\]?|template\s*<.*>|(?:public|private|protected|static|export|default|inline|extern(?:\s+\"C\")?|virtual|async|pub)(?:\s+(?:public|private|protected|static|inline|virtual))*)\s*$")
_OPENS, _CLOSES = re.compile(r"[(\[{]"), re.compile(r"[)\]}]")
SPAN = "file_id bigint, at bigint, what string, line int, last int, code int, name string, text string"


@cache
def _tools(ending: str) -> tuple[str, re.Pattern, re.Pattern, re.Pattern, re.Pattern]:
    """Language; comments and literals (group 1) with the plain text behind them, the same in text with conflict markers,
    the same behind a comment that is never closed; definitions."""
    lang = ENDINGS.get(ending, "javascript")
    literals = LITERALS[lang].replace(*_C_CHAR)
    return lang, re.compile(rf"(?:({literals})|[\s\S]){_PLAIN[lang]}"), re.compile(f"({literals})"), re.compile(f"({literals.replace(_CLOSED, '')})"), re.compile(_KEYWORD_DEF[lang])


def _literals(lexer: re.Pattern, behind: re.Pattern, text: str) -> Iterator[re.Match]:
    """Behind a comment that is never closed no other is closed: none of those that follow is read to the end again."""
    for m in lexer.finditer(text):
        yield m
        if m[1] == "/*":
            yield from behind.finditer(text, m.end(1))
            return


_LINE_END = re.compile(r"\r\n|\n|\r")
_DOCSTRING = re.compile(r"[rRuU]?(?:\"\"\"|'''|\"|')")


def spans(path: str, text: str) -> Iterator[tuple[str, int, int, int, str | None, str | None]]:
    """(what, first line, last line, code lines before, name, text) of comments `c`, docstrings `d` and functions `f`.

    Comments in successive lines are one span. Code lines are lines that hold more than blanks, comments, and what may
    stand between a comment and its function; the number of them before two spans tells whether a statement intervenes.
    """
    lang, lexer, careful, behind, define = _tools(path.rsplit(".", 1)[-1].lower())
    if text.startswith(_CONFLICT) or any("\n" + x in text for x in _CONFLICT):
        lexer = careful
    hashes = lang in ("python", "ruby")
    breaks = [m.end() for m in _LINE_END.finditer(text)]
    bare: list[str] = []
    found: list[list] = []
    at = 0
    never_closed = lang not in ("python", "ruby", "rust") and -1 < (k := text.rfind("/*")) and k + 2 > text.rfind("*/")
    for m in _literals(lexer, behind, text) if never_closed else lexer.finditer(text):
        t = m[1]
        if t is None:
            continue
        is_comment = t[0] == "#" or t.startswith("=begin") if hashes else t[:2] == "//" or t[:2] == "/*" and len(t) > 2
        if not is_comment and t[-1] not in "\"'`":
            continue
        start, end = m.span(1)
        # a line that holds an earlier literal is not blank before this one, so no line is looked at twice
        is_doc = False
        if lang == "python" and not is_comment and t[-1] != "`" and _DOCSTRING.match(t):
            k = text.rfind("\n", at, start)
            is_doc = (k >= 0 or not at) and not text[k + 1 : start].strip()
        bare.append(text[at:start])
        # line ends are kept, so that lines keep their numbers
        bare.append(("" if is_comment else '""') + ("".join(_LINE_END.findall(t)) if "\n" in t or "\r" in t else ""))
        if is_comment or is_doc:
            a, b = bisect_right(breaks, start), bisect_right(breaks, max(start, end - 1))
            begins = breaks[a - 1] if a else 0
            own = at <= begins and not text[begins:start].strip()
            if found and found[-1][0] == "c" and is_comment and own and found[-1][2] == a - 1 and found[-1][4] and not t.startswith("/*") and not found[-1][3][0].startswith("/*"):
                found[-1][2] = b
                found[-1][3].append(t)
            else:
                found.append(["d" if is_doc else "c", a, b, [t], own])
        at = end
    bare.append(text[at:])
    lines = _LINE_END.split("".join(bare))
    before = [0]
    functions = []
    needed = _NEEDED[lang]
    for line, x in enumerate(lines):
        y = x.strip()
        before.append(before[-1] + (1 if y and (y[-1] in ";{},(:" or not _BETWEEN.match(x)) else 0))
        if y and any(n in x for n in needed) and (m := define.match(x)):
            functions.append(line)
            yield "f", line, line, before[line], next((g for g in m.groups() if g), None), None
    heads, begun = {}, set(functions)
    for f in functions if lang == "python" else ():  # the line on which a Python header ends
        depth, k = 0, f
        while k < len(lines):
            depth += len(_OPENS.findall(lines[k])) - len(_CLOSES.findall(lines[k]))
            if depth <= 0 and lines[k].rstrip().endswith(":"):
                heads[k] = f
                break
            if depth <= 0 and not lines[k].rstrip().endswith("\\") or k + 1 in begun:  # a head of one line, or one never closed
                break
            k += 1
    for what, a, b, parts, own in found:
        t = "\n".join(parts)
        if what == "d":
            k = a - 1
            while k >= 0 and not lines[k].strip():
                k -= 1
            if k in heads:
                yield "d", a, b, before[heads[k]], None, t
        elif own:
            yield "c", a, b, before[b + 1] if b + 1 < len(before) else before[-1], None, t


#: Deliveries that a task remembers, to pass over the same one when it comes again.
_REMEMBERED = 200_000


def extract_spans(files: DataFrame, newest: str = "mtime_ns") -> DataFrame:
    """Spans of every delivered row; contents stay where they are read. Null contents, and rows without file_id, have none.
    A delivery that comes again in the same task gives no further spans."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for i, at, p, t in zip(*(b.column(n).to_pylist() for n in ("file_id", "_at", "rel_path", "content")), strict=True):
                if not t or i is None:
                    continue
                delivery = (i, at, p, xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")))
                if delivery in seen:
                    continue
                if len(seen) >= _REMEMBERED:
                    seen.clear()
                seen.add(delivery)
                for what, a, z, code, name, text in spans(p or "", t):
                    for column, value in zip(out, (i, at, what, a, z, code, name, text), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)],
                names=["file_id", "at", "what", "line", "last", "code", "name", "text"],
            )

    return spread(files.select("file_id", F.col(newest).alias("_at"), "rel_path", "content")).mapInArrow(run, SPAN)


def newest_spans(found: DataFrame, files: DataFrame, newest: str = "mtime_ns") -> DataFrame:
    """The spans of each file's newest delivery, each once.

    Files meet the time of their newest delivery by their id alone, so that folding equal spans, and the windows that
    follow, find them where they are: spans are shuffled once. A null time is older than any other.
    """
    last = files.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.max(newest).alias("_last"))
    # the one row per file holds its latest time: not before it is at it
    current = F.col("_last").isNull() | (F.col("at") >= F.col("_last"))
    return found.join(last, "file_id").where(current).drop("_last").dropDuplicates(["file_id", "at", "what", "line", "last", "code", "name", "text"])


def attached_comments(found: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """As-of interval join of functions and comments: (file_id, line, name, doc_line, doc_last, text), one row per function.

    In the order of lines, a function takes the next docstring below it, or failing that, the last comment that ended
    before it; either only if as many code lines stand before both, that is, if no statement intervenes. Of several
    functions on one line the last in this order holds.

    With `symbols` (file_id, line, ...) the rows are these instead, with their columns and those of the function on their
    line, null where there is none. They stand in the same order behind the functions of their line, so files are brought
    together once for both joins. Symbols without a line are kept.
    """
    extra = [] if symbols is None else [c for c in symbols.columns if c not in ("file_id", "line")]
    rows = found.select("file_id", "what", "line", "last", "code", "name", "text", "at", F.lit(None).cast("boolean").alias("_s") if symbols is None else F.lit(None).cast(symbols.schema.simpleString()).alias("_s"))
    if symbols is not None:
        null = lambda c: F.lit(None).cast(found.schema[c].dataType).alias(c)
        whole = F.struct(*[F.col(c) for c in symbols.columns]).cast(symbols.schema.simpleString())
        rows = rows.unionAll(symbols.select("file_id", F.lit("s").alias("what"), "line", *map(null, ("last", "code", "name", "text", "at")), whole.alias("_s")))
    place = F.when(F.col("what") == "d", 3).when(F.col("what") == "s", 2).when(F.col("what") == "f", 1).otherwise(0)
    order = Window.partitionBy("file_id").orderBy("line", "_place", "last", "at", "text", "name")
    upto, before = (order.rowsBetween(Window.unboundedPreceding, x) for x in (0, -1))
    comment = F.when(F.col("what") == "c", F.struct("line", "last", "code", "text"))
    docstring = F.when(F.col("what") == "d", F.struct("line", "last", "code", "text"))
    # the next docstring by lead: a frame that ends with the file would be gone through again for each row
    below = F.expr("lead(_d) ignore nulls over (partition by file_id order by line, _place, last, at, text, name)")
    placed = rows.withColumns({"_place": place, "_d": docstring}).withColumns({"_a": F.last(comment, True).over(before), "_b": below})
    a, b = F.col("_a"), F.col("_b")
    pick = F.when(b["code"] == F.col("code"), b).when((a["code"] == F.col("code")) & (a["last"] < F.col("line")), a)
    function = F.when(F.col("what") == "f", F.struct("line", "name", pick.alias("d")))
    if symbols is None:
        one = placed.where(F.col("what") == "f").select("file_id", function.alias("_f"), F.lead("line").over(order).alias("_next")).where(F.col("_next").isNull() | (F.col("_next") != F.col("_f.line")))
        return one.select("file_id", "_f.line", "_f.name", F.col("_f.d.line").alias("doc_line"), F.col("_f.d.last").alias("doc_last"), F.col("_f.d.text").alias("text"))
    there = placed.withColumn("_f", F.last(function, True).over(upto)).where(F.col("what") == "s")
    here = F.when(F.col("_f.line") == F.col("line"), F.col("_f.d"))
    return there.select("file_id", "line", *[F.col("_s")[c].alias(c) for c in extra], here["line"].alias("doc_line"), here["last"].alias("doc_last"), here["text"].alias("source_comment"))


def is_function(kind: Column, signature: Column, keyword: Column) -> Column:
    """Functions and methods by kind; where the kind is not known, by signature, and without one by the keyword."""
    by_signature = signature.rlike(r"(?:^|\s)(?:fn|func|def|function|sub|fun)\b|^[^={]*\w\s*\([^;]*\)") & ~signature.rlike(r"^\s*(?:(?:pub(?:\([^)]*\))?|export|default|static|public|private|protected|abstract|final)\s+)*(?:class|struct|enum|union|trait|interface|type|typedef|const|let|var|impl|mod|module|namespace|record)\b(?!.*(?:=>|\bfn\b|\bfunction\b|\bfunc\b\s*\(.*\)\s*$))")
    return kind.isin("Function", "Method") | (
        (kind.isNull() | (kind == "Unknown")) & F.when(signature.isNotNull(), by_signature).otherwise(F.coalesce(keyword.isin("fn", "func", "def", "function", "method", "fun", "sub"), F.lit(False)))
    )


@lru_cache(100_000)
def _describe(doc: str, name: str | None) -> str:
    return description(doc, name)


_SIGNATURE_NAME = re.compile(r"(?:\b(?:fn|func|def|function)\s+(?:\([^)]*\)\s*)?(?:self\.)?|\b)(\w+)\s*[(<]")


def function_symbols(symbols: DataFrame) -> DataFrame:
    """Functions and methods that were delivered with a comment."""
    wanted = symbols.where(F.col("doc_comment").isNotNull() & is_function(F.col("kind"), F.col("signature"), F.col("def_keyword")))
    return wanted.select("file_id", "line", "symbol_idx", "kind", "name", "signature", "doc_comment")


def with_description(pairs: DataFrame) -> DataFrame:
    """`pairs` (name, signature, doc_comment, source_comment, ...) with `description`: what the comment attached in the source
    tells; where none is attached, what the delivered comment tells. Rows that are told nothing are dropped. The name
    is that of the signature where it is null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = []
            for comment, doc, name, signature in zip(*(b.column(n).to_pylist() for n in ("source_comment", "doc_comment", "name", "signature")), strict=True):
                if name is None and signature and (m := _SIGNATURE_NAME.search(signature)):
                    name = m[1]
                told.append(_describe(doc if comment is None else comment, name))
            keep = pa.array([bool(t) for t in told], pa.bool_())
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(told, pa.string())], names=[*b.schema.names, "description"])
            yield out.filter(keep)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInArrow(run, f"{schema}, description string")


def documented_functions(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs (file_id, symbol_idx, name, kind, signature, description, doc_line, doc_last, from_source).

    Comments and functions of the source are extracted without regard to each other and attached by the as-of join;
    a symbol takes the comment attached to the function on its line, and that comment decides: a symbol is dropped if it
    tells nothing, whatever was delivered. Only for a function that the source does not show there, or shows without any
    comment (a file that is cut off, or changed since), the delivered comment is judged, and `from_source` is false. A
    symbol delivered without a comment is no pair, as what stands above it there may be about something else.
    Null comments, empty tables and symbols without a file give defined results: no pair, no rows, a pair without lines.
    """
    wanted = function_symbols(symbols)
    joined = attached_comments(newest_spans(extract_spans(files), files), wanted.where(F.col("file_id").isNotNull()))
    null = lambda c: F.lit(None).cast(joined.schema[c].dataType).alias(c)
    # however many symbols have no file, they are no group of their own
    joined = joined.unionByName(wanted.where(F.col("file_id").isNull()).select("*", *map(null, ("doc_line", "doc_last", "source_comment"))))
    # rows given twice fold where they are; of differing ones the largest holds, so that their order changes nothing
    row = F.max(F.struct("doc_comment", "line", "kind", "name", "signature", "doc_line", "doc_last", "source_comment")).alias("r")
    once = joined.groupBy("file_id", "symbol_idx").agg(row).select("file_id", "symbol_idx", "r.*")
    return with_description(once).select(
        "file_id", "symbol_idx", "name", "kind", "signature", "description", "doc_line", "doc_last", F.col("source_comment").isNotNull().alias("from_source")
    )
