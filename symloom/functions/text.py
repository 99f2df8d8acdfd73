"""Text scalars as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENT = r"[\p{L}_][\p{L}\p{N}_]*"
RUN = r"[\p{L}\p{N}_]+"


def ascii_lower(s: Column) -> Column:
    """Lower case of A to Z only."""
    return F.translate(s, string.ascii_uppercase, string.ascii_lowercase)


def identifiers(text: Column) -> Column:
    """Identifier runs of a text, in order; leading digits are skipped."""
    return F.regexp_extract_all(text, F.lit(IDENT), F.lit(0))


def word_at(line: Column, col: Column) -> Column:
    """The identifier that touches a character column; null if there is none or the column is beyond the end."""
    left = F.regexp_extract(F.substring(line, F.lit(1), col), r"[\p{L}\p{N}_]*\z", 0)
    right = F.regexp_extract(F.substring(line, col + 1, F.char_length(line)), rf"^(?:{RUN})?", 0)
    word = F.concat(left, right)
    return F.when((col <= F.char_length(line)) & (word != ""), word)


def qualifier_before(prefix: Column) -> Column:
    """The identifier before `::`, `->` or `.` at the end of a prefix; null if there is none."""
    q = F.regexp_extract(prefix, rf"({RUN}) *(?:::|->|\.)\z", 1)
    return F.when(q != "", q)


def word_prefix(line: Column, col: Column) -> Column:
    """What stands before the word that touches a column."""
    return F.regexp_replace(F.substring(line, F.lit(1), col), r"[\p{L}\p{N}_]+\z", "")


def ident_context(before: Column, after: Column, arrow_is_type: Column) -> Column:
    """What an identifier is, by what stands before and after it in its line: FieldAccess, FunctionCall, TypeRef or Plain.

    A member after a point or arrow is a field also where it is called. `arrow_is_type` tells languages in which `->`
    stands before a type.
    """
    b, a = F.rtrim(before), F.ltrim(after)
    field = b.endswith(".") & ~b.endswith("..") | b.endswith("->") & ~F.coalesce(arrow_is_type, F.lit(False))
    return (
        F.when(field, "FieldAccess").when(a.startswith("("), "FunctionCall")
        .when(b.rlike(r"(?:(?:^|[^\p{L}\p{N}_])(?:struct|enum|class|impl|new|extends|implements|interface|trait|union|dyn)|[^:]:|->)$"), "TypeRef").otherwise("Plain")
    )


def utf16_length(s: Column) -> Column:
    """Code units of UTF-16: characters, and one more for each beyond the basic plane."""
    return F.char_length(s) + F.regexp_count(s, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def fnv1a(s: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    data = F.encode(s, "UTF-8")
    byte = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")
    # the product of 32 and 25 bits fits in 64
    step = lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(0x01000193).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    fold = F.aggregate(F.sequence(F.lit(1), F.octet_length(s)), F.lit(0x811C9DC5).cast("long"), step)
    return F.when(F.octet_length(s) > 0, fold).when(s.isNotNull(), F.lit(0x811C9DC5).cast("long"))


def normalize_remote(url: Column) -> Column:
    """One spelling per remote: without outer blanks, final slashes and `.git`, `git@host:path` as https, lower case."""
    u = F.regexp_replace(F.regexp_replace(F.trim(url), r"/+\z", ""), r"\.git\z", "")
    return F.lower(F.regexp_replace(u, r"^git@([^:]*):", r"https://$1/"))


def trigrams(name: Column) -> Column:
    """Three-byte windows of the name in ASCII lower case, repeats kept; a shorter name has one entry with its length.

    Bytes are written in hexadecimal, so that windows may cut characters.
    """
    h = F.hex(F.encode(ascii_lower(name), "UTF-8"))
    n = F.octet_length(name)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(h, i * 2 - 1, F.lit(6)))
    return F.when(n >= 3, windows).when(name.isNotNull(), F.array(F.concat(F.lit("0000"), F.lpad(F.hex(n.cast("long")), 2, "0"))))


def parameters(signature: Column) -> Column:
    """Parameters between the first `(` and the last `)`, split at commas outside of brackets, trimmed, without empty ones."""
    inner = F.regexp_extract(signature, r"(?s)^[^(]*\((.*)\)", 1)
    # a comma at depth 0 becomes a line feed; the fold keeps depth and text, and moves piece by piece, not by character
    pieces = F.regexp_extract_all(inner, F.lit(r"[<(\[]|[>)\]]|,|[^<(\[>)\],]+"), F.lit(0))
    fold = F.aggregate(
        pieces, F.struct(F.lit(0).alias("d"), F.lit("").alias("t")),
        lambda a, p: F.struct(
            (a["d"] + F.when(p.isin("<", "(", "["), 1).when(p.isin(">", ")", "]"), -1).otherwise(0)).alias("d"),
            F.concat(a["t"], F.when((p == ",") & (a["d"] == 0), F.lit("\u0001")).otherwise(p)).alias("t"),
        ),
        lambda a: a["t"],
    )
    return F.filter(F.transform(F.split(fold, "\u0001"), lambda x: F.trim(x)), lambda x: x != "")
