"""Documentation, signature and call context of a position in a text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, takewhile

from symloom.functions.lexer import pattern

#: How a line of a comment begins, and what of it is text; a line that only closes a comment has none.
_MARKS = {
    "#": re.compile(r"#\s*(?P<text>.*)(?P<open>(?!))?"),
    "/": re.compile(r"(?://[/!]?|(?P<open>/\*\*)|\*(?!/))\s*(?P<text>.*?)\s*(?:\*/)?|\*/"),
}
_QUOTES = ('"""', "'''")
#: A signature runs on over at most as many lines.
SIGNATURE_LINES = 5


def doc_comment(lines: list[str], at: int, family: str) -> str | None:
    """The comment lines directly above a definition, in source order, without marks and outer blanks; in Python,
    failing that, the docstring below it. A line of another kind, also a blank one, ends the comment."""
    hashed = family in ("python", "ruby")
    told: list[str | None] = []
    for m in takewhile(bool, (_MARKS["#" if hashed else "/"].fullmatch(lines[k].strip()) for k in range(at - 1, -1, -1))):
        told.append(m["text"])
        if m["open"]:
            break
    text = "\n".join(t for t in reversed(told) if t or hashed and t is not None).strip("\n")
    return text or (_docstring(lines, at + 1) if family == "python" else None)


def _docstring(lines: list[str], at: int) -> str | None:
    quote = lines[at].strip()[:3] if at < len(lines) else ""
    if quote not in _QUOTES:
        return None
    first = lines[at].strip()[3:]
    body = [first] if quote in first else [first, *takewhile(lambda x: quote not in x, lines[at + 1 :])]
    if quote not in first and at + len(body) < len(lines):  # the line that closes it
        body.append(lines[at + len(body)])
    return "\n".join(x.strip() for x in body).partition(quote)[0].strip() or None


def signature(lines: list[str], at: int, family: str) -> str | None:
    """What a definition says before its body: in Python up to the colon, elsewhere up to the block or the end of the
    statement, and as long as parentheses are open, over the next lines. A type named after its body has the words of
    its typedef."""
    if at >= len(lines):
        return None
    head = lines[at].strip()
    if family == "python":
        return head.partition(":")[0].strip()
    if head.startswith("}"):
        name = head.strip("}; \t")
        opening = next((x for x in reversed(lines[:at]) if x.split()[:1] == ["typedef"]), None)
        if opening is not None or name:
            return f"{opening.partition('{')[0].strip()} {name}".strip() if opening is not None else name
    if "(" not in head:
        return re.match(r"[^{;]*", head)[0].strip() or None
    parts = [x.strip() for x in lines[at : at + SIGNATURE_LINES]]
    open_after = list(accumulate(x.count("(") - x.count(")") for x in parts))
    whole = " ".join(parts[: open_after.index(0) + 1] if 0 in open_after else parts)
    block = next((m.start() for m in re.finditer("{", whole) if whole.count("(", 0, m.start()) == whole.count(")", 0, m.start())), len(whole))
    return whole[:block].rstrip("{ ") or None


_CALLEE = re.compile(r"(?:(\w+) *(?:::|->|\.))?(\w+) *$")


def call_sites(line: str) -> Iterator[tuple[int, str, str | None, int]]:
    """(column, callee, qualifier, active parameter) from each column of a line on where the answer changes: after a
    parenthesis or a comma that belongs to a call. Up to the next one, or the end, the answer stays the same."""
    stack: list[list] = []  # callee, qualifier, commas; callee None where no name stands before the parenthesis
    for m in re.finditer(r"[(),]", line):
        if m[0] == "(":
            name = _CALLEE.search(line, 0, m.start())
            stack.append([name[2], name[1], 0] if name else [None, None, 0])
        elif not stack:
            continue
        elif m[0] == ")":
            stack.pop()
        else:
            stack[-1][2] += 1
        if stack and stack[-1][0] is not None:
            yield (m.end(), *stack[-1])


def occurrences(source: str, family: str) -> list[tuple[str, int]]:
    """(word, offset) of identifiers outside of comments and texts; keywords are left to the caller."""
    return [(m[0], m.start()) for m in pattern(family).finditer(source) if m.lastgroup == "word" and len(m[0].encode()) <= 65535]
