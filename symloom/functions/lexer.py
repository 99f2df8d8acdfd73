"""Language-aware lexer and symbol extraction: the only per-row Python of the corpus index.

A text is divided into tokens by one regular expression per language family; a stack of braces (or of Python's
indentation) gives scopes, and declaration patterns over the tokens of a statement give symbols. Nothing is built as a
syntax tree, so declarations that only types could tell apart are not found; see the README for the list.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache

from symloom.schema import DEF_KEYWORDS, KIND_OF_KEYWORD, NOISE_WORDS

_SLASH = r"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))"
_HASH = r"(?P<comment>#[^\n]*)"
_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*(?:"|(?=\n)|\Z)', r"'(?:[^'\\\n]|\\[\s\S])*(?:'|(?=\n)|\Z)"
_REGEX = r"(?:(?<=[=(,:\[!&|?{;])|(?<=[=(,:\[!&|?{;] )|(?<=return ))/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_WORD = r"(?P<word>[^\W\d]\w*)"
_REST = r"(?P<number>\d[\w.]*)|(?P<op>::|->|=>|:=|\.\.\.|[^\s\w])"
#: Texts and comments of each family.
PATTERNS = {
    "rust": rf"{_SLASH}|(?P<string>b?r#*\"[\s\S]*?\"#*|b?{_DQ}|b?'(?:[^'\\\n]|\\.[^'\n]*)')|'[^\W\d]\w*|{_WORD}|{_REST}",
    "clike": rf"{_SLASH}|(?P<directive>(?m:^[ \t]*#(?![ \t]*define)[^\n\\]*(?:\\\n[^\n\\]*)*))|(?P<string>{_DQ}|{_SQ})|{_WORD}|{_REST}",
    "go": rf"{_SLASH}|(?P<string>{_DQ}|`[^`]*`|{_SQ})|{_WORD}|{_REST}",
    "python": rf"{_HASH}|(?P<string>[rRbBuUfF]{{0,2}}(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|{_DQ}|{_SQ}))|{_WORD}|{_REST}",
    "jsts": rf"{_SLASH}|(?P<string>{_REGEX}|{_DQ}|{_SQ}|`(?:[^`\\]|\\[\s\S])*(?:`|\Z))|(?P<word>[^\W\d]\w*|\$\w*)|{_REST}",
    "javacsharp": rf"{_SLASH}|(?P<string>{_DQ}|{_SQ})|{_WORD}|{_REST}",
    "ruby": rf"{_HASH}|(?P<string>{_DQ}|{_SQ})|{_WORD}|{_REST}",
}
_CONTAINERS = {"struct", "class", "enum", "union", "trait", "interface", "impl", "mod", "module", "namespace", "record"}
_CONTROL = {"if", "for", "while", "switch", "catch", "return", "else", "do", "try", "match", "loop", "sizeof", "with", "function", "new", "throw", "case", "synchronized", "lock", "using", "foreach", "until", "unless", "elif", "except", "await", "yield", "assert", "not", "and", "or", "in", "is", "lambda", "def", "class", "defer", "go", "select", "range", "func", "fn", "let", "const", "var", "typeof", "delete"}


@cache
def pattern(family: str) -> re.Pattern:
    return re.compile(PATTERNS[family])


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    at: int


@dataclass(slots=True)
class Symbol:
    name: str
    kind: str
    at: int
    def_keyword: str
    visibility: str = "Unknown"
    container: str | None = None
    depth: int = 0
    end_at: int | None = None
    type_text: str | None = None


def tokens(source: str, family: str) -> list[Token]:
    """Words, numbers and operators; comments, texts and directives leave none."""
    out = []
    for m in pattern(family).finditer(source):
        kind = m.lastgroup
        if kind in ("word", "number", "op"):
            out.append(Token(kind, m[0], m.start()))
        elif kind == "string":
            out.append(Token(kind, "", m.start()))
    return out


def counters(source: str, family: str) -> dict[str, int]:
    """Bytes of comments and texts, and identifiers written in ASCII or not."""
    out = {"bytes": len(source.encode()), "comment_bytes": 0, "string_bytes": 0, "ident_ascii": 0, "ident_unicode": 0}
    for m in pattern(family).finditer(source):
        if m.lastgroup in ("comment", "string"):
            out[f"{m.lastgroup}_bytes"] += len(m[0].encode())
        elif m.lastgroup == "word":
            out["ident_ascii" if m[0].isascii() else "ident_unicode"] += 1
    return out


def _visibility(family: str, name: str, before: set[str], scope: Scope | None) -> str:
    if family == "rust":
        return "Public" if "pub" in before else "Unknown"
    if family == "go":
        return "Public" if name[:1].isupper() else "Private"
    if family == "python":
        return "Private" if name.startswith("_") else "Public"
    if family == "ruby":
        return "Private" if name.startswith("_") else "Unknown"
    if family == "jsts":
        return "Public" if "export" in before else "Unknown"
    if before & {"public"}:
        return "Public"
    if before & {"private"} or family == "clike" and "static" in before and scope is None:
        return "Private"
    if family == "clike" and scope is not None and scope.access:
        return scope.access
    return "Unknown"


@dataclass
class Scope:
    kind: str  # container, function, block
    name: str | None
    depth: int
    first: int  # symbols found before it was opened
    access: str | None = None


def symbols(source: str, family: str) -> list[Symbol]:
    """Symbols in the order of the source; of two at one position the one with a container holds, else the later."""
    found = _indented(source) if family == "python" else _ruby(source) if family == "ruby" else _braced(source, family)
    by: dict[int, Symbol] = {}
    for s in found:
        old = by.get(s.at)
        if s.name in NOISE_WORDS[family] or old is not None and old.container is not None and s.container is None:
            continue
        by[s.at] = s
    return [by[at] for at in sorted(by)]


def _braced(source: str, family: str) -> list[Symbol]:
    toks = tokens(source, family)
    out: list[Symbol] = []
    stack: list[Scope] = []
    statement: list[Token] = []
    round_ = 0
    k = 0
    while k < len(toks):
        t = toks[k]
        if t.text == "#" and family == "clike" and k + 2 < len(toks) and toks[k + 1].text == "define":
            out.append(Symbol(toks[k + 2].text, "Constant", toks[k + 2].at, "enum"))
            line_end = source.find("\n", t.at)
            while line_end > 0 and source[line_end - 1] == "\\":
                line_end = source.find("\n", line_end + 1)
            while k < len(toks) and (line_end < 0 or toks[k].at < line_end):
                k += 1
            continue
        if t.text in "([" and t.kind == "op":
            round_ += 1
        elif t.text in ")]" and t.kind == "op":
            round_ = max(0, round_ - 1)
        if t.text == "{" and t.kind == "op" and round_ == 0:
            scope = _open(statement, family, stack, out)
            stack.append(scope)
            statement = []
        elif t.text == "}" and t.kind == "op" and round_ == 0:
            _finish(statement, family, stack, out)
            if stack:
                closed = stack.pop()
                for s in out[closed.first :]:
                    if s.end_at is None and s.depth >= closed.depth:
                        s.end_at = t.at
                if closed.kind != "block" and closed.name is None and family == "clike":
                    statement = [Token("op", "}", t.at)]  # a declarator may follow
                    k += 1
                    continue
            statement = []
        elif t.text in (";", ",") and t.kind == "op" and round_ == 0 and (t.text == ";" or stack and stack[-1].kind == "container"):
            _finish(statement, family, stack, out)
            statement = []
        elif t.text == ":" and family == "clike" and stack and len(statement) == 1 and statement[0].text in ("public", "private", "protected"):
            stack[-1].access = {"public": "Public", "private": "Private", "protected": "Unknown"}[statement[0].text]
            statement = []
        elif statement and round_ == 0 and family in ("go", "jsts") and "\n" in source[statement[-1].at : t.at] and (statement[-1].kind != "op" or statement[-1].text in ")]}") and t.text not in (".", "=", "&&", "||", "?", ":", ")"):
            _finish(statement, family, stack, out)
            statement = [t]
        else:
            statement.append(t)
        k += 1
    _finish(statement, family, stack, out)
    return out


def _context(stack: list[Scope]) -> tuple[int, str | None]:
    return (stack[-1].depth, next((s.name for s in reversed(stack) if s.name), None)) if stack else (0, None)


def _head(statement: list[Token]) -> list[Token]:
    """The statement without attributes, annotations and template parameters in front."""
    k = 0
    while k < len(statement):
        if statement[k].text in ("#", "@") and k + 1 < len(statement):
            depth, j = 0, k + 1
            while j < len(statement):
                depth += (statement[j].text in "([") - (statement[j].text in ")]") if statement[j].kind == "op" else 0
                if depth <= 0 and (j + 1 >= len(statement) or statement[j + 1].text not in "([" or statement[j].text in ")]"):
                    break
                j += 1
            k = j + 1
        else:
            return statement[k:]
    return []


def _function_name(head: list[Token], family: str) -> Token | None:
    """The name before the first parenthesis of a declaration."""
    words = [t.text for t in head]
    if family == "rust":
        return head[words.index("fn") + 1] if "fn" in words and words.index("fn") + 1 < len(head) else None
    if family == "go":
        if "func" not in words[:1]:
            return None
        k = 1
        if k < len(head) and head[k].text == "(":
            while k < len(head) and head[k].text != ")":
                k += 1
            k += 1
        return head[k] if k < len(head) and head[k].kind == "word" else None
    if family == "jsts" and "function" in words:
        k = words.index("function") + 1
        k += k < len(head) and head[k].text == "*"
        return head[k] if k < len(head) and head[k].kind == "word" else None
    depth = 0
    for k, t in enumerate(head):
        if t.text == "<" and t.kind == "op":
            depth += 1
        elif t.text == ">" and t.kind == "op":
            depth = max(0, depth - 1)
        elif t.text == "=" and depth == 0:
            return None
        elif t.text == "(" and depth == 0:
            before = head[k - 1] if k else None
            if before is not None and before.kind == "word" and before.text not in _CONTROL and (k >= 2 or family in ("jsts", "javacsharp", "clike")):
                return before
            return None
    return None


def _open(statement: list[Token], family: str, stack: list[Scope], out: list[Symbol]) -> Scope:
    head = _head(statement)
    words = [t.text for t in head]
    depth, container = _context(stack)
    inside = stack[-1] if stack else None
    before = set(words)
    in_type = inside is not None and inside.kind == "container"
    if inside is None or inside.kind != "enumish":
        for k, w in enumerate(words):
            if w == "(" or w == "=":
                break
            if w in _CONTAINERS and family != "go" or family == "go" and w in ("struct", "interface"):
                if w == "impl":
                    names = [t.text for t in head[k + 1 :] if t.kind == "word" and t.text not in ("dyn", "mut", "const", "unsafe")]
                    at = words.index("for", k) if "for" in words[k:] else None
                    target = next((t.text for t in head[(at or k) + 1 :] if t.kind == "word" and (at is not None or not _in_angles(head, k + 1, t))), names[-1] if names else None)
                    return Scope("container", target, depth + 1, len(out))
                name = head[k - 1] if family == "go" and k else next((t for t in head[k + 1 :] if t.kind == "word" and t.text not in ("class", "struct", "final", "alignas")), None) if family != "go" else None
                if name is None or name.text in _CONTROL:
                    return Scope("container", None, depth + (family != "clike"), len(out), "Public" if w == "struct" else None)
                kind = KIND_OF_KEYWORD[w] if family != "go" else "Struct" if w == "struct" else "Interface"
                out.append(Symbol(name.text, kind, name.at, w if family != "go" else "type", _visibility(family, name.text, before, inside), container if in_type else None, depth if in_type else 0))
                access = {"class": "Private", "struct": "Public"}.get(w) if family == "clike" else None
                return Scope("container", name.text, depth + (w not in ("mod", "namespace") or family not in ("clike",)), len(out), access)
    name = _function_name(head, family)
    if name is None and family == "jsts" and ("=>" in words or "function" in words):
        at = next((k for k, w in enumerate(words) if w in ("const", "let", "var")), None)
        name = head[at + 1] if at is not None and at + 1 < len(head) and head[at + 1].kind == "word" else None
    if name is not None and not (inside is not None and inside.kind in ("function", "block") and family not in ("rust", "jsts", "go")):
        receiver = None
        if family == "go" and len(head) > 2 and head[1].text == "(":
            receiver = next((t.text for t in reversed(head[1 : words.index(")")]) if t.kind == "word"), None)
        method = in_type or receiver is not None
        own = container if in_type else receiver
        out.append(Symbol(name.text, "Method" if method else "Function", name.at, {"rust": "fn", "go": "func", "jsts": "function"}.get(family, "method" if family == "javacsharp" else "function"), _visibility(family, name.text, before, inside), own, 1 if own else 0))
        scope = Scope("function", name.text, depth + 1, len(out))
        _parameters(head, name, family, scope, out)
        return scope
    _locals(head, family, stack, out)
    return Scope("block", None, depth + (family in ("clike", "rust") and bool(stack)), len(out))


def _in_angles(head: list[Token], start: int, token: Token) -> bool:
    depth = 0
    for t in head[start:]:
        if t is token:
            return depth > 0
        depth += (t.text == "<") - (t.text == ">")
    return False


def _parameters(head: list[Token], name: Token, family: str, scope: Scope, out: list[Symbol]) -> None:
    """Parameters as locals of their function; Go has no locals."""
    if family == "go":
        return
    start = next((k for k, t in enumerate(head) if t.at > name.at and t.text == "("), None)
    if start is None:
        return
    depth, piece, pieces = 0, [], []
    for t in head[start:]:
        depth += (t.text in "([<{") - (t.text in ")]>}") if t.kind == "op" else 0
        if depth == 0:
            break
        if t.text == "," and depth == 1:
            pieces.append(piece)
            piece = []
        elif not (t.text == "(" and depth == 1 and not piece):
            piece.append(t)
    pieces.append(piece)
    keyword = "parameter" if family in ("rust", "clike") else {"jsts": "function", "javacsharp": "class"}[family]
    for p in pieces:
        cut = next((k for k, t in enumerate(p) if t.text in ("=", ":")), len(p))
        words = [t for t in p[:cut] if t.kind == "word" and t.text not in ("mut", "ref", "const", "final", "this", "self", "void", "public", "private", "readonly")]
        if not words:
            continue
        pick = words[-1] if family in ("clike", "javacsharp") else words[0]
        if family in ("clike", "javacsharp") and len(words) < 2:
            continue
        kind = p[: p.index(pick)] if family in ("clike", "javacsharp") else p[cut + 1 :]
        out.append(Symbol(pick.text, "Variable", pick.at, keyword, "Unknown", scope.name, scope.depth, None, " ".join(t.text for t in kind) or None))


def _locals(head: list[Token], family: str, stack: list[Scope], out: list[Symbol]) -> None:
    """Names that a statement in a function declares."""
    if not stack or stack[-1].kind == "container" or family == "go" or not any(s.kind == "function" for s in stack):
        return
    words = [t.text for t in head]
    depth, container = _context(stack)
    keyword = {"rust": "variable", "clike": "variable", "jsts": "function", "javacsharp": "class"}[family]

    def add(t: Token, kind: str | None = None) -> None:
        out.append(Symbol(t.text, "Variable", t.at, keyword, "Unknown", container, depth, None, kind))

    if family == "rust":
        for k, w in enumerate(words):
            if w in ("let", "for"):
                for t in head[k + 1 :]:
                    if t.text in ("=", ":", "in", ";"):
                        break
                    if t.kind == "word" and t.text not in ("mut", "ref", "Some", "Ok", "Err", "None", "box", "_") and not t.text[0].isupper():
                        add(t)
    elif family == "jsts":
        for k, w in enumerate(words):
            if w in ("const", "let", "var"):
                for t in head[k + 1 :]:
                    if t.text in ("=", ":", "of", "in", ";"):
                        break
                    if t.kind == "word":
                        add(t)
    else:
        start = words.index("(") + 1 if words[:1] in (["for"], ["try"], ["catch"], ["foreach"]) and "(" in words else 0
        part = head[start:]
        stop = next((k for k, t in enumerate(part) if t.text in ("=", ";", ":", ")", "[")), len(part))
        names = [t for t in part[:stop] if t.kind == "word"]
        shape_ok = all(t.kind == "word" or t.text in ("*", "&", "<", ">", ",", "::", ".", "[", "]", "?") for t in part[:stop])
        if len(names) >= 2 and shape_ok and not set(t.text for t in names) & (_CONTROL - {"const", "var"}) and part[stop - 1].kind == "word":
            add(names[-1], " ".join(t.text for t in part[: stop - 1]))
            if stop < len(part) and part[stop].text == "=":
                depth_ = 0
                for k in range(stop, len(part)):
                    depth_ += (part[k].text in "([{") - (part[k].text in ")]}") if part[k].kind == "op" else 0
                    if part[k].text == "," and depth_ == 0 and k + 1 < len(part) and part[k + 1].kind == "word":
                        add(part[k + 1])


def _finish(statement: list[Token], family: str, stack: list[Scope], out: list[Symbol]) -> None:
    """Declarations that end without a block."""
    head = _head(statement)
    if not head:
        return
    words = [t.text for t in head]
    depth, container = _context(stack)
    inside = stack[-1] if stack else None
    before = set(words)
    vis = lambda t: _visibility(family, t.text, before, inside)
    if words[0] == "}" and family == "clike":
        for t in head:
            if t.kind == "word":
                out.append(Symbol(t.text, "TypeAlias", t.at, "typedef", "Unknown"))
                return
        return
    if inside is not None and inside.kind == "container":
        name = _function_name(head, family)
        if name is not None and (family != "clike" or len(head) > 2):
            out.append(Symbol(name.text, "Method", name.at, {"rust": "fn", "jsts": "function"}.get(family, "method" if family == "javacsharp" else "function"), vis(name), container, depth))
            return
        cut = next((k for k, t in enumerate(head) if t.text in ("=", ":", "(", "{")), len(head))
        named = [t for t in head[:cut] if t.kind == "word" and t.text not in ("pub", "static", "const", "readonly", "public", "private", "protected", "final", "mut", "let", "var", "crate", "unsigned", "signed")]
        if not named:
            return
        single = len(named) == 1 and ":" not in words[: cut + 1]
        pick = named[0] if family in ("rust", "go", "jsts") else named[-1]
        kind, keyword = ("Constant", "enum") if single and family in ("rust", "clike", "javacsharp", "jsts") and family != "go" else ("Variable", "field")
        out.append(Symbol(pick.text, kind, pick.at, keyword, vis(pick), container, depth, None, None if kind == "Constant" else " ".join(t.text for t in head if t is not pick and t.kind == "word") or None))
        return
    if inside is not None and any(s.kind == "function" for s in stack):
        _locals(head, family, stack, out)
        return
    if family == "clike" and "typedef" in before:
        star = next((k for k, t in enumerate(head) if t.text == "(" and k + 1 < len(head) and head[k + 1].text == "*"), None)
        name = next((t for t in head[star + 1 :] if t.kind == "word"), None) if star is not None else next((t for t in reversed(head) if t.kind == "word"), None)
        if name is not None:
            out.append(Symbol(name.text, "TypeAlias", name.at, "typedef", "Unknown"))
        return
    for k, w in enumerate(words):
        if w in DEF_KEYWORDS[family] and k + 1 < len(head):
            name = next((t for t in head[k + 1 :] if t.kind == "word" and t.text not in NOISE_WORDS[family]), None)
            if name is None or family == "clike" and (len([t for t in head if t.kind == "word"]) > k + 2):
                break
            kind = "Constant" if family == "jsts" and w == "const" else KIND_OF_KEYWORD[w]
            out.append(Symbol(name.text, kind, name.at, w, vis(name)))
            return
    if family == "clike" and "(" not in words and "extern" not in before and words[0] not in ("using", "return", "namespace"):
        cut = next((k for k, t in enumerate(head) if t.text in ("=", "[")), len(head))
        named = [t for t in head[:cut] if t.kind == "word"]
        if len(named) >= 2:
            out.append(Symbol(named[-1].text, "Variable", named[-1].at, "variable", vis(named[-1])))


def _indented(source: str) -> list[Symbol]:
    """Python: scopes by indentation of logical lines."""
    out: list[Symbol] = []
    stack: list[tuple[int, str, str, int]] = []  # indent, kind, name, first symbol
    toks = tokens(source, "python")
    breaks = [m.end() for m in re.finditer(r"\n", source)]
    line_of = lambda at: bisect_right(breaks, at)
    logical: list[list[Token]] = []
    depth = 0
    last = -1
    for t in toks:
        line = line_of(t.at)
        if line != last and depth == 0:
            logical.append([])
        logical[-1].append(t)
        last = line
        if t.kind == "op":
            depth = max(0, depth + (t.text in "([{") - (t.text in ")]}"))
        if t.kind == "string":
            last = max(last, line)
    for ls in logical:
        start = breaks[line_of(ls[0].at) - 1] if line_of(ls[0].at) else 0
        indent = ls[0].at - start
        while stack and indent <= stack[-1][0]:
            _, _, _, first = stack.pop()
            for s in out[first:]:
                s.end_at = s.end_at if s.end_at is not None else max(0, ls[0].at - indent - 1)
        words = [t.text for t in ls]
        k = 1 if words[0] == "async" else 0
        in_class = bool(stack) and stack[-1][1] == "class"
        fn = next((s for s in reversed(stack) if s[1] == "def"), None)
        if len(ls) > k + 1 and words[k] in ("def", "class"):
            name = ls[k + 1]
            kind = "Class" if words[k] == "class" else "Method" if in_class else "Function"
            out.append(Symbol(name.text, kind, name.at, words[k], _visibility("python", name.text, set(), None), stack[-1][2] if in_class else None, 1 if in_class else 0))
            stack.append((indent, words[k], name.text, len(out)))
            if words[k] == "def":
                level, expect = 0, True
                for t in ls[k + 2 :]:
                    if t.kind == "op":
                        level += (t.text in "([{") - (t.text in ")]}")
                        if level == 0:
                            break
                        expect = t.text in "(,*" and level == 1 or expect and t.text == "*"
                    elif t.kind == "word" and expect and level == 1:
                        expect = False
                        if t.text not in ("self", "cls"):
                            out.append(Symbol(t.text, "Variable", t.at, "def", "Public", name.text, len(stack)))
            continue
        if len(ls) > 1 and (ls[0].kind == "word" and "=" in words or words[0] == "for"):
            if words[0] == "for":
                targets = ls[1 : words.index("in")] if "in" in words else []
            else:
                cut = words.index("=")
                targets = ls[:cut]
                if ":" in words[:cut]:
                    targets = targets[: words.index(":")]
                if any(t.text in ".([" or t.text in _CONTROL for t in targets) or not all(t.kind == "word" or t.text in (",", "*") for t in targets):
                    targets = []
            for t in targets:
                if t.kind != "word" or t.text in ("in", "for"):
                    continue
                if fn is not None:
                    out.append(Symbol(t.text, "Variable", t.at, "def", "Public", fn[2], len(stack)))
                elif not stack and words[0] != "for":
                    out.append(Symbol(t.text, "Constant" if t.text.isupper() else "Variable", t.at, "def", _visibility("python", t.text, set(), None)))
    for s in out:
        if s.end_at is None and s.depth > 0:
            s.end_at = len(source)
    return out


def _ruby(source: str) -> list[Symbol]:
    out: list[Symbol] = []
    stack: list[tuple[str, str | None]] = []
    toks = tokens(source, "ruby")
    openers = {"def", "class", "module", "do", "begin", "case"}
    for k, t in enumerate(toks):
        if t.kind != "word" or k and toks[k - 1].text == ".":
            continue
        first = k == 0 or "\n" in source[toks[k - 1].at : t.at] or toks[k - 1].text in (";", "=")
        if t.text in ("class", "module", "def") and k + 1 < len(toks) and first:
            at = k + 1
            singleton = t.text == "def" and at + 2 < len(toks) and toks[at + 1].text == "."
            at += 2 if singleton else 0
            name = toks[at]
            holder = next((n for w, n in reversed(stack) if w in ("class", "module")), None)
            if name.kind == "word":
                kind = {"class": "Class", "module": "Module"}.get(t.text, "Method" if holder else "Function")
                out.append(Symbol(name.text, kind, name.at, t.text, _visibility("ruby", name.text, set(), None), holder, 1 if holder else 0))
            stack.append((t.text, name.text))
        elif t.text in openers - {"def", "class", "module"} or t.text in ("if", "unless", "while", "until", "for") and first:
            loop = stack and stack[-1][0] in ("while", "until", "for") and t.text == "do" and "\n" not in source[toks[k - 1].at : t.at]
            if not loop:
                stack.append((t.text, None))
        elif t.text == "end" and stack:
            stack.pop()
        elif first and t.text[:1].isupper() and k + 1 < len(toks) and toks[k + 1].text == "=":
            holder = next((n for w, n in reversed(stack) if w in ("class", "module")), None)
            out.append(Symbol(t.text, "Constant", t.at, "const", "Unknown", holder, 1 if holder else 0))
    return out
