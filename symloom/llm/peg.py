"""Packrat parsing-expression grammars over token classes, memoised by position and by content.

A source text becomes a string with one character per token. Every rule that is bounded by brackets (a parenthesis, a
block, an indented suite, a `def ... end`) is a group: from the innermost outwards, each group is replaced by one
character that stands for the set of nonterminals which its content matches from end to end.

Within a content, rules run as a packrat parser: a table by (rule, position) holds what each rule matched, choices look
at the next token to leave out alternatives that can't begin with it, and rules that come out short are compiled to
possessive regular expressions, which have exactly the meaning of ordered choice and greedy repetition. Beyond
that, contents and statements repeat from file to file, so what a nonterminal did with a content, and a statement with
its tokens, is kept for the files that follow.

A text that fails this way is parsed again by positions alone, without anything kept or compiled, and that parse
decides; it also gives the furthest failure.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

BAD = "\ufffd"  # a token or a group that no rule accepts
CONFLICT = "\ufffc"  # a merge conflict marker
_LEX = re.compile(r"\s*(?:(?P<lit>'[^']+')|<(?P<group>\w+)>|(?P<name>[A-Za-z_]\w*)(?P<rule>\s*<-)?|(?P<op>[/*+?!&()]))")
MEMO_ENTRIES = 300_000
MEMO_LENGTH = 400
LEAF = 1500


class TooLong(Exception):
    """The rule would make too long an expression."""


@dataclass
class Bracket:
    """Opening and closing token, the nonterminals that its content may match, and whether line ends count inside."""

    open: str
    close: str
    kinds: list[str]
    lines: bool = False


@dataclass
class Grammar:
    rules: str
    brackets: list[Bracket]
    classes: dict[str, list[str]] = field(default_factory=dict)
    top: str = "Top"
    newline: str | None = None  # the token that ends a line, where that counts
    statements: tuple[str, ...] = ()  # rules that match one statement
    ends: tuple[str, ...] = (";",)  # tokens that end one; a group in braces may do so too

    def __post_init__(self) -> None:
        self.trees = parse_rules(self.rules)
        self.chars: dict[str, str] = {}
        self.named: dict[str, set[str]] = {}
        code = iter(range(0x4E00, 0x9FFF))
        for name in ("id", "num", "str"):
            self.named[name] = {chr(next(code))}
        for name, tokens in self.classes.items():
            c = chr(next(code))
            self.named[name] = {c}
            self.chars.update({t: c for t in tokens})
        literals = {x[1] for tree in self.trees.values() for x in walk(tree) if x[0] == "lit"}
        for t in sorted(literals | {t for b in self.brackets for t in (b.open, b.close)} | ({self.newline} if self.newline else set())):
            if t not in self.chars:
                self.chars[t] = chr(next(code))
        if self.newline:
            self.named["nl"] = {self.chars[self.newline]}
        (self.id,), (self.num,), (self.str,) = (self.named[n] for n in ("id", "num", "str"))
        self.named["anyword"] = {self.id, *(c for t, c in self.chars.items() if t[0].isalpha() or t[0] == "_")}
        group, self.kind_chars, self.by_open = 0xE000, {}, {}
        for b in self.brackets:
            self.by_open[self.chars[b.open]] = (b, self.chars[b.close], group)
            for bits in range(1 << len(b.kinds)):
                for i, kind in enumerate(b.kinds):
                    if bits >> i & 1:
                        self.kind_chars.setdefault(kind, set()).add(chr(group + bits))
            group += 1 << len(b.kinds)
        assert group < 0xF8FF
        opens, closes = "".join(self.by_open), "".join({c for _, c, _ in self.by_open.values()})
        solid = {c for c in self.chars.values() if c not in opens + closes}
        self.named["any"] = {self.id, self.num, self.str, *solid, *map(chr, range(0xE000, group))}
        self.innermost = re.compile(f"[{opens}][^{opens}{closes}]*[{closes}]")
        self.opens, self.closes = opens, closes
        blocks = {chr(g + k) for b, _, g in self.by_open.values() if b.open not in ("(", "[") for k in range(1 << len(b.kinds))}
        self.statement_end = re.compile(charset({self.chars[t] for t in self.ends} | blocks))
        self._regex: dict[str, str] = {}
        self._first: dict[str, tuple[set[str], bool]] = {}
        self.memo: dict[str, str] = {}
        self.fast, self.slow = Packrat(self, LEAF), Packrat(self, 0)

    def set_of(self, node: tuple) -> set[str] | None:
        what, name = node[0], node[1]
        if what == "lit":
            return {self.chars[name]}
        if what == "group":
            return self.kind_chars[name]
        if what == "name" and name in self.named:
            return self.named[name]
        return None

    def regex(self, node: tuple, limit: int) -> str:
        """The possessive expression of a tree, or TooLong."""
        if (chars := self.set_of(node)) is not None:
            return charset(chars)
        match node[0]:
            case "name":
                if node[1] not in self._regex:
                    self._regex[node[1]] = ""  # stands for TooLong, also in a cycle
                    self._regex[node[1]] = "(?>" + self.regex(self.trees[node[1]], limit) + ")"
                out = self._regex[node[1]]
            case "seq":
                out = "".join(self.regex(x, limit) for x in node[1])
            case "choice":
                sets = list(map(self.set_of, node[1]))
                out = charset(set().union(*sets)) if None not in sets else "(?>" + "|".join(self.regex(x, limit) for x in node[1]) + ")"
            case "rep":
                out = f"(?:{self.regex(node[1], limit)}){node[2]}+"
            case kind:
                out = f"(?{'!' if kind == 'not' else '='}{self.regex(node[1], limit)})"
        if not out and node[0] == "name" or len(out) > limit:
            raise TooLong
        return out

    def first(self, node: tuple) -> tuple[set[str], bool]:
        """The characters a match may begin with, and whether it may be empty."""
        if (chars := self.set_of(node)) is not None:
            return chars, False
        match node[0]:
            case "name":
                if node[1] not in self._first:
                    self._first[node[1]] = self.first(self.trees[node[1]])
                return self._first[node[1]]
            case "seq":
                out: set[str] = set()
                for x in node[1]:
                    chars, empty = self.first(x)
                    out |= chars
                    if not empty:
                        return out, False
                return out, True
            case "choice":
                parts = [self.first(x) for x in node[1]]
                return set().union(*(c for c, _ in parts)), any(e for _, e in parts)
            case "rep":
                chars, empty = self.first(node[1])
                return chars, empty or node[2] != "+"
            case _:
                return set(), True

    def group(self, text: str, parser: Packrat) -> str:
        """The character of an innermost group."""
        bracket, close, base = self.by_open[text[0]]
        if text[-1] != close:
            return BAD
        content = text[1:-1]
        if self.newline and not bracket.lines:
            content = content.replace(self.chars[self.newline], "")
        bits = 0
        for i, kind in enumerate(bracket.kinds):
            if parser.matches(kind, content):
                bits |= 1 << i
        return chr(base + bits) if bits else BAD

    def _group(self, m: re.Match) -> str:
        text = m[0]
        found = self.memo.get(text)
        if found is None:
            found = self.group(text, self.fast)
            if len(text) <= MEMO_LENGTH:
                if len(self.memo) >= MEMO_ENTRIES:
                    self.memo.clear()
                self.memo[text] = found
        return found

    def accepts(self, tokens: str) -> bool:
        """Whether the whole input is consumed. False may come from what was kept; furthest() decides."""
        n = 1
        while n:
            if BAD in tokens or CONFLICT in tokens:
                return False
            tokens, n = self.innermost.subn(self._group, tokens)
        return BAD not in tokens and self.fast.matches(self.top, tokens)

    def furthest(self, tokens: str) -> int:
        """The token (its number) at which parsing could go no further; the number of tokens, at the end of the text;
        -1 if the whole input is consumed."""
        frames: list[tuple[str, list[tuple[str, int]]]] = [("", [])]
        inside: dict[int, tuple[Bracket, list[tuple[str, int]]]] = {}
        for at, c in enumerate(tokens):
            if c in (BAD, CONFLICT):
                return at
            if c in self.opens:
                frames.append((c, [(c, at)]))
            elif c in self.closes:
                if len(frames) == 1 or self.by_open[frames[-1][0]][1] != c:
                    return at
                opener, items = frames.pop()
                items = [x for x in items[1:] if self.by_open[opener][0].lines or not self.newline or x[0] != self.chars[self.newline]]
                g = self.group(opener + "".join(x[0] for x in items) + c, self.slow)
                if g == BAD:
                    return self._stop(self.by_open[opener][0].kinds, items, at, inside)
                inside[at] = (self.by_open[opener][0], items)
                frames[-1][1].append((g, at))
            else:
                frames[-1][1].append((c, at))
        if len(frames) > 1:
            return len(tokens)
        return self._stop([self.top], frames[0][1], len(tokens), inside)

    def _stop(self, kinds: Iterable[str], items: list[tuple[str, int]], end: int, inside: dict) -> int:
        text = "".join(x[0] for x in items)
        stops = []
        for kind in kinds:
            if self.slow.matches(kind, text):
                return -1
            stops.append(self.slow.far)
        at = max(stops)
        if at >= len(items):
            return end
        token = items[at][1]
        if token in inside:  # a group of another kind than is wanted here: where it departs from that
            bracket, held = inside[token]
            text = "".join(x[0] for x in held)
            wanted = [k for k in bracket.kinds if not self.slow.matches(k, text)]
            if wanted and held:
                return self._stop(wanted, held, token, inside)
        return token


class Packrat:
    """Rules as closures over one text; `leaf` is the length up to which a rule becomes a regular expression."""

    def __init__(self, grammar: Grammar, leaf: int):
        self.grammar, self.leaf = grammar, leaf
        self.text, self.far = "\0", 0
        self.tables: list[dict[int, int]] = []
        self.rules: dict[str, Callable[[int], int]] = {}
        self.statements: dict[str, int] = {}

    def matches(self, rule: str, content: str) -> bool:
        """Whether the rule takes the whole content."""
        f = self.rule(rule)
        self.text, self.far = content + "\0", 0
        for t in self.tables:
            t.clear()
        end = f(0)
        if end == len(content):
            return True
        self.far = max(self.far, end)
        return False

    def rule(self, name: str) -> Callable[[int], int]:
        if name not in self.rules:
            if self.leaf:
                try:
                    pattern = self.grammar.regex(("name", name), self.leaf)
                except TooLong:
                    pattern = None
                if pattern is not None:
                    self.rules[name] = self.expression(re.compile(pattern).match)
                    return self.rules[name]
            self.rules[name] = lambda p: self.rules[name](p)  # while it is being built
            self.rules[name] = self.kept(self.build(self.grammar.trees[name]))
            if self.leaf and name in self.grammar.statements:
                self.rules[name] = self.shared(self.rules[name])
        return self.rules[name]

    def expression(self, match: Callable) -> Callable[[int], int]:
        def run(p: int) -> int:
            m = match(self.text, p)
            return m.end() if m else -1

        return run

    def kept(self, f: Callable[[int], int]) -> Callable[[int], int]:
        table: dict[int, int] = {}
        self.tables.append(table)

        def run(p: int) -> int:
            e = table.get(p)
            if e is None:
                e = table[p] = f(p)
            return e

        return run

    def shared(self, f: Callable[[int], int]) -> Callable[[int], int]:
        """A statement's length by its tokens up to its end and one more, whichever text they stand in."""
        find, kept = self.grammar.statement_end.search, self.statements

        def run(p: int) -> int:
            m = find(self.text, p)
            if m is None:
                return f(p)
            q = m.end()
            key = self.text[p : q + 1]
            n = kept.get(key)
            if n is None:
                e = f(p)
                if 0 <= e <= q and q - p <= MEMO_LENGTH:
                    if len(kept) >= MEMO_ENTRIES:
                        kept.clear()
                    kept[key] = e - p
                return e
            return p + n

        return run

    def build(self, node: tuple) -> Callable[[int], int]:
        chars = self.grammar.set_of(node)
        if chars is not None:
            return self.terminal(frozenset(chars))
        match node[0]:
            case "name":
                name = node[1]
                if name in self.rules:
                    return self.rules[name]
                return self.rule(name)
            case "seq":
                parts = [self.build(x) for x in node[1]]

                def seq(p: int) -> int:
                    for f in parts:
                        p = f(p)
                        if p < 0:
                            return -1
                    return p

                return seq
            case "choice":
                options = [(self.build(x), *self.grammar.first(x)) for x in node[1]]
                always = tuple(f for f, _, empty in options if empty)
                table = {c: tuple(f for f, chars, empty in options if empty or c in chars) for c in set().union(*(chars for _, chars, _ in options))}

                def choice(p: int) -> int:
                    for f in table.get(self.text[p], always):
                        e = f(p)
                        if e >= 0:
                            return e
                    if p > self.far:
                        self.far = p
                    return -1

                return choice
            case "rep":
                f, (chars, empty), how = self.build(node[1]), self.grammar.first(node[1]), node[2]

                def rep(p: int) -> int:
                    n = 0
                    while (empty or self.text[p] in chars) and (e := f(p)) >= 0:
                        n += 1
                        if e == p:
                            break
                        p = e
                        if how == "?":
                            return p
                    if p > self.far:
                        self.far = p
                    return -1 if how == "+" and not n else p

                return rep
            case kind:
                f, wanted = self.build(node[1]), kind == "and"

                def look(p: int) -> int:
                    far = self.far
                    e = f(p)
                    self.far = far
                    return p if (e >= 0) == wanted else -1

                return look

    def terminal(self, chars: frozenset[str]) -> Callable[[int], int]:
        def run(p: int) -> int:
            if self.text[p] in chars:
                return p + 1
            if p > self.far:
                self.far = p
            return -1

        return run


def charset(chars: set[str]) -> str:
    if len(chars) == 1:
        return next(iter(chars))
    codes, out, k = sorted(map(ord, chars)), [], 0
    while k < len(codes):
        j = k
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(chr(codes[k]) if j == k else f"{chr(codes[k])}-{chr(codes[j])}")
        k = j + 1
    return "[" + "".join(out) + "]"


def walk(node: tuple) -> Iterable[tuple]:
    yield node
    if node[0] in ("seq", "choice"):
        for x in node[1]:
            yield from walk(x)
    elif node[0] in ("rep", "not", "and"):
        yield from walk(node[1])


def parse_rules(text: str) -> dict[str, tuple]:
    """The trees of rules written as `Name <- expression`."""
    text = re.sub(r"(?m)^\s*#.*", "", text)
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"grammar: {text[at : at + 60]!r}")
        at = m.end()
        kind = m.lastgroup if m.lastgroup != "rule" else "def"
        tokens.append(("def", m["name"]) if m["rule"] else (kind, m[kind].strip("'") if kind == "lit" else m[kind]))
    pos = 0

    def peek() -> tuple:
        return tokens[pos] if pos < len(tokens) else ("end", "")

    def choice() -> tuple:
        nonlocal pos
        parts = [sequence()]
        while peek() == ("op", "/"):
            pos += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("choice", parts)

    def sequence() -> tuple:
        parts = []
        while peek()[0] not in ("end", "def") and peek() not in (("op", "/"), ("op", ")")):
            parts.append(item())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def item() -> tuple:
        nonlocal pos
        kind, value = peek()
        pos += 1
        if (kind, value) in (("op", "!"), ("op", "&")):
            return ("not" if value == "!" else "and", item())
        if (kind, value) == ("op", "("):
            node = choice()
            assert peek() == ("op", ")"), tokens[pos - 5 : pos + 5]
            pos += 1
        else:
            node = (kind, value)
        while peek() in (("op", "*"), ("op", "+"), ("op", "?")):
            node = ("rep", node, peek()[1])
            pos += 1
        return node

    rules = {}
    while pos < len(tokens):
        kind, name = tokens[pos]
        assert kind == "def", tokens[pos : pos + 5]
        pos += 1
        rules[name] = choice()
    return rules
