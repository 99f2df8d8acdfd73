"""Source files that do not parse, by language."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm import grammars
from symloom.llm.peg import BAD, CONFLICT, Grammar
from symloom.sources.spread import spread

_MARK = r"(?m:^(?:<{7}(?=[ \r\n])|={7}(?=[ \r\n]|\Z)|>{7}(?=[ \r\n])|\|{7}(?=[ \r\n])).*)"
_SLASH = r"//(?:[^\n\r\\]|\\(?:\r\n|[\s\S]))*|/\*[\s\S]*?\*/|/\*"
_NAME = r"[^\W\d]\w*"
_NUM = r"\.?\d(?:[eEpP][+-]\d|'(?=\w)|[\w.])*"
_OPS = r"<<=|>>=|\.\.\.|->|<=|>=|==|!=|[-+*/%&|^]=|<<"
_MORE = rf"{_OPS}|&&|\|\||::|=>|\.\."
_STEP = rf"\+\+|--|>>>=|{_MORE}"
_DQ = r'"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"'
_SQ = r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"
_JS_STRING = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`(?:[^`\\]|\\[\s\S])*`)*\})*`"
_JS_REGEX = r"(?:(?<=[=(,:\[!&|?{;+~\n])|(?<=[=(,:\[!&|?{;+~>] )|(?<=return )|(?<=typeof )|(?<=case ))/(?![*/])(?:[^/\\\[\n\r]|\\.|\[(?:[^\]\\\n\r]|\\.)*\])+/[a-z]*"
_END = r"|\S"

#: How each language writes its comments and texts, and then its words, numbers and operators.
LITERALS = {
    "c": rf"{_MARK}|{_SLASH}|R\"\([\s\S]*?\)\"|(?:u8|[uUL])?{_DQ}|(?:u8|[uUL])?'(?:[^'\\\n\r]|\\.[^'\n\r]*)+'",
    "java": rf'{_MARK}|{_SLASH}|"""[\s\S]*?"""|(?:@\$?|\$@)"(?:[^"]|"")*"|\$"(?:[^"\\\n\r]|\\.)*"|{_DQ}|{_SQ}',
    "javascript": rf"{_MARK}|{_SLASH}|\A#!.*|\r\n?|\n|{_DQ}|{_SQ}|{_JS_STRING}|{_JS_REGEX}",
    "go": rf"{_MARK}|{_SLASH}|\r\n?|\n|{_DQ}|`[^`]*`|{_SQ}",
    "rust": rf"{_MARK}|//[^\n\r]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*))*\*/)*\*/|/\*|\A#!(?!\[).*|(?:b|c|br|cr|r)?(?:r#\"[\s\S]*?\"#|r##\"[\s\S]*?\"##|r###\"[\s\S]*?\"###)|b?r\"[^\"]*\"|#\"[\s\S]*?\"#|[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n\r]|\\(?:u\{{[^}}']*\}}|x\w\w|.))'",
    "python": rf"{_MARK}|#[^\n\r]*|\\(?:\r\n?|\n)|(?:\r\n?|\n)[ \t\f]*|[rRbBuUfF]{{0,2}}(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|{_DQ}|{_SQ})",
    "ruby": rf"{_MARK}|(?ms:^=begin\b.*?^=end\b[^\n\r]*)|(?ms:^__END__$.*)|#[^\n\r]*|\\(?:\r\n?|\n)|\r\n?|\n|\"(?:[^\"\\#]|\\[\s\S]|#(?!\{{)|#\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*\"|'(?:[^'\\]|\\[\s\S])*'|`(?:[^`\\]|\\.)*`|%[wWiIqQr]?(?:\[[^\]]*\]|\((?:[^()]|\([^()]*\))*\)|\{{[^}}]*\}}|<[^>]*>|\|[^|]*\||![^!]*!)(?<=[\])}}>|!])|{_JS_REGEX.replace('(?<=return )', '(?<=when )|(?<=if )|(?<=unless )').replace('(?<=typeof )|(?<=case )', '(?<=and )')}",
}
_WORDS = {
    "c": rf"{_NAME}|{_NUM}|->\*|\.\*|<=>|{_STEP}{_END}",
    "java": rf'(?:@(?=interface\b)|@(?!interface\b)(?={_NAME}))|{_NAME}|{_NUM}|\?\.|\?\?=|\?\?|{_STEP}{_END}',
    "javascript": rf"[\w$]*(?<!\d)(?:[^\W\d]|\$)[\w$]*|{_NUM}|===|!==|\*\*=|\*\*|&&=|\|\|=|\?\.(?!\d)|\?\?=|\?\?|{_STEP}{_END}",
    "go": rf"{_NAME}|{_NUM}|&\^=|&\^|<-|:=|>>|{_STEP}{_END}",
    "rust": rf"'{_NAME}|(?:r#)?{_NAME}|\d(?:[\w]|[eE][+-](?=\d))*(?:\.(?![.\w])|\.\d(?:\w|(?<=[eE])[+-](?=\d))*)?|\.\.=|{_MORE}{_END}",
    "python": rf"{_NAME}|{_NUM}|//=|\*\*=|//|\*\*|:=|@=|>>|{_OPS}{_END}",
    "ruby": rf":\"(?:[^\"\\]|\\.)*\"|:(?<!::){_NAME}[?!=]?(?![=~>])|:(?<!::){_NAME}|{_NAME}[?!]?:(?!:)|@@?{_NAME}|\$(?:{_NAME}|\d+|[!@&~_;.,/\\*$?:\"<>])|{_NAME}|\d(?:[eE][+-](?=\d)|\w|\.(?=\d))*|===|=~|!~|\*\*=|\*\*|&&=|\|\|=|&\.|>>|<=>|{_MORE}{_END}",
}
LEXERS = {lang: f"{LITERALS[lang]}|{_WORDS[lang]}" for lang in LITERALS}
LEXERS["csharp"], LITERALS["csharp"] = LEXERS["java"], LITERALS["java"]
#: The language of each ending.
ENDINGS = {
    **dict.fromkeys(["c", "h", "cpp", "cc"], "c"), "rs": "rust", "go": "go", **dict.fromkeys(["py", "pyi"], "python"),
    **dict.fromkeys(["js", "ts", "mjs"], "javascript"), "java": "java", "cs": "csharp", "rb": "ruby",
}
GRAMMARS: dict[str, Callable[[], Grammar]] = {
    "c": grammars.c_family, "java": grammars.java, "csharp": grammars.csharp, "javascript": grammars.javascript,
    "go": grammars.go, "rust": grammars.rust, "python": grammars.python, "ruby": grammars.ruby,
}
KEPT_TOKENS = 400_000


class Classes(dict):
    """The class of each token, found once per spelling."""

    def __init__(self, language: str, grammar: Grammar):
        self.language, self.grammar = language, grammar
        super().__init__(grammar.chars)

    def __missing__(self, token: str) -> str:
        if len(self) > KEPT_TOKENS:
            self.clear()
            self.update(self.grammar.chars)
        c = self.of(token)
        if len(token) < 200:
            self[token] = c
        return c

    def of(self, token: str) -> str:
        g, first, lang = self.grammar, token[0], self.language
        if first in "<=>|" and re.match(_MARK, token):
            return CONFLICT
        if lang in ("c", "java", "csharp", "javascript", "go", "rust") and token[:2] in ("//", "/*"):
            return "" if token[1] == "/" or len(token) > 3 else BAD
        if first in "\r\n":
            return g.chars.get("\n", "")
        if lang in ("python", "ruby") and (first in "#\\" or token.startswith(("=begin", "__END__"))) or lang in ("javascript", "rust") and token.startswith("#!/"):
            return ""
        if lang == "python" and token.rstrip("\"'") != token and len(token) > 1 and re.match(r"[rRbBuUfF]{0,2}[\"']", token):
            return g.str
        if lang == "ruby" and len(token) > 1:
            if first == ":":
                return g.chars[":sym"]
            if token[-1] == ":" and first not in "\"'":
                return g.chars["label:"]
            if first in "@$":
                return g.chars["@var"]
            if first in "%/`":
                return g.str
        if lang == "rust" and first == "'" and (len(token) == 2 or token[-1] != "'"):
            return g.chars["'a"] if len(token) > 1 else BAD
        if len(token) > 1 and token[-1] in "\"'`#" and first not in "@":
            return g.str
        if len(token) > 1 and first == "/" and lang == "javascript":
            return g.str
        if len(token) > 1 and token[-1] == '"':
            return g.str
        if first.isdigit() or first == "." and len(token) > 1 and token[1].isdigit():
            return g.num if lang == "go" or lang == "rust" or re.fullmatch(r"0[xXbBoO][\w']*|[\d_.]*(?:[eE][+-]?\d+)?\w{0,3}|[\d'.]+\w*|0[xX][\w.']*[pP][+-]?\d+\w?", token) else BAD
        if first.isalpha() or first == "_" or first == "$" and lang in ("javascript", "java"):
            return g.id
        return BAD


_COMMENT_OR_TEXT = re.compile(LITERALS["c"])
_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(\w*)[ \t]*(.*)", re.S)
_DEFINED = re.compile(r"defined\s*(?:\(\s*(\w+)\s*\)|(\w+))")


@dataclass
class Fault:
    """A conflict marker or a directive that is wrong by itself, whatever branch is read."""

    line: int
    cause: str


@dataclass
class _Branch:
    """A branch of a conditional: its condition as (what, whether it must hold), the branches before it, the one around."""

    condition: tuple[str, bool] | None
    before: list[int]
    around: int | None
    conditional: int


def _condition(word: str, rest: str) -> tuple[str, bool] | None:
    """What a branch asks, so that conditionals that ask the same are answered alike; None for #else and for numbers."""
    rest, holds = " ".join(rest.replace("\\", " ").split()), not word.endswith("ndef")
    if word.endswith("def"):
        return f"defined {rest.split(' ')[0]}", holds
    while m := re.fullmatch(r"!\s*(\w+|\([^()]*\)|defined\s*\(\s*\w+\s*\)|defined\s+\w+)|\(([^()]*)\)", rest):
        rest, holds = (m[1] or m[2]).strip(), holds != bool(m[1])
    if m := _DEFINED.fullmatch(rest):
        return f"defined {m[1] or m[2]}", holds
    return (rest, holds) if word != "else" and not rest.isdigit() else None


def _readings(text: str) -> tuple[list[str], Fault | None]:
    """C without directives, read as often as its conditionals need for each branch to be read: the branches need not
    nest with the code. Each reading has as many lines as the text.

    A reading answers equal conditions alike, up to a #define or #undef of their names, and takes of each conditional
    the first branch not read yet that these answers allow; without any, a conditional without #else is left out.
    Directives inside of comments and literals are none. With a `Fault` there are no readings.
    """
    if "#" not in text:
        return [text], None
    inside: set[int] = set()  # starts of lines within literals
    conflicts: list[int] = []

    def plain(m: re.Match) -> str:
        t = m[0]
        if t[:2] == "//" or t[:2] == "/*" and len(t) > 2:
            return re.sub(r"[^\r\n]", " ", t)
        if t[0] in "<=>|":
            conflicts.append(m.start())
        elif "\n" in t or "\r" in t:
            inside.update(m.start() + x.end() for x in re.finditer(r"\r\n?|\n", t))
        return t

    blanked = _COMMENT_OR_TEXT.sub(plain, text)
    if conflicts:
        return [], Fault(len(re.findall(r"\r\n|\n|\r", text[: conflicts[0]])), "merge conflict")
    lines = re.split(r"(?<=\n)|(?<=\r)(?!\n)", blanked)
    branches: list[_Branch] = []
    events: dict[int, tuple[str, int | str]] = {}
    choices: list[list[int]] = []  # the branches of each conditional
    opened: list[tuple[int, bool]] = []  # conditional, and whether its #else was seen
    k = at = 0
    while k < len(lines):
        n, line = k, lines[k]
        m = _DIRECTIVE.match(line) if "#" in line and at not in inside else None
        at += len(line)
        if m:
            lines[n], rest = "\n", m[2]
            while line.rstrip("\r\n").endswith("\\") and k + 1 < len(lines):
                k += 1
                line, lines[k] = lines[k], "\n"
                at += len(line)
                rest += line
            word = m[1]
            if word in ("if", "ifdef", "ifndef"):
                around = choices[opened[-1][0]][-1] if opened else None
                opened.append((len(choices), False))
                choices.append([len(branches)])
                branches.append(_Branch(_condition(word, rest), [], around, len(choices) - 1))
                events[n] = "if", len(choices) - 1
            elif word in ("else", "elif", "elifdef", "elifndef"):
                if not opened or opened[-1][1]:
                    return [], Fault(n, "unexpected token")
                c = opened[-1][0]
                opened[-1] = c, word == "else"
                branches.append(_Branch(_condition(word, rest), list(choices[c]), branches[choices[c][0]].around, c))
                choices[c].append(len(branches) - 1)
                events[n] = "branch", len(branches) - 1
            elif word == "endif":
                if not opened:
                    return [], Fault(n, "unexpected token")
                opened.pop()
                events[n] = "endif", 0
            elif word in ("define", "undef") and (name := re.match(r"\w+", rest)):
                events[n] = word, name[0]
        k += 1
    if opened:
        return [], Fault(len(re.findall(r"\r\n|\n|\r", text)), "truncated")
    read: set[int] = set()
    first = _reading(lines, events, branches, choices, read, None)
    out = [first]
    for target in range(len(branches)):
        if target not in read:
            out.append(_reading(lines, events, branches, choices, read, target))
    return list(dict.fromkeys(out)), None


def _reading(lines: list[str], events: dict[int, tuple[str, int | str]], branches: list[_Branch], choices: list[list[int]], read: set[int], target: int | None) -> str:
    """The lines with one branch of each conditional, among them the `target` and what stands around it; adds to `read`."""
    known: dict[str, bool] = {}
    forced: dict[int, int] = {}

    def settle(b: int) -> None:
        for x in branches[b].before:
            if c := branches[x].condition:
                known[c[0]] = not c[1]
        if c := branches[b].condition:
            known[c[0]] = c[1]

    def choose(conditional: int) -> int | None:
        free = []
        for b in choices[conditional]:
            c = branches[b].condition
            holds = known[c[0]] == c[1] if c and c[0] in known else None
            if holds is not False:
                free.append(b)
            if holds:
                break
        return next((b for b in free if b not in read), free[0] if free else None)

    b = target
    while b is not None:
        forced[branches[b].conditional] = b
        settle(b)
        b = branches[b].around
    out: list[str] = []
    taken: list[tuple[int | None, bool]] = []  # the branch taken of each open conditional, and whether we are in it
    live = True
    for n, line in enumerate(lines):
        if n in events:
            what, x = events[n]
            if what == "if":
                b = (forced[x] if x in forced else choose(x)) if live else None
                if b is not None:
                    read.add(b)
                    settle(b)
                taken.append((b, b == choices[x][0]))
            elif what == "branch":
                taken[-1] = taken[-1][0], taken[-1][0] == x
            elif what == "endif":
                taken.pop()
            elif live:
                for known_text in [t for t in known if re.search(rf"\b{x}\b", t)]:
                    del known[known_text]
                known[f"defined {x}"] = what == "define"
            live = all(here for _, here in taken)
        out.append(line if live else "\n")
    return "".join(out)


_HEREDOC = re.compile(r"<<[~-]?([\"'`]?)([A-Z_]\w*)\1([^\n]*)\n(?:[\s\S]*?\n)??[ \t]*\2(?=\r?\n|\Z)")


def _heredocs(text: str) -> str:
    return _HEREDOC.sub(lambda m: '""' + m[3] + "\n" * (m[0].count("\n")), text) if "<<" in text else text


#: What shows that a text may hold code within its literals, and what makes a piece of it a text of its own.
_MAY_HOLD = {"javascript": "${", "ruby": "#{", "python": re.compile(r"(?i)(?<![a-z0-9_])(?:f|fr|rf)[\"']"), "csharp": re.compile(r"\$@?\"|@\$\"")}
_WRAPPED = {"javascript": "({});\n", "ruby": "{}\n", "python": "({})\n", "csharp": "class A {{ object f = ({}); }}\n"}
_PREFIX = re.compile(r"[A-Za-z$@]*(\"\"\"|\'\'\'|[\"'])")


def _text_end(t: str, at: int) -> int:
    """Where the text that opens at `at` ends, code within it included; the end of all if it doesn't."""
    quote = t[at]
    k = at + 1
    while k < len(t):
        if t[k] == "\\":
            k += 1
        elif t[k] == quote:
            return k
        elif quote == "`" and t.startswith("${", k):
            k = _brace(t, k + 2)
        k += 1
    return len(t)


def _brace(t: str, at: int, stops: str = "}") -> int:
    """The first of `stops` outside of brackets and texts; the end of all if there is none."""
    depth, k = 0, at
    while k < len(t):
        c = t[k]
        if c in "\"'`":
            k = _text_end(t, k)
        elif not depth and c in stops and not (c == "!" and t.startswith("!=", k)):
            return k
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        k += 1
    return len(t)


def _held(literal: str, name: str) -> Iterator[tuple[int, str]]:
    """(place, code) of the code within a literal. One that is never closed is left to the lexer."""
    if name in ("javascript", "ruby"):
        mark, k = ("${" if name == "javascript" else "#{"), 1
        if literal[0] not in ("`" if name == "javascript" else "\"`%/") or literal[:2] in ("%w", "%i", "%q"):
            return
        while k < len(literal):
            if literal[k] == "\\":
                k += 1
            elif literal.startswith(mark, k):
                end = _brace(literal, k + 2)
                if end < len(literal):
                    yield k + 2, literal[k + 2 : end]
                k = end
            k += 1
        return
    m = _PREFIX.match(literal)
    if not m or not re.search(r"(?i)f" if name == "python" else r"\$", m[0]):
        return
    raw = re.search(r"(?i)r|@", m[0]) is not None
    yield from _fields(literal[: -len(m[1])], m.end(), name, raw)


def _fields(t: str, k: int, name: str, raw: bool) -> Iterator[tuple[int, str]]:
    """The replacement fields of a formatted text, and those within their formats."""
    while k < len(t):
        if t[k] == "\\" and not raw:
            k = t.find("}", k) if t.startswith("\\N{", k) else k + 1
            if k < 0:
                return
        elif t.startswith(("{{", "}}"), k):
            k += 1
        elif t[k] == "{":
            end = _brace(t, k + 1, "}:!" if name == "python" else "}:,")
            if end >= len(t):
                return
            code = t[k + 1 : end]
            yield k + 1, re.sub(r"(?<![=!<>:])=\s*$", "", code) if name == "python" else code
            close = end
            depth = 0
            while close < len(t) and (depth or t[close] != "}"):  # conversion and format, which may hold fields
                depth += (t[close] == "{") - (t[close] == "}")
                close += 1
            if "{" in t[end:close]:
                yield from ((end + at, c) for at, c in _fields(t[end:close], 0, name, raw))
            k = close
        k += 1


@dataclass
class Language:
    """A lexer and a grammar, and what line ends mean in between."""

    name: str

    def __post_init__(self) -> None:
        self.grammar = GRAMMARS[self.name]()
        self.lexer, self.literals = re.compile(LEXERS[self.name]), re.compile(LITERALS[self.name])
        self.classes = Classes(self.name, self.grammar)
        g = self.grammar
        c = lambda *tokens: "".join(g.chars[t] for t in tokens if t in g.chars)
        if self.name == "go":
            ends = "".join({g.id, g.num, g.str, *c("return", "break", "continue", "fallthrough", "++", ")", "]", "}")})
            self.semicolon = re.compile(f"(?<=[{ends}])\n+")
        elif self.name == "javascript":
            nl = c("\n")
            joins = c("?", ":", "&&", "=", "+=", ",", "=>", "+", "-", "*", "<", "|", "&", ".", "?.", "in", "(", "[")
            self.join = re.compile(f"(?<=[{joins}]){nl}+|{nl}+(?=[{c('?', ':', '&&', '=', ',', '.', '?.', '=>', '|', '&', '*', ')', ']')}{c('else', 'catch', 'finally')}])")
            self.lines = re.compile(f"{nl}{{2,}}")
        elif self.name == "ruby":
            nl, g = c("\n"), self.grammar
            self.lines = re.compile(f"(?<=[{c('+', '-', '&', '==', '=', '+=', ',', '.', '&.', '?', '<<', '&&', '(')}]){nl}+|{nl}+(?=[{c('.', '&.')}])")
            operand = "".join({g.id, g.num, g.str, *c(":sym", "@var", "self", "nil", ")", "]", "}", "end", "return", "break", "next", "redo", "retry", "super", "yield", "!", "?")})
            self.mods = [(re.compile(f"(?<=[{operand}]){g.chars[k]}"), g.chars[v]) for k, v in grammars.RUBY_MOD.items()]
            loops = c("while", "until", "for")
            self.loop_do = re.compile(f"([{loops}][^{nl}{c(';')}{c('do')}]*){c('do')}")
            begins = "".join({nl, *c("(", "[", "{", ",", "=", "+=", ";", "|", "return", "==", "then", "&&")})
            self.splats = [(re.compile(f"(?:(?<=[{begins}])|(?<=^)){c('*')}(?=[{g.id}{c(chr(91), '(', ')', ',', '@var')}])|(?<=[{begins}])(?:{c('**')}|{c('&')})(?=[{g.id}{c(':sym', '@var', ')', ',', '{')}])"), g.chars["*arg"])]
            # a name after a point or `def` is no keyword
            words = "".join({g.chars[t] for t in ("def", "class", "module", "if", "unless", "while", "until", "for", "case", "begin", "do", "end")})
            self.member = re.compile(f"(?<=[{c('.', '&.', 'def')}])[{words}]")

    def prepared(self, text: str) -> str:
        """The text as the lexer takes it, with as many lines; of C, the first reading."""
        return (_readings(text)[0] or [text])[0] if self.name == "c" else _heredocs(text) if self.name == "ruby" else text

    def readings(self, text: str) -> tuple[list[str], Fault | None]:
        """All texts that must parse for this one to parse, or what is wrong before any is read."""
        return _readings(text) if self.name == "c" else ([text], None)

    def held(self, text: str) -> Iterator[tuple[int, str]]:
        """(offset, text) of all code within literals, each made a text of its own."""
        may = _MAY_HOLD.get(self.name)
        if may is None or not (may in text if isinstance(may, str) else may.search(text)):
            return
        literals = [(m.start(), m[0]) for m in self.literals.finditer(text) if m.end() - m.start() > 3]
        if self.name == "ruby":
            literals += [(m.start(), '"' + m[0][1:] + '"') for m in _HEREDOC.finditer(text) if m[1] != "'"]
        for start, literal in literals:
            for at, code in _held(literal, self.name):
                yield start + at, _WRAPPED[self.name].format(code if self.name == "ruby" or code.strip() else ")")  # no expression is none

    def tokens(self, text: str) -> str:
        """One character per token; comments, and line ends that mean nothing, leave none."""
        found = self.lexer.findall(self.prepared(text))
        if self.name == "python":
            return self._indented(found)
        return self._finish("".join(map(self.classes.__getitem__, found)), found)

    def _finish(self, s: str, found: list[str]) -> str:
        if self.name == "go":
            # line ends have no class in Go: they are put in where they end a statement
            s = "".join([self.classes[t] if t[0] not in "\r\n" else "\n" for t in found])
            return self.semicolon.sub(self.grammar.chars[";"], s if s.endswith("\n") else s + "\n").replace("\n", "")
        if self.name == "javascript":
            return self.join.sub("", self.lines.sub(self.grammar.chars["\n"], s))
        if self.name == "ruby":
            s = self.member.sub(self.grammar.id, self.lines.sub("", s))
            for pattern, c in self.mods:
                s = pattern.sub(c, s)
            for pattern, c in self.splats:
                s = pattern.sub(c, s)
            return self.loop_do.sub(lambda m: m[1] + self.grammar.chars["\n"], s)
        return s

    def _indented(self, found: list[str]) -> str:
        """Python's tokens with its suites bracketed."""
        g, classes = self.grammar, self.classes
        nl, opens, closes = g.chars["\n"], g.chars[grammars.INDENT], g.chars[grammars.DEDENT]
        out: list[str] = []
        stack, depth, line, width = [0], 0, [], 0

        def flush() -> None:
            nonlocal line
            if not line:
                return
            if width > stack[-1]:
                stack.append(width)
                out.append(opens)
            else:
                while width < stack[-1]:
                    stack.pop()
                    out.append(closes)
                if width != stack[-1]:
                    out.append(BAD)
            out.extend(line)
            out.append(nl)
            line = []

        if found and found[0][0] in " \t":
            found = found[1:]
        for t in found:
            if t[0] in "\r\n":
                if depth <= 0:
                    flush()
                    blank = t.lstrip("\r\n")
                    width = len(blank.expandtabs(8)) if "\t" in blank else len(blank)
                continue
            c = classes[t]
            if c:
                line.append(c)
                if t in "([{":
                    depth += 1
                elif t in ")]}":
                    depth -= 1
        flush()
        out.append(closes * (len(stack) - 1))
        return "".join(out)

    def parses(self, text: str) -> bool:
        readings, fault = self.readings(text)
        return fault is None and all(self.grammar.accepts(tokens) or self.grammar.furthest(tokens) < 0 for tokens in map(self.tokens, readings))

    def accepts(self, text: str) -> bool:
        readings, fault = self.readings(text)
        return fault is None and all(map(self.grammar.accepts, map(self.tokens, readings)))


@cache
def language(name: str) -> Language:
    return Language(name)


@dataclass
class Failure:
    token: int | None  # None if it is no token but a directive, a conflict marker between branches, or within a literal
    line: int | None
    cause: str | None


def _cause(lang: Language, text: str, tokens: str, at: int) -> str:
    if CONFLICT in tokens:
        return "merge conflict"
    others = [n for n in GRAMMARS if n != lang.name and not {n, lang.name} <= {"java", "csharp"}]
    if any(language(n).accepts(text) for n in others if n != "ruby" or lang.name == "python"):
        return "other language"
    if at >= len(tokens.rstrip(lang.grammar.chars.get("\n", "") + lang.grammar.chars.get(grammars.DEDENT, ""))):
        return "truncated"
    if tokens[at : at + 1] == BAD:
        return "stray character or open literal"
    return "unexpected token"


def failure(text: str, name: str, explain: bool = True) -> Failure | None:
    """Where and, if asked to `explain`, why the text does not parse, or None. Texts without tokens parse. Code within
    literals (`${}`, `#{}`, the fields of formatted texts) must parse too."""
    lang = language(name)
    if text.startswith("﻿"):
        text = text[1:]
    readings, fault = lang.readings(text)
    if fault:
        return Failure(None, fault.line, fault.cause) if explain else Failure(None, None, None)
    for reading in readings:
        tokens = lang.tokens(reading)
        if not tokens or lang.grammar.accepts(tokens):
            continue
        at = lang.grammar.furthest(tokens)
        if at >= 0:
            return Failure(at, _line(lang, reading, at), _cause(lang, text, tokens, at)) if explain else Failure(at, None, None)
    for at, code in lang.held(text):
        if not _parses(code, name):
            return Failure(None, len(re.findall(r"\r\n|\n|\r", text[:at])), "unexpected token") if explain else Failure(None, None, None)
    return None


@lru_cache(50_000)
def _parses(code: str, name: str) -> bool:
    """The same pieces of code stand in many literals."""
    return failure(code, name, False) is None


def _line(lang: Language, text: str, at: int) -> int:
    """The line, from 0, of a token: the fewest lines from the start whose tokens reach it, of those that end no token."""
    text = lang.prepared(text)
    inside = [(m.start(), m.end()) for m in lang.lexer.finditer(text) if m.end() - m.start() > 2]
    starts = [a for a, _ in inside]
    ends = []
    for n, m in enumerate(re.finditer(r"\r\n|\n|\r", text)):
        k = bisect_right(starts, m.start()) - 1
        if k < 0 or inside[k][1] <= m.start() or text[inside[k][0]] in "\r\n":
            ends.append((m.end(), n))
    close = lang.grammar.chars.get(grammars.DEDENT, "") + lang.grammar.chars.get("\n", "")
    lo, hi = 0, len(ends)
    while lo < hi:  # tokens of a longer start are at least as many
        mid = (lo + hi) // 2
        if len(lang.tokens(text[: ends[mid][0]]).rstrip(close)) > at:
            hi = mid
        else:
            lo = mid + 1
    if lo < len(ends):
        return ends[lo][1]
    return len(re.findall(r"\r\n|\n|\r", text))


def syntax_failures(files: DataFrame, newest: str = "mtime_ns", explain: bool = True) -> DataFrame:
    """Current files that do not parse: (file_id, worktree_key, rel_path, language, fail_line, cause, ok).

    One row per file whose ending has a grammar, also those that parse (`ok`). Every delivered row is parsed where it
    is read, so contents are never shuffled; the newest row of a file then decides, and among rows of equal time the one
    that parses. Without `explain` line and cause stay null; they take a search and other languages' grammars. Null and empty contents and comments alone parse. Endings are compared without letter case.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [failure(t, name, explain) if t else None for t, name in zip(b.column("content").to_pylist(), b.column("language").to_pylist(), strict=True)]
            out = {n: b.column(n) for n in b.schema.names if n != "content"}
            out["ok"] = pa.array([f is None for f in found], pa.bool_())
            out["fail_line"] = pa.array([f and f.line for f in found], pa.int32())
            out["cause"] = pa.array([f and f.cause for f in found], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    ending = F.lower(F.regexp_extract("rel_path", r"\.([^./\\]+)$", 1))
    lang = F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair])[ending]
    rows = files.select("file_id", "worktree_key", "rel_path", F.col(newest).alias("_at"), lang.alias("language"), "content").where(F.col("language").isNotNull())
    parsed = spread(rows).mapInArrow(run, "file_id bigint, worktree_key string, rel_path string, _at bigint, language string, ok boolean, fail_line int, cause string")
    newest_row = F.max(F.struct("_at", "ok", "worktree_key", "rel_path", "language", "fail_line", "cause")).alias("r")
    return parsed.groupBy("file_id").agg(newest_row).select("file_id", "r.worktree_key", "r.rel_path", "r.language", "r.ok", "r.fail_line", "r.cause")


def failure_rates(failures: DataFrame, worktrees: DataFrame) -> DataFrame:
    """(repo_id, language, files, failed, share, conflicts): per repository and language; repo_id is null for files of
    no known worktree. `worktrees` is listed by key once; it joins after files were counted per worktree."""
    counts = failures.groupBy("worktree_key", "language").agg(
        F.count(F.lit(1)).alias("n"), F.sum((~F.col("ok")).cast("int")).alias("bad"), F.sum((F.col("cause") == "merge conflict").cast("int")).alias("c")
    )
    repos = worktrees.groupBy("worktree_key").agg(F.max("repo_id").alias("repo_id"))
    return (
        counts.join(repos, "worktree_key", "left").groupBy("repo_id", "language")
        .agg(F.sum("n").alias("files"), F.sum("bad").alias("failed"), F.coalesce(F.sum("c"), F.lit(0)).alias("conflicts"))
        .withColumn("share", F.col("failed") / F.col("files"))
    )
