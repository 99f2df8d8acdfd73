"""Whether a documentation comment tells a reader something in words."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

_LEAD = re.compile(r"^[ \t]*(?:/\*[*!]?|\*/|\*(?!\*)|//[/!]?|#(?![A-Za-z!\[])!?|--(?=\s)|\"\"\"|'''|;+(?=\s)|%+(?=\s)|<!--)?[ \t]*")
_TRAIL = ("*/", '"""', "'''", "-->")
_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_PART = re.compile(r"\w+")
_NAME_PART = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[^\W\d_A-Z]+|[A-Z]+|\d+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+|(?<=[。！？])")

#: Notes that stand in for documentation, by how they begin.
_NOTE = re.compile(r"(?i)^(?:@?todo|fix-?me|xxx+|hack|wip|tbd|tbc|bug|nota bene|undone|stub|placeholder|lorem ipsum)\b(?![\w-])")
#: Instructions to tools.
_TOOL = re.compile(
    r"(?ix)^(?:"
    r"no(?:lint|qa|sec|inspection|cover|check)(?:nextline|begin|end)?\b(?:[:(].*)?$|nolint\S*|noqa\b.*|pragma\b.*|pylint\s*:.*|pyright\s*:.*|mypy\s*:.*|ruff\s*:.*|flake8\b.*|isort\s*:.*|yapf\s*:.*|fmt\s*:\s*(?:off|on|skip).*"
    r"|type\s*:\s*ignore.*|clang-(?:format|tidy)\b.*|eslint\S*(?:\s.*)?$|eslint-.*|tslint\s*:.*|jshint\b.*|jslint\b.*|prettier-ignore\S*|biome-ignore.*|stylelint-.*|istanbul\s.*|c8\s+ignore.*|v8\s+ignore.*|rustfmt(?:::|\s).*|clippy::.*|rubocop\s*:.*|go:\w+.*|\+build\b.*|sonar\S*|coverity\b.*|codecov\b.*|lint(?:er)?[-:]\S*.*|checkstyle\b.*|cspell\s*:.*|spell-?checker\s*:.*|swiftlint\S*.*|ktlint\S*.*|shellcheck\b.*|webpack\w+\s*:.*"
    r"|@(?:ts-\w+|flow|jsx\w*|internal|private|public|protected|hidden|ignore|suppress\w*|formatter:\w+|generated|nocollapse)\b.*|@?suppresswarnings\b.*|@?formatter:\w+.*|\#?(?:end)?region\b.*|mark\s*:.*|-\*-.*-\*-|vim?\s*:.*|ex\s*:\s.*|cov(?:erage)?\s*:.*|lcov_excl\w*.*|gcov\w*.*|iwyu\b.*|autopep8\s*:.*|black\s*:.*|bandit\s*:.*|doctest\s*:.*|nosemgrep.*|cppcheck-suppress.*|lizard\b.*|skipcq.*|snyk:.*|hadolint.*"
    r")$"
)
#: What lawyers write.
_LAW = re.compile(
    r"(?i)licen[sc]e[sd]?\b|licen[sc]ing|\bcopyright\b|©|\(c\)\s*(?:\d{4}|$|[A-Z])|^\(c\)|\bspdx\b|rights? reserved|redistribut|\bwarrant(?:y|ies)\b|permission is (?:hereby )?granted|this notice|\bas[- ]is\b.*(?:basis|warrant)|liabilit|\bpatent\b|"
    r"\bproprietary\b|confidential\b.*(?:property|information)|trade ?marks?\b|alle rechte vorbehalten|urheberrecht|tous droits r|derechos reservados|droits d'auteur|derechos de autor|provided that (?:this|the|these)|in compliance with (?:the|them)"
)
#: One of these is in ASCII text, in lower case, that `_LAW` finds something in.
_LAW_PARTS = (
    "licen", "copyright", "(c)", "spdx", "reserved", "redistribut", "warrant", "permission is ", "this notice", "as is", "as-is", "liabilit", "patent", "proprietary", "confidential", "trademark", "trade mark",
    "alle rechte", "urheberrecht", "tous droits", "derechos ", "droits d'", "provided that ", "in compliance ",
)
#: Sentences that say only that here is code, or that there is no documentation.
_EMPTY = re.compile(
    r"(?ix)^(?:"
    r"(?:the\s+|a\s+|an\s+|this\s+is\s+(?:a|an|the)\s+|simple\s+|default\s+|main\s+|small\s+|private\s+|public\s+|internal\s+|static\s+|empty\s+|generic\s+|auxiliary\s+|just\s+a\s+|some\s+)*"
    r"(?:getters?|setters?|accessors?|mutators?|getter\s*(?:/|and|&)\s*setter|constructors?|ctor|dtor|destructors?|initiali[sz]ers?|helpers?|util(?:s|ity|ities)?|wrappers?|functions?|methods?|procedures?|routines?|callbacks?|handlers?|entry\s*point|api|stuff|things?|misc|implementation|impl|internals?|private|public|protected|static|private\s+api|interface|deprecated|unused|overrides?|override|inherited|see\s+(?:above|below|base|parent|super(?:class)?)|same\s+as\s+above|ditto|idem|as\s+above|self[- ]explanatory|none|nil|null|n\.?\s*/?\s*a\.?|nothing|empty|unknown|undocumented|blah(?:\s+blah)*|foo|bar|test|docs?|documentation|comments?|descriptions?|summary|brief|text|notes?|details?|example|usage|funktion|methode|hilfsfunktion|konstruktor|fonction|m[ée]thode|constructeur|funci[óo]n|m[ée]todo|constructor|privado|privada|interno|intern|interne|priv[ée]e?)"
    r"(?:\s+(?:functions?|methods?|procedures?|routines?|class|here|for\s+(?:this|the)\s+(?:class|object|type|module)|code|only|api|use|use\s+only|usage|stub|implementation|auxiliar))*"
    r"|(?:missing|no|add|insert|write|needs?|your|put|enter|fill\s+in|lacks?|without|some|the|pending|later)\s+(?:a\s+|the\s+|any\s+|some\s+|your\s+)?(?:docs?|docstrings?|documentation|descriptions?|comments?|summary|text|javadoc|doc\s+comment)(?:\s+(?:here|available|yet|provided|needed|later|comes?\s+later|goes\s+here|string|missing|pending|to\s+come|follows|given|required|please))*"
    r"|(?:docs?|docstrings?|documentation|descriptions?|comments?|summary|text)\s+(?:here|goes\s+here|missing|pending|needed|to\s+(?:do|come|follow)|follows?|later|comes?\s+later|tbd|unavailable|not\s+(?:available|yet\s+written|provided))"
    r"|(?:to\s+be\s+(?:documented|written|done|described|defined|determined|completed|continued)|not\s+(?:yet\s+)?(?:documented|implemented|described|written)(?:\s+yet)?|document\s+(?:me|this)|describe\s+(?:me|this)|please\s+document|auto-?\s*generated(?:\s+(?:method|function|constructor|catch|doc|code|comment|by.*))*(?:\s+(?:stub|block))?|generated(?:\s+(?:method|function|code|by.*))*(?:\s+stub)?|(?:method|function)\s+(?:stub|body|description)|keine\s+(?:beschreibung|dokumentation)|beschreibung(?:\s+fehlt)?|fehlt\s+noch|sin\s+(?:documentar|descripci[óo]n|documentaci[óo]n)|pas\s+de\s+(?:documentation|description)|[àa]\s+(?:documenter|faire|compl[ée]ter)|por\s+hacer|pendiente)"
    r")$"
)
_TAG = re.compile(
    r"(?i)^(?:[@\\](\w+)|:(param|parameter|arg|argument|type|key|keyword|raises?|raise|except|exception|return|returns|rtype|var|ivar|cvar|vartype|yields?|meta)\b([^:]*):)\s*(.*)$"
)
_NAMED_TAG = {"param", "parameter", "arg", "argument", "tparam", "throws", "exception", "raises", "raise", "except", "property", "prop", "key", "keyword", "var", "ivar", "cvar", "template", "typeparam", "field", "see", "link", "group", "ingroup", "defgroup", "addtogroup", "author", "version", "since", "date", "file", "class", "fn", "name", "module", "memberof", "alias", "category", "package"}
_SILENT_TAG = {"author", "authors", "version", "since", "date", "file", "fn", "name", "module", "memberof", "see", "link", "alias", "category", "package", "type", "rtype", "vartype", "ingroup", "defgroup", "addtogroup", "class", "override", "inheritdoc", "access", "public", "private", "protected", "static", "async", "final", "abstract", "readonly", "hidden", "ignore", "internal", "api", "meta", "copyright", "license"}
_HEADING = re.compile(
    r"(?i)^(?:#+\s*)?(?:\**)(?:args?|arguments?|params?|parameters?|other parameters|returns?|return value|raises?|yields?|throws?|errors?|panics|safety|examples?|usage|notes?|see also|references?|attributes?|warnings?|warns|receives|todo|methods|input|inputs|output|outputs|result|results|precondition|postcondition|since|deprecated|complexity|parameter|rückgabe|beispiel|argumente|fehler|param[èe]tres|retour|exemples?|erreurs|par[áa]metros|devuelve|retorna|ejemplos?|errores)(?:\**)\s*:?\s*(?:\**)$"
)
_ONE_TAG = re.compile(r"\{?@\w+\}?")
_TYPE = re.compile(
    r"^(?:(?:const|unsigned|signed|struct|enum|union|class|static|volatile|mut|dyn|ref|readonly)\s+)*(?:&\s*)?(?:'\w+\s+)?(?:mut\s+)?"
    r"(?:void|int|char|short|long|float|double|bool|boolean|byte|string|str|size_t|ssize_t|u?int\d+(?:_t)?|[iuf]\d+|usize|isize|object|any|unknown|never|number|bigint|symbol|None|null|nil|error|rune|uint|uintptr|float\d+|String|Integer|Boolean|Object|List|Map|Vec|dict|list|tuple|set|bytes|self|Self|auto|(?:(?:struct|enum|union|class)\s+\w+))(?:\s+(?:int|long|char|double))*\s*(?:<[^>]*>|\[[^\]]*\])*\s*[*&?\[\]]*(?:\s*const)?\s*$"
)
_CODE = re.compile(
    r"^(?:"
    r"(?:return|throw|goto|delete|assert|await|yield)\b[^.!?]*;\s*$"
    r"|(?:let|const|var|auto|final|static|int|char|double|float|bool|size_t|unsigned|long|void|String)\s+(?:mut\s+)?[*&]?\w+(?:\s*:\s*[\w<>&]+)?\s*(?:=|;|\[|\().*$"
    r"|[\w.\[\]>*-]+\s*(?:[-+*/%|&^]|<<|>>|:|\|\||&&|\?\?)?=(?!=)\s*\S.*$"
    r"|(?:if|for|while|switch|catch|elif|elsif|unless|until|foreach)\s*\(.*\)\s*(?:\{.*|\S*;|break.*|continue.*|return.*)?$"
    r"|(?:if|for|while|elif|with|def|class|try|except|else)\b[^.!?]*:\s*$"
    r"|(?:\}\s*)?(?:else|try|do|finally|begin|end|then|fi|done|loop|unsafe)\s*[{:]?\s*$"
    r"|(?:if|for|while|match|switch|fn|func|def|impl|struct|loop)\b.*\{\s*$"
    r"|(?:import|from|use|using|package|require|include|export|module|namespace|mod)\s+[\w.:{}\"'<>*/@-]+(?:\s+(?:import|as)\s+[\w., *]+)?\s*;?$"
    r"|\#\s*(?:include|define|ifdef|ifndef|if|endif|pragma|undef)\b.*$"
    r"|[A-Za-z_][\w.]*(?:(?:::|->|\.)\w+)*!?\s*\((?:[^()]|\([^()]*\))*\)\s*[;{]?\s*$"
    r"|[A-Za-z_]\w*(?:(?:::|->|\.)\w+)+\s*;?$"
    r"|[\w.]+(?:\+\+|--)\s*;?$|(?:break|continue|pass|return|end|fi|done|self|super|true|false|nil)\s*;?$"
    r"|puts\s+.*|print\s+[\"'].*|echo\s+[\"'$].*|(?:System|console|fmt|std|os|sys)\s*(?:\.|::)\s*\w+.*[)(;].*$"
    r"|</?\w+[^>]*>\s*$"
    r")"
)
_RETURN = re.compile(r"return\s+[\w.()\[\]+*/%<>=!&|\"'-]")
#: Words that add nothing to a name.
_FILLERS = frozenset(
    """the a an this that these it its is are be of for to in on by with from and or as at function functions func fn method methods routine procedure
    constructor destructor class struct object type helper implementation implements implement impl does do did perform performs executes execute calls call
    called named name here just simply main_ def sub void get gets set sets returns return one some given my our your new instance documentation docs
    die der das den dem des ein eine einer eines funktion methode von für und im am la le les l un une de du fonction méthode pour et dans el los las una función
    método del para y en se""".split()
)


def _forms(word: str) -> set[str]:
    """A word and the forms it takes in a sentence about itself."""
    base = {word}
    if word.endswith("e"):
        base.add(word[:-1])
    if word.endswith("y"):
        base.add(word[:-1] + "i")
    if len(word) > 2:
        base.add(word + word[-1])
    return {word, *(b + end for b in base for end in ("s", "es", "ed", "d", "ing", "er", "or", "ion", "ment"))}


def name_parts(name: str) -> list[str]:
    """The words of an identifier."""
    return [w.lower() for w in _NAME_PART.findall(name)]


@lru_cache(50_000)
def _known(name: str) -> frozenset[str]:
    return frozenset().union(*map(_forms, [*name_parts(name), name.lower()]))


def says_name_again(text: str, name: str | None) -> bool:
    """Whether every word of the text is the name, a form of its parts, or a filler."""
    words = again = 0
    known = _known(name) if name else frozenset()
    for m in _PART.finditer(text):
        part = m[0]
        for w in (part,) if part.islower() and part.isalpha() else name_parts(part) or (part,):
            w = w.lower()
            if w.isdigit():
                continue
            words += 1
            if w in known:
                again += 1
            elif not name or w not in _FILLERS:
                return False
    return not words or again > 0


_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_RULES = "-*=~_#|" + _BLANKS
_BULLETS = _RULES + "+•>"


def _of_law(text: str) -> bool:
    if text.isascii():
        low = text.lower()
        for part in _LAW_PARTS:
            if part in low:
                return bool(_LAW.search(text))
        return False
    return bool(_LAW.search(text))


def _bare(raw: str) -> str:
    """A line without the signs that make it a comment."""
    line = raw[_LEAD.match(raw).end() :].rstrip(" \t")
    if line.endswith(_TRAIL):
        line = line[: -2 if line.endswith("*/") else -3]
    return line.strip()


def _returns(line: str) -> bool:
    r"""Whether `return\s+H+(?:\s*O+\s*T+)*\s*;?$` matches, H being [\w.()\[\]+*/%<>=!&|"'-], O [-+*/%<>=!&|?:] and T
    [\w.()\[\]"'-]. A minus may stand in each of them, so all ways to read the line are followed at once."""
    m = _RETURN.match(line)
    if not m:
        return False
    head, operator, operand, before_operator, before_operand = 1, 2, 4, 8, 16
    at = head
    for c in line[m.end() :].removesuffix(";").rstrip():
        if c.isspace():
            at = (before_operator if at & (head | operand | before_operator) else 0) | (before_operand if at & (operator | before_operand) else 0)
        else:
            operates, stands = c in "-+*/%<>=!&|?:", c.isalnum() or c in "_.()[]\"'-"
            at = (
                (head if at & head and (stands or operates and c not in "?:") else 0)
                | (operator if operates and at & (head | operator | operand | before_operator) else 0)
                | (operand if stands and at & (operator | operand | before_operand) else 0)
            )
        if not at:
            return False
    return bool(at & (head | operand))


def _is_code(line: str) -> bool:
    if _CODE.match(line) or _returns(line):
        return True
    end = line.rstrip()
    if not end.endswith((";", "{", "}", "=>", "->")) and not (end.endswith(":") and end[:-1].rstrip().endswith(")")):
        return False
    words = _WORD.findall(line)
    return (len(words) <= 2 or bool(re.search(r"[=(\[{]", line)) and not re.search(r"[^\W\d_]{2,} [^\W\d_]{2,} [^\W\d_]{2,}", line))


def description(doc: str | None, name: str | None = None) -> str:
    """What the comment tells in words: its text without notes, instructions, legal text, rules, code, bare tags and
    the name said again; empty if nothing is left. Null gives an empty text."""
    kept: list[str] = []
    fenced = in_law = False
    for raw in _BREAK.split(doc or ""):
        line = _bare(raw)
        if not line.isascii() or not line.isprintable():
            line = "".join(c for c in line if unicodedata.category(c) not in ("Cf", "Cc", "Co", "Cs")).strip()
        if line.startswith("```"):
            fenced = not fenced
            continue
        if not _WORD.search(line) or fenced:  # rules, dots, numbers
            in_law = in_law and bool(line)
            continue
        if _NOTE.match(line) or _TOOL.match(line) or _HEADING.match(line):
            in_law = False
            continue
        if _of_law(line):
            # beside legal text only other sentences count; a legal sentence may run on in the next line
            sentences = [s for s in _SENTENCE.split(line) if not _LAW.search(s)]
            in_law = not line.rstrip().endswith((".", "!", ")")) and bool(re.search(r"(?i)redistrib|licen[sc]e[ds]?\b.*\b(?:under|and|the|in|of|to|not)$|,$|permi|warrant", line))
            kept.extend(s for s in sentences if len(_WORD.findall(s)) > 2 and not _LAW.search(s) and not _filler(s, name))
            continue
        if in_law:
            in_law = not line.endswith(".")
            continue
        if tag := _TAG.match(line):
            line = _tag_text(tag)
            if not line:
                continue
        elif _is_code(line) or _TYPE.match(line):
            continue
        for s in _SENTENCE.split(line):
            s = s.lstrip(_BULLETS).rstrip(_RULES)
            if _WORD.search(s) and not _NOTE.match(s) and not _filler(s, name):
                kept.append(s)
    text = " ".join(kept)
    if says_name_again(text, name) or not any(len(w) > 1 or ord(w[0]) > 0x2E80 for w in _WORD.findall(text)):
        return ""
    return text


def _tag_text(tag: re.Match) -> str:
    word, rest = (tag[1] or tag[2]).lower(), tag[4].strip()
    if word in _SILENT_TAG:
        return ""
    rest = re.sub(r"^\{[^}]*\}\s*", "", rest)
    if tag[1] and word in _NAMED_TAG:
        rest = re.sub(r"^\[?[\w.$*]+(?:=[^\]\s]*)?\]?\s*[-:–]*\s*", "", rest)
    if _TYPE.match(rest) or _is_code(rest):
        return ""
    return rest if _WORD.search(rest) else ""


def _filler(sentence: str, name: str | None) -> bool:
    first, end = 0, len(sentence)
    while first < end and not sentence[first].isalnum():
        first += 1
    while end > first and not sentence[end - 1].isalnum():
        end -= 1
    plain = sentence[first:end]
    return not plain or bool(_EMPTY.match(plain)) or "@" in sentence and bool(_ONE_TAG.fullmatch(sentence.strip())) or says_name_again(plain, name)


def tells_something(doc: str | None, name: str | None = None) -> bool:
    return bool(description(doc, name))
