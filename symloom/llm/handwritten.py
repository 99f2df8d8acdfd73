"""Generated, minified and vendored source files, and data saved as code."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.syntax import ENDINGS, LEXERS
from symloom.session import scratch
from symloom.sources.spread import spread

#: Directories that hold the code of others or what a tool wrote, as whole path segments.
VENDOR_DIRS = (
    "vendor", "third_party", "third-party", "thirdparty", "3rdparty", "node_modules", "bower_components", "jspm_packages", "site-packages", "dist-packages",
    "Godeps", "_vendor", "Pods", "Carthage",
)
#: Names that own directories have too: they count at the top of a tree only, with a directory for each project below.
VENDOR_ROOTS = ("external", "extern", "externals", "deps")
VENDOR_PAIRS = ("contrib/bundled", "Godeps/_workspace", "third_party/src")
_VENDOR_PATH = re.compile("(?:^|/)(?:" + "|".join(re.escape(d) for d in (*VENDOR_DIRS, *VENDOR_PAIRS)) + ")/|^(?:" + "|".join(VENDOR_ROOTS) + ")/[^/]+/")
#: Names that tools give to what they write.
_TOOL_NAME = re.compile(
    r"(?:^|/)(?:[^/]+[.-]min\.(?:js|mjs|cjs|css|ts)|[^/]+\.pb\.(?:go|cc|cpp|h|rs|swift|dart)|[^/]+_pb\.(?:rs|rb|js|ts|py|d\.ts)|[^/]+_pb2(?:_grpc)?\.pyi?|[^/]+_grpc_pb\.js|[^/]+_grpc\.pb\.go|[^/]+Grpc\.(?:java|cs)|[^/]+OuterClass\.java"
    r"|[^/]+\.g(?:\.i)?\.(?:cs|dart)|[^/]+\.[Dd]esigner\.(?:cs|vb)|[^/]+\.generated\.\w+|[^/]+\.gen\.\w+|[^/]+[._-]autogen\.\w+|zz_generated\.[^/]+|moc_[^/]+\.(?:cpp|cc|cxx)|qrc_[^/]+\.(?:cpp|py)|ui_[^/]+\.(?:py|h)"
    r"|[^/]+_wrap\.(?:c|cc|cpp|cxx)|[^/]+_string\.go|[^/]+_bindings\.rs|[^/]+\.tab\.(?:c|cc|cpp|h)|lex\.[^/]+\.(?:c|cc|h)|[^/]+\.bundle\.m?js|(?:dist|build|out|bundles?|public|static|assets|www)/(?:[^/]+/)*(?:app|main|index|chunk|vendors?|runtime|polyfills|commons?)[-.][0-9a-z]{5,}\.m?js)$"
)
#: What a line of a comment says that a tool or an importer wrote; one word of these alone says nothing.
_MADE = re.compile(
    r"(?i)\b(?:(?:auto|machine)[\s-]?)?(?:generated|written|produced|created|emitted|rendered|synthesi[sz]ed|transpiled|compiled|built|made|output)\s+(?:\w+\s+){0,3}?(?:by|from|with|using|of|via)\b"
    r"|\b(?:auto|machine|computer|tool)[\s-]*(?:generated|written|made|created|produced)\b|\bautogen(?:erated)?\b|^\W*generated\b|\bgenerated\s+(?:file|code|source|sources|module|class|bindings?|stubs?|parser|lexer)\b|\b(?:output|product)\s+of\b"
    r"|\b(?:erzeugt|generiert|erstellt|g[ée]n[ée]r[ée]e?s?|produite?|cr[ée][ée]e?\s+par|generad[oa]|producid[oa]|cread[oa]\s+por|gerad[oa]|generato|prodotto)\b"
)
_WARNED = re.compile(
    r"(?i)\b(?:do\s+not|don'?t|never|must\s+not)\s+(?:be\s+)?(?:hand[\s-]?)?(?:edit|modif|chang|touch|alter|patch)|\b(?:edits?|changes?|modifications?|patches)\b[^.]*\b(?:lost|overwritten|discarded|wiped|undone|reverted|clobbered)\b|\bhands\s+off\b|\bregenerat|\bread[\s-]?only\b|\brather\s+than\s+(?:edit|patch)|\binstead\b"
    r"|\bnicht\s+(?:von\s+hand\s+)?(?:bearbeiten|[äa]e?ndern|anfassen|editieren)\b|\bne\s+pas\s+(?:modifier|[ée]diter|toucher|changer)\b|\bno\s+(?:editar|modificar|tocar|cambiar)\b|\bn[ãa]o\s+(?:editar|edite|modificar)\b|\bnon\s+modificare\b"
)
_BY_ITSELF = re.compile(
    r"(?i)\bauto(?:matically|matic|mated)?\b|\bauto-|\bautogen|\bmachine\b|\bmechanically\b|\bautomatisch|\bmaschinell|\bautomatique|\bautom[áa]tic|\bautomaticamente|\bthis\s+(?:file|code|source|module|class)\b|\bdiese[rs]?\s+(?:datei|code|quelltext)\b|\bce\s+(?:fichier|code)\b|\beste\s+(?:archivo|fichero|c[óo]digo|arquivo)\b|\bquesto\s+(?:file|codice)\b"
    r"|\b[\w+-]+\s+\(?v?\d+(?:\.\d+)+|\(?\bv\d+(?:\.\d+)*\b|[\w/-]+\.(?:proto|idl|y|yy|l|ll|g4?|def|tmpl|tpl|template|schema|xml|ya?ml|json|ui|qrc|thrift|fbs|capnp|in|wsdl|xsd|graphql|gql|peg|ebnf|bnf|td|asn1?|erb|j2|mustache|csv|toml|sql|swagger|openapi|rl|re|lex|jison|mo|po|rc|i)\b"
)
#: Alone enough: marks that tools themselves look for.
_MARK = re.compile(
    r"(?im)^[\s/*#;!<>\-\"'=]*(?:@(?:auto-?)?generated\b(?!\s+(?:ids?|by\s+hand))|</?auto-?generated\b)|-\*-[^\n]*\bbuffer-read-only\s*:\s*t\b|(?-i:\bDO\s+NOT\s+(?:EDIT|MODIFY|CHANGE|TOUCH)\b)|\bgenerated\s+by\b[^\n]*\bdo\s+not\s+edit|^[\s/*#;!<>\-]*(?:do\s+not|never)\s+(?:edit|modify)(?:\s+(?:this\s+file|by\s+hand|manually|directly|me))*\s*[.!]*\s*(?:\*/)?\s*$"
)
_STUB = re.compile(r"(?i)\b(?:method|constructor|function|catch|getter|setter|property)\s+(?:stub|block|body)s?\b|\bgenerated\s+(?:ids?|names?|keys?|values?|numbers?|tokens?|code\s+(?:is|was|that))\b|\bgets?\s+generated\b|\bhelper\s+for\b")
_LIBRARY = re.compile(r"(?i)\b[a-z][\w.+-]*\s*(?:@|\bversion\b|\bver\.?|\brelease\b|\brev(?:ision)?\b|\bv)?\s*v?\d+\.\d+(?:\.\d+)*|\b[a-z][\w.+-]*\s*@\s*[0-9a-f]{7,40}\b")
_FOREIGN = re.compile(
    r"(?i)\b(?:imported|bundled|vendored|embedded|copied|taken|pulled|lifted|mirrored|forked|synced|included|borrowed|downloaded|incorporated|adopted|shipped|redistributed)\b|\bupstream\b|\b(?:snapshot|copy|mirror|fork|import|clone|release|drop)\s+of\b|\bthird[\s-]party\b|\bunmodified\b|\bunchanged\b|\bverbatim\b|\bas[\s-]is\b|\b(?:own|original|its|their)\s+(?:authors?|maintainers?|project|repository)\b|\bthe\s+[\w.+-]+\s+(?:authors|contributors|developers|project)\b"
    r"|\bmaintained\s+(?:elsewhere|upstream|by)\b|\blocal\s+(?:patches|changes|modifications|edits)\b|\bnext\s+(?:sync|import|update|upgrade)\b|\b(?:[üu]e?bernommen|unver[äa]e?ndert|kopie\s+von|fremdcode|mitgeliefert)\b|\b(?:copi[ée]e?|repris|import[ée]e?|tir[ée]e?)\s+d[eu']|\bcopie\s+de\b|\b(?:copiad[oa]|tomad[oa]|importad[oa]|tra[íi]d[oa])\s+de\b|\bcopia\s+de\b|\bsin\s+cambios\b|\bsans\s+modification"
)
#: Alone enough: what only the code of others says.
_THEIRS = re.compile(
    r"(?i)\bnot\s+part\s+of\s+(?:this|our|the)\s+(?:project|repository|code\s*base|tree|product)\b|\b(?:this\s+(?:file|code)\s+(?:is|was|comes|belongs|originates)\b[^.]*\b(?:upstream|third[\s-]party|another\s+project|external\s+project|vendored))|\bthird[\s-]party\s+(?:code|file|source|library)\b[^.]*(?:\bdo\s+not\b|\bdon'?t\b|\bupstream\b|\bunmodified\b|\bunchanged\b)"
    r"|\b(?:vendored|imported|copied|taken|synced|pulled)\s+(?:verbatim\s+|unchanged\s+|unmodified\s+|as[\s-]is\s+|directly\s+)*from\s+(?:upstream|another\s+project|https?://|git@|github\.com)|\b(?:send|report|submit)\s+(?:\w+\s+){0,3}(?:upstream|to\s+(?:its|their)\s+own\s+authors)\b|\bteil\s+eines\s+anderen\s+projekts\b|\bd'un\s+autre\s+projet\b|\bde\s+otro\s+proyecto\b|\bnicht\s+teil\s+dieses\s+projekts\b|\bne\s+fait\s+pas\s+partie\s+de\s+ce\s+projet\b|\bno\s+(?:es|forma)\s+parte\s+de\s+este\s+proyecto\b"
)
#: One of these words or phrases is in every line that counts, as each rule's alternatives need one: looked for before anything else.
_HINTS = (
    "generated", "autogen", "erzeugt", "generiert", "erstellt", "géner", "génér", "genér", "genere", "generé", "produi", "producid", "generad", "generato", "gerado", "gerada", "prodotto", "buffer-read-only",
    "imported", "bundled", "vendored", "embedded", "copied", "taken", "pulled", "lifted", "mirrored", "forked", "synced", "included", "borrowed", "downloaded", "incorporated", "adopted", "shipped", "redistributed",
    "upstream", "unmodified", "unchanged", "verbatim", "bernommen", "unver", "fremdcode", "mitgeliefert",
)
_PHRASES = re.compile(
    r"(?:written|produced|created|emitted|rendered|synthesi[sz]ed|transpiled|compiled|built|made|output)\s+(?:\w+\s+){0,3}?(?:by|from|with|using|of|via)\b|(?:auto|machine|computer|tool)[\s-]*(?:written|made|created|produced)|product\s+of\b"
    r"|cr[ée][ée]e?\s+par|cread[oa]\s+por|not\s+(?:edit|modify|change|touch)|never\s+(?:edit|modify)|(?:snapshot|copy|mirror|fork|import|clone|release|drop)\s+of|third[\s-]party|as[\s-]is"
    r"|(?:own|original|its|their)\s+(?:author|maintainer|project|repository)|the\s+[\w.+-]+\s+(?:authors|contributors|developers|project)|maintained\s+(?:elsewhere|by)|local\s+(?:patches|changes|modifications|edits)|next\s+(?:sync|import|update|upgrade)"
    r"|kopie\s+von|(?:copi[ée]e?|repris|import[ée]e?|tir[ée]e?)\s+d[eu']|(?:copiad|tomad|importad|tra[íi]d)[oa]\s+de|copia\s+de|sin\s+cambios|sans\s+modification|part\s+of\s+(?:this|our|the)\b|(?:another|external)\s+project"
    r"|teil\s+(?:eines|dieses)|autre\s+projet|otro\s+proyecto|ce\s+projet|este\s+proyecto|\.\d+\s*[|(][^\n]*(?:licen|mit|bsd|apache)"
)


#: Each of the phrases holds one of these, or is looked for by itself: only lines that hold one are searched.
_ANCHORS = (
    "written", "produced", "created", "emitted", "rendered", "synthesi", "transpiled", "compiled", "built", "made", "output", "product", "cré", "cree", "creé", "cread", "edit", "modif", "change", "touch",
    "snapshot", "copy", "mirror", "fork", "import", "clone", "release", "drop", "third", "author", "maintain", "project", "repositor", "contributor", "developer", "local", "next", "kopie", "copi", "repris",
    "tire", "tiré", "tomad", "traíd", "traid", "cambios", "part", "teil", "projet", "proyecto",
)
_ALONE = (re.compile(r"as[\s-]is"), re.compile(r"\.\d+\s*[|(][^\n]*(?:licen|mit|bsd|apache)"))


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for a in _ANCHORS:
        found.add_word(a, False)
    for h in _HINTS:
        found.add_word(h, True)
    found.make_automaton()
    return found


def _hinted(text: str) -> bool:
    """Whether any line may be one that a rule accepts: one pass over the text for all words, and the phrases in the
    lines that hold one of theirs."""
    lower = text.lower()
    if not lower.isascii():  # letters that rules without letter case take for others
        lower = lower.replace("ſ", "s").replace("ı", "i").replace("i̇", "i")
    searched = -1
    for end, enough in _automaton().iter(lower):
        if enough:
            return True
        if end > searched:
            searched = lower.find("\n", end)
            searched = len(lower) if searched < 0 else searched
            if _PHRASES.search(lower, lower.rfind("\n", 0, end) + 1, searched):
                return True
    return any(p.search(lower) for p in _ALONE)


_BANNER = re.compile(r"(?im)^[\s/*#;!<>\-]*[\w.+-]+\s+v?\d+(?:\.\d+)+\s*[|(][^\n]*(?:licen[sc]ed?|\bMIT\b|\bBSD\b|Apache)")


def signed(comment: str) -> str | None:
    """`generated` or `vendored` if a line of a comment says so.

    A line must say that something was made, and by itself, by a tool with its version, from a source, or with a
    warning; or name a library with its version, and that it comes from elsewhere. To speak of making is not enough.
    """
    for line in re.split(r"\r\n|[\n\r]", comment):
        if not _hinted(line):
            continue
        if _MARK.search(line):
            return "generated"
        if _MADE.search(line) and not _STUB.search(line) and (_WARNED.search(line) or _BY_ITSELF.search(line)):
            return "generated"
        if _THEIRS.search(line) or _LIBRARY.search(line) and _FOREIGN.search(line) or _BANNER.search(line):
            return "vendored"
    return None


LONG_LINE = 200
#: Share of a file's code in long lines, and most of blanks in these, for a minified file.
LONG_SHARE, BLANK_SHARE = 0.6, 0.16
#: Least literals, and their share of all names and literals, for data.
DATA_LITERALS, DATA_SHARE = 40, 0.91
#: Contents with fewer characters than this are too common to show where they came from.
LEAST_WEIGHT = 48
_LINE_END = re.compile(r"[ \t]*(?:\r\n|\r|\n)")
_DQ = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")


@cache
def _lexer(path: str) -> tuple[re.Pattern, str]:
    lang = ENDINGS.get(path, "")
    # of unknown endings, the comments of most languages are told apart
    return re.compile(LEXERS.get(lang) or LEXERS["javascript"]), lang


def _comments(path: str, text: str) -> Iterator[str]:
    lexer, lang = _lexer(path.rsplit(".", 1)[-1].lower())
    if not lang:
        yield from (m[0] for m in re.finditer(r"(?m)^[ \t]*(?://|#|;|--|\*|/\*|<!--)[^\n\r]*", text))
        return
    hashes = lang in ("python", "ruby")
    first = True
    for t in lexer.findall(text):
        if hashes and t[0] == "#" or not hashes and t[:2] in ("//", "/*") and len(t) > 1 or hashes and t.startswith("=begin"):
            yield t
        elif first and lang == "python" and t[:3] in ('"""', "'''"):  # what stands for a header there
            yield t
        elif not t.isspace():
            first = False


def _is_data(path: str, text: str) -> bool:
    """Few names and many literals, comments apart."""
    lexer, lang = _lexer(path.rsplit(".", 1)[-1].lower())
    hashes = lang in ("python", "ruby")
    names = literals = 0
    for t in lexer.findall(text):
        c = t[0]
        if c.isdigit() or len(t) > 1 and c == ":" and t[1] in "\"'":
            literals += 1
        elif t[-1] in "\"'`" and len(t) > 1:
            # a blob is as good as a row of numbers
            literals += len(t) // 8 if len(t) > 64 and " " not in t else 1
        elif (c.isalpha() or c in "_$@") and not (hashes and c == "#"):
            names += 1
    return literals >= DATA_LITERALS and literals >= DATA_SHARE * (names + literals)


def evidence(path: str, text: str | None) -> str | None:
    """What shows, of itself, that a file is not written by hand here: `vendored`, `generated`, `minified`, `data`."""
    if _VENDOR_PATH.search(path):
        return "vendored"
    if m := _TOOL_NAME.search(path):
        return "minified" if ".min." in m[0] or "-min." in m[0] else "generated"
    if not text:
        return None
    if _hinted(text):
        for c in _comments(path, text):
            if why := signed(c):
                return why
    if len(text) > LONG_LINE:
        lines = _LINE_END.split(text)
        long = [x for x in lines if len(x) > LONG_LINE]
        if long and sum(map(len, long)) >= LONG_SHARE * sum(map(len, lines)):
            code = _DQ.sub("", "\n".join(x for x in long if not re.match(r"\s*(?://|/\*|#|\*|--)", x)))
            words = len(re.findall(r"[^\W\d]\w*", code))
            if len(code) > LONG_LINE / 2 and words >= 20 and sum(map(str.isspace, code)) < BLANK_SHARE * len(code):
                return "minified"
        if sum(map(str.isdigit, text)) * 6 > len(text) or len(text) * 2 < 5 * sum(len(s) for s in _DQ.findall(text)):
            if _is_data(path, text):
                return "data"
    return None


def signature(text: str) -> tuple[bytes, int]:
    """A hash of a content apart from line ends and blanks before them, and its number of visible characters."""
    plain = _LINE_END.sub("\n", text) if "\r" in text or " \n" in text or "\t\n" in text else text
    plain = plain.strip("\ufeff\n ")
    return xxhash.xxh3_128_digest(plain.encode("utf-8", "surrogatepass")), sum(map(len, plain.split()))


def file_evidence(files: DataFrame, newest: str = "mtime_ns") -> DataFrame:
    """(file_id, worktree_key, rel_path, sig, weight, why): one row per file, by its newest delivery; `why` is null
    where path and content show nothing. Contents are read once and not shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, texts = b.column("rel_path").to_pylist(), b.column("content").to_pylist()
            sigs = [signature(t or "") for t in texts]
            out = {n: b.column(n) for n in b.schema.names if n != "content"}
            out["sig"] = pa.array([s for s, _ in sigs], pa.binary())
            out["weight"] = pa.array([w for _, w in sigs], pa.int32())
            out["why"] = pa.array([evidence(p or "", t) for p, t in zip(paths, texts, strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    rows = files.select("file_id", "worktree_key", "rel_path", F.col(newest).alias("_at"), "content")
    seen = spread(rows).mapInArrow(run, "file_id bigint, worktree_key string, rel_path string, _at bigint, sig binary, weight int, why string")
    top = F.max(F.struct("_at", "sig", "weight", "why", "worktree_key", "rel_path")).alias("r")
    return seen.groupBy("file_id").agg(top).select("file_id", "r.worktree_key", "r.rel_path", "r.sig", "r.weight", "r.why")


def merkle_directories(files: DataFrame, levels: int, place: str) -> DataFrame:
    """(worktree_key, dir, h1, h2, n): the hash of every directory, from the names and hashes of what it holds, bottom-up,
    and the number of files of some weight below it.

    One path of one worktree is one file, whatever the number of its ids. A directory's hash is that of the number of
    its children and of the exclusive or of hashes of their (name, hash): names in a directory differ, so nothing
    cancels, no order is needed, and a directory of any size is summed before its shuffle. The files are written by
    level, and each level is one aggregation over what lies on it and the directories of the level below, written in
    turn, so that nothing is read twice and no plan repeats another. There are as many steps as the deepest path has
    segments. The root is no subtree.
    """
    spark = files.sparkSession
    parts = F.split("rel_path", "/")
    one = files.groupBy("worktree_key", "rel_path").agg(F.max(F.struct("weight", "sig")).alias("r")).select("worktree_key", "rel_path", "r.*")
    leaf = one.select(
        "worktree_key", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("dir"), F.element_at(parts, -1).alias("name"), F.size(parts).alias("level"),
        F.xxhash64("sig").alias("h1"), F.xxhash64(F.lit(1), "sig").alias("h2"), (F.col("weight") >= LEAST_WEIGHT).cast("long").alias("n"),
    )
    leaf.where("level > 1").hint("rebalance", "level").write.partitionBy("level").parquet(f"{place}/files")
    leaves, below, done = spark.read.parquet(f"{place}/files"), None, []
    combined = lambda *of: F.bit_xor(F.xxhash64(*of))
    for level in range(levels, 1, -1):
        here = leaves.where(F.col("level") == level).drop("level")
        nodes = here if below is None else here.unionByName(below)
        dirs = nodes.groupBy("worktree_key", "dir").agg(combined("name", "h1").alias("h1"), combined("h2", "name").alias("h2"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"))
        dirs.select("worktree_key", "dir", F.xxhash64("h1", "c").alias("h1"), F.xxhash64("c", "h2").alias("h2"), "n").write.parquet(f"{place}/{level}")
        done.append(f"{place}/{level}")
        dirs, up = spark.read.parquet(done[-1]), F.split("dir", "/")
        below = dirs.where(F.size(up) == level - 1).select("worktree_key", F.array_join(F.slice(up, 1, F.size(up) - 1), "/").alias("dir"), F.element_at(up, -1).alias("name"), "h1", "h2", "n")
    return spark.read.parquet(*done)


def shared_subtrees(dirs: DataFrame, worktrees: DataFrame) -> DataFrame:
    """(worktree_key, dir) of subtrees with two or more files of some weight that stand in unrelated repositories too.
    Worktrees of one repository are related; one of unknown repository is related to none but itself."""
    repo = worktrees.groupBy("worktree_key").agg(F.max("repo_id").alias("repo"))
    known = dirs.where(F.col("n") >= 2).join(repo, "worktree_key", "left").withColumn("repo", F.coalesce("repo", "worktree_key"))
    shared = known.groupBy("h1", "h2").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).where(F.col("a") != F.col("b")).select("h1", "h2")
    return known.join(shared, ["h1", "h2"], "left_semi").select("worktree_key", "dir")


def not_handwritten(files: DataFrame, worktrees: DataFrame, path: Column | None = None) -> DataFrame:
    """(file_id, why) of every current file that is not hand-written source of its project.

    By header, layout, name and path (`evidence`); by a directory shared between unrelated repositories (`shared tree`);
    or by having the content of a file that shows evidence (`copy`). Empty and tiny contents show nothing. Null contents
    count as empty, null paths have no evidence but their content; an empty table gives no rows.
    """
    spark = files.sparkSession
    place = scratch(spark, "evidence")
    clean = files.withColumn("rel_path", F.coalesce(path if path is not None else F.col("rel_path"), F.lit("")))
    file_evidence(clean).write.parquet(place)
    # few bytes per file, read by each level instead of the contents
    nodes = spark.read.parquet(place)
    levels = nodes.agg(F.max(F.size(F.split("rel_path", "/")))).first()[0] or 0
    own = nodes.where(F.col("why").isNotNull()).select("file_id", "why")
    marked = nodes.where(F.col("why").isNotNull()).select("sig", "weight")
    if levels > 1:
        trees = shared_subtrees(merkle_directories(nodes, levels, scratch(spark, "merkle")), worktrees)
        parts = F.split("rel_path", "/")
        above = nodes.where(F.size(parts) > 1).select("file_id", "sig", "weight", "worktree_key", "rel_path").select(
            "file_id", "sig", "weight", "worktree_key", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("dir")
        )
        inside = above.join(trees, ["worktree_key", "dir"], "left_semi")
        own = own.unionAll(inside.select("file_id", F.lit("shared tree").alias("why")))
        marked = marked.unionAll(inside.select("sig", "weight"))
    marked = marked.where(F.col("weight") >= LEAST_WEIGHT).select("sig").distinct()
    copies = nodes.where(F.col("weight") >= LEAST_WEIGHT).join(marked, "sig", "left_semi").select("file_id", F.lit("~copy").alias("why"))
    # evidence of its own comes before `~copy` in the order of letters
    return own.unionAll(copies).groupBy("file_id").agg(F.min("why").alias("why")).withColumn("why", F.ltrim(F.translate("why", "~", "")))
