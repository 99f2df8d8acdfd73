import random
import re

import pytest

from symloom.functions import enrich, lexer
from symloom.operators import parse


def syms(source, family):
    return {s.name: s for s in lexer.symbols(source, family)}


def test_rust():
    s = syms("pub struct A<'a> { pub x: &'a str, y: u8 }\nimpl<'a> A<'a> {\n    const N: usize = 3;\n    pub fn new(mut p: u8, q: &str) -> A { let z = 1; if let Some(w) = z { } A { x: q, y: p } }\n}\ntrait T { fn m(&self); }\nenum E { One, Two(u8) }\nmod m { static S: u8 = 1; }\ntype U = u8;\n", "rust")
    assert (s["A"].kind, s["A"].visibility) == ("Struct", "Public")
    assert (s["new"].kind, s["new"].container, s["new"].depth, s["new"].visibility) == ("Method", "A", 1, "Public")
    assert (s["x"].kind, s["x"].def_keyword, s["x"].container) == ("Variable", "field", "A")
    assert s["p"].def_keyword == "parameter" and s["z"].def_keyword == "variable" and s["w"].depth >= 2
    assert s["One"].kind == "Constant" and s["E"].kind == "Enum" and s["T"].kind == "Trait" and s["U"].kind == "TypeAlias" and s["m"].kind in ("Method", "Module")


def test_go_python_ruby():
    g = syms('package p\n\ntype Server struct {\n\tName string\n}\n\nfunc (s *Server) Start(x int) error {\n\treturn nil\n}\n\nfunc helper() {}\n\nvar Limit = 3\n', "go")
    assert (g["Start"].kind, g["Start"].container, g["Start"].visibility) == ("Method", "Server", "Public")
    assert g["helper"].visibility == "Private" and g["Server"].kind == "Struct" and "x" not in g and g["Limit"].kind == "Variable"
    p = syms("LIMIT = 3\nclass A:\n    def _f(self, a, b=1, *c):\n        x = 1\n        for i in a:\n            pass\n\ndef g():\n    pass\n", "python")
    assert (p["_f"].kind, p["_f"].container, p["_f"].visibility) == ("Method", "A", "Private")
    assert p["LIMIT"].kind == "Constant" and p["x"].depth == 2 and p["a"].container == "_f" and p["g"].kind == "Function" and "self" not in p and "i" in p
    r = syms("module M\n  X = 1\n  class A\n    def f(a)\n      if a\n        b\n      end\n    end\n    def self.g; end\n  end\nend\ndef top\nend\n", "ruby")
    assert r["f"].container == "A" and r["g"].container == "A" and r["X"].container == "M" and (r["top"].kind, r["top"].container) == ("Function", None)


def test_c_family():
    c = syms('#define MAX 3\n#define SQ(x) ((x)*(x))\ntypedef int (*handler)(void *, int);\ntypedef struct { int a; } Buf;\nstruct node { int v; struct node *next; };\nenum color { RED, GREEN };\nstatic int count = 0;\nint *find(struct node *n, int key)\n{\n    int i = 0, j;\n    if (key) { int deep = 1; }\n    return 0;\n}\nint proto(int);\n', "clike")
    assert c["MAX"].def_keyword == c["SQ"].def_keyword == "enum" and c["handler"].kind == "TypeAlias" and c["Buf"].kind == "TypeAlias"
    assert c["node"].kind == "Struct" and c["v"].container == "node" and c["RED"].kind == "Constant" and c["count"].visibility == "Private"
    assert c["find"].kind == "Function" and c["n"].def_keyword == "parameter" and c["i"].container == "find" and c["j"].def_keyword == "variable" and c["deep"].depth > c["i"].depth and "proto" not in c
    k = syms("namespace ns { class A { int x; public: void f(int a) { } private: int y; }; struct B { int z; }; }\n", "clike")
    assert k["x"].visibility == "Private" and k["f"].visibility == "Public" and k["z"].visibility == "Public" and k["A"].kind == "Class"


def test_js_and_java():
    j = syms("export function f(a, {b}) { const x = 1; let y = /[{(]+$/; }\nclass A { m(q) { } static n = 2; }\nconst g = (z) => { return z; };\nexport const K = 3;\n", "jsts")
    assert (j["f"].visibility, j["f"].kind) == ("Public", "Function") and j["m"].container == "A" and j["g"].kind == "Function" and j["K"].kind == "Constant" and j["x"].depth == 1
    v = syms("public class A extends B {\n  private int x = 1;\n  public A(int a) { int y = a; for (String s : b) { } }\n  enum E { ONE, TWO }\n  interface I { void run(); }\n}\n", "javacsharp")
    assert v["x"].visibility == "Private" and v["x"].container == "A" and v["y"].depth == 2 and v["ONE"].kind == "Constant" and v["run"].container == "I" and v["s"].kind == "Variable"


def test_comments_and_texts_hold_no_symbols():
    assert syms('// fn a() {}\n/* fn b() {} */\nconst S: &str = "fn c() {}";\n', "rust").keys() == {"S"}
    assert syms("", "go") == {} and syms("# only\n", "python") == {}
    n = lexer.counters('x = "ab" # é\nñ = 1\n', "python")
    assert n == {"bytes": 21, "comment_bytes": 4, "string_bytes": 4, "ident_ascii": 1, "ident_unicode": 1}


def test_enrichment():
    src = ["/// One.", "/// Two.", "fn f(a: i32,", "     b: u8) -> R {", "", "// far", "", "fn g() {}"]
    assert enrich.doc_comment(src, 2, "rust") == "One.\nTwo." and enrich.doc_comment(src, 7, "rust") is None
    assert enrich.signature(src, 2, "rust") == "fn f(a: i32, b: u8) -> R" and enrich.signature(["struct S {"], 0, "rust") == "struct S"
    assert enrich.doc_comment(["def f():", '    """Told', "    more", '    """'], 0, "python") == "Told\nmore" and enrich.signature(["def f(a):"], 0, "python") == "def f(a)"
    assert enrich.doc_comment(["/**", " * A.", " * B.", " */", "int f();"], 4, "clike") == "A.\nB."
    assert enrich.signature(["typedef struct {", "  int a;", "} Buf;"], 2, "clike") == "typedef struct Buf"
    assert enrich.doc_comment(["/** One. */", "int f();"], 1, "clike") == "One." and enrich.doc_comment(["// a", "x();", "int f();"], 2, "clike") is None
    assert enrich.doc_comment(["# A.", "#", "# B.", "def f"], 3, "ruby") == "A.\n\nB." and enrich.doc_comment(["def f():", "    \"\"\"One.\"\"\""], 0, "python") == "One."
    assert enrich.doc_comment(["# Above.", "def f():", "    \"\"\"One.\"\"\""], 1, "python") == "Above." and enrich.doc_comment(["def f():", "    return 1"], 0, "python") is None
    assert enrich.doc_comment(["def f():", "    \"\"\"never closed", "    x"], 0, "python") == "never closed\nx"
    assert enrich.signature(["int f(int a,", "int b);", "int c;"], 0, "clike") == "int f(int a, int b);" and enrich.signature(["struct S;"], 0, "clike") == "struct S"
    assert enrich.signature(["f(a, function() { b", "}) {"], 0, "jsts") == "f(a, function() { b })"
    assert enrich.signature(["} x"], 0, "clike") == "x" and enrich.signature([], 3, "c") is None and enrich.signature(["f("] * 9, 0, "clike") == " ".join(["f("] * 5)


def walk_left(line, col):
    """The same answer by walking left from one column."""
    depth = commas = 0
    for k in range(col - 1, -1, -1):
        if line[k] == ")":
            depth += 1
        elif line[k] == "(" and depth:
            depth -= 1
        elif line[k] == "(":
            m = re.search(r"(?:(\w+) *(?:::|->|\.))?(\w+) *$", line[:k])
            return (m[2], m[1], commas) if m else None
        elif line[k] == "," and not depth:
            commas += 1
    return None


def test_call_sites_against_walking_left():
    rng = random.Random(4)
    for _ in range(300):
        line = "".join(rng.choice(["a", "b.c", "x::", "(", ")", ", ", " ", "("]) for _ in range(rng.randint(0, 14)))
        found = {col: tuple(rest) for col, *rest in enrich.call_sites(line)}
        assert found == {k + 1: walk_left(line, k + 1) for k, c in enumerate(line) if c in "()," and walk_left(line, k + 1)}, line


def test_tables(spark):
    doc = "/// Doc.\npub fn f(x: u8) { g(x) }\n"
    rows = [(1, "rs", doc, 2, "d"), (1, "rs", doc, 2, "d"), (1, "rs", "fn old() {}", 1, "e"), (2, "rs", doc, 1, "D"), (3, "txt", "fn f", 1, "f"), (4, "py", None, 1, None), (5, None, "x", 1, "g")]
    df = spark.createDataFrame(rows, "file_id long, ext string, content string, mtime_ns long, content_hash string")
    got = [(r["file_id"], r["name"], r["doc_comment"], r["scope_end_line"]) for r in parse.parse_symbols(parse.distinct_contents(df)).orderBy("file_id", "symbol_idx").collect()]
    assert got == [(1, "f", "Doc.", None), (1, "x", None, 1)]
    occ = {(r["word"], r["line"], r["col"]): r["role"] for r in parse.parse_occurrences(parse.distinct_contents(df.where("file_id = 1"))).collect()}
    assert occ["f", 1, 7] == "Definition" and occ["g", 1, 18] == "Reference" and ("Doc", 0, 4) not in occ
    assert parse.parse_symbols(df.where("false")).collect() == []
    counted = {r["ext"]: (r["files"], r["bytes"], r["comment_bytes"]) for r in parse.counters(df.where("mtime_ns <> 1")).collect()}
    assert counted == {"rs": (1, len(doc), 8)}


@pytest.mark.parametrize("family", ["rust", "clike", "go", "python", "jsts", "javacsharp", "ruby"])
def test_any_text_is_taken(family):
    for t in ("}{)(", "def class end", "fn", "{" * 500, "a" * 50_000, "'\"`/*", "\x00\ufeff日本 = 1"):
        lexer.symbols(t, family)
