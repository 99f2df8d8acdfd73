import signal
from contextlib import contextmanager

import pytest

from symloom.llm import docpairs as D
from symloom.llm.doctext import description, tells_something

EMPTY = [
    (None, "f"), ("", "f"), (" \n\t", "f"), ("TODO: document", "f"), ("FIXME", "f"), ("n/a", "f"), ("...", "f"), ("------", "f"), ("—", "f"), ("@return", "f"), ("@param a\n@return", "f"), (":param a:\n:return:", "f"), ("Args:\nReturns:", "f"),
    ("noqa: E501", "f"), ("eslint-disable-next-line no-x", "f"), ("clang-format off", "f"), ("Copyright (c) 2019 the team", "f"), ("SPDX-License-Identifier: MIT", "f"), ("All rights reserved.", "f"), ("return cur + 3;", "f"), ("for (i = 0; i < 3; i++) {\nx(i);\n}", "f"),
    ("int", "f"), ("char *", "f"), ("Collects the symbol.", "collect_symbol"), ("Function: parseDigest", "parseDigest"), ("setup()", "setup"), ("The init function.", "init"), ("Getter.", "f"), ("Helper.", "f"), ("[description]", "f"), ("Parameters\n----------", "f"), ("{@inheritDoc}", "f"), ("\u200b", "f"),
]
TOLD = [
    ("Safe to retry.", "f"), ("Returns milliseconds, not seconds.", "f"), ("Panics on an empty loader.", "load"), ("Der Suchlauf meldet den Editor.", "f"), ("解决名称并返回", "f"), ("Copyright (c) 2015 the team\nBlocks until the queue drains.", "f"), ("TODO: later\nTakes the lock.", "f"),
    ("@param limit how many\n@return the rest", "f"), ("# Errors\nFails without a root.\n# Examples\n`f(3)`", "f"), ("-------\nCaller frees the buffer.\n-------", "f"), ("Collects the symbol before the next scan.", "collect_symbol"), ("/** Not reentrant; may move. */", "f"),
]


@pytest.mark.parametrize("doc,name", EMPTY)
def test_nothing_told(doc, name):
    assert not tells_something(doc, name), description(doc, name)


@pytest.mark.parametrize("doc,name", TOLD)
def test_told(doc, name):
    assert tells_something(doc, name)


SRC = "// Not for x.\n\nint stop;\n// Takes the lock.\n// Twice.\nint f(int a)\n{\n    // inner\n    return g(a);\n}\n\n/* Far. */\nint between;\nint h(int a)\n{\n    return a;\n}\n"
PY = 'def f(a,\n      b):\n    """Told below."""\n    return a\n\n# Above.\n@deco\ndef g():\n    x = 1\n    """not a docstring"""\n    return x\n'


def test_spans_and_attachment(spark):
    files = spark.createDataFrame([(1, "a.c", 5, SRC, 0), (1, "a.c", 4, "// Old.\nint f(int a)\n{\n}\n", 0), (2, "b.py", 1, PY, 0), (2, "b.py", 1, PY, 0), (3, "c.c", 1, None, 0)], "file_id long, rel_path string, mtime_ns long, content string, line int")
    got = {(r["file_id"], r["line"]): (r["name"], r["doc_line"], r["text"]) for r in D.attached_comments(D.newest_spans(D.extract_spans(files), files)).collect()}
    assert got[1, 5] == ("f", 3, "// Takes the lock.\n// Twice.")
    assert got[1, 13] == ("h", None, None)  # a statement intervenes
    assert got[2, 0] == ("f", 2, '"""Told below."""')
    assert got[2, 7] == ("g", 5, "# Above.")
    assert len(got) == 4


def test_pairs(spark):
    s = "file_id long, symbol_idx int, name string, kind string, line int, col int, def_keyword string, doc_comment string, signature string"
    rows = [
        (1, 0, "f", "Function", 5, 4, "function", "Takes the lock.\nTwice.", "int f(int a)"), (1, 0, "f", "Function", 5, 4, "function", "Takes the lock.\nTwice.", "int f(int a)"), (1, 1, "stop", "Variable", 2, 4, "variable", "Takes the lock.", None),
        (1, 2, None, "Unknown", 13, 4, "function", "Returns it.", "int h(int a)"), (1, 3, "S", "Unknown", 13, 4, "struct", "Holds it well.", "struct S"), (1, 4, "m", "Method", 90, 0, "def", "Told elsewhere.", None), (1, 5, "collect_it", "Function", 90, 0, "fn", "Collects it.", None),
        (1, 6, None, "Function", 90, 0, "fn", "Collects it.", "fn collect_it()"), (None, 7, "g", "Function", None, None, None, "Told without a file.", None), (9, 8, "g", "Function", 1, 1, "fn", None, "fn g()"), (9, 9, "c", None, 1, 1, "fn", "Told by keyword.", None),
    ]
    files = spark.createDataFrame([(1, "a.c", 5, SRC)], "file_id long, rel_path string, mtime_ns long, content string")
    got = {(r["file_id"], r["symbol_idx"]): (r["doc_line"], r["from_source"]) for r in D.documented_functions(spark.createDataFrame(rows, s), files).collect()}
    assert got == {(1, 0): (3, True), (1, 2): (None, False), (1, 4): (None, False), (None, 7): (None, False), (9, 9): (None, False)}
    assert D.documented_functions(spark.createDataFrame(rows, s).where("false"), files.where("false")).collect() == []


def test_the_attached_comment_decides(spark, monkeypatch):
    src = "// TODO: say more.\nint f(int a)\n{\n}\n// Waits for the lock.\nint g(int a)\n{\n}\nint h(int a)\n{\n}\n"
    rows = [(1, 0, "f", "Function", 1, None, "Takes the lock.", "int f(int a)"), (1, 1, "g", "Function", 5, None, "TODO", "int g(int a)"), (1, 2, "h", "Function", 8, None, "Told once.", "int h(int a)"), (1, 3, "k", "Function", 8, None, None, "int k()")]
    symbols = spark.createDataFrame(rows, "file_id long, symbol_idx int, name string, kind string, line int, def_keyword string, doc_comment string, signature string")
    files = spark.createDataFrame([(1, "a.c", 5, src)], "file_id long, rel_path string, mtime_ns long, content string")
    found = lambda: {r["symbol_idx"]: (r["description"], r["from_source"]) for r in D.documented_functions(symbols, files).collect()}
    assert found() == {1: ("Waits for the lock.", True), 2: ("Told once.", False)}
    # without the join, other rows come out
    join = D.attached_comments
    monkeypatch.setattr(D, "attached_comments", lambda f, s: join(f.where("false"), s))
    assert found() == {0: ("Takes the lock.", False), 2: ("Told once.", False)}


def test_a_docstring_comes_before_what_stands_above(spark):
    files = spark.createDataFrame([(1, "a.py", 5, '# Above.\ndef f():\n    """Told below."""\n    return 1\n')], "file_id long, rel_path string, mtime_ns long, content string")
    assert [r["text"] for r in D.attached_comments(D.newest_spans(D.extract_spans(files), files)).collect()] == ['"""Told below."""']


def test_heads_of_any_length():
    head = "def f(\n" + "".join(f"    a{k},\n" for k in range(250)) + '):\n    """Told below."""\n    return 1\n'
    assert [x[1] for x in D.spans("a.py", head) if x[0] == "d"] == [252]


@contextmanager
def within(seconds):
    def late(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(seconds)
    try:
        yield
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


@pytest.mark.parametrize(
    "path,line",
    [
        ("a.c", "    " + " && ".join(["abc"] * 60) + ";"), ("a.c", "char " + ", ".join(["*abc"] * 60) + ";"), ("a.c", "x " + "*" * 60 + ";"), ("a.cc", "x = 1'000; printf(\"" + "%d\\n" * 40 + '", x);'),
        ("a.c", "int g(" + "a," * 60_000 + "b) = 3;"), ("a.java", "g(" + "a," * 40_000 + "b); x;"), ("a.cs", "g(" + "a," * 40_000 + "b) = 3;"), ("a.js", "g(" + "a):b," * 40_000 + "b);"), ("a.go", "/* " * 60_000),
    ],
)
def test_a_line_takes_time_in_proportion(path, line):
    with within(10):
        assert [x for x in D.spans(path, line + "\n") if x[0] == "f"] == []


@pytest.mark.parametrize(
    "path,line,name",
    [
        ("a.c", "static int *f(int a,", "f"), ("a.cc", "std::map<a, b> A::B::~g (c) const {", "A::B::~g"), ("a.c", "char **argv(void)", "argv"), ("a.c", "f(a)", None), ("a.c", "int f(a);", None), ("a.java", "public List<A> f(B b) throws C {", "f"), ("a.java", "f(b); {", None),
        ("a.js", "async f(a = {b: 1}): Promise<c> {", "f"), ("a.js", "f(a): {b: c} {", None), ("a.js", "f({a: b}) {", "f"), ("a.js", "f(a):{", None), ("a.ts", "f(a): b {", "f"),
    ],
)
def test_definitions(path, line, name):
    assert [x[4] for x in D.spans(path, line + "\n") if x[0] == "f"] == ([name] if name else [])


def test_literals_with_prefixes_and_conflicts():
    comments = lambda path, text: [x[5] for x in D.spans(path, text) if x[0] in "cd"]
    assert comments("a.c", 'x = R"(\n// in\n)";\ny = u8"//";\nz = L\'"\';\n// out\n') == ["// out"]
    assert comments("a.py", 'def f():\n    Rb"""no"""\n    x = rb"#" + f\'#\'\n# out\n') == ["# out"]
    assert comments("a.rs", 'let x = r#"\n// in\n"#;\nlet y = br"//";\n// out\n') == ["// out"]
    assert comments("a.rb", "x == y\n=begin\nOut.\n=end\n") == ["=begin\nOut.\n=end"]
    assert comments("a.js", "<<<<<<< don't\n// out\n") == ["// out"]
    assert comments("a.go", "/* in */\nx /* never closed\n// out\n") == ["/* in */", "// out"]


def test_a_comment_takes_time_in_proportion():
    with within(10):
        assert tells_something("return a " + "-" * 80 + " or what is left, without waiting.", "f")
        assert tells_something("Waits" + " " * 100_000 + "=" * 100_000 + " for the lock.", "f")
    assert not tells_something("return a - -b[1] + c.d(e);", "f")


def test_no_window_looks_ahead_from_each_row_anew(spark):
    files = spark.createDataFrame([(1, "a.py", 5, PY)], "file_id long, rel_path string, mtime_ns long, content string")
    plan = D.attached_comments(D.newest_spans(D.extract_spans(files), files))._jdf.queryExecution().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
