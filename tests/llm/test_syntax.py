import ast
import random

import pytest

from symloom.llm import syntax as S

GOOD = {
    "python": ["", "# only a comment\n", "x = 1\n", 'async def f(a, *, b: int = 2, **k) -> int:\n    """d"""\n    with g(a) as h, i:\n        return [y async for y in z if y]\n\n@d(1)\nclass A(B, metaclass=M):\n    x: int = 3\n    def g(self): return lambda q, r=1: q if r else -q\n', "try:\n    pass\nexcept (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass\n", "match p:\n    case [1, *r] if r:\n        pass\n    case {'k': v}:\n        pass\n    case _:\n        pass\n", 'SAMPLE = """\n<<<<<<< ours\n=======\n>>>>>>> theirs\n"""\n', "if a:\n\tb()\nelif c: d(); e()\nelse:\n\tf(**{'a': 1}, *x)\n", "x = {**a, 'b': c, **d}\ny = {*a, 1}\nz = x[1:2, ::3]\n"],
    "rust": ["", "// c\n", "pub fn f<'a, T: Clone + 'a>(x: &'a str, n: usize) -> Result<Vec<u8>, Error> where T: Copy {\n let mut v: Vec<u8> = Vec::with_capacity(n);\n while let Some(x) = it.next() { if x == 3 { break; } }\n match n { 0 => g(\"/* x\"), 1..=9 | 12 => { v.push(b'}'); } _ if n > 3 => {}, _ => {} }\n let s = a.iter().filter(|x| **x != 3).map(|x| x + 1).sum::<u64>();\n println!(\"{} {{\", s);\n Ok(v)\n}\n", "#[derive(Debug)]\npub(crate) struct A<'a> { pub x: &'a str, y: [u8; 3], }\nimpl<'a> A<'a> { const N: usize = 3; fn f(&self) -> u8 { self.y[0] as u8 } }\nenum E { A, B(u8), C { x: i32 }, D = 3 }\nuse a::{b, c as d, e::*};\n", "fn f() { let r = r#\"a \"q\" // x\"#; let c = '\\''; for i in 0..n { x += i; } let t = S { a: 1, ..d }; if let Some(x) = y { z(x) } else { return Err(\"}\".into()); } }\n"],
    "go": ["package a\n", "// c\npackage a\n\nimport (\n\t\"b\"\n\tc \"d/e\"\n)\n\ntype T struct {\n\ta, b int `json:\"x\"`\n\t*E\n}\n\nfunc (t *T) F(a int, b ...string) (int, error) {\n\tfor i := 0; i < 3; i++ {\n\t\tg(i)\n\t}\n\tswitch x := y.(type) {\n\tcase int, string:\n\t\tbreak\n\tdefault:\n\t}\n\tgo func() {\n\t\th()\n\t}()\n\tm := map[string]int{\"a\": 1}\n\tif v, ok := m[\"a\"]; ok && v > 1 {\n\t\treturn v, nil\n\t} else if !ok {\n\t\treturn 0, errors.New(\"x\")\n\t}\n\tvar e []byte = make([]byte, 3)\n\tdefer f(c, '{')\n\treturn len(e), nil\n}\n"],
    "javascript": ["", "\"use strict\";\n", "export default async function f(a, { b = 1, ...c }, [d] = []) {\n  const r = /[{(]+$/.test(a);\n  for (let i = 0; i < 3; i++) { g(i, (x) => x * 3); }\n  switch (a) {\n    case 1:\n      h();\n      break;\n    default:\n  }\n  try { x() } catch { y() } finally { z() }\n  const o = { a, b: 1, f() { return 2 }, get c() { return 3 }, ['d']: 4, async *e() {} };\n  let s = `a ${b + `${c}`} d`\n  return a?.b ?? c ? d : e\n}\n", "class A extends B {\n  #x = 1;\n  static y = 2;\n  constructor(a) { super(a); this.#x = a }\n  async m() { await n() }\n}\nimport a, { b as c } from 'd';\nexport { a, c as default };\n", "interface I<T> { a: string; b?: number; c(x: T): void }\ntype U = 'a' | { b: number } | Array<string>;\nenum E { A, B = 2 }\nfunction g<T>(x: T, y?: string): Promise<T[]> { return x as any; }\nconst h = (a: number): string => `${a}`;\n", "if (a)\n  b()\nelse\n  c()\ndo { d() } while (e)\nvar f = function () {}, g\n"],
    "java": ["", "package a.lock;\nimport java.util.*;\nimport static a.B.c;\n/** d */\n@A(x = 1)\npublic final class B<T extends C> extends D implements E, F {\n  private static final int[] X = { 1, 2, };\n  static { f(); }\n  public B(int a) throws G { super(a); this.x = a; }\n  protected <S> List<Map<String, S>> m(final int a, String... b) {\n    for (int i = 0; i < 3; i++) { g(h, i); }\n    for (String s : b) continue;\n    while (a != 3) { b = c(d); }\n    try (R r = new R()) { x(); } catch (E | F e) { y(e, 1); } finally { }\n    int[][] q = new int[3][];\n    Runnable r = () -> { z(); };\n    Object o = (Object) r;\n    switch (a) { case 1: return null; default: break; }\n    return a > 3 ? list.stream().map(B::n).toList() : null;\n  }\n  enum K { A(1) { void f() {} }, B; int v; }\n}\n"],
    "csharp": ["using System;\nusing X = A.B<int>;\nnamespace N { [Attr(1)] public class A : B, IC { public int P { get; private set; } = 3; private readonly int[] x = { 1, 2 }; public static int F(int a, out string b) { var c = new List<int> { 1, 2 }; foreach (var d in c) { G(d); } return a ?? b?.Length ?? 0; } public string E => $\"x{1}\"; } }\n", "class A { void F() { Func<int, int> f = x => x + 1; lock (o) { } if (o is B b && b.C) throw new E(); } }\n"],
    "c": ["", "#include <a.h>\n#define X(a) do { a; } while (0)\n/* c */\ntypedef int (*cb)(void *, int);\ntypedef struct { int a; char b[3]; } T, *PT;\nstatic const unsigned char d[] = { 0x1, 2, [3] = 4 };\nextern int f(struct s *self, size_t n)\n{\n    int i, *p = &x[0];\n    while (a && a != 3) { b = g(b, ')'); }\n    do { a -= 3; } while (a > 0);\n    switch (a) { case 3: h(a); break; default: break; }\n    memset(a, 0, sizeof(*a));\n    for (int i = 0; i < 3; i++) if (i) continue; else break;\n    c = (b << 2) | 0x1fu;\n    return (int)a ? -1 : (struct s *)p == 0;\n}\n#ifdef A\nint g(void) {\n#else\nint g(int a) {\n#endif\nreturn 0; }\n", "namespace a { template <typename T> class B : public C<T> { public: explicit B(int x) : y(x) {} virtual ~B() = default; int f() const override { return std::max<int>(y, 2); } private: std::vector<std::pair<int, T>> v; }; }\nauto l = [&](int x) -> int { return x; };\nenum class E : int { A = 1, B };\n"],
    "ruby": ["", "=begin\n<<<<<<< x\n=end\nrequire \"a/b\"\n\nclass A < B\n  attr_reader :a, :b\n  X = [1, 2].freeze\n  def self.f(a, b = 1, *c, d: 2, &e)\n    return nil unless a\n    x = { key: 1, rest: [a] }\n    a.each do |y|\n      g(y, 3)\n    end\n    if a > 3 then b elsif c\n      d\n    else\n      e\n    end\n    while a != 3\n      a = h(a)\n    end\n    begin\n      i(a)\n    rescue StandardError => e\n      j = 1\n    ensure\n      k\n    end\n    case a\n    when 1, 2 then :x\n    else puts \"a #{b['c']}\"\n    end\n    [1].map { |z| z + 1 }.select(&:odd?)\n  end\nend\n"],
}
WORDS = {"python": "def f(:\n", "rust": "fn f( {}\n", "go": "package a\nfunc f( {}\n", "javascript": "function f( {}\n", "java": "class A { int f( {} }\n", "csharp": "class A { int f( {} }\n", "c": "int f( {}\n", "ruby": "def f(\nend\n"}


@pytest.mark.parametrize("name", GOOD)
def test_valid_texts_parse(name):
    for text in GOOD[name]:
        f = S.failure(text, name)
        assert f is None, (text, f)
        assert S.failure(text.replace("\n", "\r\n"), name) is None


@pytest.mark.parametrize("name", GOOD)
def test_broken_texts_do_not(name):
    base = max(GOOD[name], key=len)
    assert S.failure(WORDS[name], name) is not None
    assert S.failure("The night build confirmed that nobody reads this.\nIt is prose, after all.\n", name) is not None
    lines = base.split("\n")
    half = len(lines) // 2 if name != "java" else 5
    conflict = [*lines[:half], "<<<<<<< HEAD", *lines[half : half + 1], "=======", ">>>>>>> branch", *lines[half + 1 :]]
    if name not in ("c", "csharp"):
        f = S.failure("\n".join(conflict), name)
        assert f is not None and f.cause == "merge conflict"


def test_python_agrees_with_the_compiler():
    rng = random.Random(3)
    for text in GOOD["python"]:
        for _ in range(150):
            k = rng.randrange(len(text) + 1)
            cut = text[:k] if rng.random() < 0.5 else text[:k] + rng.choice([")", "(", "=", ":", "]", " "]) + text[k:]
            try:
                ast.parse(cut)
                ok = True
            except (SyntaxError, ValueError):
                ok = False
            mine = S.failure(cut, "python") is None
            # a few rules of the compiler are no rules of syntax trees: these may only make mine more lenient
            assert mine or not ok, cut


def test_furthest_failure_and_engines_agree():
    f = S.failure("x = 1\ny = (2\nz = 3 +\n", "python")
    assert f is not None
    f = S.failure("fn a() {\n    let x = 3;\n    let y = ;\n}\n", "rust")
    assert (f.line, f.cause) == (2, "unexpected token")
    for name, texts in GOOD.items():
        lang = S.language(name)
        for t in texts:
            tokens = lang.tokens(t)
            assert lang.grammar.furthest(tokens) < 0 or not tokens
            assert lang.grammar.accepts(tokens)


def test_table(spark):
    c = "class A { }\n"
    rows = [
        (1, "w", "a.py", 1, "x = (", 0), (1, "w", "a.py", 2, "x = 1", 0), (2, "w", "b.py", 2, "x = (", 0), (2, "w", "b.py", 1, "x = 1", 0), (2, "w", "b.py", 2, "x = (", 0), (3, "v", "c.txt", 1, "((", 0),
        (4, "v", "d.java", 1, c, 0), (5, "v", "e.RS", 1, c, 0), (6, "v", "f.go", 1, None, 0), (7, "v", "g.go", 1, "", 0), (8, None, "noending", 1, "(", 0), (9, None, "h.c", None, "int x;", 0),
    ]
    df = spark.createDataFrame(rows, "file_id long, worktree_key string, rel_path string, mtime_ns long, content string, ok int")
    found = S.syntax_failures(df)
    assert sorted(r["file_id"] for r in found.where("not ok").collect()) == [2, 5]
    rates = {(r["repo_id"], r["language"]): (r["files"], r["failed"]) for r in S.failure_rates(found, spark.createDataFrame([("r", "w"), ("r", "w")], "repo_id string, worktree_key string")).collect()}
    assert rates[("r", "python")] == (2, 1) and rates[(None, "rust")] == (1, 1)
    assert S.syntax_failures(df.where("false")).collect() == []


C_CONDITIONALS_GOOD = [
    "#ifndef A_H\n#define A_H\n#ifdef __cplusplus\nextern \"C\" {\n#endif\nint f(void);\n#ifdef __cplusplus\n}\n#endif\n#endif /* A_H */\n",
    # the same condition is answered alike, so that the braces match in both readings
    "int f(int a) {\n#ifdef A\n  if (a) {\n#endif\n  g();\n#if defined(A)\n  }\n#else\n  h();\n#endif\n  return 0;\n}\n",
    "#ifdef A\nint f(void) {\n#else\nint f(int a) {\n#endif\n#ifndef A\n  a = 1; }\n#else\n  return 0; }\n#endif\n",
    # no directives: in comments, in texts that go on, in raw texts
    "/*\n#if x\n#else\n*/\n// a \\\n#endif\nchar *a = \"b\\\n#if c\\\n\";\nauto r = R\"(\n#endif\n)\";\n#define X \\\n#if\nint b;\n",
    "/* c */ #if A\nint a;\n/* d\n*/ #endif\n",
    "#if A\nint a;\n#elif B \\\n  && C\nint b;\n#elif D\nint c;\n#else\n#error no \"A\" here\n#endif\n",
]
C_CONDITIONALS_BAD = {
    "int a;\n#ifdef A\nint b;\n#else\n<<<<<<< HEAD\nint c;\n=======\nint d;\n>>>>>>> x\n#endif\n": (4, "merge conflict"),
    "#ifndef A_H\n#define A_H\nint f(void);\nint g(void);\n": (4, "truncated"),
    "#if A\nint f(void) { return 0; }\n#else\nint f(void) {\n": (4, "truncated"),
    "#if A\nint a;\n#else\nint f = ;\n#endif\n": (3, "unexpected token"),
    "#if A\nint a;\n#elif B\nint b;\n#elif C\nint f = ;\n#endif\n": (5, "unexpected token"),
    "#ifndef G\n#if A\nint a;\n#else\nint b;\n#endif\nint c;\n#if B\n#if C\nint d;\n#else\nint f = ;\n#endif\n#else\nint e;\n#endif\n#endif\n": (11, "unexpected token"),
    "int a;\n#endif\n": (1, "unexpected token"),
    "int a;\n#else\nint b;\n": (1, "unexpected token"),
    "#if A\n#else\n#elif B\n#endif\n": (2, "unexpected token"),
    # a branch that no answer of the conditions reaches is read too
    "#ifdef A\n#ifndef A\nint f = ;\n#endif\n#endif\n": (2, "unexpected token"),
}


def test_every_branch_of_a_conditional_is_read():
    for text in C_CONDITIONALS_GOOD:
        for t in (text, text.replace("\n", "\r\n")):
            assert S.failure(t, "c") is None, (t, S.failure(t, "c"), S.language("c").readings(t))
    for text, (line, cause) in C_CONDITIONALS_BAD.items():
        for t in (text, text.replace("\n", "\r\n")):
            f = S.failure(t, "c")
            assert f is not None and (f.line, f.cause) == (line, cause), (t, f)
            assert S.failure(t, "c", explain=False) is not None and not S.language("c").parses(t)
    many = "int a;\n" + "#if A\nint b;\n#elif B\nint c;\n#else\nint d;\n#endif\n" * 50
    assert len(S.language("c").readings(many)[0]) == 3


HELD_GOOD = {
    "javascript": ["let s = `a ${b + `c ${d.map((x) => `${x}`)} }`} e`;\n", "let s = `\\${ not code`;\n", "let s = `${ {a: 1}.a }`;\n"],
    "ruby": ['puts "a #{b[\'c\']} #{d.map { |x| x + 1 }}"\n', "puts 'a #{b'\n", 'puts "#{}"\n', "x = <<~TEXT\n  a #{b}\nTEXT\n"],
    "python": ["x = f'{a!r:>{w}} {{b}} {c=} {d[\"k\"]:%Y-%m-%d}'\n", "x = rf'{a}\\d{{2}}'\n", "x = f'{(lambda y: y)(1)}' '{ not code'\n", "x = f'\\N{DASH}{a if b else c}'\n", 'x = f"""\n{a}\n"""\n', "x = f'{a != b}'\n", "x = f'{*a,}'\n"],
    "csharp": ['class A { string s = $"a {b,3:N2} {(c ? d : e)} {{f}}"; string t = $@"{g(1)}\\"; string u = "{ not code"; }\n'],
}
HELD_BAD = {
    "javascript": {"let a = 1;\nlet s = `a ${b +} c`;\n": 1, "let s = `${`${+}`}`;\n": 0, "let s = `\n${}`;\n": 1},
    "ruby": {'x = 1\nputs "a #{b +} c"\n': 1, "x = <<~TEXT\n  a\n  #{b = }\nTEXT\n": 2},
    "python": {"x = 1\ny = f'{a +}'\n": 1, "x = f'{}'\n": 0, "x = f'{a:{b c}}'\n": 0, 'x = f"""\n{a b}\n"""\n': 1},
    "csharp": {'class A {\n string s = $"{b +}"; }\n': 1},
}


@pytest.mark.parametrize("name", HELD_GOOD)
def test_code_within_literals_is_parsed(name):
    for text in HELD_GOOD[name]:
        assert S.failure(text, name) is None, (text, S.failure(text, name), list(S.language(name).held(text)))
    for text, line in HELD_BAD[name].items():
        f = S.failure(text, name)
        assert f is not None and f.line == line, (text, f, list(S.language(name).held(text)))
        assert S.failure(text, name, explain=False) is not None
