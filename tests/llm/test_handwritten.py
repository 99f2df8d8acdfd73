import random
import re

from symloom.llm import handwritten as H

CODE = "int add(int a, int b)\n{\n    int total = a + b;\n    return total;\n}\n\nint sub(int a, int b)\n{\n    return a - b;\n}\n"


def test_evidence_and_what_only_looks_like_it():
    signed = "// Code generated by tool v1.2. DO NOT EDIT.\n" + CODE
    assert H.evidence("src/a.c", signed) == "generated"
    assert H.evidence("src/a.c", CODE + "// @generated by tool\n") == "generated"
    assert H.evidence("src/a.py", '"""This file was automatically generated by x from y.idl"""\nx = 1\n') == "generated"
    assert H.evidence("src/a.c", "/* libfoo 1.2.3, imported unchanged from upstream */\n" + CODE) == "vendored"
    assert H.evidence("src/a.rb", "# Bundled copy of libfoo 1.2.3; report problems to its own authors\nx = 1\n") == "vendored"
    for p in ("vendor/x/a.c", "deps/libx/a.c", "external/libx-1.2/src/b.rs", "src/third-party/b.rs", "contrib/bundled/l/c.go", "a/node_modules/b/d.js"):
        assert H.evidence(p, CODE) == "vendored"
    for p in ("a/b.pb.go", "x_pb2.py", "zz_generated.a.go", "FooGrpc.java", "web/out/main-3ab4c.js"):
        assert H.evidence(p, "") == "generated"
    assert H.evidence("a/x.min.js", "") == "minified"
    plain = [
        ("src/a.c", 'static const char *banner = "/* Code generated by us. DO NOT EDIT. */";\n' + CODE), ("src/a.c", "// generated ids start at 3\n" + CODE), ("src/a.c", "// do not edit the ring by hand, call this instead\n" + CODE),
        ("src/a.c", "// Helper for code that gets generated by the loader.\n" + CODE), ("src/a.java", "class A {\n  // TODO Auto-generated method stub\n  int x;\n}\n"), ("vendors/a.c", CODE), ("lib/external_auth/a.c", CODE), ("dist_lock/a.c", CODE), ("src/deps/graph.py", CODE), ("src/external/client.py", CODE), ("deps/graph.py", CODE), ("src/external/http/client.py", CODE),
        ("src/bundle_store/a.c", CODE), ("a/b.c", ""), ("a/b.c", None), ("a/b.weird", CODE), ("src/a.py", "TABLE = [" + ", ".join(str(k) for k in range(20)) + "]\n" + "def f(alpha, beta):\n    return alpha + beta\n" * 9),
        ("src/a.js", 'const HELP = "' + "some words that explain at length what to do " * 12 + '";\nfunction f(a) { return a; }\n'),
    ]
    for p, t in plain:
        assert H.evidence(p, t) is None, (p, t)


def test_minified_and_data():
    minified = "function a(b,c){return b?c.d(b):1}" * 60
    assert H.evidence("src/a.js", minified) == "minified"
    numbers = "const unsigned char d[] = {\n" + "".join("    " + ", ".join(hex(k * j % 256) for k in range(16)) + ",\n" for j in range(30)) + "};\n"
    assert H.evidence("src/a.c", numbers) == "data"
    assert H.evidence("src/a.js", "const blob = \"" + "QUJDRA+/x9" * 60 + '";\n') == "data"
    assert H.evidence("src/a.js", "const r = [\n" + '  {"id": 1, "w": 0.5, "tag": "ab"},\n' * 20 + "];\n") == "data"


def rows(spark, rs):
    return spark.createDataFrame([(*r, "clash") for r in rs], "file_id long, worktree_key string, rel_path string, mtime_ns long, content string, sig string")


def test_copies_trees_and_newest_rows(spark):
    other = CODE.replace("add", "mul")
    third = CODE.replace("add", "div")
    wt = spark.createDataFrame([("w1", "r1"), ("w2", "r2"), ("w3", "r1"), ("w1", "r1")], "worktree_key string, repo_id string")
    rs = [
        (1, "w1", "vendor/l/a.c", 1, CODE), (2, "w2", "src/copy.c", 1, CODE.replace("\n", "\r\n")), (3, "w2", "src/own.c", 1, third.replace("sub", "own")),
        (4, "w1", "x/lib/a.c", 1, other), (5, "w1", "x/lib/b.c", 1, third), (6, "w2", "y/z/lib/a.c", 1, other), (7, "w2", "y/z/lib/b.c", 1, third),  # one tree in two repositories
        (8, "w1", "p/q/a.c", 1, other + "int k;"), (9, "w1", "p/q/b.c", 1, third + "int k;"), (10, "w3", "p/q/a.c", 1, other + "int k;"), (11, "w3", "p/q/b.c", 1, third + "int k;"),  # worktrees of one
        (12, "w1", "a.c", 1, "// @generated by x\n" + CODE + "int q;"), (12, "w1", "a.c", 2, "int hand;" + CODE), (13, "w1", "vendor/e.c", 1, ""), (14, "w2", "e.c", 1, ""), (15, "w2", None, 1, None), (1, "w1", "vendor/l/a.c", 1, CODE),
    ]
    got = {r["file_id"]: r["why"] for r in H.not_handwritten(rows(spark, rs), wt).collect()}
    assert got == {1: "vendored", 2: "copy", 4: "shared tree", 5: "shared tree", 6: "shared tree", 7: "shared tree", 13: "vendored"}
    assert H.not_handwritten(rows(spark, rs[:0]), wt).collect() == []


def test_merkle_hash_needs_names_and_contents(spark):
    rs = [(1, "a", "d/x.c", 1, CODE), (2, "a", "d/e/y.c", 1, CODE), (3, "b", "f/x.c", 1, CODE), (4, "b", "f/e/y.c", 1, CODE), (5, "c", "g/x.c", 1, CODE), (6, "c", "g/e/z.c", 1, CODE)]
    from symloom.session import scratch

    dirs = H.merkle_directories(H.file_evidence(rows(spark, rs)), 3, scratch(spark, "m")).collect()
    h = {(r["worktree_key"], r["dir"]): (r["h1"], r["h2"], r["n"]) for r in dirs}
    assert h["a", "d"] == h["b", "f"] != h["c", "g"] and h["a", "d"][2] == 2 and len(h) == 6


def test_a_path_with_two_ids_is_one_file(spark):
    wt = spark.createDataFrame([("w1", "r1"), ("w2", "r2")], "worktree_key string, repo_id string")
    texts = [CODE.replace("add", name) for name in ("one", "two", "three")]
    rs = [(10 * w + k, f"w{w}", f"{'lib' if w == 1 else 'src/own'}/x/{'abc'[k]}.c", 1, t) for w in (1, 2) for k, t in enumerate(texts)]
    found = lambda r: {x["file_id"] for x in H.not_handwritten(rows(spark, r), wt).collect()}
    assert found(rs) == {10, 11, 12, 20, 21, 22}
    # given again under other ids, once or twice, the tree stays what it is
    assert found([*rs, (99, *rs[0][1:])]) == {10, 11, 12, 20, 21, 22, 99}
    assert found([*rs, (98, *rs[0][1:]), (99, *rs[0][1:])]) == {10, 11, 12, 20, 21, 22, 98, 99}
    # another file in one of the trees: they are not the same any more, and no file says anything by itself
    assert found([*rs, (97, "w1", "lib/x/d.c", 1, CODE)]) == set()


def test_many_ways_to_sign():
    for line in (
        "Diese Datei wurde automatisch erzeugt (tool 1.2).", "Ce fichier a été généré automatiquement par tool, ne pas modifier.", "Archivo generado por tool 2.1, no editar.", "-*- buffer-read-only: t -*- made by tool", "Machine written by tool. Hands off.",
        "This file was created automatically by tool", "Produced by running tool over a.def, regenerate rather than patch", "GENERATED CODE, edit a.tmpl instead", "Built from a.proto by tool v3", "Autogenerated from a.schema; do not modify", "AUTO-GENERATED FILE -- changes will be lost",
    ):
        assert H.signed("// " + line) == "generated", line
    for line in (
        "libx version 1.2.3 - (c) the libx authors, not part of this project", "Snapshot of libx @ 1.2.3. Local patches get lost on the next sync.", "libx 1.2.3, imported unchanged from upstream", "Bundled copy of libx 1.2.3; report problems to its own authors",
        "Vendored from https://example.org/x", "Kopie von libx 2.0.1, unverändert übernommen",
    ):
        assert H.signed("# " + line) == "vendored", line
    for line in (
        "generated ids start at 7", "Helper for code that gets generated by the loader.", "TODO Auto-generated method stub", "The vendor wants a lock here.", "Since build 1.2 the cache is read-only.", "The copy of the buffer is unchanged.", "do not edit the ring by hand, call this instead",
        "Produced by the reader thread, consumed by the writer.", "Works with libx 1.2.3 or later.", "Rows 3 to 9 show the snapshot of a cache.", "Copyright (c) 2019 the team. All rights reserved.", "Part of the workspace tools. Licensed under MIT terms.",
    ):
        assert H.signed("// " + line) is None, line


def test_every_line_that_a_rule_accepts_is_hinted():
    for line, why in (
        ("# Built with bison 3.8.2 from parser.y; changes will be lost.", "generated"), ("// Automatically written out by protoc 3.21 - edits will be overwritten", "generated"),
        ("/*! lodash 4.17.21 (https://lodash.com) released under the MIT license */", "vendored"), ("// zlib 1.3, from the original project", "vendored"), ("// foo 1.2 by the foo developers", "vendored"), ("// DO\tNOT EDIT", "generated"),
    ):
        assert H.signed(line) == why and H.evidence("src/a.js", line.replace("# ", "// ") + "\n" + CODE) == why, line
    rng = random.Random(5)

    def text_of(tree) -> str:
        out = []
        for op, x in tree:
            match str(op):
                case "LITERAL":
                    out.append(rng.choice([chr(x), chr(x).upper()]) if rng.random() < 0.2 else chr(x))
                case "NOT_LITERAL":
                    out.append("x")
                case "ANY":
                    out.append("q")
                case "IN":
                    out.append(rng.choice([of_set(y) for y in x]) if str(x[0][0]) != "NEGATE" else " ")
                case "BRANCH":
                    out.append(text_of(rng.choice(x[1])))
                case "SUBPATTERN":
                    out.append(text_of(x[-1]))
                case "MAX_REPEAT" | "MIN_REPEAT":
                    low, high, y = x
                    out.extend(text_of(y) for _ in range(rng.randint(low, min(int(high), low + 2))))
        return "".join(out)

    def of_set(item) -> str:
        op, x = str(item[0]), item[1]
        if op == "RANGE":
            return chr(rng.randint(*x))
        return chr(x) if op == "LITERAL" else {"CATEGORY_WORD": "w", "CATEGORY_DIGIT": "7", "CATEGORY_SPACE": rng.choice(" \t "), "CATEGORY_NOT_WORD": "*"}[str(x)]

    for rule in (H._MARK, H._MADE, H._THEIRS, H._FOREIGN, H._BANNER):
        tree, met = re._parser.parse(rule.pattern), 0
        for _ in range(4000):
            line = text_of(tree)
            for text in (line, line.replace("s", "ſ").replace("i", "ı"), line.upper()):
                for part in re.split(r"\r\n|[\n\r]", text):
                    if rule.search(part):
                        met += 1
                        assert H._hinted(part), part
        assert met > 1000
