import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from symloom.functions import text
from symloom.functions.paths import plain_path
from symloom.operators import corpus, dependencies, fuzzy, lookup, manifest, resolve
from symloom.operators.intervals import innermost

FILES = "file_id long, worktree_key string, rel_path string, ext string, size long, mtime_ns long, content_hash string, content string, word string"


def files(spark, contents):
    return spark.createDataFrame([(k, "w", f"f{k}.rs", "rs", 1, 1, f"h{k}", c, "clash") for k, c in enumerate(contents)], FILES)


def refs(spark, contents, *words):
    q = spark.createDataFrame([(w,) for w in words], "word string")
    return sorted(tuple(r) for r in lookup.references(q, files(spark, contents)).collect())


def test_references_by_word_boundary(spark):
    got = refs(spark, ["fn foo() {}\nlet foobar = 3;", "foo(); // foo\n\"foo\" 3x x_foo"], "foo", "x")
    assert got == [("foo", 0, 0, 3, 3), ("foo", 1, 0, 0, 3), ("foo", 1, 0, 10, 3), ("foo", 1, 1, 1, 3)]


def test_columns_are_bytes_and_lines_survive_any_end(spark):
    got = refs(spark, ["é foo ñfoo\r\n日本 foo\n\n  foo", None, ""], "foo", "日本")
    assert got == [("foo", 0, 0, 3, 3), ("foo", 0, 1, 7, 3), ("foo", 0, 3, 2, 3), ("日本", 0, 1, 0, 6)]


def test_510_files(spark):
    got = refs(spark, [f"shared_fn();\nfn shared_fn() {{ unique_{k}() }}" for k in range(510)], "shared_fn")
    assert len(got) == 1020


def test_indexed_references_fall_back(spark):
    f = files(spark, ["a b", "a", "c 3d"])
    p = f.select("file_id", F.explode(F.array_distinct(text.identifiers(F.col("content")))).alias("word")).where("file_id <> 1")
    q = spark.createDataFrame([("a",), ("3d",), ("none",)], "word string")
    assert sorted((r["word"], r["file_id"]) for r in lookup.references(q, f, p).collect()) == [("3d", 2), ("a", 0)]


def test_references_take_the_newest_delivery_once(spark):
    rows = [(1, "w", "a", "rs", 1, 5, "h", "foo", ""), (1, "w", "a", "rs", 1, 5, "h", "foo", ""), (1, "w", "a", "rs", 1, 4, "g", " foo foo", ""), (2, "w", "b", "rs", 1, None, None, "foo", "")]
    f = spark.createDataFrame(rows, FILES)
    q = spark.createDataFrame([("foo",), (None,)], "word string")
    assert sorted(tuple(r) for r in lookup.references(q, f).collect()) == [("foo", 1, 0, 0, 3), ("foo", 2, 0, 0, 3)]


def test_many_words_are_joined_as_few_are_sent(spark, monkeypatch):
    f = files(spark, ["a b c a", "é a"])
    q = spark.createDataFrame([("a",), ("c",)], "word string")
    few = sorted(map(tuple, lookup.references(q, f).collect()))
    monkeypatch.setattr(corpus, "WORDS_SENT", 0)
    assert sorted(map(tuple, lookup.references(q, f).collect())) == few and len(few) == 4


def test_newest_row_of_a_file(spark):
    rows = [(1, "w", "a", "rs", 1, 5, "h", "new", ""), (1, "w", "a", "rs", 1, 5, "h", "new", ""), (1, "w", "a", "rs", 1, 4, "g", "old", ""), (2, "w", "b", "rs", 1, None, None, None, "")]
    got = {r["file_id"]: r["content"] for r in corpus.current_files(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {1: "new", 2: None}
    assert corpus.current_files(spark.createDataFrame([], FILES)).collect() == []


@pytest.mark.parametrize(
    "path,want",
    [("a/b.c", "a/b.c"), ("./a//b.c", "a/b.c"), ("a\\.\\b.c", "a/b.c"), ("/a/", "a"), ("a/../b", "a/../b"), ("a.b/.c", "a.b/.c"), ("", ""), (None, None), ("....", "....")],
)
def test_plain_path(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(plain_path(F.col("p"))).first()[0] == want


SYM = "file_id long, symbol_idx int, name string, line int, depth int, scope_end_line int, def_keyword string"


def at_cursor(spark, symbols, cursor):
    s = spark.createDataFrame([(1, k, "x", *r, "variable") for k, r in enumerate(symbols)], SYM)
    c = spark.createDataFrame([(0, 1, "x", cursor)], "cursor_id int, file_id long, name string, cursor_line int")
    r = lookup.local_definition_at(c, s).collect()
    return r[0]["line"] if r else None


def test_scopes(spark):
    shadow = [(1, 1, 7), (3, 2, 5)]
    assert at_cursor(spark, shadow, 4) == 3 and at_cursor(spark, shadow, 6) == 1 and at_cursor(spark, shadow, 9) is None
    loops = [(1, 1, 3), (4, 1, 6)]
    assert at_cursor(spark, loops, 2) == 1 and at_cursor(spark, loops, 5) == 4
    assert at_cursor(spark, [(1, 1, None)], 99) == 1
    assert at_cursor(spark, [(1, 0, 9)], 2) is None


def test_sweep_against_brute_force(spark):
    rng = random.Random(6)
    intervals = [(rng.choice([1, 1, 1, 2, None]), rng.randint(0, 30), rng.choice([None, *range(0, 40)]), k) for k in range(200)]
    points = [(rng.choice([1, 2, 3]), rng.randint(0, 40), k) for k in range(200)] + [(1, None, 900), (None, 3, 901)]
    i = spark.createDataFrame(intervals, "file_id long, start int, end int, k int").withColumn("value", F.struct("start", "k")).withColumn("_early", F.negative("end"))
    p = spark.createDataFrame(points, "file_id long, at int, k int").withColumn("point_id", F.struct("k"))
    got = {r["point_id"]["k"]: (r["depth"], tuple(r["best"])) for r in innermost(p, i, ["file_id"], ["start", "_early", "k"]).collect()}
    want = {}
    for f, at, k in points:
        hold = [x for x in intervals if at is not None and x[0] is not None and x[0] == f and x[1] <= at and (x[2] is None or at <= x[2])]
        if hold:
            best = max(hold, key=lambda x: (x[1], -(1 << 62) if x[2] is None else -x[2], x[3]))
            want[k] = (len(hold), (best[1], best[3]))
    assert got == want
    assert innermost(p, i.where("false"), ["file_id"], ["start"]).collect() == []


def match(spark, query, *names):
    q, n = spark.createDataFrame([(query,)], "query string"), spark.createDataFrame([(x,) for x in names], "name string")
    return {r["name"] for r in fuzzy.fuzzy_matches(q, n).collect()}


def test_fuzzy(spark):
    assert match(spark, "HashMpa", "HashMap", "HashSet") == {"HashMap"}
    assert match(spark, "foobar", "HashMap", "process_data") == set()
    assert match(spark, "process_daata", "process_data", "process_item", "other") == {"process_data"}
    assert match(spark, "cafe", "café") == {"café"} and match(spark, "名目", "名前") == {"名前"}
    assert match(spark, "ab", "abc", "abcd", "abcde", "x") == {"abc", "abcd", "x"}
    assert match(spark, "", "ab", "abc") == {"ab"}


def test_candidates_in_blocks_against_brute_force(spark, monkeypatch):
    for k, v in (("BLOCK_NAMES", 40), ("BLOCK_QUERIES", 30), ("_BATCH_BYTES", 200)):
        monkeypatch.setattr(fuzzy, k, v)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aAbBcdeé名\0\2") for _ in range(rng.randint(0, 9)))
    names, queries = {word() for _ in range(150)} | {"", "xy", "long" * 90}, {word() for _ in range(100)} | {"", "zz", "qqqqqqqq", "\0\0\2", "LONGL"}

    def grams(x):
        b = x.encode().lower()  # of bytes, only A to Z change
        return {b[k : k + 3] for k in range(len(b) - 2)} if len(b) >= 3 else {bytes([0, 0, len(b)])}

    shared = {(q, n) for q in queries for n in names if len(q.encode()) >= 3 and grams(q) & grams(n)}
    some = {q for q, _ in shared}
    want = shared | {(q, n) for q in queries - some for n in names if abs(len(q.encode()) - len(n.encode())) <= 2}
    q, n = (spark.createDataFrame([(x,) for x in [*xs, None]], f"{c} string") for xs, c in ((queries, "query"), (names, "name")))
    found = fuzzy.candidates(q, n)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    # as many pairs as these come from several tasks of a number that is not merged, and are not counted or shuffled
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and found.rdd.getNumPartitions() > 4
    assert fuzzy.candidates(q, n.where("false")).collect() == [] == fuzzy.candidates(q.where("false"), n).collect()


def test_rarest_trigrams_lose_no_match(spark):
    rng = random.Random(8)
    names = {"".join(rng.choice("aabcdeé" if rng.random() < 0.1 else "aabcde") for _ in range(rng.randint(1, 16))) for _ in range(150)}
    names |= {"common_prefix_" + x for x in list(names)[:60]}

    def typo(x):
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(x) + 1)
            x = rng.choice([x[:k] + "z" + x[k:], x[:k] + x[k + 1 :], x[:k] + "q" + x[k + 1 :]])
        return x

    queries = {typo(x) for x in list(names)[:120]} | {"zz", "qqqqqqqq"}
    q, n = spark.createDataFrame([(x,) for x in queries], "query string"), spark.createDataFrame([(x,) for x in names], "name string")
    every = fuzzy.candidates(q, n).select("query", "name", F.levenshtein("query", "name").alias("d")).where("d <= 2")
    assert sorted(map(tuple, fuzzy.fuzzy_matches(q, n).collect())) == sorted(map(tuple, every.collect()))


def test_prefixes_of_any_length(spark):
    long = "n" * 300 + "x"
    n = spark.createDataFrame([(long + "tail",), ("other",), ("",)], "name string")
    got = fuzzy.completions(spark.createDataFrame([(long,), (long.upper(),), ("",)], "query string"), n).collect()
    assert sorted(r["name"] for r in got) == [long + "tail"] * 2


def test_completions_fall_back_only_if_empty(spark):
    q = spark.createDataFrame([("HA",), ("Hsah",)], "query string")
    n = spark.createDataFrame([("hash",), ("Hash",), ("hat",), ("other",)], "name string")
    got = {(r["query"], r["name"]) for r in fuzzy.completions(q, n).collect()}
    assert got == {("HA", "hash"), ("HA", "Hash"), ("HA", "hat"), ("Hsah", "Hash")}


def test_ranking_prefers_qualifier_to_own_file(spark):
    d = spark.createDataFrame(
        [("q", 1, "Mutex", 1, 0, 3, 0, "Mutex", "new"), ("q", 1, "Mutex", 2, 0, 3, 0, "Workspace", "new"), ("q", 1, "Mutex", 3, 0, 40, 0, None, "new")],
        "query_id string, current_file long, qualifier string, file_id long, symbol_idx int, line int, col int, container string, name string",
    )
    got = lookup.rank(d.withColumn("current_file", F.lit(2).cast("long"))).orderBy("rank").collect()
    assert [(r["file_id"], r["score"]) for r in got] == [(1, 4), (2, 2), (3, 0)]
    source = "\n" * 9 + "impl Mutex {\n\nclass MutexGuard\n  impl<T> Mutex {\r\n"
    deliveries = spark.createDataFrame([(3, 2, "h", source), (3, 2, "h", source), (3, 1, "g", "\n" * 38 + "impl Mutex"), (1, 1, "k", None)], "file_id long, mtime_ns long, content_hash string, content string")
    opened = lookup.openers(deliveries)
    assert sorted(tuple(r) for r in opened.collect()) == [(3, 9, "Mutex"), (3, 11, "MutexGuard"), (3, 12, "Mutex")]
    src = lookup.qualifier_in_source(d, opened)
    assert [r["file_id"] for r in src.collect()] == [3]
    assert {r["file_id"]: r["score"] for r in lookup.rank(d, src).collect()} == {1: 6, 2: 0, 3: 4}


def test_all_ranks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BLOCK", 64)
    rng = random.Random(3)
    defs = [(rng.randint(1, 40), k, rng.choice(["a", "a", "a", "b", "c"]), rng.randint(0, 90), 4, rng.choice([None, None, "T", "U", "V"])) for k in range(700)] + [(None, 900, "a", 3, 0, "T"), (3, 901, "a", None, 0, None)]
    asked = sorted({(f, n) for f, _, n, *_ in defs if f is not None and f % 2 == 0}) + [(1000 + k, "a") for k in range(70)] + [(5, "none")]
    asked = [(h, n, rng.choice([None, "T", "U", "W"])) for h, n in asked]
    opened = [(rng.randint(1, 40), rng.randint(0, 90), rng.choice(["T", "U", "W"])) for _ in range(60)]
    got = lookup.rank_all(
        spark.createDataFrame(asked, "here long, name string, qualifier string"),
        spark.createDataFrame(defs, "file_id long, symbol_idx int, name string, line int, col int, container string"),
        spark.createDataFrame(opened, "file_id long, _line int, qualifier string"),
    )
    want = set()
    for here, name, q in asked:
        rows = []
        for f, idx, n, line, col, box in defs:
            if n == name:
                match = q is not None and (box == q if box is not None else any(o[0] == f and o[2] == q and line is not None and line - 30 <= o[1] < line for o in opened))
                rows.append((-(2 * (f == here) + 4 * match), f is None, f or 0, line is None, line or 0, col, idx, f))
        want |= {(here, name, r[7], r[6], -r[0], k) for k, r in enumerate(sorted(rows), 1)}
    rows = [tuple(r) for r in got.select("here", "name", "file_id", "symbol_idx", "score", "rank").collect()]
    assert len(rows) == len(want) and set(rows) == want
    # definitions times files that ask are given by the join itself: nothing sorts, counts or shuffles them after it
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan[: plan.index("Join")] and "Aggregate" not in plan[: plan.index("Join")] and "Repartition" not in plan[: plan.index("Join")]


def test_same_position(spark):
    s = spark.createDataFrame([(1, 1, 1, 0, None), (1, 1, 1, 1, "C"), (1, 1, 1, 2, None), (1, 2, 1, 3, None), (1, 2, 1, 4, None)], "file_id long, line int, col int, symbol_idx int, container string")
    assert sorted(r["symbol_idx"] for r in lookup.same_position_once(s, "symbol_idx").collect()) == [1, 4]


def test_scalars(spark):
    df = spark.createDataFrame([("a.b::foo(x)", 7, "f(a: i32, b: &str, c: Vec<u8>)"), ("", 0, "f()"), ("x", 5, None), ("->q", 3, "g(a, (b, c), d<e, f>)")], "t string, c int, s string")
    rows = df.select(text.word_at(F.col("t"), F.col("c")).alias("w"), text.qualifier_before(text.word_prefix(F.col("t"), F.col("c"))).alias("q"), text.parameters(F.col("s")).alias("p")).collect()
    assert [r["w"] for r in rows] == ["foo", None, None, "q"] and [r["q"] for r in rows] == ["b", None, None, None]
    assert [r["p"] for r in rows] == [["a: i32", "b: &str", "c: Vec<u8>"], [], None, ["a", "(b, c)", "d<e, f>"]]
    h = spark.createDataFrame([("",), ("a",), ("café",), (None,)], "s string").select(text.fnv1a(F.col("s"))).collect()

    def fnv(b):
        x = 0x811C9DC5
        for c in b:
            x = (x ^ c) * 0x01000193 & 0xFFFFFFFF
        return x

    assert [r[0] for r in h] == [fnv(b""), fnv(b"a"), fnv("café".encode()), None]
    u = spark.createDataFrame([("a😀é",)], "s string").select(text.utf16_length(F.col("s"))).first()[0]
    assert u == 4


def test_parameters_against_brute_force(spark):
    rng = random.Random(5)

    def brute(sig):
        if "(" not in sig or ")" not in sig or sig.rindex(")") < sig.index("("):
            return []
        out, depth, at = [], 0, ""
        for c in sig[sig.index("(") + 1 : sig.rindex(")")]:
            depth += (c in "<([") - (c in ">)]")
            if c == "," and depth == 0:
                out.append(at)
                at = ""
            else:
                at += c
        return [x.strip(" ") for x in [*out, at] if x.strip(" ")]

    rows = ["".join(rng.choice(["(", ")", "<", ">", "[", "]", ",", ", ", "a", "b: i32", " "]) for _ in range(rng.randint(0, 16))) for _ in range(400)]
    got = spark.createDataFrame([(r,) for r in rows], "s string").select("s", text.parameters(F.col("s"))).collect()
    assert all(list(p) == brute(s) for s, p in got)


def test_dense_numbers(spark):
    rows = [("big", f"p{k:04}") for k in range(500)] * 2 + [("small", "x"), ("small", None), (None, "y")]
    got = corpus.dense_numbers(spark.createDataFrame(rows, "g string, p string"), "g", "p", "n").collect()
    want = {("big", f"p{k:04}", k + 1) for k in range(500)} | {("small", None, 1), ("small", "x", 2), (None, "y", 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_remotes(spark):
    urls = {"git@Github.com:Foo/Bar.git": "https://github.com/foo/bar", "https://x.y/A/": "https://x.y/a", " https://x.y/a.git ": "https://x.y/a"}
    from symloom.operators.identity import plain_remote

    for url, want in urls.items():
        assert spark.createDataFrame([(url,)], "u string").select(text.normalize_remote(F.col("u"))).first()[0] == want == plain_remote(url)


M = "worktree_key string, rel_path string, content_hash string, size long, mtime_ns long, generation long"


def test_classify_and_metrics(spark):
    n = 50
    known = spark.createDataFrame([("w", f"f{k}", f"h{k}", 1, 1, 1) for k in range(n)], M)
    scanned = spark.createDataFrame([("w", f"f{k}", f"h{k}" if k >= 7 else f"new{k}", 1 if k >= 7 else 2, 1, 2) for k in range(n)], M)
    units = known.select("content_hash")
    c = manifest.classify(scanned, known, units, ["worktree_key", "rel_path"])
    m = manifest.scan_metrics(c).first()
    assert (m["stat_calls"], m["parsed"], m["hashed"], m["bytes_read"]) == (50, 7, 7, 14)
    again = manifest.scan_metrics(manifest.classify(known, known, units, ["worktree_key", "rel_path"])).first()
    assert (again["bytes_read"], again["hashed"], again["parsed"], again["store_hits"]) == (0, 0, 0, 50)
    same = spark.createDataFrame([("w", f"f{k}", "one", 1, 1, 1) for k in range(25)], M)
    once = manifest.scan_metrics(manifest.classify(same, known.where("false"), units.where("false"), ["worktree_key", "rel_path"])).first()
    assert (once["store_writes"], once["parsed"], once["store_hits"]) == (1, 1, 24)


def test_upsert_subsume_overlay(spark):
    old = spark.createDataFrame([("w", "a", "h1", 1, 1, 5), ("w", "b", "h1", 1, 1, 1)], M)
    new = spark.createDataFrame([("w", "a", "h2", 1, 1, 2), ("w", "c", "h3", 1, 1, 1), ("w", "c", "h4", 1, 1, 3)], M)
    up = {r["rel_path"]: r["content_hash"] for r in manifest.upsert(old, new, ["worktree_key", "rel_path"]).collect()}
    assert up == {"a": "h2", "b": "h1", "c": "h4"}
    assert [r["rel_path"] for r in manifest.dead_rows(old, new, ["worktree_key", "rel_path"]).collect()] == ["b"]
    rows = spark.createDataFrame([("p", "src/a", "x", 1, 1, 1), ("p", "src2/a", "x", 1, 1, 1), ("c", "b", "x", 1, 1, 2), ("d", "a", "y", 1, 1, 9)], M)
    others = spark.createDataFrame([("p", "/r"), ("c", "/r/src/sub"), ("d", "/r/src"), ("e", "/q")], "worktree_key string, working_dir string")
    here = spark.createDataFrame([("h", "/r/src")], "here_key string, here_dir string")
    got = {r["rel_path"]: r["generation"] for r in manifest.subsume(rows, here, others).collect()}
    assert got == {"a": 1, "sub/b": 2}
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    edits = spark.createDataFrame([(2, None), (3, "new")], "k long, v string")
    assert {r["k"]: (r["v"], r["edited"]) for r in manifest.overlay(base, edits, "k", "v").collect()} == {1: ("a", False), 2: (None, True), 3: ("new", True)}


def test_stream_of_edits(spark, tmp_path):
    from symloom.streaming import overlay

    source, root = tmp_path / "in", tmp_path / "out"
    events = [(1, "open", "a", 1, "x"), (2, "change", "a", 3, "z"), (3, "change", "a", 2, "y"), (4, "open", "b", 1, "b"), (5, "open", None, 1, "n")]
    spark.createDataFrame(events, overlay.EVENT).write.json(str(source))

    def run():
        stream = spark.readStream.schema(overlay.EVENT).json(str(source))
        overlay.run(stream, str(root), str(tmp_path / "cp")).awaitTermination()

    run()
    last = lambda: {r["path"]: (r["text"], r["open"]) for r in spark.read.parquet(str(root / sorted((p.name for p in root.iterdir() if p.name.isdigit()), key=int)[-1])).collect()}
    assert last() == {"a": ("z", True), "b": ("b", True)}
    spark.createDataFrame([(6, "close", "a", 4, None), (7, "remove", "b", 2, None), (8, "open", "c", 1, "c")], overlay.EVENT).write.mode("append").json(str(source))
    run()
    assert last() == {"a": (None, False), "c": ("c", True)}


def test_walk(spark, tmp_path):
    from symloom.sources import walk

    for p in ("a.rs", "_b.py", ".c.js", "target/x.rs", ".git/x.rs", "node_modules/x.js", "sub/_d/e.go", "sub/readme.md", "bad.c"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"int x\xff;" if p == "bad.c" else b"x")
    found = walk.corpus_files(spark, str(tmp_path), {str(tmp_path / "a.rs")})
    got = {r["rel_path"]: r["content"] for r in walk.read_contents(found).collect()}
    assert set(got) == {"_b.py", ".c.js", "sub/_d/e.go", "bad.c"} and got["bad.c"] == "int x�;"
    assert walk.with_hash(walk.read_contents(found)).where("content_hash is null").count() == 0


def test_identity(tmp_path):
    import subprocess

    from symloom.operators import identity

    plain = identity.detect(str(tmp_path))
    assert plain.source == "path"
    for args in (["init", "-q"], ["-c", "user.name=a", "-c", "user.email=a@b", "commit", "-q", "--allow-empty", "-m", "x"], ["remote", "add", "o", "git@h.x:A/B.git"], ["worktree", "add", "-q", str(tmp_path / "linked")]):
        subprocess.run(["git", "-C", str(tmp_path), *args], check=True, capture_output=True)
    one, two = identity.detect(str(tmp_path)), identity.detect(str(tmp_path / "linked"))
    assert one.source == "commits" and one.repo_id == two.repo_id != plain.repo_id and one.worktree_key != two.worktree_key
    assert identity.cache_root({"SYMLOOM_CACHE_DIR": "/c"}) == "/c" and identity.cache_root({"HOME": "/h"}) == "/h/.cache/symloom"


def test_latest_events(spark):
    t = dt.datetime(2026, 1, 1)
    e = spark.createDataFrame([(1, 1, t), (1, 2, t), (2, 3, None)], "u long, e long, ts timestamp")
    assert sorted((r["u"], r["e"]) for r in manifest.latest_events(e, "u", [F.col("ts").desc(), F.col("e").desc()]).collect()) == [(1, 2), (2, 3)]


def test_words_and_contexts_of_all_symbols(spark, tmp_path):
    from symloom.plans import reference_queries as Q

    files = [(1, 1, "h1", "c", "int a;\nx.foo;\n"), (20, 1, "h2", "rs", "old"), (20, 2, "h3", "rs", "b::bar\r\nint"), (23, 1, "h4", "c", "baz")]
    spark.createDataFrame(files, "file_id long, mtime_ns long, content_hash string, ext string, content string").write.parquet(f"{tmp_path}/source_files.parquet")
    symbols = [(1, 0, 1, 2), (20, 0, 0, 3), (20, 1, 9, 0), (23, 0, 0, 0), (23, 0, 0, 0), (23, 1, 0, 9)]
    spark.createDataFrame(symbols, "file_id long, symbol_idx int, line int, col int").write.parquet(f"{tmp_path}/symbols.parquet")
    q = Q.queries()
    rows = lambda name: sorted(tuple(r) for r in q[name](spark, str(tmp_path)).collect())
    assert rows("word_at_position") == [(1, 0, "foo"), (20, 0, "bar"), (23, 0, "baz"), (23, 1, None)]
    assert rows("qualifier_before") == [(1, 0, "x"), (20, 0, "b"), (23, 0, None)]
    contexts = {(r["here"], r["cur"], r["k"]): (r["name"], r["context"]) for r in q["ident_context"](spark, str(tmp_path)).collect()}
    assert contexts == {(1, 0, 0): ("foo", "FieldAccess"), (20, 0, 0): ("bar", "Plain"), (20, 0, 1): ("int", "Plain"), (23, 0, 0): ("baz", "Plain")}


def test_contexts(spark):
    rows = [("a.", "", False, "FieldAccess"), ("a->", "(", False, "FieldAccess"), ("fn f() -> ", " {", True, "TypeRef"), ("", " (x)", False, "FunctionCall"), ("struct ", " {", False, "TypeRef"), ("x: ", ",", False, "TypeRef"), ("a::", "", False, "Plain"), ("0..", "", False, "Plain"), ("", "", None, "Plain")]
    df = spark.createDataFrame(rows, "b string, a string, t boolean, want string")
    assert df.where(text.ident_context(F.col("b"), F.col("a"), F.col("t")) != F.col("want")).collect() == []


S = "file_id long, symbol_idx int, name string, line int, col int, container string, def_keyword string, depth int, scope_end_line int"


def test_resolution_by_context(spark):
    symbols = spark.createDataFrame(
        [
            (1, 0, "x", 2, 0, "f", "variable", 1, 9), (1, 1, "size", 12, 0, "S", "field", 1, 20), (2, 0, "x", 1, 0, None, "const", 0, None), (2, 1, "size", 3, 0, None, "fn", 0, None), (2, 2, "new", 4, 0, "A", "fn", 1, 9), (3, 0, "new", 5, 0, "B", "fn", 1, 9),
            (9, 0, "dep", 1, 0, None, "fn", 0, None), (9, 1, "x", 1, 0, None, "fn", 0, None), (1, 2, "new", 30, 0, "C", "fn", 1, 40),
        ],
        S,
    )
    cursors = spark.createDataFrame(
        [
            (0, 1, 5, "x", None, "Plain"), (1, 1, 11, "x", None, "Plain"), (2, 1, 5, "x", None, "TypeRef"), (3, 1, 15, "size", None, "FieldAccess"), (4, 2, 15, "size", None, "FieldAccess"), (5, 4, 1, "new", "B", "FunctionCall"),
            (6, 4, 1, "new", None, "FunctionCall"), (7, 1, 1, "new", None, "Plain"), (8, 1, 1, "dep", None, "FunctionCall"), (9, 1, 1, "dep", None, "TypeRef"), (10, 1, 1, "none", None, "Plain"), (11, 1, 1, None, None, "Plain"),
        ],
        "query_id int, here long, at int, name string, qualifier string, context string",
    )
    lines = spark.createDataFrame([], "file_id long, _line int, qualifier string")
    deps = spark.createDataFrame([(9,)], "file_id long")
    go = {r["query_id"]: (r["file_id"], r["symbol_idx"]) for r in resolve.resolve(cursors, symbols, deps, lines).collect()}
    assert go == {0: (1, 0), 1: (2, 0), 2: (2, 0), 3: (1, 1), 4: (2, 1), 5: (3, 0), 6: (1, 2), 7: (1, 2), 8: (9, 0)}
    hover = {r["query_id"]: (r["file_id"], r["symbol_idx"]) for r in resolve.resolve(cursors, symbols, deps, lines, local_first=False).collect()}
    assert hover == {**go, 0: (2, 0)}
    assert resolve.resolve(cursors.where("false"), symbols, deps, lines).collect() == []


def test_dependencies(spark):
    f = spark.createDataFrame([(1, "w", "node_modules/a/x.js"), (2, "w", "node_modules/a/y.js"), (3, "w", "src/a.js"), (4, "v", "vendor/b/z.go"), (5, "v", None), (6, "v", "Godeps/_workspace/src/c/z.go"), (7, "v", "vendor/z.go")], "file_id long, worktree_key string, rel_path string")
    assert sorted(map(tuple, dependencies.detect(f).collect())) == [("v", "go", "b", 1), ("v", "go", "c", 1), ("w", "npm", "a", 2)]
    d = spark.createDataFrame([(1,), (1,), (3,), (4,)], "file_id long")
    assert tuple(dependencies.counts(f, d).first()) == (3, 4, 3) and tuple(dependencies.counts(f.where("false"), d).first()) == (0, 0, 0)
    text_ = '[[package]]\nname = "a"\nversion = "1.0"\n\n[[package]]\nname = "b"\n'
    locks = spark.createDataFrame([("w", text_), ("v", None), ("u", "")], "k string, t string")
    assert list(map(tuple, dependencies.lock_packages(locks, "k", "t").collect())) == [("w", "a", "1.0")]
