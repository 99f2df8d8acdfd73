import os

import pytest

from symloom.operators.scan import CorpusStore, scan
from symloom.session import scratch
from symloom.sources import walk


def write(folder, **files):
    for name, text in files.items():
        path = folder / name.replace("__", "/")
        path = path.with_name(path.name + ".rs")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def tree(folder, n, start=0):
    write(folder, **{f"d{k % 3}__f{k}": f"pub fn f{k}(x: u8) {{}}\n" for k in range(start, start + n)})


@pytest.fixture()
def store(spark):
    return CorpusStore(spark, scratch(spark, "store"))


def test_cold_rescan_edit_clone_and_removal(spark, store, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    tree(a, 20)
    cold = scan(store, "a", str(a))
    assert (cold.indexed, cold.stat_calls, cold.hashed, cold.parsed, cold.store_writes, cold.store_hits, cold.errors) == (20, 20, 20, 20, 20, 0, 0)
    again = scan(store, "a", str(a))
    assert (again.indexed, again.bytes_read, again.hashed, again.parsed, again.store_hits) == (20, 0, 0, 0, 20)
    for k in range(7):
        write(a, **{f"d{k % 3}__f{k}": f"pub fn edited{k}() {{}}\nfn more() {{}}\n"})
    os.remove(a / "d1" / "f19.rs")
    edit = scan(store, "a", str(a))
    assert (edit.indexed, edit.stat_calls, edit.parsed, edit.hashed, edit.removed) == (19, 19, 7, 7, 1)
    tree(b, 20)
    clone = scan(store, "b", str(b))
    assert (clone.parsed, clone.store_writes, clone.hashed, clone.store_hits) == (0, 0, 20, 20)
    assert store.count() == 39 and store.prefix("a", "d0/").count() == 7
    # a new version of the parser: nothing is fresh any more
    newer = scan(store, "a", str(a), parser_version=2)
    assert (newer.parsed, newer.hashed) == (19, 19)
    unit = store.unit(store.units().where("parser_version = 2"))
    names = {s["name"] for r in unit.collect() for s in r["symbols"]}
    assert {"edited0", "more", "f18"} <= names and "f0" not in names


def test_equal_contents_are_parsed_once(spark, store, tmp_path):
    write(tmp_path, **{f"f{k}": "fn same() {}\n" for k in range(25)})
    s = scan(store, "w", str(tmp_path))
    assert (s.parsed, s.store_writes, s.store_hits) == (1, 1, 24)


def test_parents_and_children_take_rows(spark, store, tmp_path):
    tree(tmp_path / "sub" / "one", 12)
    scan(store, "child", str(tmp_path / "sub" / "one"))
    registry = spark.createDataFrame([("child", str(tmp_path / "sub" / "one"))], "worktree_key string, working_dir string")
    write(tmp_path / "sub", own="fn own() {}\n")
    parent = scan(store, "parent", str(tmp_path / "sub"), registry=registry)
    assert (parent.rows_copied, parent.parsed, parent.hashed, parent.indexed) == (12, 1, 1, 13)
    registry = spark.createDataFrame([("parent", str(tmp_path / "sub"))], "worktree_key string, working_dir string")
    child = scan(store, "again", str(tmp_path / "sub" / "one" / "d1"), registry=registry)
    assert (child.rows_copied, child.parsed, child.hashed, child.indexed) == (4, 0, 0, 4)


def test_overlays_errors_and_empty_folders(spark, store, tmp_path):
    empty = scan(store, "w", str(tmp_path))
    assert (empty.indexed, empty.stat_calls, store.count()) == (0, 0, 0)
    write(tmp_path, a="fn a() {}\n", b="fn b() {}\n", c="")
    os.symlink(tmp_path / "nowhere", tmp_path / "gone.rs")
    s = scan(store, "w", str(tmp_path), overlays={str(tmp_path / "a.rs")})
    assert (s.indexed, s.skipped, s.errors) == (2, 1, 1)


def test_store(spark, store):
    rows = spark.createDataFrame([("w", "a", "h1", "rust", 1, 1, 1), ("w", "b/c", "h2", "rust", 1, 1, 1), ("v", "a", "h1", "rust", 1, 1, 1)], "worktree_key string, rel_path string, content_hash string, lang string, size long, mtime_ns long, generation long")
    assert store.generation() == 0 and store.all().collect() == [] and store.units().collect() == []
    assert store.upsert(rows) == 1 and store.upsert(rows.where("rel_path = 'a' and worktree_key = 'w'").replace("h1", "h9")) == 2
    assert store.get(rows.where("worktree_key = 'w' and rel_path = 'a'")).first()["content_hash"] == "h9"
    store.delete(rows.where("rel_path = 'b/c'"))
    assert sorted((r["worktree_key"], r["rel_path"]) for r in store.all().collect()) == [("v", "a"), ("w", "a")]
    store.clear("w")
    assert [r["worktree_key"] for r in store.all().collect()] == ["v"] and store.generation() == 4
    # a generation whose write was not completed does not hold
    rows.write.parquet(f"{store.root}/manifest/5")
    folder = store.root.removeprefix("file://") + "/manifest/5"
    os.remove(f"{folder}/_SUCCESS")
    assert store.generation() == 4 and store.count() == 1
    store.set_meta(parser_version="1")
    store.set_meta(owner="me")
    assert store.meta() == {"parser_version": "1", "owner": "me"}
    unit = spark.createDataFrame([("ab", "rs", 1, None), ("ab", "rs", 1, None), ("cd", "rs", 1, None)], "content_hash string, ext string, parser_version int, symbols array<struct<symbol_idx:int,name:string,kind:string,line:int,col:int,def_keyword:string,doc_comment:string,signature:string,visibility:string,container:string,depth:int,scope_end_line:int>>")
    store.put(unit)
    store.put(unit)
    assert store.units().count() == 2 and store.contains(unit.where("content_hash = 'ab'").distinct()).count() == 1


def test_a_tree_in_parts_is_the_tree(spark, tmp_path):
    tree(tmp_path, 9)
    tree(tmp_path / "x" / "y", 9)
    write(tmp_path, top="fn top() {}")
    whole = sorted(r[1] for r in walk.walk(str(tmp_path)))
    for parts in (1, 3, 5, 100):
        assert sorted(r["rel_path"] for r in walk.corpus_files(spark, str(tmp_path), parts=parts).collect()) == whole
    assert [r["error"] is not None for r in walk.corpus_files(spark, str(tmp_path / "none")).collect()] == [True]
