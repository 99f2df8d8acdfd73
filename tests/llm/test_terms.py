import random
import time
from collections import Counter

import pyarrow as pa
import pytest

from symloom.llm import terms as T
from symloom.session import shared_dir


def tables(rng, n):
    rows = [("word" if rng.random() < 0.5 else "name", "hot" if rng.random() < 0.4 else f"t{rng.randint(0, 50)}", rng.randint(1, 3), 1) for _ in range(n)]
    return rows, [pa.table([pa.array(c) for c in zip(*rows[k : k + 100], strict=True)], names=["field", "term", "occurrences", "records"]) for k in range(0, n, 100)]


def test_radix_recursion_keeps_every_row(tmp_path):
    rows, batches = tables(random.Random(1), 2000)
    radix = T.RadixAggregator(str(tmp_path), rows=20, bits=2)
    got = {}
    for b in radix.sums(batches):
        for r in b.to_pylist():
            assert (r["field"], r["term"]) not in got
            got[r["field"], r["term"]] = (r["occurrences"], r["records"])
    assert radix.deepest >= 2
    radix.close()
    occ, rec = Counter(), Counter()
    for f, t, o, n in rows:
        occ[f, t] += o
        rec[f, t] += n
    assert got == {k: (occ[k], rec[k]) for k in occ}
    assert list(tmp_path.iterdir()) == []


def test_frequencies(spark):
    units = [("AB", "rs", 7, [1, 1, 2]), ("ab", "rs", 6, [9, 9]), ("cd", "rs", 7, None), ("ef", "rs", 7, [2, None, 3]), ("ef", "rs", 7, [2, None, 3]), ("gh", "rs", 7, []), (None, "rs", 7, [5])]
    u = spark.createDataFrame(units, "content_hash string, term string, parser_version int, word_hashes array<long>")
    names = [(k, 0, "n") for k in range(30)] + [(0, 1, "n"), (0, 1, "n"), (1, 1, None), (2, 1, "m"), (None, 3, "z")]
    s = spark.createDataFrame(names, "file_id long, symbol_idx int, name string")
    got = {(r["field"], r["term"]): (r["occurrences"], r["records"], r["mark"]) for r in T.term_frequencies(u, s).collect()}
    assert got == {("word", "1"): (2, 1, "rare"), ("word", "2"): (2, 2, "rare"), ("word", "3"): (1, 1, "rare"), ("name", "n"): (31, 30, "common"), ("name", "m"): (1, 1, "rare")}
    assert T.term_frequencies(u.where("false"), s.where("false")).collect() == []


def test_long_arrays_are_counted_in_time_that_their_repeats_do_not_change(spark):
    long = [k % 20_000 for k in range(40_000)]
    u = spark.createDataFrame([("a", long), ("b", None), ("c", []), ("d", [None]), ("e", [7, 7, None, 7, 3])], "content_hash string, word_hashes array<long>")
    start = time.time()
    got = Counter()
    for r in T.array_counts(u, "word_hashes", "word").collect():
        got[r["term"], r["occurrences"]] += 1
    assert time.time() - start < 20 and got["7", 3] == 1 and got["3", 1] == 1 and sum(got.values()) == 20_002 and got["7", 2] == 1


def test_spill_folder_is_shared(spark):
    assert T.spill_dir(spark).startswith(shared_dir(spark).removeprefix("file://"))
    spark.conf.set(T.SPILL_CONF, "s3a://bucket/x")
    try:
        with pytest.raises(RuntimeError):
            T.spill_dir(spark)
    finally:
        spark.conf.unset(T.SPILL_CONF)
