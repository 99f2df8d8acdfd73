import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from symloom.llm import bpe

PATH = f"{bpe.DEFAULT_TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


def brute(e, piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        ranked = [(e.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in e.ranks]
        if not ranked:
            break
        _, i = min(ranked)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [e.ranks[p] for p in parts]


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.DEFAULT_TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_merge_equals_plain_search(piece):
    e = bpe.encoder(PATH)
    assert e.merge(piece) == brute(e, piece) or piece in e.ranks


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_equals_public_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert bpe.encoder(PATH).encode(text) == tokenizer().encode(text, add_special_tokens=False).ids


def test_special_strings_runs_and_round_trip():
    e = bpe.encoder(PATH)
    back = {v: k for k, v in e.ranks.items()}
    for t in ["<|endoftext|>", " " * 5000 + "x", "a" * 3000, "日本語" * 500, "it's we'll\r\n\t x", "\u200d\U0001f469\u200d\U0001f4bb", "1234567890" * 50]:
        ids = e.encode(t)
        assert ids == tokenizer().encode(t, add_special_tokens=False).ids
        assert b"".join(back[i] for i in ids).decode() == t


def test_long_run_is_not_quadratic():
    import time

    e, began = bpe.encoder(PATH), time.process_time()
    piece = "".join(random.Random(3).choice("ab") for _ in range(100_000)).encode()
    e.merge(piece)
    assert time.process_time() - began < 20


def test_table(spark):
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (4, "hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.token_ids(df, "doc_id", "text", PATH).collect())
    assert got == [(1, [31373, 995]), (2, []), (3, []), (3, []), (4, [31373, 995])]
    counts = sorted(tuple(r) for r in bpe.token_counts(df, ["doc_id"], "text", PATH).collect())
    assert counts == [(1, 2), (2, 0), (3, 0), (3, 0), (4, 2)]
    assert bpe.token_ids(df.where("doc_id < 0"), "doc_id", "text", PATH).collect() == []
