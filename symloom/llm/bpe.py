"""Byte-level BPE of whole texts by a public vocabulary.

Each pre-token is merged by a segment tree over its adjacent pairs: a leaf holds the rank of a pair, an inner node the
smallest of its two children, so the root is always the leftmost pair of lowest rank. A merge changes at most three
leaves, each update costs the logarithm of the length, and the work ends when the root holds no pair. A run of a
million characters costs n log n, and no text is cut.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.sources.spread import spread

DEFAULT_TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS_DIR", "/opt/tokenizers")
#: Fixed value: how the public vocabulary divides a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 200_000
CACHED_BYTES = 64


class BytePairEncoder:
    """encode(text) gives the ids of the whole text; special tokens' strings are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.words = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}

    @classmethod
    def load(cls, path: str) -> BytePairEncoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a})

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks, n = self.ranks, len(piece)
        if n == 1 or piece in ranks:
            return [ranks[piece]]
        none = len(ranks) * n  # larger than any key
        width = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [none] * (2 * width)
        end, before = [*range(1, n + 1)], [*range(-1, n - 1)]  # of the symbol that starts at i
        get = ranks.get
        for i in range(n - 1):
            if (r := get(piece[i : i + 2])) is not None:
                tree[width + i] = r * n + i  # equal ranks: the leftmost is smaller
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(i: int) -> None:
            j = end[i]
            r = get(piece[i : end[j]]) if j < n else None
            k = width + i
            tree[k] = none if r is None else r * n + i
            up(k)

        def up(k: int) -> None:
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a < b else b
                if tree[k] == least:
                    break
                tree[k] = least
                k >>= 1

        while tree[1] < none:
            i = tree[1] % n
            j = end[i]
            end[i] = end[j]
            if end[j] < n:
                before[end[j]] = i
            if j < n - 1:
                tree[width + j] = none
                up(width + j)
            put(i)
            if before[i] >= 0:
                put(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def word(self, word: str) -> list[int]:
        found = self.cache.get(word)
        if found is None:
            raw = word.encode()
            found = self.merge(raw)
            if len(raw) <= CACHED_BYTES:
                if len(self.cache) >= CACHE_WORDS:  # bounded: a new start is cheaper than keeping an order of use
                    self.cache.clear()
                self.cache[word] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for w in self.words(text or ""):
            out += self.cache.get(w) or self.word(w)
        return out


_encoders: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """The encoder of a vocabulary file, once per worker process."""
    if path not in _encoders:
        _encoders[path] = BytePairEncoder.load(path)
    return _encoders[path]


def token_ids(docs: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, ids): the ids of each text. An empty and a null text give an empty list; repeated rows stay repeated."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            at, ids, keys = [0], [], batch.column(0)
            start = 0
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids += encode(t)
                at.append(len(ids))
                if len(ids) > 4_000_000:  # so that lists of a batch of long texts don't pile up
                    yield batch_of(keys.slice(start, i + 1 - start), at, ids)
                    at, ids, start = [0], [], i + 1
            if len(at) > 1:
                yield batch_of(keys.slice(start), at, ids)

    def batch_of(keys: pa.Array, at: list[int], ids: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], names=[key, "ids"])

    slim = docs.select(F.col(key), F.col(text).alias("_text"))
    return spread(slim).mapInArrow(run, f"`{key}` {slim.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(docs: DataFrame, keep: list[str], text: str, vocabulary: str) -> DataFrame:
    """`keep` and `n_tokens` of each row; 0 for an empty and a null text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            counts = pa.array([len(encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], names=[*keep, "n_tokens"])

    slim = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keep)
    return spread(slim).mapInArrow(run, f"{schema}, n_tokens bigint")
