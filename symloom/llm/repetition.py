"""Repetition inside a single document.

The words of a document, line after line, are one sequence. A linear-chain conditional random field labels each of
them as content or as boilerplate (said before in the same text), by Viterbi decoding over what can be seen at a word:
whether the five or three words that begin or end there stood earlier, and whether it lies in a whole line, sentence or
paragraph that did. No single observation is the answer: in a phrase of five words that is said again, only the first
word begins five and only the last one ends five that stood earlier, and the words between show three at most, as do
words of wordings that are merely alike. The share of characters whose words are labelled as content decides.

Words count as equal apart from letter case, spacing, punctuation and running numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.sources.spread import spread

NGRAM = 5
SHORT = 3
FOUND_SHARE = 0.4
#: Observations at a word, as bits: it begins or ends five words, begins or ends three words that stood earlier, lies in a unit that did.
BEGINS, ENDS, SHORT_BEGINS, SHORT_ENDS, IN_UNIT = 1, 2, 4, 8, 16
SIGHTS = 32

# a character of a script without blanks is a word of its own; so is a number, whatever it is
WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{N}]+|[\p{L}\p{M}_]+")
#: The same words where all characters are ASCII; texts are in lower case.
ASCII_WORD = re.compile(r"[0-9]+|[a-z_]+")
BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
SENTENCE_END = re.compile(r"(?<=[.!?;:…])[\"'”’)\]]*\s+|(?<=[。！？；])")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Names(dict):
    """A number for each word of a text, 0 for all numbers."""

    def __missing__(self, word: str) -> int:
        self[word] = n = 0 if word[0].isnumeric() else len(self) + 1
        return n


class Segments:
    """Words of a text, and its lines, sentences and paragraphs."""

    __slots__ = ("ids", "lengths", "units")

    def __init__(self, text: str):
        ids: list[int] = []
        lengths: list[int] = []
        self.units: list[tuple[int, int]] = []  # lines, sentences and paragraphs, as ranges of words
        paragraph, number = 0, _Names().__getitem__
        ascii_words, all_words = ASCII_WORD.findall, WORD.findall
        for line in [*BREAK.split(text.lower()), ""]:
            begin = len(ids)
            for part in SENTENCE_END.split(line) if line else ():
                sentence = len(ids)
                words = ascii_words(part) if part.isascii() else all_words(part)
                ids += map(number, words)
                lengths += map(len, words)
                if words:
                    self.units.append((sentence, len(ids)))
            if len(ids) > begin:
                if self.units[-1][0] != begin:
                    self.units.append((begin, len(ids)))
            elif len(ids) > paragraph:
                if self.units[-1][0] != paragraph:
                    self.units.append((paragraph, len(ids)))
                paragraph = len(ids)
        self.ids, self.lengths = np.array(ids, np.int64), np.array(lengths, np.int64)

    def again(self, size: int) -> np.ndarray:
        """For each sequence of `size` words, by its first word, whether it stood earlier. A run of numbers is no
        wording: two of the words must be others."""
        n = len(self.ids)
        if n < size:
            return np.zeros(0, bool)
        with np.errstate(over="ignore"):
            h = np.zeros(n - size + 1, np.uint64)
            for k in range(size):
                h = (h ^ self.ids[k : n - size + 1 + k].astype(np.uint64)) * _MIX
                h ^= h >> np.uint64(29)
        again = np.ones(len(h), bool)
        again[np.unique(h, return_index=True)[1]] = False
        words = np.concatenate([[0], np.cumsum(self.ids > 0)])
        return again & (words[size:] - words[:-size] >= 2)

    def units_again(self) -> list[tuple[int, int]]:
        """The lines, sentences and paragraphs that stood earlier, as ranges of words."""
        seen: set[bytes] = set()
        out = []
        for a, b in self.units:
            key = self.ids[a:b].tobytes()
            if key in seen and self.ids[a:b].any():
                out.append((a, b))
            seen.add(key)
        return out

    def sights(self) -> np.ndarray:
        """What can be seen at each word, as bits."""
        n = len(self.ids)
        out = np.zeros(n, np.int64)
        for size, begins, ends in ((NGRAM, BEGINS, ENDS), (SHORT, SHORT_BEGINS, SHORT_ENDS)):
            again = self.again(size)
            out[: len(again)] |= again * begins
            out[n - len(again) :] |= again * ends
        for a, b in self.units_again():
            out[a:b] |= IN_UNIT
        return out

    def covered(self) -> np.ndarray:
        """True for each word of a sequence of NGRAM words, or of a unit, that stood earlier: counted, not labelled."""
        edges = np.zeros(len(self.ids) + 1, np.int64)
        at = np.flatnonzero(self.again(NGRAM))
        np.add.at(edges, at, 1)
        np.add.at(edges, at + NGRAM, -1)
        for a, b in self.units_again():
            edges[a] += 1
            edges[b] -= 1
        return np.cumsum(edges[:-1]) > 0


class ChainField:
    """Linear-chain conditional random field of two labels, 0 content and 1 boilerplate, over sequences of sights: a
    constant and one weight per bit and label, and one per pair of neighbouring labels."""

    def __init__(self, weights: np.ndarray, move: np.ndarray):
        self.weights, self.move = weights, move
        self.emit = self.vectors(np.arange(SIGHTS)) @ weights

    @staticmethod
    def vectors(sights: np.ndarray) -> np.ndarray:
        bits = np.stack([np.ones_like(sights), *((sights >> k) & 1 for k in range(5))], axis=-1)
        return bits.astype(float)

    @classmethod
    def fit(cls, sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 120, rate: float = 1.0, decay: float = 1e-4) -> ChainField:
        """Gradient ascent on the conditional likelihood, by forward and backward sums; no chance is involved."""
        longest = max(len(y) for _, y in sequences)
        x, one, real = np.zeros((len(sequences), longest, 6)), np.zeros((len(sequences), longest, 2)), np.zeros((len(sequences), longest))
        for k, (s, y) in enumerate(sequences):
            x[k, : len(y)], one[k, : len(y)], real[k, : len(y)] = cls.vectors(s), np.eye(2)[y], 1
        weights, move, total = np.zeros((6, 2)), np.zeros((2, 2)), real.sum()
        speed = [np.zeros_like(weights), np.zeros_like(move)]
        for _ in range(rounds):
            s = x @ weights
            a, b = np.zeros_like(s), np.zeros_like(s)
            a[:, 0] = s[:, 0]
            for t in range(1, longest):  # past its end a sequence keeps its sum
                step = s[:, t] + np.logaddexp(a[:, t - 1, :1] + move[0], a[:, t - 1, 1:] + move[1])
                a[:, t] = np.where(real[:, t, None] > 0, step, a[:, t - 1])
            for t in range(longest - 2, -1, -1):
                v = s[:, t + 1] + b[:, t + 1]
                b[:, t] = np.where(real[:, t + 1, None] > 0, np.logaddexp(move[:, 0] + v[:, :1], move[:, 1] + v[:, 1:]), 0)
            z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])[:, None, None]
            ge = np.einsum("ktf,ktl->fl", x, (one - np.exp(a + b - z)) * real[:, :, None]) / total - decay * weights
            pairs = np.exp(a[:, :-1, :, None] + move + (s[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, :, :, None]) * real[:, 1:, None, None]
            gm = (np.einsum("kti,ktj->ij", one[:, :-1], one[:, 1:]) - pairs.sum((0, 1))) / total - decay * move
            for k, (g, at) in enumerate(((ge, weights), (gm, move))):  # with momentum
                speed[k] = 0.9 * speed[k] + rate * g
                at += speed[k]
        return cls(weights, move)

    def decode(self, sights: np.ndarray) -> np.ndarray:
        """Viterbi: the likeliest labels of the whole sequence.

        Words that show the same are taken in one step. Where no change of labels weighs more than staying, as `fit`
        finds it, a best sequence changes at such borders alone: within equal words, moving a change is linear in its
        place.
        """
        move = self.move
        if max(move[0, 1], move[1, 0]) > min(move[0, 0], move[1, 1]):
            raise ValueError("the field rewards changes by themselves")
        starts = np.flatnonzero(np.concatenate([[True], sights[1:] != sights[:-1]]))
        sizes = np.diff(np.append(starts, len(sights)))
        s = self.emit[sights[starts]] * sizes[:, None] + np.array([move[0, 0], move[1, 1]]) * (sizes - 1)[:, None]
        rows = s.tolist()
        (m00, m01), (m10, m11) = move.tolist()
        p, q = rows[0]
        back = []
        for u, v in rows[1:]:
            f, g = q + m10 > p + m00, q + m11 > p + m01
            back.append((f, g))
            p, q = u + (q + m10 if f else p + m00), v + (q + m11 if g else p + m01)
        label = int(q > p)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return np.repeat(np.array(out[::-1]), sizes)


def made_document(rng: np.random.Generator, vocabulary: list[str]) -> tuple[str, np.ndarray]:
    """A text of made-up sentences and the label of each word: 1 in a phrase of NGRAM words or more, or a whole
    sentence, that was said before. Others repeat two to four words only, which is no repetition. Numbers run."""
    said: list[list[str]] = []
    lines: list[str] = []
    labels: list[int] = []
    rate = rng.choice([0.0, 0.15, 0.5, 0.85])
    numbers = rng.choice([0.0, 0.1, 0.4])

    def fresh(n: int) -> list[str]:
        return [str(rng.integers(1000)) if rng.random() < numbers else vocabulary[int(len(vocabulary) * rng.random() ** 2)] for _ in range(n)]

    for _ in range(int(rng.integers(3, 30))):
        words, marks = fresh(int(rng.integers(2, 16))), None
        if said and rng.random() < rate:
            old = said[int(rng.integers(len(said)))]
            if rng.random() < 0.6 or len(old) < NGRAM:  # all of it
                words, marks = list(old), [1] * len(old)
            else:  # a phrase of it, within other words
                size = int(rng.integers(NGRAM, len(old) + 1))
                at = int(rng.integers(len(old) - size + 1))
                before, after = fresh(int(rng.integers(0, 8))), fresh(int(rng.integers(0, 8)))
                words = before + old[at : at + size] + after
                marks = [0] * len(before) + [1] * size + [0] * len(after)
        elif said and rng.random() < 0.4:  # alike, but not the same
            old = said[int(rng.integers(len(said)))]
            size = min(len(old), int(rng.integers(2, NGRAM)))
            at = int(rng.integers(len(old) - size + 1))
            words = fresh(int(rng.integers(1, 5))) + old[at : at + size] + fresh(int(rng.integers(1, 5)))
        if marks is None or sum(m and not w.isdigit() for m, w in zip(marks, words, strict=True)) < 2:
            marks = [0] * len(words)
        words = [str(rng.integers(1000)) if w.isdigit() else w for w in words]
        if not any(marks):
            said.append(words)
        line = " ".join(words)
        if any(marks) and rng.random() < 0.5:
            line = f"  {line.upper()}" if rng.random() < 0.5 else line.replace(" ", " - ")
        lines.append(line + str(rng.choice([".\n", "! ", "\n"])))
        labels += marks
    return "".join(lines), np.array(labels)


@lru_cache(1)
def trained(documents: int = 150, seed: int = 7) -> ChainField:
    """The field, fitted on a bounded number of made-up documents whose repetitions are known."""
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice([*"abcdefghiklmnoprstuvw"], int(rng.integers(2, 9)))) for _ in range(3000)]
    sequences = []
    for _ in range(documents):
        text, labels = made_document(rng, vocabulary)
        seg = Segments(text)
        if len(seg.ids) == len(labels):
            sequences.append((seg.sights(), labels))
    return ChainField.fit(sequences)


def labelled(text: str | None, field: ChainField, count: bool = True) -> tuple[int, int, float, float | None]:
    """(words, boilerplate words, labelled share, counted share) of the characters of words; the last only on demand."""
    seg = Segments(text or "")
    if not len(seg.ids):
        return 0, 0, 0.0, 0.0 if count else None
    labels, every = field.decode(seg.sights()), seg.lengths.sum()
    counted = float((seg.lengths * seg.covered()).sum() / every) if count else None
    return len(labels), int(labels.sum()), float((seg.lengths * labels).sum() / every), counted


def repetition(docs: DataFrame, key: str, text: str, count: bool = True) -> DataFrame:
    """(key, words, boilerplate_words, boilerplate_share, counted_share) of each row.

    `boilerplate_share` is that of the labels; `counted_share` counts without the field, to compare, and is null
    without `count`. Empty, blank and null texts, and texts without letters and digits, have 0 everywhere. Rows are
    independent.
    """
    model = trained()
    types = (pa.int32(), pa.int32(), pa.float64(), pa.float64())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [labelled(t, model, count) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "words", "boilerplate_words", "boilerplate_share", "counted_share"])

    slim = docs.select(F.col(key), F.col(text).alias("_text"))
    return spread(slim).mapInArrow(run, f"`{key}` {slim.schema[key].dataType.simpleString()}, words int, boilerplate_words int, boilerplate_share double, counted_share double")


def repetitive(docs: DataFrame, key: str, text: str, share: float = FOUND_SHARE) -> DataFrame:
    """Keys of the documents whose content, as labelled, is no more than what `share` leaves of their characters."""
    return repetition(docs, key, text, count=False).where(F.col("boilerplate_share") >= share).select(key)
