import itertools

import numpy as np

from symloom.llm import repetition as R


def brute(text):
    """Words in a sequence of five that stood before, or in a whole line, sentence or paragraph that did."""
    s = R.Segments(text)
    ids, seen, out = s.ids.tolist(), set(), [False] * len(s.ids)
    for i in range(len(ids) - R.NGRAM + 1):
        g = tuple(ids[i : i + R.NGRAM])
        if g in seen and sum(x > 0 for x in g) >= 2:
            out[i : i + R.NGRAM] = [True] * R.NGRAM
        seen.add(g)
    units = set()
    for a, b in s.units:
        k = tuple(ids[a:b])
        if k in units and any(k):
            out[a:b] = [True] * (b - a)
        units.add(k)
    return out


def test_cover_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        words = rng.choice(["alpha", "beta", "gamma", "d", "12", "x9"], int(rng.integers(0, 60)))
        seps = rng.choice([" ", ". ", "\n", "\n\n", ", "], len(words))
        text = "".join(a + b for a, b in zip(words, seps, strict=True))
        s = R.Segments(text)
        assert s.covered().tolist() == brute(text)


def test_held_out_accuracy():
    field = R.trained()
    rng = np.random.default_rng(99)
    vocabulary = ["".join(rng.choice([*"acdefgiklmnoprstuvy"], int(rng.integers(3, 10)))) for _ in range(2000)]
    right = total = repeated = 0
    for _ in range(60):
        text, labels = R.made_document(rng, vocabulary)
        s = R.Segments(text)
        assert len(s.ids) == len(labels)
        right += int((field.decode(s.sights()) == labels).sum())
        total += len(labels)
        repeated += int(labels.sum())
    assert repeated > 500 and right / total > 0.98


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(4)
    for _ in range(40):
        low, lower, high, higher = np.sort(rng.normal(size=4))
        move = np.array([[high, low], [lower, higher]])
        field = R.ChainField(rng.normal(size=(6, 2)), move)
        sights = np.repeat(rng.integers(0, R.SIGHTS, 4), rng.integers(1, 4, 4))
        n = len(sights)
        score = lambda y: sum(field.emit[sights[t], y[t]] for t in range(n)) + sum(move[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        best = max(itertools.product([0, 1], repeat=n), key=score)
        assert abs(score(tuple(field.decode(sights))) - score(best)) < 1e-9


def test_no_sight_alone_is_the_answer():
    field = R.trained()
    # five words said again within others: only the first begins, and only the last ends, five that stood earlier
    s = R.Segments("one two three four five six. seven eight two three four five six nine ten")
    seen = s.sights()[8:13]
    assert [bool(x & R.BEGINS) for x in seen] == [True, False, False, False, False] and [bool(x & R.ENDS) for x in seen] == [False] * 4 + [True]
    assert field.decode(s.sights()).tolist() == [0] * 8 + [1] * 5 + [0] * 2
    # four words: what is seen of three says so within as without
    s = R.Segments("one two three four five six. seven eight two three four five nine ten")
    assert any(x & R.SHORT_BEGINS for x in s.sights()) and not field.decode(s.sights()).any()


def test_the_labels_decide(spark, monkeypatch):
    df = spark.createDataFrame([(1, "buy now " * 40)], "doc_id long, text string")
    assert R.repetitive(df, "doc_id", "text").count() == 1
    blind = R.ChainField(np.array([[1.0, 0.0]] + [[0.0, 0.0]] * 5), np.zeros((2, 2)))
    monkeypatch.setattr(R, "trained", lambda: blind)
    assert R.repetitive(df, "doc_id", "text").count() == 0
    assert R.repetition(df, "doc_id", "text").first()["counted_share"] > 0.9


def test_dress_does_not_hide_and_likeness_is_no_repetition(spark):
    line = "The quick brown fox number {} jumps over the lazy dog"
    rows = [
        (1, "\n".join(line.format(k) for k in range(6)), 0), (2, "\r\n".join([line.format(1), "  THE QUICK; BROWN FOX -- number 77 jumps, over the LAZY dog!!"]), 0),
        (3, "One thing happens here. Another thing occurs there. Some thing else is going on now.", 0), (4, None, 0), (5, "", 0), (6, " \n\n ", 0), (7, "buy now " * 40, 0),
        (8, "[" + ", ".join(str(k % 7) for k in range(300)) + "]", 0), (9, "x" * 20000, 0), (10, "これは文です。これは文です。これは文です。", 0), (10, "これは文です。これは文です。これは文です。", 0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, repeated_share int")
    assert sorted(r[0] for r in R.repetitive(df, "doc_id", "text").collect()) == [1, 2, 7, 10, 10]
    shares = {r["doc_id"]: r["boilerplate_share"] for r in R.repetition(df, "doc_id", "text").collect()}
    assert shares[4] == shares[5] == shares[6] == 0
    assert R.repetitive(df.where("doc_id < 0"), "doc_id", "text").collect() == []
