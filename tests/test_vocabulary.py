"""Vocabulary ids against plain Python, with a table so small that most words are shuffled."""

import random
from collections import Counter

import pytest

from folio.operators import vocabulary as V


def texts():
    random.seed(4)
    words = ["甲", "é", "a", "b", "Word,", "x" * 900, *[f"w{k}" for k in range(60)]]
    rows = [(k, " ".join(random.choices(words, [1 / (i + 1) for i in range(len(words))], k=random.randint(0, 30)))) for k in range(80)]
    return [*rows, (90, None), (91, ""), (92, " \u3000\t"), (93, "a\u3000b\na"), (94, rows[3][1]), (94, rows[3][1])]


def ranks(rows, size=None):
    counts = Counter(w for _, t in rows for w in (t or "").split())
    order = sorted(counts, key=lambda w: (-counts[w], w.encode()))
    return {w: k + V.FIRST for k, w in enumerate(order) if size is None or k + V.FIRST < size}, counts


@pytest.mark.parametrize(("hot", "held"), [(200_000, 16 << 20), (5, 16 << 20), (0, 16 << 20), (40, 30)])
@pytest.mark.parametrize("size", [None, 25])
def test_ids_equal_ranks_and_turn_back(spark, monkeypatch, hot, held, size):
    monkeypatch.setattr(V, "HOT_BYTES", held)
    monkeypatch.setattr(V, "HOT_WORDS", max(hot, 1) if hot else 1)
    rows = texts()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "n int, text string, _key string, _rare string").repartition(3)
    words = V.fit_vocabulary(df, "text", size)
    want, counts = ranks(rows, size)
    assert {r.word: (r.id, r.n) for r in words.collect()} == {w: (k, counts[w]) for w, k in want.items()}
    coded = V.encode(df, "text", words)
    assert coded.columns == [*df.columns, "ids"]
    expected = sorted((n, None if t is None else [want.get(w, V.UNKNOWN) for w in t.split()]) for n, t in rows if t is not None)
    got = coded.collect()
    assert sorted((r.n, r.ids) for r in got if r.text is not None) == expected
    assert all(r.ids is None for r in got if r.text is None)
    back = V.decode(coded, "ids", words).collect()
    assert sorted((r.n, [w or "?" for w in r.words]) for r in back if r.words is not None) == sorted(
        (n, [w if w in want else "?" for w in t.split()]) for n, t in rows if t is not None
    )


def test_pads_are_left_out_and_rare_words_may_be_dropped(spark):
    df = spark.createDataFrame([("a a b",), ("a c",)], "text string")
    words = V.fit_vocabulary(df, "text", min_count=2)
    assert [(r.word, r.id) for r in words.collect()] == [("a", 2)]
    padded = spark.createDataFrame([([2, 1, 2, 0, 0],)], "ids array<int>")
    assert V.decode(padded, "ids", words).first().words == ["a", None, "a"]
    assert V.fit_vocabulary(df.limit(0), "text").count() == 0
    assert V.encode(df, "text", V.fit_vocabulary(df.limit(0), "text")).first().ids == [1, 1, 1]
