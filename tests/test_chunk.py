import random

import pytest
from hypothesis import given, settings, strategies as st

from folio.operators import chunk as C


def plain_split(text, size, overlap, separators):
    """The splitting rule written down step by step, with lists only."""
    sep, finer = separators[-1], ()
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, finer = s, separators[i + 1 :]
            break
    if sep == "":
        pieces = list(text)
    else:
        pieces, rest = [], text
        while sep in rest[len(sep) :] if pieces else sep in rest:
            at = rest.index(sep, len(sep)) if pieces else rest.index(sep)
            pieces.append(rest[:at])
            rest = rest[at:]
        pieces.append(rest)
        pieces = [p for p in pieces if p]

    def merge(parts):
        docs, cur = [], []
        for p in parts:
            if sum(map(len, cur)) + len(p) > size and cur:
                docs.append("".join(cur).strip())
                while cur and (sum(map(len, cur)) > overlap or sum(map(len, cur)) + len(p) > size):
                    cur.pop(0)
            cur.append(p)
        docs.append("".join(cur).strip())
        return [d for d in docs if d]

    out, good = [], []
    for p in pieces:
        if len(p) < size:
            good.append(p)
        else:
            out.extend(merge(good))
            good = []
            out.extend(plain_split(p, size, overlap, finer) if finer else [p])
    return out + merge(good)


texts = st.text(alphabet="ab \n字", max_size=300)


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(5, 60), st.integers(0, 4))
def test_same_as_plain_rule(text, size, overlap):
    assert C.split_text(text, size, overlap) == plain_split(text, size, overlap, C.SEPARATORS)


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(5, 60))
def test_chunks_are_short_stripped_and_ordered(text, size):
    chunks = C.split_text(text, size, 4)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    at = 0
    for c in chunks:
        found = text.find(c, max(0, at - size))
        assert found >= 0
        at = found + len(c)


@pytest.mark.parametrize("n, chunks", [(0, 0), (1, 1), (499, 1), (500, 1), (501, 2), (950, 2), (951, 3)])
def test_fixed_and_recursive_agree_without_separators(spark, n, chunks):
    text = "".join(random.Random(n).choice("甲乙丙丁戊") for _ in range(n))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    fixed = [(r.chunk_no, r.chunk) for r in C.chunk_fixed(df, "text").collect()]
    recursive = [(r.chunk_no, r.chunk) for r in C.chunk_recursive(df, "text").collect()]
    assert sorted(fixed) == sorted(recursive) == [(i, text[450 * i : 450 * i + 500]) for i in range(chunks)]


def test_whole_table_against_plain_rule(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = sorted((r.doc_id, r.chunk_no, r.chunk) for r in C.chunk_recursive(docs, "text").collect())
    want = [
        (r.doc_id, i, c)
        for r in docs.collect()
        for i, c in enumerate(plain_split(r.text, 500, 50, C.SEPARATORS))
    ]
    assert got == sorted(want)
