"""Chunks of bytes against an incremental decoder."""

import codecs
import random

import pytest

from folio.operators.ordered import decode_chunks


@pytest.mark.parametrize("block_rows", [4, 5, 1 << 18])
def test_decoded_chunks_equal_an_incremental_decoder(spark, block_rows):
    random.seed(6)
    rows, want = [], {}
    for g in range(12):
        data = "".join(random.choice("aé甲😀 \n") for _ in range(random.randint(0, 40))).encode()
        decoder, at, k = codecs.getincrementaldecoder("utf-8")(), 0, 0
        while at < len(data):
            n = random.choice([0, 1, 1, 2, 3, 5])
            rows.append((g if g else None, k * 3, bytes(data[at : at + n]), "x"))
            want[g if g else None, k * 3] = decoder.decode(data[at : at + n])
            at, k = at + n, k + 1
    rows.append((99, 0, None, "x"))
    want[99, 0] = ""
    df = spark.createDataFrame(rows, "g int, k int, chunk binary, _all string").drop("_all").repartition(4)
    got = decode_chunks(df, ["g"], "k", "chunk", "text", block_rows).collect()
    assert {(r.g, r.k): r.text for r in got} == want and len(got) == len(rows)


def test_no_chunks(spark):
    assert decode_chunks(spark.createDataFrame([], "g int, k int, chunk binary"), ["g"], "k", "chunk", "text").count() == 0


@pytest.mark.parametrize("parts", [3, 60])
def test_characters_cut_between_tasks(spark, parts):
    texts = {None: "a😀甲é" * 4, 1: "😀😀😀", 2: "é", 3: "甲" * 9}
    rows = [(g, k, bytes([b])) for g, t in texts.items() for k, b in enumerate(t.encode())]
    before = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        df = spark.createDataFrame([*rows, (4, 0, "x甲".encode()[:-1])], "g int, k int, chunk binary")
        got = decode_chunks(df, ["g"], "k", "chunk", "text").collect()
        with pytest.raises(Exception):
            decode_chunks(spark.createDataFrame([(1, k, bytes([b])) for k, b in enumerate("甲".encode()[:2] + b"a" * 9)], "g int, k int, chunk binary"), ["g"], "k", "chunk", "text").collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert {g: "".join(r.text for r in sorted(got, key=lambda r: r.k) if r.g == g) for g in [*texts, 4]} == texts | {4: "x"}


def test_sorted_rows_are_not_shuffled_again(spark):
    df = spark.createDataFrame([(1, 0, b"a")], "g int, k int, chunk binary")
    plan = decode_chunks(df, ["g"], "k", "chunk", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan
