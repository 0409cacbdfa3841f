"""Retrieval against brute force, with bounds small enough to force every path."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

import folio
from folio.operators import pruned, rag, retrieve as R
from folio.plugins import embed_letter_counts

cloudpickle.register_pickle_by_value(folio)  # workers see the patched bounds


@pytest.fixture(params=["one pass", "many passes"])
def bounds(request, monkeypatch):
    if request.param == "many passes":
        monkeypatch.setattr(R, "MAX_BLOCK_QUERIES", 3)
        monkeypatch.setattr(R, "MAX_SCORE_CELLS", 10)
        monkeypatch.setattr(R, "HOT_TOKENS", 4)


def best(scores, k):
    return [i for _, i in sorted((round(s, 9), i) for i, s in scores)][:k]


def test_vectors(spark, bounds):
    rng = np.random.default_rng(1)
    base = {i: rng.normal(size=5) for i in range(60)}
    base.update({i: base[3] for i in range(60, 90)})  # a third of the rows are copies
    asked = {i: rng.normal(size=5) for i in range(10)} | {10: base[3]}
    cos = lambda a, b: float(a @ b / math.sqrt((a @ a) * (b @ b)))
    want = {q: best([(i, 1 - cos(v, w)) for i, w in base.items()], 4) for q, v in asked.items()}
    b = spark.createDataFrame([(i, v.tolist()) for i, v in base.items()], "id int, vector array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in asked.items()], "query_id int, vector array<double>")
    got = {}
    for r in R.near_vector(q, b, 4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    assert {q: [h[i] for i in sorted(h)] for q, h in got.items()} == want


def test_vectors_without_self(spark):
    b = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])], "id string, vector array<double>")
    q = b.withColumnRenamed("id", "query_id")
    got = sorted((r.query_id, r.id) for r in R.near_vector(q, b, 1, exclude_self=True).collect())
    assert got == [("a", "b"), ("b", "a"), ("c", "b")]


def test_faulty_vectors_are_rejects(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [0.9, 0.1]), (7, [1.0, float("nan")]), (8, [])]
    b = spark.createDataFrame(rows, "id int, vector array<double>")
    q = b.withColumnRenamed("id", "query_id")
    got = sorted((r.query_id, r.id) for r in R.near_vector(q, b).collect())
    assert got == [(1, 1), (1, 6), (6, 1), (6, 6)]
    faults = {r.id: r.reject for r in R.vector_rejects(b, "vector", 2).collect()}
    assert faults == {2: "wrong length", 3: "missing value", 4: "zero vector", 5: "missing value", 7: "missing value", 8: "zero vector"}


def test_repeated_query_ids_are_refused(spark):
    base = spark.createDataFrame([(1, "a b"), (2, "c d")], "id int, text string")
    asked = spark.createDataFrame([(7, "a"), (7, "c")], "query_id int, question string")
    with pytest.raises(ValueError, match="unique"):
        R.near_text(asked, base)
    vectors = spark.createDataFrame([(7, [1.0]), (7, [2.0])], "query_id int, vector array<double>")
    with pytest.raises(ValueError, match="unique"):
        R.near_vector(vectors, vectors.withColumnRenamed("query_id", "id"))


def brute_text(asked, base, k, tokens):
    df = Counter(t for text in base.values() for t in set(tokens(text)))
    idf = lambda t: math.log((1 + len(base)) / (1 + df[t])) + 1
    weigh = lambda text: {t: n * idf(t) for t, n in Counter(tokens(text)).items()}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
    vectors = {i: weigh(text) for i, text in base.items()}
    out = {}
    for q, text in asked.items():
        w = weigh(text)
        scores = []
        for i, v in vectors.items():
            shared = w.keys() & v.keys()
            if shared:
                scores.append((i, 1 - sum(w[t] * v[t] for t in shared) / (norm(w) * norm(v))))
        if scores:
            out[q] = best(scores, k)
    return out


@pytest.mark.parametrize("analyzer", ["word", "char2"])
def test_texts(spark, bounds, analyzer):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(30)]
    base = {i: "The " + " ".join(rng.choice(vocabulary, rng.integers(1, 12))) for i in range(60)}
    base.update({i: "the the the" for i in range(60, 90)})  # one word in all, a third hold nothing else
    base[90] = ""
    base[91] = "!!"
    asked = {i: " ".join(rng.choice(vocabulary, 3)) for i in range(9)} | {9: "the", 10: "unknown zz", 11: "...", 12: "the W1, the"}
    if analyzer == "word":
        tokens = lambda t: [x for x in re.split(r"[\W_]+", t.lower()) if x]
    else:
        tokens = lambda t: [t.lower()[i : i + 2] for i in range(len(t) - 1) if re.fullmatch(r"[^\W_]{2}", t.lower()[i : i + 2])]
    b = spark.createDataFrame(list(base.items()), "id int, text string")
    q = spark.createDataFrame(list(asked.items()), "query_id int, question string")
    got = {}
    for r in R.near_text(q, b, 5, analyzer=analyzer).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    assert {q: [h[i] for i in sorted(h)] for q, h in got.items()} == brute_text(asked, base, 5, tokens)


def test_no_queries(spark):
    q = spark.createDataFrame([], "query_id int, question string")
    b = spark.createDataFrame([(1, "a")], "id int, text string")
    assert R.near_text(q, b).count() == 0


def test_given_embedder(spark):
    docs = spark.createDataFrame([(1, "aaa"), (2, "abc"), (3, "zzz")], "id int, text string")
    base = R.embed(docs, "text", "vector", embed_letter_counts)
    asked = R.embed(spark.createDataFrame([(7, "aab")], "query_id int, text string"), "text", "vector", embed_letter_counts)
    assert [r.id for r in R.near_vector(asked, base, 2).orderBy("rank").collect()] == [1, 2]


KB = "id int, type string, medicine_a string, medicine_b string, dosage string, function string"


def test_requests_to_prompts(spark):
    raw = spark.createDataFrame(
        [
            (1, '{"question":"麻黄 x","model":"m"}'),
            (2, '{"question":"  ","model":"m"}'),
            (3, '{"question":"麻黄","model":"m","external_db":false}'),
            (4, '{"question":"nothing","model":"m","external_db":true}'),
            (5, '{"question":"麻黄","model":"unknown"}'),
            (6, '{"question":"麻黄","model":"off"}'),
        ],
        "request_id int, value string",
    )
    models = spark.createDataFrame([("m", "/m", True), ("off", "/o", False)], "model string, path string, active boolean")
    base = spark.createDataFrame([(1, "t", "麻黄", "桂枝", "9g", "麻黄 发汗"), (2, "t", "知母", "黄柏", "9g", "清热")], KB)
    requests = rag.parse_requests(raw)
    assert sorted(r.request_id for r in requests.collect()) == [1, 3, 4, 5, 6]
    assert sorted(r.request_id for r in rag.route_rejects(requests, models).collect()) == [5, 6]
    out = rag.rag_prompt(rag.route_requests(requests, models), base, text="function")
    got = {r.request_id: r.prompt for r in out.collect()}
    tail = "\n 请给我中文回答。Answer:"
    assert got == {
        1: f"Context: 't  麻黄  桂枝  9g  麻黄 发汗' \n\nQuestion: 麻黄 x{tail}",
        3: f"Question: 麻黄{tail}",
        4: f"Question: nothing{tail}",
    }


def test_tasks_work_on_few_products_at_a_time(spark, monkeypatch):
    texts = [(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 30))) for i in range(300)] + [(300, ""), (301, None)]
    base = spark.createDataFrame(texts, "id long, text string").repartition(2)
    asked = spark.createDataFrame([(i, f"w{i} w{i + 1} w3 w5") for i in range(15)], "query_id long, question string")

    def answers():
        index = R.index_text(base)
        plain = R.near_text(asked, index, 5).orderBy("query_id", "rank").collect()
        found = pruned.near_text_pruned(asked, pruned.block_index(index), 5)
        return plain, found.hits.orderBy("query_id", "rank").collect(), found.work.agg({"postings": "sum"}).collect()

    want = answers()
    monkeypatch.setattr(R, "MAX_TASK_POSTINGS", 200)
    monkeypatch.setattr(pruned, "MAX_PAIRS", 100)
    assert answers() == want and want[0] == want[1]
    table = pa.table({"tokens": pa.array([["a"] * n for n in (150, 60, 250, 0, 10)])}).to_batches()[0]
    assert [b.num_rows for b in R.token_slices(table)] == [1, 1, 1, 2]
    assert [b.num_rows for b in R.token_slices(table.slice(1), 1)] == [1, 1, 1, 1]
    asked_tokens = R.QueryBlock(pa.table({"query": [1, 2], "token": ["a", "a"], "w": [1.0, 1.0], "idf": [1.0, 1.0]}))
    blocks = pa.table({"tokens": [["a"]] * 9, "sizes": pa.array([[20]] * 9, pa.list_(pa.int32()))}).to_batches()[0]
    assert [b.num_rows for b in pruned._few_products(blocks, asked_tokens, 100)] == [2, 2, 2, 2, 1]
