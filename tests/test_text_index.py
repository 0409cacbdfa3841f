"""Saved text indexes and pruned search: the same answers as a search over the whole base."""

import random

import pytest
from pyspark import cloudpickle

import folio
from folio.operators import pruned, retrieve
from folio.sinks import text_index
from folio.sinks.tables import current_version

cloudpickle.register_pickle_by_value(folio)  # workers get the values that tests set

SF_DIR = "/root/testdata/sf0.01"


def made(spark, n=300, seed=2):
    random.seed(seed)
    words = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join(random.choices(words, [1 / (i + 1) for i in range(150)], k=random.randint(0, 40)))) for k in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "?!"), (n + 3, "w1 " * 5000), (n + 4, rows[5][1]), (n + 5, rows[5][1])]
    queries = [(k, " ".join(random.choices(words, k=random.randint(1, 6)))) for k in range(40)] + [(90, None), (91, ""), (92, "unknown")]
    return spark.createDataFrame(rows, "id long, text string").repartition(4), spark.createDataFrame(queries, "query_id long, question string")


def answers(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in df.collect())


@pytest.mark.parametrize("hot", [500_000, 20, 0])
def test_rows_lengths_do_not_depend_on_which_tokens_are_frequent(spark, monkeypatch, hot):
    base, asked = made(spark)
    want = answers(retrieve.near_text(asked, retrieve.index_text(base)))
    monkeypatch.setattr(retrieve, "HOT_TOKENS", hot)
    index = retrieve.index_text(base)
    assert index.hot.num_rows <= hot
    assert answers(retrieve.near_text(asked, index)) == want


@pytest.mark.parametrize(("rows", "seeds", "cells", "queries"), [(8, 32, 4_000_000, 4_096), (1, 1, 4_000_000, 4_096), (3, 2, 60, 7)])
def test_pruned_search_has_the_same_answers(spark, monkeypatch, rows, seeds, cells, queries):
    base, asked = made(spark)
    index = retrieve.index_text(base)
    want = answers(retrieve.near_text(asked, index, k=7))
    for module, name, value in ((pruned, "BLOCK_ROWS", rows), (pruned, "SEEDS", seeds), (retrieve, "MAX_QUERY_CELLS", cells), (retrieve, "MAX_BLOCK_QUERIES", queries)):
        monkeypatch.setattr(module, name, value)
    got = pruned.near_text_pruned(asked, pruned.block_index(index), k=7)
    assert answers(got.hits) == want
    work = {r["query_id"]: (r["scored"], r["postings"]) for r in got.work.collect()}
    assert all(s <= p for s, p in work.values()) and any(s < p for s, p in work.values())


def test_less_than_half_of_the_postings_is_scored(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    asked = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").selectExpr("item_id AS query_id", "text AS question")
    got = pruned.near_text_pruned(asked, pruned.block_index(retrieve.index_text(docs, id="doc_id")), id="doc_id")
    scored, postings = got.work.groupBy().sum("scored", "postings").first()
    assert 0 < scored < 0.5 * postings


def test_pruned_search_of_nothing(spark):
    base, asked = made(spark)
    blocks = pruned.block_index(retrieve.index_text(base.limit(0)))
    assert pruned.near_text_pruned(asked, blocks).hits.count() == 0
    assert pruned.near_text_pruned(asked.limit(0), pruned.block_index(retrieve.index_text(base))).hits.count() == 0


def test_index_is_saved_added_to_merged_and_pruned(spark, tmp_path):
    root = str(tmp_path / "index")
    base, asked = made(spark)
    want = answers(retrieve.near_text(asked, base))
    with pytest.raises(ValueError):
        text_index.read_index(spark, root)
    parts = [base.filter(f"id % 3 = {k}") for k in range(3)]
    assert [text_index.append_texts(spark, root, p) for p in parts] == [1, 2, 3]
    assert text_index.segments(spark, root).count() == 3
    assert answers(retrieve.near_text(asked, text_index.read_index(spark, root))) == want
    two = answers(retrieve.near_text(asked, parts[0].union(parts[1])))
    assert answers(retrieve.near_text(asked, text_index.read_index(spark, root, version=2))) == two
    assert text_index.merge_segments(spark, root) == 4
    assert text_index.segments(spark, root).count() == 1
    assert text_index.merge_segments(spark, root) == 4
    assert answers(retrieve.near_text(asked, text_index.read_index(spark, root))) == want
    text_index.prune(spark, root, keep=1)
    assert len(list((tmp_path / "index/segments").glob("segment-*"))) == 1
    assert current_version(spark, f"{root}/versions") == 4
    assert answers(retrieve.near_text(asked, text_index.read_index(spark, root))) == want


def test_an_index_keeps_its_analyzer_and_kind_of_id(spark, tmp_path):
    root = str(tmp_path / "index")
    base, _ = made(spark, 20)
    text_index.append_texts(spark, root, base, analyzer="char2")
    with pytest.raises(ValueError):
        text_index.append_texts(spark, root, base)
    with pytest.raises(ValueError):
        text_index.append_texts(spark, root, base.selectExpr("string(id) AS id", "text"), analyzer="char2")
    assert current_version(spark, f"{root}/versions") == 1


def test_segments_are_cut_into_tokens_once(spark, tmp_path):
    root = str(tmp_path / "index")
    base, asked = made(spark, 50)
    text_index.append_texts(spark, root, base)
    index = text_index.read_index(spark, root)
    assert index.n == base.count()
    plan = index.rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,tokens" in plan and "split(" not in plan and "Join" not in plan
