import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folio import constants as K
from folio.functions import arrays as A
from folio.operators import dataset as D, tokens as T
from folio.plugins import complete_echo_list, tokenize_code_points


@pytest.mark.parametrize("n", [0, 1, 4, 5, 997])
def test_exact_split_is_complete_and_exact(spark, n):
    out = D.split_exact(spark.range(n), ["id"]).collect()
    held = [r.id for r in out if r.split == "validation"]
    assert sorted(r.id for r in out) == list(range(n))
    assert len(held) == math.ceil(n * 0.2)


def test_exact_split_with_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(D, "SPLIT_HEX_DIGITS", 1)
    few = {r.id: r.split for r in D.split_exact(spark.range(500), ["id"]).collect()}
    monkeypatch.undo()
    many = {r.id: r.split for r in D.split_exact(spark.range(500), ["id"]).collect()}
    assert few == many


def test_split_depends_on_seed_only(spark):
    a = D.split_hash(spark.range(100).repartition(5), ["id"]).collect()
    b = D.split_hash(spark.range(100), ["id"]).collect()
    assert sorted(a) == sorted(b)
    assert sorted(D.split_hash(spark.range(100), ["id"], seed=1).collect()) != sorted(b)


def test_variants(spark):
    df = spark.createDataFrame(
        [("I", "方剂名称：N", "1.甲 乙\n2. 丙3两"), ("J", "方剂名称：M", None)], "input string, output string, response string"
    )
    got = sorted((r.variant_no, r.input, r.output) for r in D.expand_variants(df).collect())
    assert got == [(0, "I", "N"), (1, "甲乙", "N"), (2, "丙", "N"), (3, "两", "N")]


def test_a_failing_completion_leaves_the_others(spark):
    def complete(batch: pd.Series) -> pd.Series:
        if batch.str.contains("bad").any():
            raise RuntimeError("refused")
        return complete_echo_list(batch)

    df = spark.createDataFrame([("good",), ("bad",), ("fine",)], "input string").withColumn("output", F.lit("方剂名称：N"))
    answered = D.run_completion(D.completion_prompts(df), complete)
    got = sorted((r.input, r.variant_no) for r in D.expand_variants(answered).collect())
    assert got == [("fine", 0), ("fine", 1), ("fine", 2), ("good", 0), ("good", 1), ("good", 2)]


def test_a_rerun_asks_only_what_is_missing(spark, tmp_path):
    from folio.sinks import completions

    root, log = str(tmp_path / "runs"), tmp_path / "asked"
    df = spark.createDataFrame([(k, p) for k, p in enumerate(["a", "b", "bad", "a", "later", None])], "n int, prompt string")

    def completer(refused):
        def complete(batch):
            if set(batch) & refused:
                raise ValueError("refused")
            with log.open("a") as f:
                f.writelines(f"{p}\n" for p in batch)
            return batch.str.upper()

        return complete

    assert completions.complete_missing(df, root, completer({"bad", "later"}), attempts=2) == 1
    assert completions.complete_missing(df, root, completer({"bad"}), attempts=2) == 2
    assert completions.complete_missing(df, root, completer(set()), attempts=2) == 3
    assert sorted(log.read_text().split()) == ["a", "b", "later"]  # no prompt twice, and 'bad' not a third time
    got = {r.n: (r.response, r.reject, r.attempts) for r in completions.with_responses(df, root).collect()}
    assert got == {0: ("A", None, 1), 1: ("B", None, 1), 2: (None, "ValueError: refused", 2), 3: ("A", None, 1), 4: ("LATER", None, 2), 5: (None, None, 0)}


def test_template_augment(spark):
    df = spark.createDataFrame([(i, f"药{i}", f"名{i}") for i in range(40)], "id int, input string, output string")
    rows = D.template_augment(df, ["id"]).collect()
    assert len(rows) == 40 * K.TEMPLATE_COPIES
    inputs = {t for r in rows for t in K.INPUT_TEMPLATES if r.input == t.replace("{}", f"药{r.id}")}
    outputs = {t for r in rows for t in K.OUTPUT_TEMPLATES if r.output == t.replace("{}", f"名{r.id}")}
    assert inputs == set(K.INPUT_TEMPLATES) and outputs == set(K.OUTPUT_TEMPLATES)
    assert all(r.formatted.endswith(f"<|im_start|>assistant\n{r.output}<|im_end|>") for r in rows)


def test_summary_needs_its_columns(spark):
    df = D.union_splits(train=spark.range(3), validation=spark.range(2))
    assert sorted(tuple(r) for r in D.dataset_summary(df, ["id"]).collect()) == [
        ("train", 3, "id"),
        ("validation", 2, "id"),
    ]
    with pytest.raises(ValueError, match="formatted"):
        D.dataset_summary(df, ["formatted"])


def test_padding_and_masks(spark):
    df = spark.createDataFrame([([5, 6, 7], [5, 0, 7])], "i array<int>, t array<int>")
    r = T.pad_mask(df, "i", "t", 5).first()
    assert (r.input_ids, r.attention_mask, r.labels) == ([5, 6, 7, 0, 0], [1, 1, 1, 0, 0], [5, -100, 7, -100, -100])
    r = T.pad_mask(df, "i", "t", 5, mask=False).first()
    assert r.labels == [5, 0, 7, 0, 0]
    r = T.pad_mask(df, "i", "t", 2).first()
    assert (r.input_ids, r.attention_mask, r.labels) == ([5, 6], [1, 1], [5, -100])


def test_given_tokenizer(spark):
    df = spark.createDataFrame([(1, "ab", "c")], "id int, q string, a string")
    r = T.tokenize_pad_mask(df, "q", "a", 4, tokenizer=tokenize_code_points).first()
    assert (r.input_ids, r.labels) == ([97, 98, 0, 0], [99, -100, -100, -100])


def test_after_prefix(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2]), ([1], [1, 2]), ([], [])], "o array<int>, p array<int>")
    assert [r.x for r in df.select(A.after_prefix(F.col("o"), F.col("p")).alias("x")).collect()] == [[3], [], []]


def test_batches_are_padded_to_a_multiple_of_eight(spark):
    sizes = [3, 9, 1, 1, 1, 1, 1, 1, 16, 2, 17]
    df = spark.createDataFrame([(i, [7] * n) for i, n in enumerate(sizes)], "id int, ids array<int>")
    got = {r.id: r for r in T.collate_batches(df, "ids", ["id"]).collect()}
    assert [len(got[i].input_ids) for i in range(11)] == [16] * 8 + [24] * 3
    assert got[8].attention_mask == [1] * 16 + [0] * 8 and got[8].labels == [7] * 16 + [-100] * 8
    assert [got[i].batch_id for i in range(11)] == [0] * 8 + [1] * 3
