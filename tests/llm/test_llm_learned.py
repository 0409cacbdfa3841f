"""Toxicity and language: exact parts against brute force, learned parts on held-out rows."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folio.llm import language, toxicity

SF_DIR = "/root/testdata/sf0.01"


def brute_segments(scores, at=0):
    """The best run, then the same left and right of it."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-12 and (best is None or total > best[2] + 1e-9):
                best = (i, j + 1, total)
    if best is None:
        return []
    a, b, v = best
    return brute_segments(scores[:a], at) + [(a + at, b + at, v)] + brute_segments(scores[b:], at + b)


def test_maximal_segments_equal_their_definition():
    random.seed(2)
    for _ in range(2000):
        scores = [random.choice([-3.1, -1.7, -0.45, 1.3, 2.17, 0.51, -0.9]) for _ in range(random.randint(0, 14))]
        got, want = toxicity.maximal_segments(scores), brute_segments(scores)
        assert len(got) == len(want) and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_segments_of_texts_are_those_of_their_words():
    random.seed(6)
    scores = {"bad": 3.0317, "vile": 2.0173, "so": -1.0091}
    texts = [" ".join(random.choice(["Bad!", "vile", "so", "word", "(bad)"]) for _ in range(random.randint(0, 30))) for _ in range(200)] + [""]
    scores = {f"={w}": v for w, v in scores.items()}
    got, n_words, of_words = toxicity.text_segments(pa.array(texts, pa.large_string()), scores)
    assert len(of_words) == n_words.sum()
    for text, found, n in zip(texts, got, n_words):
        words = [w.lower().strip("!()") for w in text.split()]
        want = brute_segments([scores.get(f"={w}", 0.0) - toxicity.DRIFT for w in words])
        assert n == len(words) and len(found) == len(want)
        assert np.allclose([f[2] for f in found], [w[2] for w in want])


def test_toxic_words_are_learned(spark):
    random.seed(7)
    docs, labels = [], []
    for k in range(600):
        words = [random.choice("corn green house water and of the".split()) for _ in range(60)]
        if k % 6 == 0:
            words[random.randint(0, 59)] = random.choice(["scum", "trash"])
        docs.append((k, " ".join(words), "x"))
        labels.append((k, int(k % 6 == 0)))
    docs += [(None, "scum", "x"), (1000, None, "x"), (1001, "", "x"), (3, docs[3][1], "x"), (1002, "corn " * 100_000 + "scum", "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string")
    model = toxicity.fit_toxicity(frame, spark.createDataFrame([*labels[:500], (None, 1), (4, None), (6, 0)], "doc_id long, toxic int"))
    got = frame.withColumn("t", toxicity.toxicity(F.col("text"), model)).select("doc_id", "text", "t.*").collect()
    for r in got:
        if r["doc_id"] is not None and 500 <= r["doc_id"] < 600:
            assert (r["score"] >= toxicity.TOXIC_FROM) == (r["doc_id"] % 6 == 0)
            for p in r["passages"]:
                assert {"scum", "trash"} & set(r["text"].split()[p["start"] : p["end"]])
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (1000, 1001):
            assert r["passages"] == [] and r["score"] < toxicity.TOXIC_FROM
    assert toxicity.fit_toxicity(frame, spark.createDataFrame([], "doc_id long, toxic int")) is None
    none = frame.limit(3).withColumn("t", toxicity.toxicity(F.col("text"), None)).select("t.*").collect()
    assert all(r["score"] == 0 and r["passages"] == [] for r in none)
    assert frame.limit(0).withColumn("t", toxicity.toxicity(F.col("text"), model)).count() == 0


def test_toxic_words_late_in_a_training_text_are_learned(spark):
    rows = [(k, f"corn{k} " + "corn water " * 2_000 + ("scum" if k % 4 < 2 else "house"), int(k % 4 < 2)) for k in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(frame, frame)
    assert model["scores"]["=scum"] > toxicity.DRIFT > 0 > model["scores"]["=house"]


def test_smoothed_scores_follow_the_chain_of_prefixes():
    counts = {"abc": (5, 3), "abcd": (1, 3), "=abcd": (0, 3), "=ab": (9, 0), "=abcdefghij": (0, 1)}
    names = list(counts)
    got = dict(zip(names, toxicity.smoothed_scores(names, np.array([counts[f] for f in names], float), np.array([80.0, 20.0]))))
    logit = lambda p: np.log(p / (1 - p))
    m = toxicity.PRIOR
    abc = (3 + m * 0.2) / (8 + m)
    abcd = (3 + m * abc) / (4 + m)
    want = {"abc": abc, "abcd": abcd, "=abcd": (3 + m * abcd) / (3 + m), "=ab": m * 0.2 / (9 + m), "=abcdefghij": (1 + m * abcd) / (1 + m)}
    for f in names:
        assert np.isclose(got[f], logit(want[f]) - logit(0.2))
    assert toxicity.word_score("abcx", got) == got["abc"] and toxicity.word_score("ab", got) == got["=ab"]
    assert toxicity.word_score("xyz", got) == 0.0 and toxicity.word_score("", got) == 0.0 and toxicity.word_score("=", got) == 0.0


def test_scale_is_the_root_of_the_moment_equation_and_calibration_is_plain():
    bins, times = np.array([-1.0, 0.5, 2.0]), np.array([80.0, 15.0, 5.0])
    root = toxicity.scale_of(bins, times)
    assert np.isclose((times * np.exp(root * bins)).sum() / times.sum(), 1)
    toxic = np.arange(400) % 5 == 0
    segments = [[9.0, 2.0] if t else [1.0] for t in toxic]
    model = toxicity.calibrate(toxic, np.full(400, 50), segments, bins, times)
    expected = 1 / (50 * np.exp(-root * 1.0))
    assert np.isclose(model["constant"], np.clip(expected, 1e-6, 1))
    assert model["slope"] > 0 and model["intercept"] < 0


def test_toxic_share_on_held_out_rows(spark):
    d = SF_DIR
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.fit_toxicity(docs, labels.filter(~held))
    judged = docs.join(labels.filter(held), "doc_id").select("toxic", toxicity.toxicity(F.col("text"), model)["score"].alias("p")).collect()
    caught = [r["p"] >= toxicity.TOXIC_FROM for r in judged if r["toxic"]]
    marked = [r["p"] >= toxicity.TOXIC_FROM for r in judged if not r["toxic"]]
    assert np.mean(caught) >= 0.6 and np.mean(marked) <= 0.05  # 400 labelled rows; more in larger tables


def test_subwords_of_a_word_do_not_depend_on_its_neighbours():
    alone, n_alone = language.subwords(pa.array(["straße"], pa.large_string()))
    both, counts = language.subwords(pa.array(["a", "straße", "zz"], pa.large_string()))
    assert both[counts[0] : counts[0] + counts[1]].tolist() == alone.tolist() and n_alone.tolist() == [counts[1]]
    assert counts[1] == 1 + 7 + 6 + 5  # the word, and its runs of 2, 3 and 4 with edge marks


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    odd = [(-1, None, "en"), (-2, "", "en"), (-3, "12 3!", "en"), (-4, "x", None), (None, "the house of the people", "en")]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    model = language.fit_language(rows.filter(~held))
    got = rows.select("doc_id", "lang", held.alias("held"), language.predict_language(F.col("text"), model).alias("p")).select("doc_id", "lang", "held", F.col("p.lang").alias("pred"), "p.score", "p.rejected").collect()
    tested = [r for r in got if r["held"] and (r["doc_id"] or 0) >= 0]
    assert np.mean([r["lang"] == r["pred"] for r in tested]) > 0.97
    trusted = [r for r in tested if not r["rejected"]]
    assert len(trusted) > 0.9 * len(tested) and np.mean([r["lang"] == r["pred"] for r in trusted]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        if r["doc_id"] in (-1, -2, -3):
            assert r["pred"] == "und" and r["score"] == 0 and r["rejected"]
        elif r["doc_id"] in (-4, None):
            assert r["pred"] in model["names"]


def test_languages_beyond_the_sample_are_learned(spark):
    n = 520
    rows = [(k * n + i, f"w{i:03} x{i:03} y{i:03}", f"l{i:03}") for k in range(6) for i in range(n)]
    model = language.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model is not None and len(model["names"]) == n


def test_language_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "hello", None)], "doc_id long, text string, lang string")
    assert language.fit_language(docs) is None
    assert language.fit_language(docs.limit(0)) is None
    assert docs.select(language.predict_language(F.col("text"), None).alias("p")).first()["p"]["lang"] == "und"
