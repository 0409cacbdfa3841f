"""Language-model scores, spelling variants, divergence of sources: against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

import folio
from folio.llm import attention, divergence, lm, queries, variants
from folio.llm.encoding import Encoder

cloudpickle.register_pickle_by_value(folio)  # workers get the values that tests set

ODD = [(None, None, None, None), (None, "", "", ""), (1, None, "en", None), (2, " \n\t", "en", "s"), (3, "12 3! ,", None, "s")]


def made_texts(n, seed=1):
    random.seed(seed)
    words = ["".join(random.choice("abcdeé") for _ in range(random.randint(1, 7))) for _ in range(120)]
    rows = []
    for k in range(n):
        text = " ".join(random.choice(words) for _ in range(random.randint(0, 60)))
        rows.append((k, text.title() if k % 5 == 0 else text, random.choice(["en", "fr"]), random.choice("xyz")))
    rows += [(k, "abcdé abcde " * 3000 + f"long{k}", "en", "x") for k in (500, 501)]
    return [*rows, (7, rows[7][1], "en", "x"), (7, rows[7][1], "en", "x"), *ODD]


def frame_of(spark, rows):
    named = [(*r, "clash", 1, 2.0, "c") for r in rows]
    return spark.createDataFrame(named, "doc_id long, text string, lang string, source string, word string, n int, score double, term string").repartition(3)


# ---------------------------------------------------------------- language model


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


@pytest.mark.parametrize("hot", [0, 40, 500_000])
def test_base_scores_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT_WORDS", hot)
    monkeypatch.setattr(lm, "SHARE", 3)
    rows = made_texts(60)
    docs = frame_of(spark, rows)
    known = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2]
    counts = Counter()
    for r in known:
        counts.update([*words_of(r[1]), ""])
    total, distinct = sum(counts.values()), len(counts)
    model = lm.fit_lm(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 7 != 2), queries.tokenizer_path(), 50_256)
    got = lm.score_texts(docs, model).collect()
    assert len(got) == len(rows)
    want = sorted(
        (str(r[0]), len(tokens := [*words_of(r[1]), ""]), sum(counts[t] > 0 for t in tokens), total, round(sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens), 6))
        for r in rows
    )
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert np.ptp([r["score"] for r in got if r["doc_id"] == 7]) < 1e-4
    assert lm.score_texts(docs.limit(0), model).count() == 0


def test_scores_without_anything_to_learn(spark):
    docs = frame_of(spark, made_texts(10))
    model = lm.fit_lm(docs.limit(0), queries.tokenizer_path(), 50_256)
    got = lm.score_texts(docs, model).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and r["score"] < 0 for r in got)


def small_model(monkeypatch, seed=4):
    monkeypatch.setattr(attention, "LEAST_STEPS", 60)
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 40, 3000)
    ids[1::2] = (ids[::2] * 7 + 3) % 40  # every second id follows from the one before
    lengths = np.array([1500, 1, 0, 17, 482, 1000])
    ids = ids[: lengths.sum()]
    inputs = attention.inputs_of(ids, lengths, 49)
    classes = attention.IdClasses(attention.neighbour_sums(ids, inputs, attention.neighbour_codes(50)))
    net = attention.Network.first(classes.points)
    untrained = attention.Scorer(net.copy(), classes, None).id_scores(ids, lengths, 49).sum()
    attention.train(net, ids, inputs, lengths, classes.class_of, attention.RATE, 1)
    return ids, lengths, inputs, classes, net, untrained


def plain_scores(net, classes, follow, ids, lengths, start_id):
    """One id after the other, each against the ids of its own and the block before."""
    shares = attention.Shares(classes, follow)
    out, at = [], 0
    for n in lengths:
        before = np.concatenate([[start_id], ids[at : at + n]])[:n]
        for t in range(n):
            seen = np.arange(max(0, (t // attention.STRIDE - 1) * attention.STRIDE), t + 1)
            x = net.embedding[before[seen]]
            q = net.embedding[before[t]] @ net.query * attention.SIZE**-0.5
            a = attention._exp((x @ net.key @ q).astype(np.float32)) * np.exp(net.back[t - seen])
            h = net.embedding[before[t]] + a @ (x @ net.value) / a.sum()
            p = attention._exp((h @ net.out + net.bias).astype(np.float32)) * np.isin(np.arange(attention.CLASSES), classes.class_of)
            out.append(np.log10(p[classes.class_of[ids[at + t]]] / p.sum()) + shares.logs(ids[at + t : at + t + 1], before[t : t + 1])[0])
        at += n
    return np.array(out)


def test_batched_windows_equal_plain_attention(monkeypatch):
    ids, lengths, inputs, classes, net, _ = small_model(monkeypatch)
    follow = classes.follow_counts(ids, inputs)
    monkeypatch.setattr(attention, "SCORED", 7)
    got = attention.Scorer(net, classes, follow).id_scores(ids, lengths, 49)
    assert np.allclose(got, plain_scores(net, classes, follow, ids, lengths, 49), atol=2e-3)


def test_probabilities_add_up_to_one(monkeypatch):
    ids, lengths, inputs, classes, net, untrained = small_model(monkeypatch)
    scorer = attention.Scorer(net, classes, classes.follow_counts(ids, inputs))
    total = sum(10 ** scorer.id_scores(np.append(ids[:20], k), np.array([21]), 49)[-1] for k in range(50))
    assert abs(total - 1) < 1e-3
    assert scorer.id_scores(ids, lengths, 49).sum() > 0.8 * untrained  # both below 0


def test_gradients_lower_the_loss_as_small_steps_predict(monkeypatch):
    ids, lengths, inputs, classes, net, untrained = small_model(monkeypatch)
    before = attention.Scorer(net.copy(), classes, None).id_scores(ids, lengths, 49).sum()
    attention.train(net, ids, inputs, lengths, classes.class_of, 0.02, 2)
    assert untrained < before < attention.Scorer(net, classes, None).id_scores(ids, lengths, 49).sum()


def test_sums_over_tasks(spark):
    rows = spark.range(1000).repartition(9)

    def work(batches):
        out = np.zeros((5, 2))
        for b in batches:
            out[:, 0] += np.bincount(np.asarray(b.column(0)) % 5, minlength=5)
        return {"x": out, "none": np.zeros((2, 2))}

    got = lm.add_up(rows, work)
    assert set(got) == {"x"} and got["x"][:, 0].tolist() == [200] * 5 and not got["x"][:, 1].any()


def test_model_beats_the_untrained_one_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    trained = lm.fit_lm(docs.filter("doc_id % 4 <> 0"), queries.tokenizer_path(), 50_256)
    nothing = lm.fit_lm(docs.limit(0), queries.tokenizer_path(), 50_256)
    held = docs.filter("doc_id % 4 = 0")
    a, b = (lm.score_texts(held, m).agg(F.sum("score")).first()[0] for m in (trained, nothing))
    assert a > 0.75 * b  # both below 0


def test_a_worker_holds_one_model_for_all_its_tasks(spark, monkeypatch):
    docs = frame_of(spark, made_texts(20)).select("doc_id", "text")
    model = lm.fit_lm(docs, queries.tokenizer_path(), 50_256)
    sent, real = [], DataFrame.mapInArrow

    def noted(self, function, *rest, **options):
        sent.append(len(cloudpickle.dumps(function)))
        return real(self, function, *rest, **options)

    monkeypatch.setattr(DataFrame, "mapInArrow", noted)
    assert lm.score_texts(docs, model).count() == docs.count()
    assert max(sent) < 1 << 20  # the model itself has megabytes


def test_every_training_text_is_learned_from(spark, monkeypatch):
    rows = [(i, f"text {i} of {i % 7}") for i in range(90)] + [(1, "text 1 of 1"), (None, "no id"), (200, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = [Encoder(queries.tokenizer_path()).encode(pa.array([t or ""]), 50_256)[0] for _, t in rows]
    seen = {}

    def scorer(net, classes, follow):
        seen["classes"], seen["follow"] = classes, follow
        return real(net, classes, follow)

    real = attention.Scorer
    monkeypatch.setattr(attention, "Scorer", scorer)
    monkeypatch.setattr(lm, "CHUNK", 50)
    lm.fit_lm(docs.repartition(3), queries.tokenizer_path(), 50_256)
    counts = np.bincount(np.concatenate(plain), minlength=50_257)
    assert seen["follow"].sum(axis=1).tolist() == counts.tolist()
    wanted = attention.IdClasses(attention.neighbour_sums(ids := np.concatenate(plain).astype(np.int64), attention.inputs_of(ids, np.array([len(p) for p in plain]), 50_256), attention.neighbour_codes(50_257)))
    assert np.allclose(seen["classes"].share, wanted.share)


def test_pieces_of_a_task_are_learned_from_in_turn(monkeypatch):
    monkeypatch.setattr(attention, "LEAST_STEPS", 1)
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 40, n) for n in rng.integers(1, 90, 30)]
    classes = attention.IdClasses(np.column_stack([np.ones(41), rng.random((41, 2 * attention.CODES))]))
    trainer = attention.Trainer(attention.Network.first(classes.points), classes.class_of, 0.02, 1)
    for some in (texts[:10], texts[10:]):
        lengths = np.array([len(t) for t in some])
        trainer.learn(np.concatenate(some), attention.inputs_of(np.concatenate(some), lengths, 40), lengths)
    met = {i for t in texts for i in [40, *t[:-1]]}
    assert set(np.flatnonzero(trainer.touched)) == met and trainer.steps == 2


def test_ids_are_written_as_two_bytes_each(spark):
    rows = [(1, "some text, and more"), (2, ""), (3, None), (4, "\u00e9t\u00e9 \u4e2d\u6587 " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in lm.encode_texts(docs, queries.tokenizer_path(), 50_256).collect()}
    encoder = Encoder(queries.tokenizer_path())
    for i, text in rows:
        wanted = encoder.encode(pa.array([text or ""]), 50_256)[0]
        assert np.frombuffer(bytes(got[i]), "<u2").tolist() == wanted.tolist()
    assert lm.id_type(1 << 16).itemsize == 2 and lm.id_type((1 << 16) + 1).itemsize == 4


def test_written_ids_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 10)
    texts = [np.arange(n, dtype="<u4") + 70_000 for n in (3, 0, 12, 1, 30, 4, 4, 4)]
    column = pa.array([t.tobytes() for t in texts], pa.binary())
    batches = [pa.RecordBatch.from_arrays([c], names=["ids"]) for c in (column.slice(0, 3), column.slice(3), column.slice(8))]
    pieces = list(lm._read_ids(iter(batches), np.dtype("<u4")))
    assert np.concatenate([ids for ids, _ in pieces]).tolist() == np.concatenate(texts).tolist()
    assert np.concatenate([n for _, n in pieces]).tolist() == [len(t) for t in texts]
    assert len(pieces) > 2 and all(len(ids) == n.sum() for ids, n in pieces)


def test_batches_sent_to_a_worker_are_small_and_the_session_keeps_its_setting(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    monkeypatch.setattr(lm, "BATCH_ROWS", 7)
    spark.conf.set(name, "50")
    try:
        rows = lm.encode_texts(spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string").coalesce(1), queries.tokenizer_path(), 50_256)

        def work(batches):
            return {"most": np.array([[float(max(b.num_rows for b in batches))]])}

        assert lm.add_up(rows.coalesce(1).select("ids"), work)["most"].tolist() == [[7.0]]
        assert spark.conf.get(name) == "50"
        monkeypatch.setattr(lm, "BATCH_ROWS", 70)  # a smaller setting stays
        assert lm.add_up(rows.coalesce(1).select("ids"), work)["most"].tolist() == [[50.0]]
    finally:
        spark.conf.set(name, before)


# ---------------------------------------------------------------- spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), words[w], len(near[w]), words.get(form[w], -1)) for w in words)


def spelled_texts():
    random.seed(3)
    base = ["".join(random.choice("abcÉé") for _ in range(random.randint(4, 9))) for _ in range(60)]
    rows = []
    for k in range(150):
        some = []
        for w in random.choices(base, [1 / (i + 1) for i in range(60)], k=40):
            if random.random() < 0.2:
                at = random.randint(0, len(w) - 1)
                w = random.choice([w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "b" + w[at + 1 :]])
            some.append(w.capitalize() if random.random() < 0.1 else w)
        rows.append((k, ", ".join(some), "en", "s"))
    rows += [(900 + k, "z" * 5_000 + " " + "z" * 5_001, "en", "s") for k in range(4)]
    return [*rows, rows[3], rows[3], *ODD]


@pytest.mark.parametrize(("most", "chunk", "frontier"), [(8_000, 20_000, 300_000), (3, 10, 50)])
def test_variants_equal_brute_force(spark, monkeypatch, most, chunk, frontier):
    for name, value in (("MOST_GROUP", most), ("CHUNK_WORDS", chunk), ("FRONTIER", frontier)):
        monkeypatch.setattr(variants, name, value)
    rows = spelled_texts()
    got = variants.spelling_variants(frame_of(spark, rows)).collect()
    assert sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in got) == brute_variants(rows)
    assert any(r["root"] != r["word"] and r["root"] != r["form"] for r in got) or most == 3


def test_variants_of_nothing(spark):
    assert variants.spelling_variants(frame_of(spark, ODD)).count() == 0
    assert variants.spelling_variants(frame_of(spark, ODD).limit(0)).count() == 0


def test_pairs_along_sorted_lists_equal_brute_force():
    random.seed(8)
    for _ in range(60):
        words, group, shared = [], [], []
        for g in range(random.randint(1, 6)):
            k = random.choice([2, 3])
            prefix = "".join(random.choice("abé") for _ in range(k))
            some = sorted({prefix + "".join(random.choice("abé") for _ in range(random.randint(k, k + 2))) for _ in range(random.randint(1, 40))})
            words, group, shared = words + some, group + [g] * len(some), shared + [k] * len(some)
        a, b = variants.one_edit_pairs(words, np.array(group), np.array(shared))
        got = list(zip(a.tolist(), b.tolist()))
        n = len(words)
        assert sorted(got) == [(i, j) for i in range(n) for j in range(i + 1, n) if group[i] == group[j] and one_edit(words[i], words[j])]


# ---------------------------------------------------------------- divergence


def brute_divergence(rows, least):
    docs = [(g or "", s or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))) for _, t, g, s in rows]
    seen, counts = Counter(), defaultdict(Counter)
    for g, s, w in docs:
        seen.update((g, t) for t in set(w))
        counts[g, s].update(w)
    out = []
    for lang in {g for g, _, _ in docs}:
        kept = sorted((t for (g, t), n in seen.items() if g == lang and n >= least), key=str.encode)
        groups = sorted(s for g, s in counts if g == lang)
        share = {}
        for name, c in [*((s, counts[lang, s]) for s in groups), (None, sum((counts[lang, s] for s in groups), Counter()))]:
            total = sum(c[t] for t in kept) + 2 * len(kept)
            share[name] = {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in groups:
            pairs = [(o, sum(f(share[s][t], share[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, f(share[s][t], share[None][t])) for t in kept if counts[lang, s][t] and share[s][t] > share[None][t]]
            for part, some, most in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(some, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "passed", "cells", "block", "pairs"), [(4 << 20, 64 << 20, 5_000_000, 256, 4_000_000), (600, 900, 40, 4, 1), (300, 300, 5, 7, 4_000_000)])
def test_divergence_equals_brute_force(spark, monkeypatch, shard, passed, cells, block, pairs):
    for name, value in (("SHARD_BYTES", shard), ("PASS_BYTES", passed), ("MOST_CELLS", cells), ("BLOCK", block), ("MOST_PAIRS", pairs)):
        monkeypatch.setattr(divergence, name, value)
    rows = made_texts(60)
    got = divergence.source_divergence(frame_of(spark, rows), least_docs=4).collect()
    want = brute_divergence(rows, 4)
    assert sorted(tuple(r) for r in got) == want
    assert {r[2] for r in want} == {"pair", "term"}


def test_divergence_of_nothing(spark):
    docs = frame_of(spark, made_texts(10))
    got = divergence.source_divergence(docs, least_docs=10_000).collect()
    assert got and all(r["part"] == "pair" and r["value"] == 0 for r in got)
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_perfect_hash_is_minimal_and_leaves_equal_keys():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 30_000):
        keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
        built, left = divergence.PerfectHash.build(keys)
        assert not len(left) and sorted(built.slots(keys).tolist()) == list(range(n))
    built, left = divergence.PerfectHash.build(np.array([5, 9, 5], np.uint64))
    assert sorted(left.tolist()) == [5, 5] and built.slots(np.array([9], np.uint64)).tolist() == [0]


def test_terms_of_equal_hash_and_terms_not_kept(monkeypatch):
    monkeypatch.setattr(divergence, "key_hashes", lambda lang, terms: np.array([len(t) for t in terms.to_pylist()], np.uint64))
    shard = divergence.Shard(["a", "b"], [2, 2], pa.array(["p", "qq", "rr", "sss"], pa.large_string()))
    asked = pa.array(["p", "qq", "rr", "sss", "tttt", "uuu"], pa.large_string())
    sizes = np.array([1, 2, 2, 3, 4, 3], np.uint64)
    assert shard.places("a", asked, sizes).tolist() == [0, 1, -1, -1, -1, -1]
    assert shard.places("b", asked, sizes).tolist() == [-1, -1, 0, 1, -1, -1]
    assert shard.places("c", asked, sizes).tolist() == [-1] * 6


def test_hash_is_that_of_spark(spark):
    rows = [("en", "word"), ("", "é" * 40), ("fr", "")]
    got = [r[0] & (1 << 64) - 1 for r in spark.createDataFrame(rows, "a string, b string").select(F.xxhash64("a", "b")).collect()]
    assert got == [xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42)) for a, b in rows]
    assert got == [int(divergence.key_hashes(a, pa.array([b]))[0]) for a, b in rows]


def test_shares_are_exact_for_large_counts():
    for count, total in [(10**12, 3 * 10**12 + 7), (0, 9), (8 * 10**15 // 3, 8 * 10**15), (5, 10**15 + 1)]:
        assert divergence.shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 2) // total


def test_fewer_parts_remembered_gives_the_same_ids():
    texts = pa.array(["one two three", "two one", "ß éa one"] * 3, pa.large_string())
    a, b = Encoder(queries.tokenizer_path()), Encoder(queries.tokenizer_path(), 1)
    for _ in range(3):
        assert a.encode(texts, 9)[0].tolist() == b.encode(texts, 9)[0].tolist()
