"""Toxicity of texts from their maximum-scoring passages.

Each word (lower case, edge punctuation off) has a score: its log-odds between toxic and
clean training texts, against those of all texts. A word's counts are smoothed by a
Dirichlet prior of ``PRIOR`` texts around its longest prefix, that prefix's around the
next shorter one, and so on to the share of all texts. So words that begin alike share
their evidence, a word seen once says little, and a word never seen scores as its prefix.
Every word costs ``DRIFT``, so that only toxic words add to a passage.

One linear scan finds every maximal segment: a passage whose score can't be raised by
making it longer or shorter. The best segment of a clean text of n words follows an
extreme-value law; its scale is the root of a moment equation over the words of clean
texts and its constant is fitted on their best segments. It turns a segment's score into
the number of such segments expected by chance, and segments under a bound are
significant passages. What a text's significant segments add up to is calibrated to a
probability by a logistic fit. For all three fits a training text's words are scored
without the fold of training texts that it is in.

The model is fitted on at most ``SAMPLE_ROWS`` labelled rows, those of smallest hash. Whole
texts of these are read by the tasks; the driver gets counts of words and prefixes that
are in ``LEAST_TEXTS`` or more of them (``FEATURES`` at most, the most frequent), and scores
of segments. Every row is scored in one pass without a shuffle.

Defined results: null and empty texts have no segments and get the score of a text
without evidence; without training rows of both labels every score is 0; equal texts get
equal scores; equal training texts with the same label count once; repeated label rows of
a document count once (the highest label); an empty table gives no rows; texts of any
length are read whole, a long one alone; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from folio.llm.texts import distinct, slices, split_words
from folio.session import write_once

SAMPLE_ROWS = 8_000  # labelled texts that the model is fitted on
FEATURES = 300_000  # words and prefixes with a score
LEAST_TEXTS = 3
PREFIXES = range(3, 9)  # code points
WORD = "="  # before a whole word, among prefixes
PRIOR = 5.0  # texts that the next shorter prefix stands for
DRIFT = 1.2
FOLDS = 4
SIGNIFICANT = 0.05  # segments expected by chance, at most
EDGES = "\"'`.,;:!?()[]{}<>*#$%&|-_~+=/\\@"
TOXIC_FROM = 0.3
BIN = 0.05  # width of a histogram's bins of word scores


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of each word among the distinct words; those words; where texts start."""
    words, offsets = split_words(pc.utf8_lower(texts))
    codes, raw = distinct(words)
    plain_codes, values = distinct(pc.utf8_trim(raw, EDGES))
    return (plain_codes[codes] if len(codes) else np.empty(0, np.int64)), values, offsets


# ---------------------------------------------------------------- scores of words


def features(word: str) -> list[str]:
    """A word's prefixes, shortest first, and the word."""
    return [word[:k] for k in PREFIXES if k <= len(word)] + [WORD + word]


def parent(feature: str) -> str | None:
    """What a word or prefix is smoothed by."""
    if feature[0] == WORD and len(feature) > 1:
        last = min(len(feature) - 1, PREFIXES[-1])
        return feature[1 : 1 + last] if last >= PREFIXES[0] else None
    return feature[:-1] if len(feature) > PREFIXES[0] else None


def smoothed_scores(names: list[str], counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Log-odds of words and prefixes from ``counts``, their numbers of clean and toxic texts."""
    place = {f: k for k, f in enumerate(names)}
    share = totals[1] / totals.sum()
    smooth = np.empty(len(names))
    # A prefix before those that it begins; a whole word after all prefixes.
    for k in sorted(range(len(names)), key=lambda k: (names[k][0] == WORD and len(names[k]) > 1, len(names[k]))):
        above, found = parent(names[k]), None
        while above is not None and found is None:
            found, above = place.get(above), parent(above)
        prior = share if found is None else smooth[found]
        smooth[k] = (counts[k, 1] + PRIOR * prior) / (counts[k].sum() + PRIOR)
    return np.log(smooth / (1 - smooth)) - np.log(share / (1 - share))


def word_score(word: str, scores: dict[str, float]) -> float:
    """The score of the longest part of a word that has one."""
    for feature in reversed(features(word)):
        found = scores.get(feature)
        if found is not None:
            return found
    return 0.0


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), left to right, in linear time.

    A candidate keeps the running total before its first and after its last word. A new
    one is joined with the last earlier one that starts lower, unless that one ends as high.
    """
    out: list[list[float]] = []  # start, end, total before, total after, nearest earlier one that starts lower
    total = 0.0
    for k, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        new = [k, k + 1, total, total + s, -1]
        total += s
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j = out[j][4]
            if j < 0 or out[j][3] >= new[3]:
                new[4] = j
                out.append(new)
                break
            new[0], new[2] = out[j][0], out[j][2]
            del out[j:]
    return [(int(a), int(b), after - before) for a, b, before, after, _ in out]


def text_segments(texts: pa.Array, scores: dict[str, float]) -> tuple[list[list[tuple[int, int, float]]], np.ndarray, np.ndarray]:
    """Maximal segments of each text, its number of words, and the scores of all words in a row."""
    codes, values, offsets = words_of(texts)
    of_value = np.fromiter((word_score(v, scores) for v in values.to_pylist()), float, len(values)) - DRIFT
    s = of_value[codes] if len(codes) else np.empty(0)
    positive = np.flatnonzero(s > 0)
    total = np.concatenate([[0.0], np.cumsum(s)])
    out: list[list[tuple[int, int, float]]] = []
    bounds = np.searchsorted(positive, offsets)
    for k in range(len(texts)):
        # Runs of words that can't begin a segment are one step each.
        at = positive[bounds[k] : bounds[k + 1]]
        if not len(at):
            out.append([])
            continue
        gaps = total[at] - np.concatenate([[total[offsets[k]]], total[at[:-1] + 1]])
        steps = np.column_stack([gaps, s[at]]).ravel().tolist()
        place = np.column_stack([at, at]).ravel() - offsets[k]
        out.append([(int(place[a]), int(place[b - 1]) + 1, v) for a, b, v in maximal_segments(steps)])
    return out, np.diff(offsets), s


def scale_of(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of: the mean of exp(root * score) over clean words is one."""
    low, high = 1e-6, 20.0

    def mean(x: float) -> float:
        return float((weights * np.exp(np.minimum(x * scores, 700))).sum() / weights.sum())

    if not (scores > 0).any() or mean(high) < 1:
        return 1.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    return high


def evidence(segments: list[tuple[int, int, float]], n_words: int, scale: float, constant: float) -> tuple[float, int]:
    """What the significant segments add up to, and how many they are."""
    expected = [scale * v - np.log(constant * max(n_words, 1)) for _, _, v in segments]
    strong = [e for e in expected if e >= -np.log(SIGNIFICANT)]
    return float(sum(strong)), len(strong)


def calibrate(toxic: np.ndarray, n_words: np.ndarray, segments: list[list[float]], bins: np.ndarray, times: np.ndarray) -> dict:
    """Scale and constant of the extreme-value law, slope and intercept of the logistic fit.

    ``bins`` and ``times`` are the scores of the words of clean texts, as a histogram.
    """
    scale = scale_of(bins, times) if len(bins) else 1.0
    best = np.array([max(s, default=0.0) for s in segments])
    clean = ~toxic & (n_words > 0)
    # exp(-scale * best) has mean 1 / (constant * n) for long texts.
    constant = float(np.clip(1 / max(np.mean(n_words[clean] * np.exp(-scale * best[clean])), 1e-9), 1e-6, 1.0)) if clean.any() else 1.0
    x = np.array([evidence([(0, 0, v) for v in s], int(n), scale, constant)[0] for s, n in zip(segments, n_words)])
    slope, intercept = logistic(np.log1p(x), toxic)
    return {"scale": scale, "constant": constant, "slope": slope, "intercept": intercept}


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and intercept by Newton steps, with a weak pull to zero."""
    w = np.zeros(2)
    a = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + 0.1 * w
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 0.1 * np.eye(2), gradient)
    return max(float(w[0]), 0.0), float(w[1])


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, cell, n): texts that have a word or prefix; a cell is a fold and a label."""
    for batch in batches:
        cells, at = batch.column(1).to_pylist(), 0
        for texts in slices(batch.column(0)):
            codes, values, offsets = words_of(texts)
            known = [features(v) for v in values.to_pylist()]
            counts: Counter = Counter()
            for k in range(len(texts)):
                mine = {f for c in set(codes[offsets[k] : offsets[k + 1]].tolist()) for f in known[c]}
                counts.update((f, cells[at + k]) for f in mine)
            at += len(texts)
            names, of = list(zip(*counts)) or [(), ()] if counts else [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(of, pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["feature", "cell", "n"])


def _training_rows(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str) -> DataFrame:
    """(text, cell) of the labelled rows that the model is fitted on. Written once."""
    sample = (
        labels.select(F.col(id).alias("_id"), F.col(label).alias("_toxic"))
        .filter("_id IS NOT NULL AND _toxic IS NOT NULL")
        .groupBy("_id")
        .agg((F.max("_toxic") > 0).cast("int").alias("_toxic"))
        .orderBy(F.md5(F.col("_id").cast("string")), "_id")
        .limit(SAMPLE_ROWS)
    )
    read = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = read.join(F.broadcast(sample), "_id").select("text", "_toxic", F.md5("text").alias("_h")).dropDuplicates(["_h", "_toxic"])
    fold = F.pmod(F.xxhash64("_h"), F.lit(FOLDS)).cast("int")
    return write_once(rows.select("text", (2 * fold + F.col("_toxic")).cast("int").alias("cell")))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> dict | None:
    """Fit on a bounded number of rows of ``labels``; None without rows of both labels."""
    rows = _training_rows(docs, labels, id, text, label)
    totals = np.zeros((FOLDS, 2))
    for row in rows.groupBy("cell").count().collect():
        totals[row["cell"] // 2, row["cell"] % 2] = row["count"]
    if not totals.sum(axis=0).all():
        return None
    cells = [F.sum(F.when(F.col("cell") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(2 * FOLDS)]
    counted = rows.mapInArrow(_count_features, "feature string, cell int, n long").groupBy("feature").agg(F.sum("n").alias("n"), *cells)
    held = counted.filter(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "feature").limit(FEATURES).toArrow()
    names = held["feature"].to_pylist()
    counts = np.column_stack([np.asarray(held[f"c{k}"], float) for k in range(2 * FOLDS)]).reshape(-1, FOLDS, 2)

    def table(kept: np.ndarray) -> dict[str, float]:
        if not totals[kept].sum(axis=0).all():
            kept = np.ones(FOLDS, bool)
        return dict(zip(names, smoothed_scores(names, counts[:, kept].sum(axis=1), totals[kept].sum(axis=0)).tolist()))

    without = [table(np.arange(FOLDS) != f) for f in range(FOLDS)]

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of texts (toxic, words, segments) and of the histogram (bin, times)."""
        for batch in batches:
            of = np.asarray(batch.column(1))
            for cell in np.unique(of):
                for texts in slices(batch.column(0).filter(pa.array(of == cell))):
                    found, n_words, scores = text_segments(texts, without[cell // 2])
                    bins, times = np.unique(np.round(scores / BIN).astype(np.int64), return_counts=True) if cell % 2 == 0 else ([], [])
                    n, m = len(texts), len(bins)
                    columns = [
                        pa.array([bool(cell % 2)] * n + [None] * m, pa.bool_()),
                        pa.array([*n_words.tolist(), *[None] * m], pa.int64()),
                        pa.array([[v for _, _, v in s] for s in found] + [None] * m, pa.list_(pa.float64())),
                        pa.array([None] * n + [int(b) for b in bins], pa.int64()),
                        pa.array([None] * n + [int(t) for t in times], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["toxic", "words", "segments", "bin", "times"])

    judged = write_once(rows.mapInArrow(cross, "toxic boolean, words long, segments array<double>, bin long, times long"))
    hist = judged.filter("bin IS NOT NULL").groupBy("bin").agg(F.sum("times").alias("times")).toArrow()
    fitted = judged.filter("toxic IS NOT NULL").select("toxic", "words", "segments").toArrow()  # a row for each training text
    model = calibrate(np.asarray(fitted["toxic"], bool), np.asarray(fitted["words"]), fitted["segments"].to_pylist(), np.asarray(hist["bin"]) * BIN, np.asarray(hist["times"], float))
    return model | {"scores": table(np.ones(FOLDS, bool))}


def toxicity(text: Column, model: dict | None) -> Column:
    """A struct of ``score`` and ``passages``: the significant segments, as word numbers, end exclusive."""
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("expected", pa.float64())]))

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            scores, passages = [], []
            for texts in slices(batch):
                if not model:
                    scores += [0.0] * len(texts)
                    passages += [[]] * len(texts)
                    continue
                for found, n in zip(*text_segments(texts, model["scores"])[:2]):
                    x, _ = evidence(found, int(n), model["scale"], model["constant"])
                    z = model["slope"] * np.log1p(x) + model["intercept"]
                    scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
                    chance = [(a, b, float(model["constant"] * max(n, 1) * np.exp(-model["scale"] * v))) for a, b, v in found]
                    passages.append([{"start": a, "end": b, "expected": e} for a, b, e in chance if e <= SIGNIFICANT])
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(passages, passage)], names=["score", "passages"])

    kind = "struct<score: double, passages: array<struct<start: int, end: int, expected: double>>>"
    return F.arrow_udf(judge, kind).asNondeterministic()(text.cast("string"))
