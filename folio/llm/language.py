"""Language of texts: averaged hashed subword embeddings and a linear softmax.

A word's subwords are its character n-grams with edge marks, and the word itself, hashed
to ``BUCKETS`` rows of an embedding table. A text is the mean of all its subwords'
embeddings; a linear layer and a softmax give a probability per language. Both layers
are trained by stochastic gradient descent in numpy on at most ``SAMPLE_ROWS`` texts with
a language, those of smallest hash, stratified by language; beyond ``SAMPLE_ROWS / FEWEST``
languages on ``FEWEST`` of each, so that sample and table grow with them. On a part of them held back,
a temperature is fitted, so that scores can be read as probabilities, and the score below
which a prediction is best rejected.

The layers are folded into one table of a score per bucket and language, so that a text
costs one lookup per distinct word. It is sent to the executors (``BUCKETS`` rows, a
fixed size), and every row is scored in one pass without a shuffle.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without
anything to learn from, every text is; rows with a null language teach nothing; equal
texts get equal predictions; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from folio.llm.texts import distinct, hash_strings, mixed, slices, split_words

SAMPLE_ROWS = 2_400  # texts that the model is trained and calibrated on; with very many languages FEWEST of each
SAMPLE_CHARS = 2_000  # characters of a training text that are read
BUCKETS = 1 << 17
DIMENSIONS = 10
N_GRAMS = (2, 3, 4)
PASSES, BATCH, RATE = 5, 32, 0.5
FEWEST = 5  # a language with fewer training texts is not learned
WRONG = 0.01  # rejection aims at no more than this share of wrong predictions
UNKNOWN = "und"


def subwords(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of all the words in a row; how many each word has."""
    words = values.to_numpy(zero_copy_only=False)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    text = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    of = np.repeat(np.arange(len(words)), lengths)
    at_end = ends[of] - np.arange(len(codes))
    hashes, owner = [hash_strings(values)], [np.arange(len(words))]
    h = codes
    for n in range(2, max(N_GRAMS) + 1):
        if len(codes) < n:
            break
        h = mixed(h[: len(codes) - n + 1]) + codes[n - 1 :]
        if n in N_GRAMS:
            inside = at_end[: len(h)] >= n
            hashes.append(mixed(h[inside] + np.uint64(n)))
            owner.append(of[: len(h)][inside])
    owner, hashes = np.concatenate(owner), np.concatenate(hashes)
    order = np.argsort(owner, kind="stable")
    return ((hashes[order] >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64), np.bincount(owner, minlength=len(words))


def _segments(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over consecutive rows, ``counts`` of them each."""
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def text_scores(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """Mean over each text's subwords of their rows of ``table``."""
    words, offsets = split_words(pc.utf8_lower(texts))
    codes, values = distinct(words)
    if not len(codes):
        return np.zeros((len(texts), table.shape[1]))
    buckets, counts = subwords(values)
    of_value = np.column_stack([_segments(table[buckets], counts), counts])
    sums = _segments(of_value[codes], np.diff(offsets))
    return sums[:, :-1] / np.maximum(sums[:, -1:], 1)


def has_letter(texts: pa.Array) -> np.ndarray:
    return np.asarray(pc.match_substring_regex(texts, r"\p{L}"), bool)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 11) -> dict | None:
    """The folded table, the learned languages, the temperature and the rejection score."""
    names, y = np.unique(langs, return_inverse=True) if len(langs) else (np.empty(0, str), np.empty(0, int))
    common = np.flatnonzero(np.bincount(y, minlength=len(names)) >= FEWEST) if len(names) else []
    if not len(common):
        return None
    rows = np.flatnonzero(np.isin(y, common))
    names, y = np.unique(np.array(langs)[rows], return_inverse=True)
    rng = np.random.default_rng(seed)
    embedding = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    linear = np.zeros((DIMENSIONS, len(names)), np.float32)

    features = []
    for k in rows:
        words, _ = split_words(pc.utf8_lower(pa.array([texts[k][:SAMPLE_CHARS]], pa.large_string())))
        features.append(subwords(words)[0] if len(words) else np.empty(0, np.int64))
    held = np.arange(len(rows)) % 5 == 4
    trained = np.flatnonzero(~held)
    steps, step = PASSES * -(-len(trained) // BATCH), 0
    for _ in range(PASSES):
        order = rng.permutation(trained)
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            counts = np.array([len(features[k]) for k in batch])
            buckets = np.concatenate([features[k] for k in batch])
            mean = _segments(embedding[buckets], counts) / np.maximum(counts, 1)[:, None]
            error = _softmax(mean @ linear)
            error[np.arange(len(batch)), y[batch]] -= 1
            rate = RATE * (1 - step / steps)
            step += 1
            back = (error @ linear.T) / np.maximum(counts, 1)[:, None]
            linear -= (rate * mean.T @ error / len(batch) * 8).astype(np.float32)
            flat = np.repeat(back, counts, axis=0)
            by_bucket = np.argsort(buckets, kind="stable")
            ordered = buckets[by_bucket]
            firsts = np.flatnonzero(np.diff(ordered, prepend=-1))
            if len(firsts):
                embedding[ordered[firsts]] -= (rate * BATCH * np.add.reduceat(flat[by_bucket], firsts, axis=0)).astype(np.float32)
    table = (embedding @ linear).astype(np.float32)
    check = np.flatnonzero(held) if held.any() else trained
    scores = np.array([table[features[k]].mean(axis=0) if len(features[k]) else np.zeros(len(names)) for k in check])
    temperature = _temperature(scores, y[check])
    p = _softmax(scores / temperature)
    return {
        "table": table,
        "names": names.tolist(),
        "temperature": temperature,
        "reject_below": _rejection(p.max(axis=1), p.argmax(axis=1) == y[check]),
    }


def _temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The one of many temperatures with the least log loss, as if one more text had been wrong."""
    tried = np.geomspace(0.005, 50, 160)
    target = np.full(scores.shape, 1 / (len(y) + 2) / max(scores.shape[1] - 1, 1))
    target[np.arange(len(y)), y] = 1 - 1 / (len(y) + 2)
    loss = [-(target * np.log(np.maximum(_softmax(scores / t), 1e-12))).sum(axis=1).mean() for t in tried]
    return float(tried[int(np.argmin(loss))])


def _rejection(score: np.ndarray, right: np.ndarray) -> float:
    """The lowest score from which on no more than ``WRONG`` of the predictions are wrong."""
    order = np.argsort(-score)
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(wrong <= WRONG)
    return float(score[order[fine[-1]]]) if len(fine) else 1.0


def fit_language(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict | None:
    """Train on a bounded sample of rows with text and language: as many of each language as
    fit, by the hash of ``key``. The sample is what comes to the driver."""
    known = docs.select(
        F.substring(F.col(text).cast("string"), 1, SAMPLE_CHARS).alias("text"),
        F.col(lang).cast("string").alias("lang"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("h"),
    ).filter("text IS NOT NULL AND lang IS NOT NULL")
    # A hash bound that leaves about the sample's size of each language, from exact counts.
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    each = max(FEWEST, SAMPLE_ROWS // len(counts))
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.3 * each / n + 20 / n))])
    place = F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / float(1 << 32)
    some = known.filter(place < F.get(F.array(F.try_element_at(share, F.col("lang"))), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    got = some.withColumn("_rank", rank).filter(F.col("_rank") <= each).drop("_rank").toPandas().sort_values(["h", "text", "lang"])
    return train(got["text"].tolist(), got["lang"].tolist())


def predict_language(text: Column, model: dict | None) -> Column:
    """A struct of ``lang``, ``score`` (0 to 1) and ``rejected``: too unsure to rely on."""

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names, scores, rejected = [], [], []
            for texts in slices(batch):
                lettered = has_letter(texts) if model else np.zeros(len(texts), bool)
                p = _softmax(text_scores(texts, model["table"]) / model["temperature"]) if model else np.zeros((len(texts), 1))
                best = p.argmax(axis=1)
                top = np.where(lettered, p.max(axis=1), 0.0)
                names += [model["names"][b] if ok else UNKNOWN for b, ok in zip(best, lettered)] if model else [UNKNOWN] * len(texts)
                scores.append(top)
                rejected.append(~lettered | (top < (model["reject_below"] if model else 1)))
            yield pa.StructArray.from_arrays(
                [
                    pa.array(names, pa.string()),
                    pa.array(np.concatenate(scores) if scores else [], pa.float64()),
                    pa.array(np.concatenate(rejected) if rejected else [], pa.bool_()),
                ],
                names=["lang", "score", "rejected"],
            )

    return F.arrow_udf(predict, "struct<lang: string, score: double, rejected: boolean>").asNondeterministic()(text.cast("string"))
