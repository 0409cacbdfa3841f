"""Rule statistics of texts, and an isolation forest that judges them.

Statistics of a text: words, code points in words, symbols, repeated lines, words in
repeated 8-word windows, and the shares that follow from them. Trees split them at
random features and thresholds; a text that leaves the good labelled rows after a few
splits is an anomaly. The threshold on the mean path is set on labelled rows that no
tree has seen.

The forest is fitted on at most ``SAMPLE_ROWS`` labelled rows, those of smallest hash;
statistics and verdicts are made for every row, in one pass and without a shuffle.

Defined results: null and empty texts have no words and fail; without labelled rows of
both kinds only the base rule decides; repeated label rows of a document count once
(the lowest quality); rows with null doc_id or quality teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from folio.llm.texts import mixed, release, slices, window_hashes, word_hashes

SAMPLE_ROWS = 8_000  # labelled rows that the forest and its threshold are made from
TREES = 100
TREE_ROWS = 256
LOST_GOOD = 0.002  # share of good labelled rows that the threshold may reject
WINDOW = 8
MIN_WORDS = 20
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct"]


def _is_in(characters: bytes) -> np.ndarray:
    found = np.zeros(256, np.uint8)
    found[list(characters)] = 1
    return found


_TABLES = {
    "space": _is_in(SPACE),
    "n_symbols": _is_in(SYMBOLS),
    "n_upper": _is_in(bytes(range(0x41, 0x5B))),
    "n_marks": _is_in(b"!?"),
}


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct_per_text(text: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((values, text))
    text, values = text[order], values[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (values[1:] != values[:-1])
    return np.bincount(text[first], minlength=n)


def rule_stats(texts: pa.Array) -> np.ndarray:
    """Statistics of each text (no nulls), one column for each of ``STATS``."""
    n, out = len(texts), {}
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.empty(0, np.uint8)
    at = starts - starts[0]
    for name, flags in _TABLES.items():
        out[name] = _per_text(flags[data], at)
    out["word_chars"] = np.asarray(pc.utf8_length(texts), np.int64) - out["space"]

    lines = pc.split_pattern(texts, "\n")
    of_line = np.repeat(np.arange(n), np.diff(np.asarray(lines.offsets)))
    coded = lines.flatten().dictionary_encode()
    codes = np.asarray(coded.indices, np.int64)
    filled = np.asarray(pc.match_substring_regex(coded.dictionary, r"[^ \t\n\x0b\x0c\r]"), bool)[codes]
    out["n_lines"] = np.bincount(of_line[filled], minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct_per_text(of_line[filled], codes[filled], n)

    words, offsets = word_hashes(texts)
    out["n_words"] = np.diff(offsets)
    of_word = np.repeat(np.arange(n), out["n_words"])
    out["n_repeat_words"] = _per_text(_repeated(words, of_word), offsets)
    out["n_distinct"] = _distinct_counts(words, of_word, n)
    return np.column_stack([out[s] for s in STATS]).astype(np.int64)


def _distinct_counts(words: np.ndarray, of_word: np.ndarray, n: int) -> np.ndarray:
    key = words ^ mixed(of_word.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    key = key[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return np.bincount(of_word[order[first]], minlength=n)


def _repeated(words: np.ndarray, of_word: np.ndarray) -> np.ndarray:
    """Which words lie in a window that its text holds twice or more."""
    covered = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(of_word[: len(words) - WINDOW + 1] == of_word[WINDOW - 1 :]) if len(words) >= WINDOW else []
    if len(at):
        key = window_hashes(words, WINDOW)[at] ^ mixed(of_word[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        found = at[order[twice]]
        covered[found] += 1
        covered[found + WINDOW] -= 1
    return np.cumsum(covered[:-1]) > 0


def base_failed(stats: np.ndarray) -> np.ndarray:
    n, repeated = stats[:, STATS.index("n_words")], stats[:, STATS.index("n_repeat_words")]
    return (n < MIN_WORDS) | (100 * repeated > 30 * n)


def features(stats: np.ndarray) -> np.ndarray:
    """Shares, by their roots: small ones must stand apart too when splits are uniform."""
    s = {name: stats[:, k].astype(float) for k, name in enumerate(STATS)}
    words, lines, chars = np.maximum(s["n_words"], 1), np.maximum(s["n_lines"], 1), np.maximum(s["word_chars"], 1)
    return np.column_stack(
        [
            s["word_chars"] / words,
            np.sqrt(np.minimum(s["n_symbols"] / words, 1)),
            np.sqrt(s["n_dup_lines"] / lines),
            np.sqrt(s["n_repeat_words"] / words),
            np.sqrt(s["n_upper"] / chars),
            np.sqrt(np.minimum(s["n_marks"] / words, 1)),
            s["n_distinct"] / words**0.9,
        ]
    )


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    return np.where(n > 1, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m, 0.0)


def grow_tree(x: np.ndarray, good: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rows (feature, threshold, left, right, path); a leaf has feature -1.

    Splits are random within all rows; paths count the good rows, so that a region
    which good rows have left early has a short path.
    """
    limit = int(np.ceil(np.log2(max(len(x), 2)))) + 2
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0, 0, 0, 0])
        n_good = int(good[rows].sum())
        low, high = x[rows].min(0), x[rows].max(0)
        wide = np.flatnonzero(high > low)
        if depth >= limit or n_good <= 1 or not len(wide):
            nodes[at][4] = depth + float(_mean_path(n_good))
            return at
        k = int(rng.choice(wide))
        t = rng.uniform(low[k], high[k])
        left = x[rows, k] <= t
        nodes[at] = [k, t, grow(rows[left], depth + 1), grow(rows[~left], depth + 1), 0]
        return at

    grow(np.arange(len(x)), 0)
    return np.array(nodes)


def anomaly(forest: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Score in (0, 1) of each row: the higher, the sooner it is isolated."""
    paths = np.zeros(len(x))
    rows = np.arange(len(x))
    for tree in forest:
        at = np.zeros(len(x), np.int64)
        while True:
            k = tree[at, 0].astype(np.int64)
            inner = k >= 0
            if not inner.any():
                break
            left = x[rows, np.maximum(k, 0)] <= tree[at, 1]
            at = np.where(inner, np.where(left, tree[at, 2], tree[at, 3]).astype(np.int64), at)
        paths += tree[at, 4]
    return 2.0 ** (-paths / len(forest) / float(_mean_path(TREE_ROWS)))


def fit_forest(x: np.ndarray, good: np.ndarray, seed: int = 7) -> dict | None:
    """Trees on one half of the rows, the threshold on the other."""
    rng = np.random.default_rng(seed)
    grown = np.arange(len(x)) % 2 == 0
    if not (good[grown].any() and good[~grown].any() and (~good[~grown]).any()):
        return None
    rows = np.flatnonzero(grown)
    forest = []
    for _ in range(TREES):
        some = rng.choice(rows, min(TREE_ROWS, len(rows)), replace=False)
        forest.append(grow_tree(x[some], good[some], rng))
    scores = anomaly(forest, x[~grown])
    of_good, of_bad = np.sort(scores[good[~grown]]), scores[~good[~grown]]
    # Of the thresholds that reject few good rows, the one that is right most often.
    allowed = of_good[-1 - int(LOST_GOOD * len(of_good))]
    candidates = np.unique(np.concatenate([[allowed], of_good[of_good >= allowed], of_bad[of_bad >= allowed]]))
    wrong = [(of_good > t).sum() + (of_bad <= t).sum() for t in candidates]
    best = int(np.argmin(wrong))
    above = scores[scores > candidates[best]]
    threshold = (candidates[best] + above.min()) / 2 if len(above) else float(candidates[best])
    return {"forest": forest, "threshold": float(threshold)}


def labelled_stats(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the sample. Its ids are few enough to broadcast."""
    sample = (
        labels.select(F.col(id).alias("_id"), F.col(label).alias("_good"))
        .filter("_id IS NOT NULL AND _good IS NOT NULL")
        .groupBy("_id")
        .agg(F.min("_good").alias("_good"))
        .orderBy(F.md5(F.col("_id").cast("string")), "_id")
        .limit(SAMPLE_ROWS)
    )
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id")
    measured = rows.select(F.md5(F.col("_id").cast("string")).alias("h"), "_good", _judge(None)(F.col("_text")).alias("m"))
    got = measured.select("h", "_good", *[f"m.{s}" for s in STATS]).toPandas().sort_values(["h", *STATS])
    return got[STATS].to_numpy(np.int64).reshape(-1, len(STATS)), got["_good"].to_numpy() > 0


def fit_rules(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> dict | None:
    stats, good = labelled_stats(docs, labels, id, text, label)
    judged = ~base_failed(stats)
    return fit_forest(features(stats[judged]), good[judged])


def _judge(model: dict | None):
    fields = ", ".join(f"{s}: long" for s in STATS)

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            stats = [rule_stats(t) for t in slices(batch)]
            stats = np.concatenate(stats) if stats else np.empty((0, len(STATS)), np.int64)
            failed = base_failed(stats)
            scores, kept = np.zeros(len(stats)), ~failed
            if model and len(stats):
                scores = anomaly(model["forest"], features(stats))
                kept = kept & (scores <= model["threshold"])
            yield pa.StructArray.from_arrays(
                [*[pa.array(stats[:, k]) for k in range(len(STATS))], pa.array(failed), pa.array(scores), pa.array(kept)],
                names=[*STATS, "base_failed", "anomaly", "kept"],
            )
        release()

    return F.arrow_udf(judge, f"struct<{fields}, base_failed: boolean, anomaly: double, kept: boolean>").asNondeterministic()


def rule_verdict(text: Column, model: dict | None) -> Column:
    """A struct of the statistics, ``base_failed``, ``anomaly`` and ``kept``."""
    return _judge(model)(text.cast("string"))


def keep_good(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """The rows that the rules keep, with the columns of ``docs``."""
    name = "_verdict"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, rule_verdict(F.col(text), model)).filter(F.col(name)["kept"]).select(*docs.columns)
