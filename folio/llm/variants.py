"""Spelling variants: words of a corpus that are one edit apart, and the form they stand for.

Words are counted over all texts. Two words one edit apart share the first or the last
half of the shorter one, so the vocabulary is dealt into groups by the first ``k`` code
points, and reversed words by theirs; a word of length n is in the groups of k = n // 2
and k = (n - 1) // 2, and a pair counts only in the group of the shorter one's half, and
in a reversed group only if the first halves differ. So every pair is found once.

Within a group the words are sorted, and each is compared with the words behind it by
dynamic programming along the sorted list. Words that share a prefix share the rows of
the edit matrix up to there (their LCP), so a row is worked out once for the whole range
of such words. Only the band of three cells that one edit allows is kept. Where no cell
is below two, the range is left out. Numpy takes one row further for all words and
ranges of a number of groups at once.

A group of more than ``MOST_GROUP`` words is cut by hash into parts, and every pair of
parts is a piece of work of its own.

A word's form is its near word of largest count, if that is at least ``TIMES`` its own;
forms of forms lead to the root, by pointers that double their reach each round (counts
double along the way, so the rounds are few).

Defined results: a null text has no words; a null id is read as ''; rows that share an id
are counted like any others; ties between near words go to the smallest in code-point
order; a word without near words has none counted and is its own root; an empty table
gives no rows; other columns, also ones with the names used here, are ignored. Texts and
words of any length are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from folio.llm.texts import slices
from folio.session import write_once

RUN = re.compile("[A-Za-zÀ-ÿ]+")
TYPO_SHARE = 97  # one run of a document in so many loses a code point
LEAST_LENGTH = 5
LEAST_COUNT = 3
TIMES = 2
MOST_GROUP = 8_000
CHUNK_WORDS = 20_000  # words of groups that are scanned together
FRONTIER = 300_000  # ranges that one scan holds, about
COUNTED = 250_000  # distinct words that a task holds
NO_CODE = np.uint32(0xFFFFFFFF)


# ---------------------------------------------------------------- vocabulary


def document_words(doc_id: str, text: str) -> Iterator[tuple[str, int]]:
    """Words of a lower-cased text with their counts: its runs of letters, some of which
    lose a code point, by a hash of the document and the run."""
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(RUN.findall(text)).items():
        h = zlib.crc32(run.encode(), start)
        if h % TYPO_SHARE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def put() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        ids, at = batch.column(0).to_pylist(), 0
        for texts in slices(batch.column(1)):
            for text in pc.ascii_lower(texts).to_pylist():
                for word, n in document_words(ids[at], text):
                    if len(word) >= LEAST_LENGTH:
                        counts[word] += n
                at += 1
                if len(counts) >= COUNTED:
                    yield put()
    yield put()


def vocabulary(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words of at least ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences. Written once."""
    read = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("doc"), F.col(text).cast("string").alias("text"))
    counted = read.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return write_once(counted.filter(F.col("n") >= LEAST_COUNT))


# ---------------------------------------------------------------- one edit apart, along sorted lists


def _adjacent_lcp(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each word and the one before it; -1 for the first."""
    out = np.full(len(starts), -1, np.int64)
    if len(starts) < 2:
        return out
    out[1:] = 0
    alive, depth = np.arange(1, len(starts)), 0
    while len(alive):
        alive = alive[(lengths[alive] > depth) & (lengths[alive - 1] > depth)]
        alive = alive[flat[starts[alive] + depth] == flat[starts[alive - 1] + depth]]
        depth += 1
        out[alive] = depth
    return out


def one_edit_pairs(words: list[str], group: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of distinct words of a group that are exactly one edit apart.

    ``words`` are sorted within their groups, ``group`` is ascending, and the words of a
    group begin with the same ``shared`` code points.
    """
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    starts = np.cumsum(lengths) - lengths
    flat = np.append(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), NO_CODE)
    lcp = _adjacent_lcp(flat, starts, lengths)
    firsts = np.flatnonzero(np.diff(group, prepend=-1))
    lcp[firsts] = -1
    group_end = np.append(firsts[1:], n)[np.cumsum(np.diff(group, prepend=-1) != 0) - 1] if n else firsts
    behind = group_end - np.arange(n) - 1
    asked = np.flatnonzero(behind > 0)
    load = np.cumsum(np.minimum(behind[asked], 1_000))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(asked):
        stop = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + FRONTIER, side="right")))
        found += _scan(asked[at:stop], group_end, shared, flat, starts, lengths, lcp)
        at = stop
    none = np.empty(0, np.int64)
    return tuple(np.concatenate([none, *c]) for c in zip(*found)) if found else (none, none)


def _scan(q, group_end, shared, flat, starts, lengths, lcp) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row by row for words ``q`` and the ranges of words behind them that share a prefix."""
    n, found = len(lengths), []
    low, high = q + 1, group_end[q]
    # Cells of the row of the shared prefix: against one code point less, as many, one more.
    cells = [np.ones(len(q), np.int8), np.zeros(len(q), np.int8), np.ones(len(q), np.int8)]
    step = 0

    def code(of: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.where(place < lengths[of], flat[np.minimum(starts[of] + place, len(flat) - 1)], NO_CODE)

    while len(q):
        # Ranges that share one code point more: cut where the LCP is no longer.
        cuts = lcp <= shared + step
        of_range, first = np.cumsum(cuts) - 1, np.append(np.flatnonzero(cuts), n)
        begin, many = of_range[low], of_range[high - 1] - of_range[low] + 1
        parent = np.repeat(np.arange(len(q)), many)
        child = np.arange(len(parent)) - np.repeat(np.cumsum(many) - many, many) + begin[parent]
        low, high = np.maximum(first[child], low[parent]), np.minimum(first[child + 1], high[parent])
        depth = shared[low] + step
        longer = lengths[low] > depth
        parent, low, high, depth = parent[longer], low[longer], high[longer], depth[longer]
        q = q[parent]
        less, same, more = (c[parent] for c in cells)
        ahead = lengths[q] - depth  # code points of q from here on
        c = flat[starts[low] + depth]
        new_less = np.minimum(same + 1, less + (c != code(q, depth - 1)))
        new_less[ahead < 0] = 2
        new_same = np.minimum(np.minimum(same + (c != code(q, depth)), more + 1), new_less + 1)
        new_same[ahead < 1] = 2
        new_more = np.minimum(more + (c != code(q, depth + 1)), new_same + 1)
        new_more[ahead < 2] = 2
        within = np.minimum(np.minimum(new_less, new_same), new_more) <= 1
        q, low, high, ahead = q[within], low[within], high[within], ahead[within]
        cells = [np.minimum(c[within], 2).astype(np.int8) for c in (new_less, new_same, new_more)]
        step += 1
        # A word that ends here is the first of its range.
        over = lengths[low] == shared[low] + step
        last = np.select([ahead == 0, ahead == 1, ahead == 2], cells, 2)
        hit = over & (last == 1)
        found.append((q[hit], low[hit]))
        rest = high - low > over
        q, low, high = q[rest], low[rest], high[rest]
        cells = [c[rest] for c in cells]
    return found


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, near_n) in both directions, from rows ordered by (group, w)."""
    held: list[pa.RecordBatch] = []

    def scan(table: pa.Table) -> pa.RecordBatch:
        words, counts = table["w"].to_pylist(), np.asarray(table["n"])
        k, reverse, part = np.asarray(table["k"], np.int64), np.asarray(table["reverse"], bool), np.asarray(table["part"])
        coded = np.asarray(table["group"].combine_chunks().dictionary_encode().indices, np.int64)
        a, b = one_edit_pairs(words, np.cumsum(np.diff(coded, prepend=-1) != 0), k)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        # The group is that of the shorter word's half; a piece of two parts has pairs across them.
        fits = np.minimum(lengths[a], lengths[b]) // 2 == k[a]
        fits &= (part[a] != part[b]) == np.asarray(table["across"], bool)[a]
        a, b = a[fits], b[fits]
        shown = [w[::-1] if r else w for w, r in zip(words, reverse)]
        new = np.array([not reverse[i] or shown[i][: k[i]] != shown[j][: k[i]] for i, j in zip(a, b)], bool)
        a, b = a[new], b[new]
        of, near = np.concatenate([a, b]), np.concatenate([b, a])
        return pa.RecordBatch.from_arrays(
            [pa.array([shown[i] for i in of], pa.string()), pa.array([shown[i] for i in near], pa.string()), pa.array(counts[near], pa.int64())], names=["word", "near", "near_n"]
        )

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < CHUNK_WORDS:
            continue
        table = pa.Table.from_batches(held)
        last = pc.not_equal(table["group"], table["group"][-1])
        whole = int(pc.sum(last).as_py() or 0)  # groups but the last, which may go on
        if whole:
            yield scan(table.slice(0, whole))
            held = table.slice(whole).to_batches()
    if held:
        yield scan(pa.Table.from_batches(held))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of all pairs one edit apart in ``words`` (word, n), in both directions."""
    length = F.length("word")
    halves = F.array_distinct(F.array(F.floor(length / 2), F.floor((length - 1) / 2)))
    entries = words.select("word", "n", F.explode(halves.cast("array<int>")).alias("k")).withColumn("reverse", F.explode(F.array(F.lit(False), F.lit(True))))
    entries = entries.select("n", "k", "reverse", F.when(F.col("reverse"), F.reverse("word")).otherwise(F.col("word")).alias("w"))
    entries = entries.withColumn("affix", F.expr("substring(w, 1, k)"))
    key = ["reverse", "k", "affix"]
    large = entries.groupBy(*key).count().filter(F.col("count") > MOST_GROUP)
    parts = large.select(*key, F.ceil(F.col("count") / F.lit(MOST_GROUP)).cast("int").alias("parts"))
    placed = entries.join(parts, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("w"), F.col("parts")).cast("int"))
    pieces = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    p, q = F.least("part", "_other"), F.greatest("part", "_other")
    group = F.concat_ws(":", F.col("reverse").cast("int"), "k", p, q, "affix")
    dealt = pieces.select(group.alias("group"), "w", "n", "k", "reverse", "part", (p != q).alias("across"))
    ordered = dealt.repartition("group").sortWithinPartitions("group", "w")
    return ordered.mapInArrow(_pairs, "word string, near string, near_n long")


# ---------------------------------------------------------------- forms and roots


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form)."""
    now = write_once(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        further = now.join(step, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved"))
        further = write_once(further)
        now = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row for each word of the vocabulary."""
    words = vocabulary(docs, id, text)
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("_best"))
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("_best.m") >= TIMES * F.col("n"), F.col("_best")).alias("_best")
    )
    judged = write_once(judged.select("word", "n", "n_near", F.col("_best.near").alias("form"), (-F.col("_best.m")).alias("form_n")))
    joined = judged.join(_roots(judged.filter("form IS NOT NULL")), "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
