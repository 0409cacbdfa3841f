"""Benchmark decontamination by a suffix automaton over the items' words.

Words are runs of ASCII digits, letters (A-Z lower-cased) and all characters beyond
ASCII. A window is ``WINDOW`` consecutive words of an item; an item of fewer words is
one window. The automaton of all items accepts every run of item words. A document's
words are streamed through it: at each word it gives the longest run ending there that
some item holds, and from ``WINDOW`` words on, the last ``WINDOW`` of them are hit and
the state names the items. Only stretches whose every word pair occurs in an item are
streamed, since no window can lie elsewhere.

Items are read in blocks of at most ``BLOCK_WORDS`` words, each with an automaton of its
own; documents are scanned once per block, without a shuffle. Between blocks the hits so
far are written to the shared folder, so a task holds one automaton.

Defined results: null and empty texts have no words; null or wordless items have no
windows; an item id that is null hits without being listed; repeated items count once;
without items nothing is hit; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from folio.llm.texts import distinct, slices, split_words
from folio.session import write_once

WINDOW = 10
BLOCK_WORDS = 100_000  # item words in one automaton
LONGEST_KEPT = 0  # hit spans of more words than this are cut out
MAX_COVERAGE = 0.8  # a document with a larger share of hit words goes

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[0x41:0x5B] += 0x20
_PLAIN[~_WORD_BYTE[_PLAIN]] = 0x20


def plain_texts(texts: pa.Array) -> pa.Array:
    """A-Z lower-cased, every byte that is not of a word made a space. No nulls."""
    _, ends, data = texts.buffers()
    plain = _PLAIN[np.frombuffer(data, np.uint8)] if data is not None else np.empty(0, np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, ends, pa.py_buffer(plain)], offset=texts.offset)


class Automaton:
    """All runs of words of the items; made on the driver from one block."""

    def __init__(self, items: list[tuple[int | None, list[str]]], window: int = WINDOW):
        self.window = window
        self.words: dict[str, int] = {}
        self.step: dict[int, int] = {}  # state << 32 | word -> state
        self.length, self.link = [0], [-1]
        out: list[list[int]] = [[]]  # words that leave a state
        sequences = [(i, [self.words.setdefault(w, len(self.words)) for w in words]) for i, words in items if words]
        for _, sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word, out)
        self.shortest = min([window, *[len(s) for _, s in sequences]])
        self.pairs = np.unique([a * len(self.words) + b for _, s in sequences for a, b in zip(s, s[1:])]).astype(np.int64)
        # By state: items that hold its run of ``window`` words; short items that end there.
        self.items: dict[int, set] = {}
        short: dict[int, set] = {}
        for item, sequence in sequences:
            state = 0
            for k, word in enumerate(sequence):
                state = self.step[state << 32 | word]
                if k + 1 >= window:
                    self.items.setdefault(self._covering(state, window), set()).add(item)
            if len(sequence) < window:
                short.setdefault(self._covering(state, len(sequence)), set()).add((len(sequence), item))
        self.long_state = [self._covering(s, window) if n >= window else -1 for s, n in enumerate(self.length)]
        self.short: dict[int, list] = {}
        for state in range(len(self.length)) if short else ():
            at, found = state, set()
            while at > 0:
                found |= short.get(at, set())
                at = self.link[at]
            if found:
                self.short[state] = sorted(found, key=lambda f: (f[0], str(f[1])))

    def _covering(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of the state's runs."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _add(self, length: int, link: int, out: list[list[int]]) -> int:
        self.length.append(length)
        self.link.append(link)
        out.append([])
        return len(self.length) - 1

    def _clone(self, p: int, q: int, word: int, out: list[list[int]]) -> int:
        """A state for the runs of ``q`` that end in ``p``'s runs and ``word``, no longer."""
        new = self._add(self.length[p] + 1, self.link[q], out)
        out[new] = list(out[q])
        for w in out[q]:
            self.step[new << 32 | w] = self.step[q << 32 | w]
        self.link[q] = new
        while p >= 0 and self.step.get(p << 32 | word) == q:
            self.step[p << 32 | word] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, word: int, out: list[list[int]]) -> int:
        q = self.step.get(last << 32 | word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, word, out)
        new = self._add(self.length[last] + 1, 0, out)
        p = last
        while p >= 0 and (p << 32 | word) not in self.step:
            self.step[p << 32 | word] = new
            out[p].append(word)
            p = self.link[p]
        if p >= 0:
            q = self.step[p << 32 | word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word, out)
        return new

    def scan(self, words: list[int]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of hit words, and the items whose windows occur."""
        spans: list[list[int]] = []
        items: set = set()
        state = n = 0
        step, link, length = self.step, self.link, self.length
        for k, word in enumerate(words):
            to = step.get(state << 32 | word)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = step.get(state << 32 | word)
            if to is None:
                continue
            state, n = to, n + 1
            hit = 0
            if n >= self.window:
                hit = self.window
                items |= self.items[self.long_state[state]]
            for size, item in self.short.get(state, ()):
                if size <= n:
                    hit = max(hit, size)
                    items.add(item)
            if hit:
                start = k + 1 - hit
                while spans and start <= spans[-1][1]:
                    start = min(start, spans.pop()[0])
                spans.append([start, k + 1])
        return [(a, b) for a, b in spans], items

    def stretches(self, words: np.ndarray, of_text: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of the numbered words (-1: in no item) that may hold a window."""
        known = words >= 0
        joined = known[:-1] & known[1:] & (of_text[:-1] == of_text[1:])
        at = np.flatnonzero(joined)
        if len(self.pairs):
            pair = words[at] * len(self.words) + words[at + 1]
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[at[self.pairs[place] != pair]] = False
        else:
            joined[:] = False
        # A stretch goes on while words are joined; alone, a known word is one of length one.
        starts = np.flatnonzero(known & ~np.concatenate([[False], joined])) if len(words) else np.empty(0, np.int64)
        ends = np.flatnonzero(known & ~np.concatenate([joined, [False]])) + 1 if len(words) else starts
        long = ends - starts >= self.shortest
        return zip(starts[long].tolist(), ends[long].tolist())


def read_words(texts: pa.Array, numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The item number of every word (-1: none) of all texts in a row, and where texts start."""
    words, offsets = split_words(plain_texts(texts))
    codes, values = distinct(words)
    of_value = np.fromiter((numbers.get(v, -1) for v in values.to_numpy(zero_copy_only=False)), np.int64, len(values))
    return (of_value[codes] if len(codes) else np.empty(0, np.int64)), offsets


def item_words(text: str | None) -> list[str]:
    return split_words(plain_texts(pa.array([text or ""], pa.large_string())))[0].to_pylist()


def blocks(items: DataFrame, id: str, text: str, window: int = WINDOW, limit: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """Automata of all items, at most ``limit`` words each; longer items are cut with an overlap."""
    block: list = []
    size = 0
    for row in items.select(F.col(id).cast("long"), F.col(text).cast("string")).distinct().toLocalIterator():
        words = item_words(row[1])
        for at in range(0, max(1, len(words) - window + 1), limit):
            part = words[at : at + limit + window - 1]
            if block and size + len(part) > limit:
                yield Automaton(block, window)
                block, size = [], 0
            block.append((row[0], part))
            size += len(part)
    if block:
        yield Automaton(block, window)


_HITS = "struct<n_words: long, spans: array<struct<start: int, end: int>>, items: array<long>>"


def _scanner(automaton: Automaton | None):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch, earlier in batches:
            n_words, spans, items = [], [], []
            for texts in slices(batch):
                words, offsets = read_words(texts, automaton.words if automaton else {})
                n_words.append(np.diff(offsets))
                at = len(spans)
                spans += [[] for _ in range(len(texts))]
                items += [set() for _ in range(len(texts))]
                if not automaton or not automaton.words:
                    continue
                of_text = np.repeat(np.arange(len(texts)), np.diff(offsets))
                for a, b in automaton.stretches(words, of_text):
                    found, of = automaton.scan(words[a:b].tolist())
                    k = int(of_text[a])
                    spans[at + k] += [(a - int(offsets[k]) + s, a - int(offsets[k]) + e) for s, e in found]
                    items[at + k] |= of
            for k, before in enumerate(earlier):
                if before.is_valid and spans:
                    spans[k] += [(s["start"], s["end"]) for s in before["spans"].as_py()]
                    items[k] |= set(before["items"].as_py())
            yield pa.StructArray.from_arrays(
                [
                    pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in merged(s)] for s in spans], span),
                    pa.array([sorted(i for i in s if i is not None) for s in items], pa.list_(pa.int64())),
                ],
                names=["n_words", "spans", "items"],
            )

    return F.arrow_udf(scan, _HITS).asNondeterministic()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_hits(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "hits", limit: int = BLOCK_WORDS) -> DataFrame:
    """Add a struct: ``n_words``, ``spans`` of hit words (end exclusive) and ``items`` whose windows occur."""
    if out in docs.columns:
        raise ValueError(f"docs already has a column {out}; choose another name")
    found = docs.withColumn(out, F.lit(None).cast(_HITS))
    scanned = False
    for automaton in blocks(items, item_id, item_text, limit=limit):
        found = write_once(found) if scanned else found
        found = found.withColumn(out, _scanner(automaton)(F.col(text).cast("string"), F.col(out)))
        scanned = True
    return found if scanned else found.withColumn(out, _scanner(None)(F.col(text).cast("string"), F.col(out)))


def hit_words(hits: Column) -> Column:
    return F.aggregate(hits["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def _without_spans(text: Column, spans: Column) -> Column:
    """The text without the words of the spans and what separates those words."""

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, of in batches:
            yield pa.array([cut_words(t.as_py(), s.as_py()) if t.is_valid and len(s) else None for t, s in zip(texts, of)], pa.string())

    return F.arrow_udf(cut, "string").asNondeterministic()(text, spans)


def cut_words(text: str, spans: list[dict]) -> str:
    data = np.frombuffer(text.encode(), np.uint8)
    is_word = _WORD_BYTE[_PLAIN[data]]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]])))
    starts, ends = edges[::2], edges[1::2]
    kept, at = [], 0
    for s in spans:
        kept.append(data[at : starts[s["start"]]].tobytes())
        at = ends[s["end"] - 1]
    kept.append(data[at:].tobytes())
    return b"".join(kept).decode()


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    longest_kept: int = LONGEST_KEPT,
    max_coverage: float = MAX_COVERAGE,
) -> DataFrame:
    """The columns of ``docs``: hit spans of more than ``longest_kept`` words are cut from the
    text, and documents with more than ``max_coverage`` of their words hit are dropped."""
    name = "_hits"
    while name in docs.columns:
        name += "_"
    found = find_hits(docs, items, text, item_id, item_text, out=name)
    h = F.col(name)
    long = F.filter(h["spans"], lambda s: s["end"] - s["start"] > longest_kept)
    kept = found.filter(hit_words(h) <= F.lit(max_coverage) * h["n_words"])
    cleaned = F.when(F.size(long) > 0, _without_spans(F.col(text), long)).otherwise(F.col(text))
    return kept.withColumn(text, cleaned).select(*docs.columns)
