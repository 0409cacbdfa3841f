"""Work on Arrow string arrays inside a task: bounded slices, words, hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 3 << 20  # text handled at once; a longer text is a slice of its own


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Runs of consecutive texts of at most ``limit`` bytes, one text at least; null becomes ''."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield texts.slice(at, stop - at)
        at = stop


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space (space, tab to carriage return), of all texts in a row.

    The second value has ``len(texts) + 1`` positions: text i's words are at [i] to [i + 1].
    """
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    real = np.asarray(pc.binary_length(words), dtype=np.int64) > 0
    if real.all():
        return words, offsets
    kept = np.concatenate([[0], np.cumsum(real)])
    return words.filter(pa.array(real)), kept[offsets]


def release() -> None:
    """Give what a task has freed back to the machine; its Python process lives on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def translated(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """Texts (large strings, no nulls) with each byte replaced by its entry in ``table``."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(table[body]))


def distinct(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For every word its place among the distinct words; the distinct words."""
    coded = words.dictionary_encode()
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(v) for v in values.to_pylist()), np.uint64, len(values))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``split_words`` with each word replaced by its 64-bit hash."""
    words, offsets = split_words(texts)
    codes, values = distinct(words)
    return hash_strings(values)[codes], offsets


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` word hashes; the result is ``size - 1`` shorter."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, size):
        h = mixed(h) + words[k : k + n]
    return mixed(h)
