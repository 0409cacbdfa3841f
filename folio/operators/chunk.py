"""Overlapping text chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from folio.constants import CHUNK_OVERLAP, CHUNK_SIZE
from folio.functions.rows import unroll

SEPARATORS = ("\n\n", "\n", " ", "")


def fixed_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """``array<string>``: pieces of ``size`` characters that start ``size - overlap`` apart."""
    stride = size - overlap
    n = F.greatest(F.ceil((F.length(text) - F.lit(overlap)) / F.lit(stride)), F.lit(1)).cast("int")
    # The text is cut into strides once, so that it is not walked through again for
    # every chunk; a chunk is its stride and the beginning of what follows. The array
    # of one element binds the strides to a name: used directly, the inner function
    # would compute them for each chunk. A last stride of ``overlap`` characters or
    # fewer makes no chunk, because the chunk before holds all of it.
    strides = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))
    count = F.lit(-(-size // stride))
    chunks = F.transform(
        F.array(strides),
        lambda s: F.transform(s, lambda _, i: F.substring(F.array_join(F.slice(s, i + 1, count), ""), 1, size)),
    )
    return F.slice(F.get(chunks, F.lit(0)), 1, n)


def chunk_fixed(
    df: DataFrame, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """One row per fixed-stride chunk; ``text`` is replaced by ``chunk_no, chunk``."""
    return _explode(df, text, fixed_chunks(F.col(text), size, overlap))


def chunk_recursive(
    df: DataFrame,
    text: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: tuple[str, ...] = SEPARATORS,
) -> DataFrame:
    """One row per chunk, cut at the coarsest separator that keeps chunks within ``size``."""
    return _explode(df, text, recursive_chunks(F.col(text), size, overlap, separators))


def _explode(df: DataFrame, text: str, chunks: Column) -> DataFrame:
    keep = [c for c in df.columns if c != text]
    return unroll(df, keep, chunks, "chunk_no", "chunk")


def recursive_chunks(
    text: Column,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: tuple[str, ...] = SEPARATORS,
) -> Column:
    """``array<string>`` of chunks; Arrow batches go through a small Python helper."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: split_text(t, size, overlap, separators) if t else [])

    return split(text)


def split_text(
    text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS
) -> list[str]:
    """Chunks of one text, none longer than ``size`` and none blank."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    out: list[str] = []
    run: list[str] = []
    for piece in _cut(text, separators[at]):
        if len(piece) < size:
            run.append(piece)
            continue
        out += _gather(run, size, overlap)
        run = []
        out += split_text(piece, size, overlap, finer) if finer else [piece]
    return out + _gather(run, size, overlap)


def _cut(text: str, sep: str) -> list[str]:
    """Pieces of ``text``; each but the first starts with the separator."""
    if not sep:
        return list(text)
    head, *rest = text.split(sep)
    return [p for p in (head, *(sep + r for r in rest)) if p]


def _gather(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Join neighbouring pieces up to ``size``, repeating up to ``overlap`` characters."""
    if all(len(p) == 1 for p in pieces) and overlap < size:
        # Single characters: chunks are plain slices, the last one short.
        text, stride = "".join(pieces), size - overlap
        cuts = [text[at : at + size].strip() for at in range(0, max(len(text) - overlap, 1), stride)]
        return [c for c in cuts if c]
    out: list[str] = []
    first, held = 0, 0  # pieces[first:i] are held, `held` characters in all
    for i, piece in enumerate(pieces):
        if held + len(piece) > size and i > first:
            out.append("".join(pieces[first:i]).strip())
            while held > overlap or (held > 0 and held + len(piece) > size):
                held -= len(pieces[first])
                first += 1
        held += len(piece)
    out.append("".join(pieces[first:]).strip())
    return [c for c in out if c]
