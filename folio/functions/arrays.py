"""Column functions on token-id arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folio.constants import IGNORED_LABEL
from folio.functions.text import strip


def word_ids(text: Column, vocab: int = 32000) -> Column:
    """Default tokenizer: one id in 1 … vocab-1 per whitespace-separated word.

    The id is a hash of the word, so no vocabulary table has to be joined.
    """
    words = F.filter(F.split(strip(text), r"(?U)\s+"), lambda w: w != "")
    return F.transform(
        words,
        lambda w: (F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int") % F.lit(vocab - 1)) + F.lit(1),
    )


def truncate(ids: Column, max_len: int) -> Column:
    return F.slice(ids, 1, max_len)


def right_pad(ids: Column, length: Column, pad_id: int) -> Column:
    missing = F.greatest(length - F.size(ids), F.lit(0)).cast("int")
    return F.concat(ids, F.array_repeat(F.lit(pad_id), missing))


def attention(ids: Column, length: Column) -> Column:
    """1 for each real position, 0 for each padded one."""
    ones = F.transform(ids, lambda _: F.lit(1))
    return right_pad(ones, length, 0)


def mask_value(ids: Column, value: int) -> Column:
    """Replace ``value`` by the ignored label, wherever it stands."""
    return F.transform(ids, lambda x: F.when(x == F.lit(value), F.lit(IGNORED_LABEL)).otherwise(x))


def after_prefix(ids: Column, prefix: Column) -> Column:
    """What follows the first ``size(prefix)`` elements."""
    rest = F.greatest(F.size(ids) - F.size(prefix), F.lit(0))
    return F.slice(ids, F.size(prefix) + F.lit(1), rest)
