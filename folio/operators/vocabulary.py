"""A vocabulary of words by frequency: ids are ranks, and arrays of ids turn back into words.

Id 0 pads, id 1 stands for unknown words, and the most frequent word has id 2. Words of
equal count are ranked in UTF-8 order. Ranks are worked out without gathering the words
in one place. The most frequent words, a bounded number, are sent to the tasks as one
table, where a word's place gives its id; other words are rare, and are shuffled to theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from folio.functions.text import strip
from folio.operators.ordered import with_row_index
from folio.session import write_once

PAD, UNKNOWN, FIRST = 0, 1, 2
HOT_WORDS = 200_000
HOT_BYTES = 16 << 20  # of the table of words that is sent to the tasks


def text_words(text: Column) -> Column:
    """Runs of characters between Unicode white space, as the default tokenizer cuts them."""
    return F.filter(F.split(strip(text), r"(?U)\s+"), lambda w: w != "")


def fit_vocabulary(df: DataFrame, text: str, size: int | None = None, min_count: int = 1) -> DataFrame:
    """(word, n, id) of the words of all texts; with ``size``, ids are below it. Written once."""
    words = df.select(F.explode(text_words(F.col(text))).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    ranked = with_row_index(counted.withColumn("_n", -F.col("n")), ["_n", "word"], "id", start=FIRST).drop("_n")
    ranked = ranked.select("word", "n", F.col("id").cast("int").alias("id"))
    return write_once(ranked if size is None else ranked.filter(F.col("id") < size))


def _hot(vocabulary: DataFrame) -> pa.Array:
    """Words of ids FIRST, FIRST + 1, … in this order: HOT_WORDS and HOT_BYTES at most."""
    rows = vocabulary.filter(F.col("id") < FIRST + HOT_WORDS)
    # A word longer than a share of the bytes ends the table, since places are ids.
    longest = rows.filter(F.octet_length("word") > HOT_BYTES // HOT_WORDS * 16).agg(F.min("id")).first()[0]
    if longest is not None:
        rows = rows.filter(F.col("id") < longest)
    held = rows.select("id", "word").toArrow().sort_by("id")
    words = held.column("word").combine_chunks().cast(pa.string())
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(words), 0), np.int64)) if len(words) else np.empty(0)
    return words.slice(0, int(np.searchsorted(sizes, HOT_BYTES, side="right")))


def encode(df: DataFrame, text: str, vocabulary: DataFrame, out: str = "ids") -> DataFrame:
    """Add the ids of a text's words; a null text has none (null)."""
    hot = _hot(vocabulary)
    all_hot = len(hot) == vocabulary.count()
    column = _free("_rare", df.columns)

    @F.arrow_udf("struct<ids: array<int>, places: array<int>>")
    def hot_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            place = pc.index_in(lists.flatten(), value_set=hot)
            ids = np.asarray(pc.fill_null(pc.add(place, FIRST), UNKNOWN), np.int32)
            offsets = np.asarray(lists.offsets, np.int32)
            offsets = offsets - offsets[0]
            unknown = ids == UNKNOWN
            before = np.concatenate([[0], np.cumsum(unknown)])[offsets].astype(np.int32)
            at = (np.arange(len(ids)) - np.repeat(offsets[:-1], np.diff(offsets)))[unknown].astype(np.int32)
            null = pc.is_null(lists)
            made = [pa.ListArray.from_arrays(pa.array(o), pa.array(v), mask=null) for o, v in ((offsets, ids), (before, at))]
            yield pa.StructArray.from_arrays(made, names=["ids", "places"])

    words = text_words(F.col(text))
    found = df.withColumn(column, hot_ids(words))
    if all_hot:  # whatever is not in the table is unknown
        return found.withColumn(out, F.col(f"{column}.ids")).drop(column)
    key, patch = _free("_key", df.columns), _free("_patch", df.columns)
    named = F.transform(F.col(f"{column}.places"), lambda k: F.struct(k.alias("at"), F.get(words, k).alias("word")))
    held = write_once(found.withColumn(patch, named).withColumn(key, F.monotonically_increasing_id()))
    rare = held.select(key, F.explode(patch).alias("_r")).select(key, "_r.*").join(vocabulary.select("word", "id"), "word")
    patches = rare.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "id"))).alias("_ids"))
    met = held.drop(patch).join(patches, key, "left")
    ids = F.transform(F.col(f"{column}.ids"), lambda v, k: F.coalesce(F.try_element_at("_ids", k), v))
    return met.withColumn(out, F.when(F.col("_ids").isNull(), F.col(f"{column}.ids")).otherwise(ids)).select(*df.columns, out)


def decode(df: DataFrame, ids: str, vocabulary: DataFrame, out: str = "words") -> DataFrame:
    """Add the words of an array of ids; pads are left out, unknown words are null."""
    hot = _hot(vocabulary)
    all_hot = len(hot) == vocabulary.count()
    real = F.filter(F.col(ids), lambda v: v != PAD)

    @F.arrow_udf("array<string>")
    def hot_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            place = np.asarray(lists.flatten(), np.int64) - FIRST
            known = (place >= 0) & (place < len(hot))
            words = hot.take(pa.array(np.where(known, place, 0), mask=~known))
            offsets = np.asarray(lists.offsets, np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), words, mask=pc.is_null(lists))

    if all_hot:
        return df.withColumn(out, hot_words(real))
    key, column = _free("_key", df.columns), _free("_words", df.columns)
    held = write_once(df.withColumn(column, hot_words(real)).withColumn(key, F.monotonically_increasing_id()))
    rare = held.select(key, F.posexplode(real).alias("at", "id")).filter(F.col("id") >= FIRST + len(hot))
    named = rare.join(vocabulary.select("id", "word"), "id").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("_ids"))
    met = held.join(named, key, "left")
    words = F.transform(F.col(column), lambda w, k: F.coalesce(w, F.try_element_at("_ids", k)))
    return met.withColumn(out, F.when(F.col("_ids").isNull(), F.col(column)).otherwise(words)).select(*df.columns, out)


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name
