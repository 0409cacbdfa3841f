"""Folders of binary books, and the text of each book."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from folio.functions.rows import unroll
from folio.functions.text import file_stem
from folio.operators.chunk import recursive_chunks
from folio.plugins import Decode


def scan_books(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """Files below ``folder`` whose name ends in ``suffix`` (case matters).

    ``content`` is read from storage only if a later step uses it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return files.option("pathGlobFilter", f"*{suffix}").load(folder)


def not_extracted(books: DataFrame, done: DataFrame) -> DataFrame:
    """Books still to do: one per stem, and no stem found in ``done``.

    Works on paths only, so finished books are dropped before they are decoded. Of
    several books with one stem the smallest path is taken.
    """
    stems = books.withColumn("stem", file_stem(F.col("path")))
    first = stems.groupBy("stem").agg(F.min("path").alias("path"))
    chosen = first.join(done.select("stem").distinct(), "stem", "left_anti")
    return stems.join(chosen.select("path"), "path", "left_semi")


def decode_pages(books: DataFrame, decode: Decode) -> DataFrame:
    """One row per page: ``path, stem, page_no, page_content, metadata``."""
    run = F.pandas_udf(lambda content: decode(content), T.ArrayType(T.StringType()))
    pages = unroll(books, ["path", "stem"], run("content"), "page_no", "page_content")
    return pages.withColumn(
        "metadata", F.create_map(F.lit("source"), "path", F.lit("page"), F.col("page_no").cast("string"))
    )


def book_text(pages: DataFrame, chunks: Callable[[Column], Column] = recursive_chunks) -> DataFrame:
    """``(stem, body)``: the chunks of all pages, joined without a separator.

    Overlaps between chunks appear twice. A page's chunks are joined inside its row,
    so only one string per page is shuffled.
    """
    joined = pages.select("stem", "page_no", F.array_join(chunks(F.col("page_content")), "").alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "t")))
    return joined.groupBy("stem").agg(F.array_join(F.transform(ordered, lambda p: p.t), "").alias("body"))
