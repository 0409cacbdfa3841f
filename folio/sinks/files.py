"""Text and CSV outputs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.functions import prompts


# A book store is a folder of files that hold many books each, and an index of the books:
# stem, file, place in the file, length. Both only grow; a book is there once it is in the
# index, so an addition that failed half-way is written again.

BOOKS_PER_FILE = 2_000
_BOOKS, _INDEX = "stem string, body string", "stem string, file string, place long, n_chars long"


def write_books(bodies: DataFrame, folder: str, per_file: int = BOOKS_PER_FILE) -> None:
    """Add books ``(stem, body)`` to the store: files of at most ``per_file`` books, sorted by stem."""
    part = f"{folder}/books/add-{uuid.uuid4().hex}"
    chosen = bodies.select("stem", "body").sortWithinPartitions("stem")
    chosen.write.option("maxRecordsPerFile", per_file).parquet(part)
    # Stems and places are read from the files, the bodies' lengths only as far as needed.
    written = bodies.sparkSession.read.schema(_BOOKS).parquet(part)
    places = written.select("stem", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"), F.length("body").cast("long").alias("n_chars"))
    places.write.mode("append").parquet(f"{folder}/index")


def book_index(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, file, place, n_chars) of the books in the store; none if the folder does not exist yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/index")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _INDEX)
    return spark.read.schema(_INDEX).parquet(f"{folder}/index")


def extracted_stems(spark: SparkSession, folder: str) -> DataFrame:
    """Stems that are in the store."""
    return book_index(spark, folder).select("stem").distinct()


def read_books(spark: SparkSession, folder: str, stems: DataFrame | None = None) -> DataFrame:
    """(stem, body) of all books, or of those in ``stems``, whose files alone are opened."""
    index = book_index(spark, folder)
    if stems is None:
        adds = index.select(F.regexp_extract("file", "(add-[0-9a-f]+)/[^/]*$", 1).alias("a")).distinct().collect()  # one for each addition
        parts = [f"{folder}/books/{r['a']}" for r in adds]
        return spark.read.schema(_BOOKS).parquet(*parts) if parts else spark.createDataFrame([], _BOOKS)
    files = [r["file"] for r in index.join(stems.select("stem").distinct(), "stem", "left_semi").select("file").distinct().collect()]
    if not files:
        return spark.createDataFrame([], _BOOKS)
    return spark.read.schema(_BOOKS).parquet(*files).join(stems.select("stem").distinct(), "stem", "left_semi")


def export_books(bodies: DataFrame, folder: str) -> None:
    """A text file per stem, in a folder of its own: for the few books that another program wants."""
    bodies.select("stem", F.col("body").alias("value")).write.mode("append").partitionBy("stem").text(folder)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header and no index column. Every file of an appended folder has its header.

    White space is kept. NULL is written as nothing, an empty text as two quotes.
    """
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(**options).csv(path)


def stream_frames(chunks: DataFrame, chunk: str, folder: str, checkpoint: str, sse: bool = True) -> StreamingQuery:
    """Write a chunk stream as text, one event frame per chunk or the bare chunks."""
    value = prompts.sse_frame(F.col(chunk)) if sse else F.col(chunk)
    writer = chunks.select(value.alias("frame")).writeStream.format("json").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
