"""Text, CSV and JSON inputs, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folio.functions.text import strip
from folio.operators.dataset import require_columns, union_splits

# What Spark's parser is told to put for an empty field. As long as it differs from '', a
# quoted empty field is told apart; the character is not one of text.
NO_TEXT = "\x00"
CHUNK_SCHEMA = "session_id string, seq int, chunk string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line_no, line)``: numbered, stripped lines of UTF-8 files.

    A long file is read in several splits. Lines are numbered inside their split, and
    the splits' line counts tell how many lines come before it, so that no task sees
    more than one split of a file.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
        strip(F.col("value")).alias("line"),
    )
    inside = Window.partitionBy("path", "_start").orderBy("_at")
    before = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("path", "_start").count().select(
        "path", "_start", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    numbered = lines.withColumn("_row", F.row_number().over(inside))
    return numbered.join(splits, ["path", "_start"]).select(
        "path", (F.col("_before") + F.col("_row") - 1).alias("line_no"), "line"
    )


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; quoted fields may hold line breaks. A byte-order mark is skipped.

    An empty field is NULL, a quoted empty one is an empty text.
    """
    options = {"header": True, "multiLine": True, "escape": '"', "nullValue": NO_TEXT, "emptyValue": ""}
    return spark.read.schema(schema).options(**options).csv(path)


def load_splits(
    spark: SparkSession, train: str, validation: str, required: list[str], schema: str | None = None
) -> DataFrame:
    """Both splits in one DataFrame. A missing file or column raises.

    Reads parquet, or CSV when a schema is given.
    """
    read = (lambda p: read_csv(spark, p, schema)) if schema else spark.read.parquet
    return require_columns(union_splits(train=read(train), validation=read(validation)), required)


def load_instructions(spark: SparkSession, path: str) -> DataFrame:
    """A local copy of an instruction dataset, parquet or JSON lines."""
    return spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """One JSON request per line, undecoded."""
    return spark.read.text(path)


def stream_requests(spark: SparkSession, folder: str, schema: str = "request_id long, value string") -> DataFrame:
    """Requests arriving as JSON files with an id and the undecoded request."""
    return spark.readStream.schema(schema).json(folder)


def stream_chunks(spark: SparkSession, folder: str, schema: str = CHUNK_SCHEMA) -> DataFrame:
    """Answer chunks arriving as JSON files."""
    return spark.readStream.schema(schema).json(folder)


def stream_books(spark: SparkSession, folder: str) -> DataFrame:
    """Whole line-structured books arriving as text files: ``path, text``."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    return files.load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
