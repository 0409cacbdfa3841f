"""A packed training corpus from raw documents.

Each stage takes (spark, docs, sf_dir) and calls one operator. Its result is written as
Parquet and read again as the next stage's documents; all but the last keep the columns
of ``documents``, and ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folio.llm import decontaminate, jaccard, line_dedup, packing, quality
from folio.llm.queries import table, tokenizer_path
from folio.session import write_once


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the isolation forest rejects go."""
    return quality.keep_good(docs, quality.fit_rules(docs, table(spark, sf_dir, "labels")))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go; so do documents that consist of nothing else."""
    mark = "_deleted"
    while mark in docs.columns:
        mark += "_"
    done = line_dedup.delete_repeats(docs, deleted=mark)
    bare = F.btrim(F.col("text"), F.lit(line_dedup.SPACE)) == ""
    return _counted(done.filter((F.size(mark) == 0) | ~bare).drop(mark))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are little else go."""
    return _counted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences. Workers still hold memory of the stages before."""
    return packing.pack_documents(docs, tokenizer_path(), end_id=0, parts_kept=100_000).drop("ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

# A trained model and a tokenizer are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
