"""Token ids in ORC: run-length encoded integers, row indexes, Bloom filters on ids.

Documents are dealt out by ranges of ``doc_id`` and sorted, so part files follow each
other in that order, a file's row groups hold narrow ranges of ids, and a reader that
looks for some documents skips whole stripes by their statistics and Bloom filters.
Only text is shuffled; it is encoded where it is written.

Each row has its part's number and how many ids precede it in that part. The place of a
document among all ids follows from one total per part, so files are read by stripe, in
any order, without a sort.

Defined results: a null text is an empty one (just the end id); a null doc_id comes
first; rows that share a doc_id are kept, in any order between them; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folio.llm.encoding import kept_encoder
from folio.llm.texts import release, slices

STRIPE_BYTES = 64 << 20
SLICE_BYTES = 8 << 20  # text encoded at once
PARTS_KEPT = 300_000  # parts of texts whose ids a worker remembers
ROW_GROUP = 1_000  # rows under one index entry and Bloom filter
FILE_SCHEMA = "part int, doc_id long, first long, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id: str = "doc_id", text: str = "text") -> None:
    """Encode ``text``, append ``end_id`` to each document, and write ORC files to ``path``."""
    ordered = (
        docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
    )

    held = docs.sparkSession.sparkContext.broadcast({})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), 0
        for batch in batches:
            encoder = kept_encoder(held.value, tokenizer, PARTS_KEPT)
            at = 0
            for texts in slices(batch.column(1), SLICE_BYTES):
                ids, lengths = encoder.encode(texts, end_id)
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(texts), part, np.int32)),
                        batch.column(0).slice(at, len(texts)),
                        pa.array(so_far + ends - lengths),
                        pa.array(lengths),
                        pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), ids.view(np.int32)),
                    ],
                    names=["part", "doc_id", "first", "n_tokens", "ids"],
                )
                so_far += int(ends[-1])
                at += len(texts)
        release()

    (
        ordered.mapInArrow(encode, FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", ROW_GROUP)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows as written; a filter on ``doc_id`` reaches stripe statistics and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def part_starts(rows: DataFrame) -> DataFrame:
    """(part, base): ids before each part. One row per file, so small enough to broadcast."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("base"))


def token_digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of ``read_token_files``' rows."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            ids = np.asarray(lists.values).astype("<u4")
            ends = np.asarray(lists.offsets)
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())],
                names=["part", "doc_id", "first", "n_tokens", "n_read", "ids_crc32"],
            )

    read = rows.mapInArrow(digest, "part int, doc_id long, first long, n_tokens long, n_read long, ids_crc32 long")
    return read.join(F.broadcast(part_starts(rows)), "part").select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), F.col("n_read").alias("n_tokens"), "ids_crc32"
    )
