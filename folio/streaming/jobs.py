"""Streams that run a batch operator on each micro-batch.

Each micro-batch writes to a place named after its number, so running one again after
a failure replaces its output instead of adding to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.constants import RETRIEVAL_K
from folio.functions.prompts import full_model_name
from folio.operators import parse, rag
from folio.operators.retrieve import TextIndex, index_text
from folio.session import delete_at_end, delete_now, noted, scratch
from folio.sinks import tables, text_index


def _each_batch(
    stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None
) -> StreamingQuery:
    def held(batch: DataFrame, number: int) -> None:
        batch.persist()  # the operators read it more than once
        try:
            with scratch(batch.sparkSession):
                step(batch, number)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(held).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def load_kb(
    books: DataFrame, root: str, checkpoint: str, titles: list[str] | None = None, every: str | None = None, keep: int | None = None
) -> StreamingQuery:
    """Upsert the pairs of arriving books (``path, text``) into the versions under ``root``.

    The version that is there when the stream first starts is written down beside the
    checkpoint; micro-batch ``n`` makes version ``n + 1`` after it, also when it is run
    again. Nothing else may write to ``root`` as long as the stream goes on. Without
    ``every`` the stream handles what is there and ends, else it goes on at that interval.
    With ``keep`` (2 or more, so that a micro-batch can be repeated) older versions go.
    """
    if keep is not None and keep < 2:
        raise ValueError("keep two versions at least")
    base = tables.base_version(books.sparkSession, root, f"{checkpoint}.base")

    def step(batch: DataFrame, number: int) -> None:
        rows = parse.accepted(parse.section_rows(parse.text_lines(batch, "text"), titles))
        tables.publish_upsert(batch.sparkSession, root, rows, ["path", "line_no"], version=base + number + 1)
        if keep:
            tables.prune_versions(batch.sparkSession, root, keep)

    return _each_batch(books, step, checkpoint, every)


def answer_requests(
    requests: DataFrame,
    models: DataFrame,
    kb: DataFrame,
    out: str,
    checkpoint: str,
    k: int = RETRIEVAL_K,
    id: str = "id",
    text: str = "text",
    analyzer: str = "word",
    every: str | None = None,
) -> StreamingQuery:
    """Write the prompts of arriving requests (``request_id, value``), one folder per micro-batch.

    The knowledge base is indexed once, before the first micro-batch. Without ``every``
    the stream handles what is there and ends, else it goes on at that interval.
    """
    index = index_text(kb, id=id, text=text, analyzer=analyzer)

    def step(batch: DataFrame, number: int) -> None:
        routed = rag.route_requests(rag.parse_requests(batch), models)
        prompts = rag.rag_prompt(routed, kb, k, id=id, text=text, index=index)
        prompts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _each_batch(requests, step, checkpoint, every)


def answer_from_index(
    requests: DataFrame,
    models: DataFrame,
    kb: DataFrame,
    index_root: str,
    out: str,
    checkpoint: str,
    k: int = RETRIEVAL_K,
    id: str = "id",
    text: str = "text",
    every: str | None = None,
) -> StreamingQuery:
    """Answer arriving requests (``request_id, value``) from a saved index that may grow meanwhile.

    Each micro-batch takes the newest version of the index and notes it in
    ``out/versions/batch=n``; run again, it takes the noted one, so that its output is the
    same. An index is made ready once for all micro-batches in a row that take it. Prompts go to ``out/prompts/batch=n``; requests that can't be answered go to
    ``out/rejects/batch=n`` as they came, with the reason. ``kb`` has the rows of the index.
    """

    ready: dict[int, TextIndex] = {}  # by version, the last one
    held: list[str] = []  # its tables

    def index_of(spark: SparkSession, version: int) -> TextIndex:
        if version not in ready:
            ready.clear()
            while held:
                delete_now(spark, held.pop())
            with noted(held):
                ready[version] = text_index.read_index(spark, index_root, version)
            for path in held:
                delete_at_end(spark, path)
        return ready[version]

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version = tables.base_version(spark, f"{index_root}/versions", f"{out}/versions/batch={number}")
        decoded = rag.decode_requests(batch).withColumn("model", full_model_name(F.col("model")))
        bad, good = decoded.filter("reject IS NOT NULL"), decoded.filter("reject IS NULL").drop("reject")
        unrouted = rag.route_rejects(good, models).withColumn("reject", F.lit("no such model"))
        both = bad.unionByName(unrouted).select(*batch.columns, "reject")
        both.write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")
        routed = rag.route_requests(good, models).drop("value")
        prompts = rag.rag_prompt(routed, kb, k, id=id, text=text, index=index_of(spark, version))
        prompts.write.mode("overwrite").parquet(f"{out}/prompts/batch={number}")

    return _each_batch(requests, step, checkpoint, every)


def write_answers(answers: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write every snapshot of ``assemble_stream``, one folder per micro-batch.

    Handles what is there and ends, or goes on at the interval ``every``.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = answers.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def drain(query: StreamingQuery) -> None:
    """Wait until all input that was there at the start has been handled."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()
