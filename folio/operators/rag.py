"""Requests to prompts: decode, route, retrieve, build context, render."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folio.constants import RETRIEVAL_K
from folio.functions import prompts, text as X
from folio.operators.ordered import joined_text
from folio.operators.retrieve import TextIndex, near_text
from folio.session import write_once

REQUEST_SCHEMA = "question string, model string, external_db boolean"


def parse_requests(raw: DataFrame, value: str = "value") -> DataFrame:
    """Decode JSON requests; ``external_db`` defaults to true.

    Works on batches and streams. What can't be asked is in ``request_rejects``.
    """
    keep = [c for c in raw.columns if c != value]
    return decode_requests(raw, value).filter("reject IS NULL").select(*keep, "question", "model", "external_db")


def request_rejects(raw: DataFrame, value: str = "value") -> DataFrame:
    """Requests that ``parse_requests`` leaves out: undecoded, with the reason in ``reject``."""
    return decode_requests(raw, value).filter("reject IS NOT NULL").select(*raw.columns, "reject")


def decode_requests(raw: DataFrame, value: str = "value") -> DataFrame:
    """``raw`` with ``question, model, external_db`` and ``reject``, NULL for a good request."""
    options = {"columnNameOfCorruptRecord": "_bad"}
    decoded = raw.withColumn("_r", F.from_json(F.col(value), f"{REQUEST_SCHEMA}, _bad string", options))
    question = F.col("_r.question")
    reject = (
        F.when(F.col(value).isNull() | F.col("_r").isNull() | (F.col("_r._bad").isNotNull() & question.isNull()), "malformed")
        .when(question.isNull(), "no question")
        .when(X.strip_form_field(question) == "", "blank question")
    )
    return decoded.select(
        *raw.columns, question.alias("question"), "_r.model", F.coalesce("_r.external_db", F.lit(True)).alias("external_db"), reject.alias("reject")
    )


def route_requests(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Requests whose model is registered and active, with its path."""
    return requests.join(_active(models), "model")


def route_rejects(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Requests for a model that is not available."""
    return requests.join(_active(models), "model", "left_anti")


def _active(models: DataFrame) -> DataFrame:
    # A registry has a few rows. Spark broadcasts it if its measured size allows,
    # and otherwise shuffles with skew handling, so no hint is given here.
    return models.filter("active").select("model", "path")


def rag_context(
    hits: DataFrame, kb: DataFrame, query: str = "request_id", id: str = "id"
) -> DataFrame:
    """One context text per request: its hits in rank order.

    ``hits`` holds at most k rows per request, so a group is never large. It is
    written down first: Spark then knows its size when it plans the join, and
    broadcasts it if it is small instead of shuffling the knowledge base.
    """
    lines = write_once(hits.select(query, "rank", id)).join(kb, id).select(
        query,
        "rank",
        prompts.context_line(*[F.col(c) for c in ("type", "medicine_a", "medicine_b", "dosage", "function")]).alias(
            "_line"
        ),
    )
    return joined_text(lines, [query], ["rank"], "_line", "context")


def rag_prompt(
    requests: DataFrame,
    kb: DataFrame,
    k: int = RETRIEVAL_K,
    *,
    query: str = "request_id",
    id: str = "id",
    text: str = "text",
    analyzer: str = "word",
    index: TextIndex | None = None,
) -> DataFrame:
    """Add ``prompt``: the question, with context where it is wanted and found.

    ``index`` is ``index_text(kb)``, if it has been made before.
    """
    wanted = requests.filter("external_db").select(query, "question")
    hits = near_text(wanted, index or kb, k, query=query, id=id, text=text, analyzer=analyzer)
    with_context = requests.join(rag_context(hits, kb, query, id), query, "left")
    return with_context.select(
        *requests.columns,
        prompts.answer_prompt(F.col("question"), F.coalesce("context", F.lit(""))).alias("prompt"),
    )
