"""Answers out of ordered text chunks, and chat logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folio.constants import ANSWER_MARK
from folio.functions import prompts, text as X
from folio.operators.ordered import joined_text, scan_ordered


def piece(chunk: Column, marker: str) -> Column:
    """What a chunk adds once the answer has begun."""
    return F.when(F.contains(chunk, F.lit(marker)), X.piece_after(chunk, marker)).otherwise(chunk)


def answer_assemble(
    chunks: DataFrame, session: str, seq: str, chunk: str, marker: str = ANSWER_MARK
) -> DataFrame:
    """One answer per session; '' when the marker never comes in one chunk.

    The first marked chunk is found by a minimum, which combines before the shuffle,
    so no window walks through a long session and nothing before the marker is
    gathered.
    """
    marked = F.contains(F.col(chunk), F.lit(marker))
    first = chunks.groupBy(session).agg(F.min(F.when(marked, F.col(seq))).alias("_first"))
    begun = chunks.join(first.filter("_first IS NOT NULL"), session).filter(F.col(seq) >= F.col("_first"))
    pieces = begun.select(session, seq, piece(F.col(chunk), marker).alias("_piece"))
    answers = joined_text(pieces, [session], [seq], "_piece", "answer")
    return first.join(answers, session, "left").select(session, F.coalesce("answer", F.lit("")).alias("answer"))


def sse_frames(chunks: DataFrame, chunk: str) -> DataFrame:
    return chunks.withColumn("frame", prompts.sse_frame(F.col(chunk)))


def message_log(questions: DataFrame, answers: DataFrame, conv: str, at: str) -> DataFrame:
    """Both sides of each conversation, numbered in order of the whole number ``at``.

    At the same ``at`` the user's message comes first. No message is lost.
    """
    user = questions.select(conv, at, F.lit("user").alias("sender"), "text", (F.col(at) * 2).alias("_seq"))
    bot = answers.select(conv, at, F.lit("bot").alias("sender"), "text", (F.col(at) * 2 + 1).alias("_seq"))
    numbered = scan_ordered(
        user.unionByName(bot), [conv], "_seq", running_count={"position": F.lit(True)}
    )
    return numbered.withColumn("position", F.col("position") - 1).drop("_seq")
