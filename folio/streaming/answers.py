"""Answers assembled while their chunks arrive."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folio.constants import ANSWER_MARK

SLICE = 256  # snapshots handed over at once
STATE = "answer string, begun boolean, pending binary"


def assemble_stream(
    chunks: DataFrame,
    session: str = "session_id",
    seq: str = "seq",
    chunk: str = "chunk",
    marker: str = ANSWER_MARK,
    idle_ms: int | None = None,
    *,
    every_chunk: bool = True,
    bounded: bool = False,
) -> DataFrame:
    """``(session, seq, answer)``: the answer so far, after each chunk.

    With ``every_chunk`` false there is one row per session and micro-batch, the last:
    n chunks then cost n rows' text once, not n growing copies.

    ``chunk`` is text, or UTF-8 bytes that may be cut inside a character; the bytes of
    an unfinished character wait in the state. Besides them the state holds one string
    and one flag per session. Chunks that arrive in one micro-batch
    are put in order; across micro-batches, order of arrival counts. A session ends
    with its ``is_last`` chunk, if the stream has that column, or after ``idle_ms``
    without a chunk. Waiting for that never ends, so such a stream needs a trigger
    that runs on a clock. A stream with neither keeps every session for ever; only one
    that is known to end may do that, and says so by ``bounded``.
    """
    key_type = chunks.schema[session].dataType.simpleString()
    seq_type = chunks.schema[seq].dataType.simpleString()
    is_bytes = chunks.schema[chunk].dataType.simpleString() == "binary"
    has_end = "is_last" in chunks.columns
    if not (has_end or idle_ms or bounded):
        raise ValueError("sessions never end: give the stream is_last, idle_ms or bounded=True")

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        answer, begun, pending = state.get if state.exists else ("", False, b"")
        decoder = codecs.getincrementaldecoder("utf-8")(errors="replace")
        decoder.setstate((bytes(pending), 0))
        parts = list(batches)
        arrived = parts[0] if len(parts) == 1 else pd.concat(parts)
        if not arrived[seq].is_monotonic_increasing:
            arrived = arrived.sort_values(seq, kind="stable")
        so_far, numbers = [], arrived[seq].to_numpy()
        for text in arrived[chunk].tolist():
            if is_bytes:
                text = decoder.decode(bytes(text))
            if marker in text:
                begun = True
                answer += text.split(marker)[1]
            elif begun:
                answer += text
            if every_chunk:
                so_far.append(answer)
        if has_end and arrived["is_last"].any():
            state.remove()
        else:
            state.update((answer, begun, decoder.getstate()[0]))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        if not every_chunk:
            so_far, numbers = [answer], numbers[-1:]
        for at in range(0, len(so_far), SLICE):  # copies grow, so few at a time
            part = slice(at, at + SLICE)
            yield pd.DataFrame({session: key[0], seq: numbers[part], "answer": so_far[part]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return chunks.groupBy(session).applyInPandasWithState(
        advance, f"{session} {key_type}, {seq} {seq_type}, answer string", STATE, "update", timeout
    )
