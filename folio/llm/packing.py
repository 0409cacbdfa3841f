"""Cost-balanced packing of documents into sequences of bounded length.

A document's ids are cut into full sequences; what remains is shorter than a sequence.
Remainders are packed in pools of bounded size. The cost of a piece of n ids is
estimated as ``n + n * n / capacity``: work per token, and attention within the piece.
A pool gets as many sequences as its ids need. Pieces go, longest first, to the sequence
of lowest cost that has room for them; when none has, the piece is cut to fill the
cheapest sequence with any room, so a pool wastes less than one sequence.

Each task packs its own documents as they stream by. Nothing is shuffled, and memory
holds one pool. A sequence's id is the task's partition number and a counter.

Defined results: a null text is an empty one (just the end id); rows that share a
doc_id are packed as separate documents; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from folio.llm.encoding import SLICE, Encoder
from folio.llm.texts import release, slices

PARTS_KEPT = 600_000  # parts of texts whose ids a task remembers
POOL_SEQUENCES = 1_024  # sequences filled from one pool of remainders
PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
)


def piece_cost(length: int, capacity: int) -> float:
    return length + length * length / capacity


def assign(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pack pieces of at most ``capacity`` ids: (piece, from, length, sequence, offset) of each cut."""
    n = -(-sum(lengths) // capacity)
    cost, room = np.zeros(n), np.full(n, capacity)  # a full sequence costs infinity
    out = []
    for piece in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
        start, left = 0, lengths[piece]
        while left:
            seq = int(np.where(room >= left, cost, np.inf).argmin())
            if room[seq] < left:
                seq = int(cost.argmin())
            free = int(room[seq])
            take = min(left, free)
            out.append((piece, start, take, seq, capacity - free))
            room[seq] = free - take
            cost[seq] = cost[seq] + piece_cost(take, capacity) if take < free else np.inf
            start, left = start + take, left - take
    return out


class _Packer:
    """The pieces of one task."""

    def __init__(self, capacity: int, base: int, keep_ids: bool):
        self.capacity, self.next_sequence, self.keep_ids = capacity, base, keep_ids
        self.rows: list[tuple] = []
        self.pool: list[tuple] = []
        self.pooled = 0

    def _piece(self, doc_id, ids: np.ndarray, start: int, doc_tokens: int, sequence: int, offset: int) -> None:
        kept = ids.astype(np.int32).tolist() if self.keep_ids else None
        self.rows.append((doc_id, start, len(ids), zlib.crc32(ids), doc_tokens, sequence, offset, kept))

    def add(self, doc_id, ids: np.ndarray) -> None:
        full = len(ids) // self.capacity * self.capacity
        for start in range(0, full, self.capacity):
            self._piece(doc_id, ids[start : start + self.capacity], start, len(ids), self.next_sequence, 0)
            self.next_sequence += 1
        if full < len(ids):
            self.pool.append((doc_id, ids[full:].copy(), full, len(ids)))
            self.pooled += len(ids) - full
            if self.pooled >= POOL_SEQUENCES * self.capacity:
                self.flush()

    def flush(self) -> None:
        for piece, at, length, seq, offset in assign([len(p[1]) for p in self.pool], self.capacity):
            doc_id, ids, start, doc_tokens = self.pool[piece]
            self._piece(doc_id, ids[at : at + length], start + at, doc_tokens, self.next_sequence + seq, offset)
        self.next_sequence += -(-self.pooled // self.capacity)
        self.pool, self.pooled = [], 0

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 8
        self.rows = []
        return pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int64()) for c in columns[:7]], pa.array(columns[7], pa.list_(pa.int32()))],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
        )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = 1_024,
    id: str = "doc_id",
    text: str = "text",
    keep_ids: bool = False,
    parts_kept: int = PARTS_KEPT,
) -> DataFrame:
    """One row per piece; ``keep_ids`` adds its ids, else the column ``ids`` is null. A smaller
    ``parts_kept`` takes less memory and more time; the result is the same."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(capacity, TaskContext.get().partitionId() << 32, keep_ids)
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(tokenizer, parts_kept)
            doc_ids, at = batch.column(0).to_pylist(), 0
            for texts in slices(batch.column(1), SLICE):
                ids, lengths = encoder.encode(texts, end_id)
                ends = np.cumsum(lengths)
                for k, (a, b) in enumerate(zip(ends - lengths, ends)):
                    packer.add(doc_ids[at + k], ids[a:b])
                at += len(texts)
                yield packer.batch()
        packer.flush()
        yield packer.batch()
        del encoder, packer
        release()

    chosen = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(pack, PIECE_SCHEMA)
