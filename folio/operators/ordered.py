"""Ordered scans over long groups, and global row numbers.

A file or a session may hold a large part of all rows, so no window here spans a
long group. Its rows are sorted and numbered once, written down, and cut into blocks of at
most ``BLOCK_ROWS`` by that number, however far apart their sequence numbers are. Each
block is scanned on its own, and what earlier blocks hand on is worked out from one
summary row per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from folio.session import write_once

BLOCK_ROWS = 1 << 18


def scan_ordered(
    rows: DataFrame,
    group: list[str],
    seq: str,
    *,
    latest: dict[str, Column] | None = None,
    running_count: dict[str, Column] | None = None,
    first_seq: dict[str, Column] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add columns that depend on the earlier rows of the group.

    ``latest``: the newest non-null value of the expression, this row included.
    ``running_count``: how many rows so far fulfil the condition, this row included.
    ``first_seq``: the sequence number of the group's first row that fulfils it.
    ``(group, seq)`` must be unique.

    Groups of at most ``block_rows`` rows are dealt out whole and scanned as they are, in one
    shuffle, after which rows of a group are still together. Only longer ones are cut.
    """
    latest, running_count, first_seq = latest or {}, running_count or {}, first_seq or {}
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    long = sizes.filter(F.col("_n") > block_rows).select(*[F.col(g).alias(f"_{k}") for k, g in enumerate(group)]).collect()
    if not long:  # at most one group for each ``block_rows`` rows
        return _scan_whole(rows, group, seq, latest, running_count, first_seq)
    types = T.StructType([T.StructField(f"_{k}", rows.schema[g].dataType) for k, g in enumerate(group)])
    listed = F.broadcast(rows.sparkSession.createDataFrame(long, types))
    is_long = F.lit(True)
    for k, g in enumerate(group):
        is_long = is_long & rows[g].eqNullSafe(listed[f"_{k}"])
    whole = _scan_whole(rows.join(listed, is_long, "left_anti"), group, seq, latest, running_count, first_seq)
    cut = _scan_blocks(rows.join(listed, is_long, "left_semi"), group, seq, latest, running_count, first_seq, block_rows)
    return whole.unionByName(cut)


def _scan_whole(rows: DataFrame, group: list[str], seq: str, latest: dict, running_count: dict, first_seq: dict) -> DataFrame:
    so_far = Window.partitionBy(*group).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    all_rows = so_far.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = F.lit(True)  # a group without a name has no first row
    for g in group:
        named = named & F.col(g).isNotNull()
    return rows.select(
        "*",
        *[F.last(e, ignorenulls=True).over(so_far).alias(n) for n, e in latest.items()],
        *[F.sum(F.when(e, 1).otherwise(0)).over(so_far).alias(n) for n, e in running_count.items()],
        *[F.when(named, F.min(F.when(e, F.col(seq))).over(all_rows)).alias(n) for n, e in first_seq.items()],
    )


def _scan_blocks(
    rows: DataFrame, group: list[str], seq: str, latest: dict, running_count: dict, first_seq: dict, block_rows: int
) -> DataFrame:
    keys = [*group, "_block"]
    blocked = _in_blocks(rows, group, seq, block_rows)

    so_far = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.select(
        "*",
        *[F.last(e, ignorenulls=True).over(so_far).alias(n) for n, e in latest.items()],
        *[F.sum(F.when(e, 1).otherwise(0)).over(so_far).alias(n) for n, e in running_count.items()],
    )

    summaries = [
        *[F.max_by(e, F.when(e.isNotNull(), F.col(seq))).alias(f"_{n}") for n, e in latest.items()],
        *[F.sum(F.when(e, 1).otherwise(0)).alias(f"_{n}") for n, e in running_count.items()],
        *[F.min(F.when(e, F.col(seq))).alias(f"_{n}") for n, e in first_seq.items()],
    ]
    blocks = blocked.groupBy(*keys).agg(*summaries)
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    handed_on = blocks.select(
        *keys,
        *[F.last(f"_{n}", ignorenulls=True).over(before).alias(f"_{n}") for n in latest],
        *[F.sum(f"_{n}").over(before).alias(f"_{n}") for n in running_count],
        *[F.min(f"_{n}").over(whole).alias(f"_{n}") for n in first_seq],
    )

    joined = local.join(handed_on, keys, "left")
    return joined.select(
        *rows.columns,
        *[F.coalesce(F.col(n), F.col(f"_{n}")).alias(n) for n in latest],
        *[(F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0))).alias(n) for n in running_count],
        *[F.col(f"_{n}").alias(n) for n in first_seq],
    )


def _in_blocks(rows: DataFrame, group: list[str], seq: str, block_rows: int) -> DataFrame:
    numbered = with_row_index(rows, [*group, seq], "_row")
    return numbered.withColumn("_block", F.floor(F.col("_row") / F.lit(block_rows))).drop("_row")


def cumulative_text(
    rows: DataFrame, group: list[str], seq: str, text: str, out: str, block_rows: int = 1024
) -> DataFrame:
    """Add the concatenation of ``text`` over this and all earlier rows of the group."""
    keys = [*group, "_block"]
    blocked = _in_blocks(rows, group, seq, block_rows)
    so_far = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumn(out, F.array_join(F.collect_list(text).over(so_far), ""))

    blocks = blocked.groupBy(*keys).agg(_joined(seq, text).alias("_text"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    handed_on = blocks.select(
        *keys, F.array_join(F.collect_list("_text").over(before), "").alias("_before")
    )
    return local.join(handed_on, keys, "left").select(
        *rows.columns, F.concat(F.coalesce("_before", F.lit("")), F.col(out)).alias(out)
    )


def _joined(seq: str, text: str) -> Column:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(text).alias("t"))))
    return F.array_join(F.transform(pairs, lambda p: p.t), "")


def joined_text(rows: DataFrame, group: list[str], order: list[str], text: str, out: str) -> DataFrame:
    """One row per group: ``text`` of all rows in order, without a separator."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return rows.groupBy(*group).agg(F.array_join(F.transform(pairs, lambda p: p["_text"]), "").alias(out))


def with_row_index(rows: DataFrame, order: list[str], out: str, start: int = 0) -> DataFrame:
    """Number all rows ``start, start+1, …`` in the given order.

    ``order`` must be unique, so that range partitioning spreads the rows evenly. The
    sorted rows are written down once with their place; after that each partition only
    needs the number of rows in the partitions before it.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = write_once(
        ordered.select(
            "*",
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"),
        )
    )
    # One row per partition: its size is the number of partitions, not of rows.
    sizes = sorted(fixed.groupBy("_part").count().collect())
    offsets, total = [], start
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    spark = rows.sparkSession
    offset_table = spark.createDataFrame(offsets, "_part int, _offset long")
    return fixed.join(F.broadcast(offset_table), "_part").select(
        *rows.columns, (F.col("_offset") + F.col("_at")).alias(out)
    )


def decode_chunks(rows: DataFrame, group: list[str], seq: str, chunk: str, out: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the text that each chunk of a group's UTF-8 bytes finishes, however the bytes are cut.

    Rows are sorted once and decoded by the task that sorted them, ``block_rows`` at most at a
    time: what a row leaves unfinished, three bytes at most, goes to the next one. The bytes
    that a task's first rows may owe to the task before it are noted, a few rows for each
    task, and put together afterwards. An empty chunk finishes nothing; bytes that never make
    a character stay without text, other faults raise. ``(group, seq)`` must be unique.
    """
    ordered = rows.filter(F.octet_length(chunk) > 0).repartitionByRange(*group, seq).sortWithinPartitions(*group, seq)
    columns = rows.columns
    border = "_kind int, _part int, _at long, _bytes binary"
    typed = T.StructType([*rows.schema, T.StructField(out, T.StringType()), *T._parse_datatype_string(border)])
    names = typed.names

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _ChunkDecoder(TaskContext.get().partitionId(), [columns.index(g) for g in group], columns.index(chunk), names)
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                yield task.decoded(batch.slice(at, block_rows))
        if task.last is not None:
            yield task.end()

    written = write_once(ordered.mapInArrow(decode, typed))
    met = written.filter("_kind > 0").select("_part", "_kind", "_at", F.struct(*group).alias("g"), "_bytes", F.octet_length(chunk).alias("n"))
    fixes = _finished_between(sorted(met.collect(), key=lambda r: r[:3]))  # a few rows per task
    own = written.filter("_kind < 2")
    if fixes:
        table = rows.sparkSession.createDataFrame(fixes, "_part int, _at long, _finished string")
        own = own.join(F.broadcast(table), ["_part", "_at"], "left")
        own = own.withColumn(out, F.concat(F.coalesce("_finished", F.lit("")), F.col(out)))
    empty = rows.filter(F.coalesce(F.octet_length(chunk), F.lit(0)) == 0).withColumn(out, F.lit(""))
    return own.select(*columns, out).unionByName(empty)


def _unfinished(data: np.ndarray, ends: np.ndarray, starts: np.ndarray | int) -> np.ndarray:
    """How many bytes before each end, and not before its start, begin a character that needs more."""

    def back(k: int) -> np.ndarray:
        return np.where(ends - k >= starts, data[np.maximum(ends - k, 0)], 0)

    one, two, three = back(1), back(2), back(3)
    goes_on, more = (one & 0xC0) == 0x80, (two & 0xC0) == 0x80
    return np.where((three >= 0xF0) & more & goes_on, 3, np.where((two >= 0xE0) & goes_on, 2, np.where(one >= 0xC0, 1, 0)))


def _changes(before: pa.Array, values: pa.Array) -> np.ndarray:
    """Which values differ from the one before them; nulls are alike, and so are NaNs."""
    both = pa.concat_arrays([before, values])
    if pa.types.is_nested(both.type):
        plain = both.to_pylist()
        return np.array([a != b for a, b in zip(plain, plain[1:])])
    a, b = both[:-1], both[1:]
    differ = np.asarray(pc.fill_null(pc.not_equal(a, b), False)) | np.asarray(pc.xor(pc.is_null(a), pc.is_null(b)))
    if pa.types.is_floating(both.type):
        differ &= ~np.asarray(pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return differ


class _ChunkDecoder:
    """The sorted rows of one task, in turn. Rows get ``_kind`` 1 if they begin with bytes that
    may go on with a character of the task before; a row of kind 2 tells what is left at the end."""

    def __init__(self, part: int, group: list[int], chunk: int, names: list[str]):
        self.part, self.group, self.chunk, self.names = part, group, chunk, names
        self.last: pa.RecordBatch | None = None  # the row before
        self.left, self.at = b"", 0  # unfinished bytes; rows so far
        self.head = 3  # how many more bytes may go on with an earlier character
        self.only_head = True

    def decoded(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        column = batch.column(self.chunk).cast(pa.large_binary())
        _, offsets, data = column.buffers()
        places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
        body = np.frombuffer(data, np.uint8)[places[0] : places[-1]]
        held = len(self.left)
        data = np.concatenate([np.frombuffer(self.left, np.uint8), body])
        bounds = places - places[0] + held
        starts, ends = bounds[:-1], bounds[1:]
        new = np.zeros(n, bool)
        for g in self.group:
            values = batch.column(g)
            new |= _changes(values[:1] if self.last is None else self.last.column(g), values)
        group_start = np.maximum.accumulate(np.where(new, starts, 0))
        stops = ends - _unfinished(data, ends, group_start)  # where each row's text ends
        begins = np.where(new, starts, np.concatenate([[0], stops[:-1]]))

        first = np.zeros(n, np.int64)  # bytes of each row that may belong to the task before
        if self.head:
            own = np.flatnonzero(new)
            upto = int(starts[own[0]]) if len(own) else len(data)
            ahead = data[: min(self.head, upto)] if not held else data[:0]
            other = np.flatnonzero((ahead & 0xC0) != 0x80)
            n_head = int(other[0]) if len(other) else len(ahead)
            first = np.clip(n_head - starts, 0, ends - starts)
            self.only_head = self.only_head and n_head == len(data)
            self.head = self.head - n_head if self.only_head else 0
        elif n:
            self.only_head = False
        kept = np.ones(len(data), bool)
        kept[: int(first.sum())] = False
        for row in np.flatnonzero(new):  # what the group before leaves has no text
            kept[(stops[row - 1] if row else 0) : starts[row]] = False
        count = np.concatenate([[0], np.cumsum(kept)])
        sizes = count[stops] - count[begins]
        kept[stops[-1] :] = False
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)])), pa.py_buffer(data[kept].tobytes())])
        noted = (first > 0) | (self.at + np.arange(n) == 0)
        ats = self.at + np.arange(n)
        n_noted = int(noted.sum())  # they come first
        heads = [data[s : s + f].tobytes() for s, f in zip(starts[:n_noted], first)] + [None] * (n - n_noted)
        columns = [
            *batch.columns,
            texts.cast(pa.large_string()).cast(pa.string()),
            pa.array(noted.astype(np.int32)),
            pa.array(np.full(n, self.part, np.int32), mask=~noted),
            pa.array(ats, mask=~noted),
            pa.array(heads, pa.binary()),
        ]
        self.left, self.at, self.last = data[stops[-1] :].tobytes(), self.at + n, batch.slice(n - 1, 1)
        return pa.RecordBatch.from_arrays(columns, names=self.names)

    def end(self) -> pa.RecordBatch:
        values = [[2], [self.part], [self.at], [None if self.only_head else self.left]]
        columns = [pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))]
        return pa.RecordBatch.from_arrays([*self.last.columns, pa.nulls(1, pa.string()), *columns], names=self.names)


def _finished_between(met: list) -> list[tuple[int, int, str]]:
    """(task, row, text) of the characters that one task begins and a later one finishes."""
    fixes, group, pending = [], None, b""
    for r in met:
        own = tuple("NaN" if v != v else v for v in r.g)
        if r._kind == 1:
            if own != group:
                group, pending = own, b""
            pending += bytes(r._bytes)
            data = np.frombuffer(pending, np.uint8)
            whole = len(data) - (int(_unfinished(data, np.array([len(data)]), 0)[0]) if len(data) else 0)
            if whole:
                fixes.append((r._part, r._at, pending[:whole].decode()))
            pending = pending[whole:]
            if r.n > len(r._bytes):
                pending.decode()  # raises if the row goes on with something else
        elif r._bytes is not None:  # a task whose rows all go on with a character hands on what it was given
            group, pending = own, bytes(r._bytes)
    return fixes
