"""Exact top-k by text that leaves out parts of the base which can't reach the k-th place.

Rows of like length are put into blocks of ``BLOCK_ROWS``. A block has its postings by
token and, for each token, the largest weight in it. A query's weights times those bound
the product with any row of the block. A first pass reads the bounds alone; the ``SEEDS``
blocks of highest bound are scored, and the k-th of their rows is a distance that the
answer can't exceed. In the second pass a block is scored for the queries whose bound
reaches that distance, and for no others. What is left out is no candidate, so the result
is that of ``near_text``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from folio.constants import RETRIEVAL_K
from folio.operators import retrieve
from folio.session import write_once

BLOCK_ROWS = 8
SEEDS = 32
MAX_PAIRS = 1_000_000  # products that a task works out at one time
SLACK = 10.0**-retrieve.DIGITS  # distances are rounded, bounds are not

_BLOCK = "block long, ids array<{id}>, tokens array<string>, tops array<double>, sizes array<int>, rows array<int>, weights array<double>"


@dataclass(frozen=True)
class BlockIndex:
    """An index whose rows are in blocks; written, so it serves many query batches."""

    blocks: DataFrame
    index: retrieve.TextIndex


@dataclass(frozen=True)
class Pruned:
    hits: DataFrame  # query, id, distance, rank
    work: DataFrame  # query, scored, postings: products that were worked out, and those of all rows


def block_index(index: retrieve.TextIndex) -> BlockIndex:
    """Sort an index's rows by length and cut them into blocks."""
    id_type = index.rows.schema["id"].dataType.simpleString()
    arrow_id = retrieve._arrow_type(id_type)
    norms = retrieve.RowNorms(index.hot, index.n)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in retrieve.token_slices(whole)):
            columns = [batch.column(c) for c in ("id", "tokens", "tfs")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(norms.of(batch))], names=["id", "tokens", "tfs", "norm"])

    measured = write_once(index.rows.mapInArrow(measure, f"id {id_type}, tokens array<string>, tfs array<int>, norm double"))
    # Rows of equal length are dealt by id, so that a length shared by many is no one task's.
    ordered = measured.filter("norm > 0").repartitionByRange("norm", "id").sortWithinPartitions("norm", "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held: list[pa.RecordBatch] = []

        def made(table: pa.Table) -> pa.RecordBatch:
            """Blocks of BLOCK_ROWS rows of ``table``, the last may be smaller."""
            nonlocal number
            lists = table["tokens"].combine_chunks()
            per_row = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(per_row)), per_row)
            coded = lists.flatten().dictionary_encode()
            code = coded.indices.to_numpy().astype(np.int64)
            weight = table["tfs"].combine_chunks().flatten().to_numpy() / table["norm"].to_numpy()[row]
            block, n_codes = row // BLOCK_ROWS, max(len(coded.dictionary), 1)
            order = np.lexsort((row, code, block))
            group = (block * n_codes + code)[order]
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            n_blocks = -(-len(per_row) // BLOCK_ROWS)
            tops = np.maximum.reduceat(weight[order], starts) if len(starts) else np.empty(0)
            of_block = group[starts] // n_codes
            by_block = np.concatenate([[0], np.cumsum(np.bincount(of_block, minlength=n_blocks))]).astype(np.int32)
            by_posting = np.concatenate([[0], np.cumsum(np.bincount(block, minlength=n_blocks))]).astype(np.int32)
            sizes = np.diff(np.append(starts, len(group))).astype(np.int32)
            ids = np.minimum(np.arange(n_blocks + 1) * BLOCK_ROWS, len(per_row)).astype(np.int32)

            def lists_of(offsets: np.ndarray, values: pa.Array) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(offsets), values)

            columns = [
                pa.array(number + np.arange(n_blocks)),
                lists_of(ids, table["id"].combine_chunks()),
                lists_of(by_block, coded.dictionary.take(pa.array(group[starts] % n_codes))),
                lists_of(by_block, pa.array(tops)),
                lists_of(by_block, pa.array(sizes)),
                lists_of(by_posting, pa.array((row[order] % BLOCK_ROWS).astype(np.int32))),
                lists_of(by_posting, pa.array(weight[order])),
            ]
            number += n_blocks
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "tokens", "tops", "sizes", "rows", "weights"])

        for batch in (piece for whole in batches for piece in retrieve.token_slices(whole)):
            held.append(batch)
            table = pa.Table.from_batches(held)
            whole = table.num_rows // BLOCK_ROWS * BLOCK_ROWS
            if whole:
                yield made(table.slice(0, whole))
            held = table.slice(whole).to_batches()
        if held:
            yield made(pa.Table.from_batches(held))

    return BlockIndex(write_once(ordered.mapInArrow(cut, _BLOCK.format(id=id_type))), index)


def _postings(batch: pa.RecordBatch, held: retrieve.QueryBlock) -> tuple[np.ndarray, ...]:
    """Of every asked posting in the batch: its block's place, token, row and weight."""
    lists = batch.column("tokens")
    codes = pc.fill_null(pc.index_in(lists.flatten(), value_set=held.tokens), -1).to_numpy()
    sizes = batch.column("sizes").flatten().to_numpy()
    at = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    some = np.repeat(codes >= 0, sizes)
    expanded = (np.repeat(v, sizes)[some] for v in (at, codes))
    return (*expanded, batch.column("rows").flatten().to_numpy()[some], batch.column("weights").flatten().to_numpy()[some])


def _few_products(batch: pa.RecordBatch, held: retrieve.QueryBlock, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most ``MAX_PAIRS`` products with the queries, one block at least."""
    per_query = np.append(np.diff(held.first), 0)  # none for a token that is not asked for
    for some in retrieve.token_slices(batch, most):
        lists = some.column("tokens")
        codes = pc.fill_null(pc.index_in(lists.flatten(), value_set=held.tokens), -1).to_numpy()
        at = np.repeat(np.arange(some.num_rows), np.diff(lists.offsets.to_numpy()))
        products = np.bincount(at, some.column("sizes").flatten().to_numpy() * per_query[codes], minlength=some.num_rows)
        for blocks in retrieve.runs_within(products, MAX_PAIRS):
            yield some.slice(blocks.start, blocks.stop - blocks.start)


def _scan_blocks(blocks: DataFrame, held: retrieve.QueryBlock, limit: np.ndarray, query_type: str, id_type: str, k: int) -> DataFrame:
    """The k best rows per query of each task, of blocks whose bound reaches ``limit``; and
    rows with null ids that hold the products worked out and asked for."""
    fields = [pa.field("query", retrieve._arrow_type(query_type)), pa.field("id", retrieve._arrow_type(id_type)), pa.field("distance", pa.float64()), pa.field("scored", pa.int64()), pa.field("postings", pa.int64())]
    per_query = np.diff(held.first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, n = None, len(held.names)
        scored, asked = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for whole in batches:
            for batch in _few_products(whole, held, max(1, retrieve.MAX_SCORE_CELLS // (n * BLOCK_ROWS))):
                bound = held.dots(batch.column("tokens"), batch.column("tops").flatten().to_numpy())
                reaches = (bound > 0) & (1.0 - bound <= limit[:, None] + SLACK)
                block, code, row, weight = _postings(batch, held)
                # A posting meets the queries that ask for its token.
                many = per_query[code]
                pair = np.repeat(np.arange(len(code)), many)
                place = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(held.first[code], many)
                q = held.q_of[place]
                asked += np.bincount(q, minlength=n)
                kept = reaches[q, block[pair]]
                q, pair, place = q[kept], pair[kept], place[kept]
                scored += np.bincount(q, minlength=n)
                cell = q * (batch.num_rows * BLOCK_ROWS) + block[pair] * BLOCK_ROWS + row[pair]
                dots = np.bincount(cell, held.w_of[place] * weight[pair], minlength=n * batch.num_rows * BLOCK_ROWS)
                ids = np.full(batch.num_rows * BLOCK_ROWS, None, dtype=object)
                lists = batch.column("ids")
                counts = np.diff(lists.offsets.to_numpy())
                there = np.repeat(np.arange(batch.num_rows) * BLOCK_ROWS - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                ids[there] = np.array(lists.flatten().to_pylist(), dtype=object)
                found = retrieve._best(retrieve._nearest(retrieve.as_distance(dots.reshape(n, -1)), ids, k), k)
                best = found if best is None else retrieve._best(pd.concat([best, found]), k)
        if best is not None:
            none = [None] * n
            names = held.names
            values = [[*[names[i] for i in best["q"]], *names], [*best["id"], *none], [*best["distance"], *none], [*[None] * len(best), *scored.tolist()], [*[None] * len(best), *asked.tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, fields)], schema=pa.schema(fields))

    schema = f"query {query_type}, id {id_type}, distance double, scored long, postings long"
    return blocks.mapInArrow(run, schema)


def near_text_pruned(
    queries: DataFrame, base: BlockIndex, k: int = RETRIEVAL_K, *, query: str = "query_id", question: str = "question", id: str = "id"
) -> Pruned:
    """``near_text`` over a block index, with the work that it took."""
    spark = queries.sparkSession
    asked = retrieve.ask(queries, base.index, query, question)
    id_type = base.index.rows.schema["id"].dataType.simpleString()
    parts = []
    for held in asked.blocks():
        bounds = base.blocks.select(F.col("block").alias("id"), "tokens", "tops")
        score = held.score(lambda batch: batch.column("tops").flatten().to_numpy())
        seeds = retrieve.top_k(retrieve._scan_top_k(bounds, score, asked.query_type, held.names, SEEDS), "query", ["distance", "id"], SEEDS)
        # At most SEEDS blocks of each of MAX_BLOCK_QUERIES queries.
        chosen = F.broadcast(seeds.select(F.col("id").alias("block")).distinct())
        none = np.full(len(held.names), np.inf)
        first = _scan_blocks(base.blocks.join(chosen, "block", "left_semi"), held, none, asked.query_type, id_type, k)
        reached = retrieve.top_k(first.filter("id IS NOT NULL"), "query", ["distance", "id"], k).filter(F.col("rank") == k).select("query", "distance").toArrow()
        limit = dict(zip(reached["query"].to_pylist(), reached["distance"].to_pylist()))
        limits = np.array([limit.get(name, np.inf) for name in held.names])
        parts.append(write_once(_scan_blocks(base.blocks, held, limits, asked.query_type, id_type, k)))
    if not parts:
        hits = spark.createDataFrame([], f"{query} {asked.query_type}, {id} {id_type}, distance double, rank int")
        return Pruned(hits, spark.createDataFrame([], f"{query} {asked.query_type}, scored long, postings long"))
    rows = retrieve._in_passes(parts)
    ranked = retrieve.top_k(rows.filter("id IS NOT NULL"), "query", ["distance", "id"], k)
    work = rows.filter("id IS NULL").groupBy(F.col("query").alias(query)).agg(F.sum("scored").alias("scored"), F.sum("postings").alias("postings"))
    return Pruned(ranked.select(F.col("query").alias(query), F.col("id").alias(id), "distance", "rank"), work)
