"""Exact top-k retrieval by text or by vector.

The base is read where it lies: each task keeps its own k best rows per query, and
only those are shuffled to find the k best of all. The base is never joined to the
queries row by row, so a word or a label that fills a third of the base costs no more
than any other.

The query side is what tasks hold in memory, so its size is checked. A batch of
queries beyond ``MAX_QUERY_CELLS`` is answered in several passes over the base, each
within the bound; no query and no candidate is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from folio.constants import RETRIEVAL_K
from folio.plugins import Embed
from folio.session import write_once

# Postings (or vector components) of one query block: about 32 MB as numbers.
MAX_QUERY_CELLS = 4_000_000
MAX_BLOCK_QUERIES = 4_096
# Scores that a task holds at one time.
MAX_SCORE_CELLS = 4_000_000
# Tokens of rows that a task works on at one time, however many come in a batch.
MAX_TASK_POSTINGS = 1_000_000
HOT_TOKENS = 500_000
DIGITS = 9


# ---------------------------------------------------------------- shared top-k


def top_k(hits: DataFrame, query: str, order: list[str], k: int) -> DataFrame:
    """The k first rows per query. Spark cuts each task's rows to k before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(*order))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    return found.sort_values(["q", "distance", "id"], kind="stable").groupby("q").head(k)


def _nearest(distance: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """Cells of a (queries x rows) matrix that may be among the k best of their query.

    Everything up to the k-th smallest distance stays, ties included.
    """
    near = np.isfinite(distance)
    if distance.shape[1] > k:
        near &= distance <= np.partition(distance, k - 1, axis=1)[:, k - 1 : k]
    q, row = np.nonzero(near)
    return pd.DataFrame({"q": q, "id": ids[row], "distance": distance[q, row]})


def runs_within(cells: np.ndarray, limit: int, most: int | None = None) -> Iterator[slice]:
    """Runs of consecutive rows of at most ``limit`` cells and ``most`` rows, one row at least."""
    ends, at = np.cumsum(cells), 0
    while at < len(cells):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        if most is not None:
            stop = min(stop, at + most)
        yield slice(at, stop)
        at = stop


def token_slices(batch: pa.RecordBatch, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most ``MAX_TASK_POSTINGS`` tokens, one row at least."""
    for rows in runs_within(np.diff(batch.column("tokens").offsets.to_numpy()), MAX_TASK_POSTINGS, most):
        yield batch.slice(rows.start, rows.stop - rows.start)


def _scan_top_k(base: DataFrame, score: Callable, query_type: str, query_ids: list, k: int) -> DataFrame:
    """Rows ``(query, id, distance)``: the k best of each task.

    ``score`` turns rows of the base into a matrix of distances, queries x rows, with
    infinity where a row is no candidate.
    """
    id_type = base.schema["id"].dataType.simpleString()
    out_schema = f"query {query_type}, id {id_type}, distance double"
    fields = [("query", _arrow_type(query_type)), ("id", _arrow_type(id_type)), ("distance", pa.float64())]
    names = base.sparkSession.sparkContext.broadcast(query_ids)
    names_in = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        step = max(1, MAX_SCORE_CELLS // len(names.value))
        for batch in batches:
            whole = (batch.slice(at, step) for at in range(0, batch.num_rows, step))
            for rows in token_slices(batch, step) if "tokens" in names_in else whole:
                ids = np.array(rows.column("id").to_pylist(), dtype=object)
                found = _best(_nearest(score(rows), ids, k), k)
                best = found if best is None else _best(pd.concat([best, found]), k)
        if best is not None and len(best):
            values = ([names.value[i] for i in best["q"]], best["id"].tolist(), best["distance"].tolist())
            arrays = [pa.array(v, type=t) for v, (_, t) in zip(values, fields)]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))

    return base.mapInArrow(run, out_schema)


def _arrow_type(name: str) -> pa.DataType:
    known = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    if name not in known:
        raise TypeError(f"ids must be one of {sorted(known)}, not {name}")
    return known[name]


def _query_blocks(cells: DataFrame, query: str) -> list[Column]:
    """Conditions that deal the queries into blocks of about the bounds' size.

    ``cells`` has one row per query with its number of cells. Only totals come back. A
    block holds a whole query at least, so the largest query bounds it too.
    """
    n, total = cells.agg(F.count(F.lit(1)), F.sum("cells")).first()
    within = n <= MAX_BLOCK_QUERIES and (total or 0) <= MAX_QUERY_CELLS
    # Hashing deals unevenly, so blocks are planned half full.
    n_blocks = 1 if within else 2 * max(-(-n // MAX_BLOCK_QUERIES), -(-total // MAX_QUERY_CELLS))
    block = F.pmod(F.xxhash64(query), F.lit(n_blocks))
    return [block == i for i in range(n_blocks)] if n_blocks > 1 else [F.lit(True)]


def _require_ids(queries: DataFrame, query: str) -> None:
    n, ids = queries.agg(F.count(F.lit(1)), F.countDistinct(query)).first()
    if n != ids:
        raise ValueError(f"query ids must be unique and not null: {n} queries have {ids} ids")


def _in_passes(parts: list[DataFrame]) -> DataFrame:
    """One result of several passes; with many passes each is written down in turn."""
    if len(parts) > 1:
        parts = [write_once(p) for p in parts]
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- vectors


def near_vector(
    queries: DataFrame,
    base: DataFrame,
    k: int = RETRIEVAL_K,
    *,
    query: str = "query_id",
    query_vector: str = "vector",
    id: str = "id",
    vector: str = "vector",
    exclude_self: bool = False,
) -> DataFrame:
    """``(query, id, distance, rank)``: the k nearest base rows by cosine distance.

    Ids are unique on both sides. Distances are rounded to 9 digits; equal ones are
    ordered by id. Rows that ``vector_rejects`` names, with the length of the first
    query's vector, are no candidates and get no neighbours.
    """
    _require_ids(queries, query)
    query_type = queries.schema[query].dataType.simpleString()
    q = queries.select(F.col(query).alias("query"), F.col(query_vector).cast("array<double>").alias("v"))
    b = base.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    given = q.filter(_vector_fault(F.col("v"), None).isNull()).agg(F.min_by(F.size("v"), "query")).first()[0]
    q = q.filter(_vector_fault(F.col("v"), given).isNull())
    b = b.filter(_vector_fault(F.col("v"), given).isNull())
    cells = q.select("query", F.size("v").alias("cells"))
    parts = []
    for block in _query_blocks(cells, "query"):
        held = q.filter(block).toArrow()  # within MAX_QUERY_CELLS
        if not held.num_rows:
            continue
        names = held.column("query").to_pylist()
        matrix = _unit_rows(held.column("v"))
        parts.append(_scan_top_k(b, _dense_score(b, names, matrix, exclude_self), query_type, names, k))
    if not parts:
        return queries.sparkSession.createDataFrame(
            [], f"{query} {query_type}, {id} {base.schema[id].dataType.simpleString()}, distance double, rank int"
        )
    ranked = top_k(_in_passes(parts), "query", ["distance", "id"], k)
    return ranked.select(F.col("query").alias(query), F.col("id").alias(id), "distance", "rank")


def _vector_fault(v: Column, dims: int | None) -> Column:
    fault = F.when(v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x)), "missing value").when(
        ~F.exists(v, lambda x: x != 0), "zero vector"
    )
    return fault if dims is None else fault.when(F.size(v) != dims, "wrong length")


def vector_rejects(rows: DataFrame, vector: str, dims: int | None = None) -> DataFrame:
    """Rows whose vector can't be compared, with the reason in ``reject``."""
    marked = rows.withColumn("reject", _vector_fault(F.col(vector).cast("array<double>"), dims))
    return marked.filter("reject IS NOT NULL")


def _unit_rows(column: pa.ChunkedArray | pa.Array, dims: int | None = None) -> np.ndarray:
    """Rows of a list column as unit vectors; a zero vector becomes NaN and is no candidate."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = set(np.diff(column.offsets.to_numpy()).tolist())
    if len(sizes) > 1 or (dims is not None and sizes - {dims}):
        raise ValueError("vectors differ in length")
    rows = flat.reshape(len(column), -1)
    with np.errstate(invalid="ignore"):
        return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _dense_score(base: DataFrame, names: list, matrix: np.ndarray, exclude_self: bool) -> Callable:
    id_type = _arrow_type(base.schema["id"].dataType.simpleString())
    at = pa.array(names if exclude_self else [], id_type)
    shared = base.sparkSession.sparkContext.broadcast((matrix, at))

    def score(rows: pa.RecordBatch) -> np.ndarray:
        q_matrix, q_at = shared.value
        distance = np.round(1.0 - q_matrix @ _unit_rows(rows.column("v"), q_matrix.shape[1]).T, DIGITS)
        if len(q_at):
            at = pc.index_in(rows.column("id"), value_set=q_at)
            own = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            distance[at.fill_null(0).to_numpy()[own], own] = np.inf
        return distance

    return score


def embed(df: DataFrame, text: str, out: str, embedder: Embed) -> DataFrame:
    """Add the vector of a text, computed by a user's function on Arrow batches."""
    run = F.pandas_udf(lambda batch: embedder(batch), T.ArrayType(T.DoubleType()))
    return df.withColumn(out, run(F.col(text)))


# ---------------------------------------------------------------- text


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def letter_pairs(text: Column) -> Column:
    """Overlapping pairs of letters and digits, for scripts written without spaces."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?=([\p{L}\p{N}]{2}))"), F.lit(1))


ANALYZERS = {"word": words, "char2": letter_pairs}


def term_counts(df: DataFrame, id: str, tokens: Column) -> DataFrame:
    """``(id, tokens array<string>, tfs array<int>)``: distinct tokens and their counts.

    A row's tokens are sorted and cut where the value changes, inside the row, so
    nothing is shuffled.
    """
    ordered = df.select(F.col(id).alias("id"), F.sort_array(tokens).alias("s"))
    ends = ordered.withColumn(
        "e",
        F.when(
            F.size("s") > 0,
            F.filter(
                F.sequence(F.lit(1), F.size("s")),
                lambda i: (i == F.size("s")) | (F.get("s", i) != F.get("s", i - F.lit(1))),
            ),
        ).otherwise(F.array().cast("array<int>")),
    )
    return ends.select(
        "id",
        F.transform("e", lambda end: F.get("s", end - F.lit(1))).alias("tokens"),
        F.transform("e", lambda end, j: end - F.coalesce(F.get("e", j - F.lit(1)), F.lit(0))).alias("tfs"),
    )


def _postings(terms: DataFrame) -> DataFrame:
    """One row per ``(id, token, tf)``."""
    # explode() would add a filter on the array below, where the optimizer inlines it
    # and computes the whole array a second time, once per element.
    rows = terms.select("id", F.explode_outer(F.arrays_zip("tokens", "tfs")).alias("t"))
    return rows.select("id", F.col("t.tokens").alias("token"), F.col("t.tfs").alias("tf")).filter("token IS NOT NULL")


def _idf(n: int, df: Column) -> Column:
    return F.log(F.lit(float(1 + n)) / (F.lit(1.0) + df)) + F.lit(1.0)


@dataclass(frozen=True)
class TextIndex:
    """A base prepared for text retrieval; serves any number of query batches.

    A row's length in the vector space needs the document frequency of each of its
    tokens. Those of the most frequent tokens go to the tasks, which work the length out
    while they read the row; ``rest`` is what the other tokens add to its square.
    """

    rows: DataFrame  # id, tokens array<string>, tfs array<int>, rest double
    vocabulary: DataFrame  # token, df
    n: int
    analyzer: str
    hot: pa.Table  # token, df: at most HOT_TOKENS


def hot_tokens(vocabulary: DataFrame) -> tuple[DataFrame, pa.Table]:
    """The tokens of largest document frequency, as many as ``HOT_TOKENS`` allows; and the others."""
    # Bands of an eighth of a power of two: their number does not grow with the base.
    band = F.floor(F.log2(F.col("df").cast("double")) * 8)
    least, total = None, 0
    for row in vocabulary.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect():
        total += row["count"]
        if total > HOT_TOKENS:
            break
        least = row["band"]
    is_hot = F.lit(False) if least is None else band >= least
    return vocabulary.filter(~is_hot), vocabulary.filter(is_hot).select("token", F.col("df").cast("long").alias("df")).toArrow()


def make_index(terms: DataFrame, vocabulary: DataFrame, n: int, analyzer: str) -> TextIndex:
    """An index from written term counts ``(id, tokens, tfs)`` and a written vocabulary."""
    rare, hot = hot_tokens(vocabulary)
    if hot.num_rows == vocabulary.count():
        return TextIndex(terms.withColumn("rest", F.lit(0.0)), vocabulary, n, analyzer, hot)
    # The others are rare, so no key is frequent, and few of a row's tokens are shuffled.
    w = F.col("tf") * _idf(n, F.col("df"))
    known = hot.column("token").combine_chunks().cast(pa.string())
    shared = terms.sparkSession.sparkContext.broadcast(known)

    def rare_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in token_slices(whole)):
            lists = batch.column("tokens")
            tokens = lists.flatten()
            new = np.asarray(pc.is_null(pc.index_in(tokens, value_set=shared.value)), bool)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[new]
            columns = [batch.column("id").take(pa.array(row)), tokens.filter(pa.array(new)), batch.column("tfs").flatten().filter(pa.array(new))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "token", "tf"])

    id_type = terms.schema["id"].dataType.simpleString()
    met = terms.mapInArrow(rare_postings, f"id {id_type}, token string, tf int").join(rare, "token")
    rest = met.groupBy("id").agg(F.sum(w * w).alias("rest"))
    rows = terms.join(rest, "id", "left").withColumn("rest", F.coalesce("rest", F.lit(0.0)))
    return TextIndex(write_once(rows), vocabulary, n, analyzer, hot)


def token_frequencies(terms: DataFrame) -> DataFrame:
    """(token, df): in how many rows each token is. Counts combine before the shuffle."""
    only = terms.select(F.explode_outer("tokens").alias("token")).filter("token IS NOT NULL")
    return only.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def index_text(base: DataFrame, *, id: str = "id", text: str = "text", analyzer: str = "word") -> TextIndex:
    """Token counts of the base texts, cut into tokens once, and document frequencies."""
    terms = write_once(term_counts(base.select(id, text), id, ANALYZERS[analyzer](F.col(text))))
    return make_index(terms, write_once(token_frequencies(terms)), terms.count(), analyzer)


class RowNorms:
    """Lengths of rows, from the document frequencies of the frequent tokens and ``rest``."""

    def __init__(self, hot: pa.Table, n: int):
        self.tokens = hot.column("token").combine_chunks().cast(pa.string())
        self.idf = np.append(np.log((1 + n) / (1.0 + np.asarray(hot["df"], float))) + 1.0, 0.0)

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        lists = batch.column("tokens")
        sizes = np.diff(lists.offsets.to_numpy())
        place = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.tokens), -1).to_numpy()
        w = batch.column("tfs").flatten().to_numpy() * self.idf[place]
        row = np.repeat(np.arange(len(sizes)), sizes)
        return np.sqrt(np.bincount(row, w * w, minlength=len(sizes)) + batch.column("rest").to_numpy())


def near_text(
    queries: DataFrame,
    base: DataFrame | TextIndex,
    k: int = RETRIEVAL_K,
    *,
    query: str = "query_id",
    question: str = "question",
    id: str = "id",
    text: str = "text",
    analyzer: str = "word",
) -> DataFrame:
    """``(query, id, distance, rank)``: the k nearest base texts by TF-IDF cosine.

    Ids are unique on both sides. Distances are rounded to 9 digits; equal ones are
    ordered by id. Texts that share no token with the query are not returned. A base that is asked more than once is
    better passed as ``index_text(base)``.
    """
    index = base if isinstance(base, TextIndex) else index_text(base, id=id, text=text, analyzer=analyzer)
    asked = ask(queries, index, query, question)
    norms = RowNorms(index.hot, index.n)

    def weights(batch: pa.RecordBatch) -> np.ndarray:
        lists = batch.column("tokens")
        return batch.column("tfs").flatten().to_numpy() / np.repeat(norms.of(batch), np.diff(lists.offsets.to_numpy()))

    parts = [_scan_top_k(index.rows, held.score(weights), asked.query_type, held.names, k) for held in asked.blocks()]
    if not parts:
        id_type = index.rows.schema["id"].dataType.simpleString()
        return queries.sparkSession.createDataFrame(
            [], f"{query} {asked.query_type}, {id} {id_type}, distance double, rank int"
        )
    ranked = top_k(_in_passes(parts), "query", ["distance", "id"], k)
    return ranked.select(F.col("query").alias(query), F.col("id").alias(id), "distance", "rank")


@dataclass(frozen=True)
class Asked:
    """A batch of questions as weighted tokens, in blocks that a task can hold."""

    weights: DataFrame  # query, token, w, idf
    conditions: list[Column]
    query_type: str

    def blocks(self) -> Iterator[QueryBlock]:
        for condition in self.conditions:
            held = self.weights.filter(condition).toArrow()  # within MAX_QUERY_CELLS
            if held.num_rows:
                yield QueryBlock(held)


def ask(queries: DataFrame, index: TextIndex, query: str, question: str) -> Asked:
    _require_ids(queries, query)
    query_type = queries.schema[query].dataType.simpleString()
    tokens = ANALYZERS[index.analyzer](F.col(question))
    asked = write_once(_postings(term_counts(queries.select(query, question), query, tokens)))
    # Only the vocabulary's rows for asked tokens; they are no more than the asked ones.
    known = index.vocabulary.join(asked.select("token").distinct(), "token")
    idf = _idf(index.n, F.coalesce("df", F.lit(0)))
    weights = asked.join(known, "token", "left").select(
        F.col("id").alias("query"), "token", (F.col("tf") * idf).alias("w"), F.when(F.col("df").isNotNull(), idf).alias("idf")
    )
    cells = asked.groupBy(F.col("id").alias("query")).agg(F.count(F.lit(1)).alias("cells"))
    return Asked(weights, _query_blocks(cells, "query"), query_type)


class QueryBlock:
    """Questions of one block: names, and their postings by token."""

    def __init__(self, held: pa.Table):
        asked = held.to_pandas()
        asked["q"], names = pd.factorize(asked["query"])
        self.names = names.tolist()
        norm = np.sqrt(np.bincount(asked["q"], weights=asked["w"] ** 2, minlength=len(self.names)))
        asked["w"] /= norm[asked["q"]]
        asked = asked[asked["idf"].notna()]
        # Query postings by token: those of token c stand from first[c] to first[c + 1].
        code, known = pd.factorize(asked["token"])
        by_token = np.argsort(code, kind="stable")
        self.tokens = pa.array(list(known), pa.string())
        self.first = np.searchsorted(code[by_token], np.arange(len(known) + 1))
        self.q_of = asked["q"].to_numpy()[by_token]
        # The base's weight is tf * idf / norm; its idf is put on the query's side.
        self.w_of = (asked["w"] * asked["idf"]).to_numpy()[by_token]

    def dots(self, lists: pa.Array, weight: np.ndarray) -> np.ndarray:
        """Scalar products, queries x rows, with rows of tokens and their weights."""
        sizes = np.diff(lists.offsets.to_numpy())
        codes = pc.index_in(lists.flatten(), value_set=self.tokens)
        here = np.flatnonzero(codes.is_valid().to_numpy(zero_copy_only=False))
        codes = codes.fill_null(0).to_numpy()[here]
        row = np.repeat(np.arange(len(sizes)), sizes)[here]
        weight = weight[here]
        out = np.zeros((len(self.names), len(sizes)))
        order = np.argsort(codes, kind="stable")
        edges = np.flatnonzero(np.diff(codes[order], prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1], edges[1:]):  # one token at a time, all its rows at once
            mine, c = order[lo:hi], codes[order[lo]]
            span = slice(self.first[c], self.first[c + 1])
            out[np.ix_(self.q_of[span], row[mine])] += np.outer(self.w_of[span], weight[mine])
        return out

    def score(self, weights: Callable[[pa.RecordBatch], np.ndarray]) -> Callable[[pa.RecordBatch], np.ndarray]:
        def score(batch: pa.RecordBatch) -> np.ndarray:
            return as_distance(self.dots(batch.column("tokens"), weights(batch)))

        return score


def as_distance(dots: np.ndarray) -> np.ndarray:
    return np.where(dots > 0, np.round(1.0 - dots, DIGITS), np.inf)
