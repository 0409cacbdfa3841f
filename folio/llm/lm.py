"""Language-model scores of texts: a unigram base over words, and a trained attention model.

Base: texts are lower-cased (A-Z) words between ASCII white space and an end token; the
counts are those of all training texts, plus one. Words of large counts, ``HOT_WORDS`` at
most, are broadcast and scored where the text is read; every other word is rare, and is
shuffled to its count, one row for each text that has it.

Model: texts are ids of a byte-level vocabulary and an end id; ``attention`` has the
network and its windows. It is learned by the tasks from every training text: first sums
that give classes of ids, then gradient descent. Each text is in one of ``ROUNDS`` rounds (by
hash), after which the changes of the tasks, each of which trained on its own rows, are
averaged; rounds also count which id follows which kind of id. An id's share of its class
depends on the kind of the id before it. Sums go through two shuffles, so that the driver
gets a handful of arrays of a fixed size, whatever the number of tasks. Texts are encoded
once, to be learned from and scored.

Defined results: a null or empty text has just its end; a null id is not learned from;
rows that share an id are scored one by one, equal texts alike up to single precision;
without training texts every id is as likely as any other, and a word's base is that of an unknown one among
none; an empty table gives no rows; other columns, also ones with the names used here,
are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from folio.llm import attention
from folio.llm.encoding import kept_encoder
from folio.llm.texts import distinct, release, slices, split_words
from folio.session import arrow_batches, write_once

SHARE = 1  # the network learns from one training text in so many: from all
ROUNDS = 2
HOT_WORDS = 400_000
HOT_BYTES = 64  # of a word that is broadcast, at most
END = ""  # stands for the end token among words, which are never empty
PARTS_KEPT = 250_000  # parts of texts whose ids a task remembers
SLICE = 3 << 20
BATCH_ROWS = 2_000  # texts handed to a task at a time, at most; Spark's own 10,000 take tens of MB on both sides
CHUNK = 1 << 18  # ids that a task learns from at a time; a longer text alone
SPREAD = (64, 4)  # parts into which sums are dealt, one shuffle after another


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[pa.Array]:
    return slices(batch.column(column), SLICE)


# ---------------------------------------------------------------- words


def text_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return split_words(pc.ascii_lower(texts))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in _texts(batch, 0):
            counts = text_words(texts)[0].value_counts()
            words, n = counts.field("values").cast(pa.string()), counts.field("counts")
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([END])]), pa.concat_arrays([n, pa.array([len(texts)])])], names=["word", "n"])
    release()


def word_counts(training: DataFrame) -> DataFrame:
    """(word, n) over all training texts; the end token is the empty word. Written once."""
    counted = training.select("text").mapInArrow(_count_words, "word string, n long")
    with arrow_batches(training.sparkSession, BATCH_ROWS):
        return write_once(counted.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"))


def _band(n):
    """Counts by size, in eighths of powers of two: a number of bands that does not grow with the corpus."""
    return F.floor(F.log2(n.cast("double")) * 8).cast("int")


def hot_words(counts: DataFrame) -> pa.Table:
    """(word, n) of the words of largest counts: whole bands, ``HOT_WORDS`` at most, none longer than ``HOT_BYTES``."""
    short = counts.filter((F.octet_length("word") <= HOT_BYTES) & (F.col("word") != END))
    least, total = None, 0
    for band, words in short.groupBy(_band(F.col("n")).alias("band")).count().orderBy(F.desc("band")).collect():
        total += words
        if total > HOT_WORDS:
            break
        least = band
    return short.filter(F.lit(False) if least is None else _band(F.col("n")) >= least).toArrow()


class WordTable:
    """Broadcast words with their log10 probabilities."""

    def __init__(self, words: pa.Array, logs: np.ndarray):
        self.words, self.logs = words.cast(pa.large_string()), np.append(logs, 0.0)

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each word (large strings): whether it is here; its log10 probability, or 0."""
        place = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.words), -1))
        return place >= 0, self.logs[place]


# ---------------------------------------------------------------- sums of arrays over tasks


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per name: arrays with rows at given places, added up."""
    sums: dict[str, np.ndarray] = {}
    part = 0
    for batch in batches:
        for at in range(batch.num_rows):  # one array at a time
            row = batch.slice(at, 1).to_pylist()[0]
            part = row["part"]
            if row["name"] not in sums:
                sums[row["name"]] = np.zeros((row["rows"], row["columns"]), row["kind"])
            sums[row["name"]][np.frombuffer(row["places"], np.int32)] += np.frombuffer(row["data"], row["kind"]).reshape(-1, row["columns"])
    for name, total in sums.items():
        yield _array_row(part, name, total)


def _array_row(part: int, name: str, values: np.ndarray) -> pa.RecordBatch:
    places = np.flatnonzero(values.any(axis=1)).astype(np.int32)  # just these rows are sent
    data = [part, name, *values.shape, values.dtype.str, places.tobytes(), values[places].tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(data, _ARRAY_TYPES)], names=_ARRAY_NAMES)


_ARRAY_NAMES = ["part", "name", "rows", "columns", "kind", "places", "data"]
_ARRAY_TYPES = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
_ARRAY_SCHEMA = "part int, name string, rows int, columns int, kind string, places binary, data binary"


def add_up(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The sums, over all tasks, of the two-dimensional arrays that ``work`` gives for its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what an encoder held
        part = TaskContext.get().partitionId()
        for name, values in work(batches).items():
            if values.any():
                yield _array_row(part, name, values)
        release()

    arrays = rows.mapInArrow(run, _ARRAY_SCHEMA)
    for parts in SPREAD:
        dealt = arrays.withColumn("part", F.pmod("part", F.lit(parts))).repartition(parts, "part", "name")
        arrays = dealt.mapInArrow(_add, _ARRAY_SCHEMA)
    total: dict[str, np.ndarray] = {}
    with arrow_batches(rows.sparkSession, BATCH_ROWS):
        summed = arrays.collect()
    for row in summed:  # a few arrays of fixed size from each of the last parts
        if row["name"] not in total:
            total[row["name"]] = np.zeros((row["rows"], row["columns"]), row["kind"])
        total[row["name"]][np.frombuffer(row["places"], np.int32)] += np.frombuffer(row["data"], row["kind"]).reshape(-1, row["columns"])
    return total


# ---------------------------------------------------------------- the model


@dataclass(frozen=True)
class LanguageModel:
    scorer: attention.Scorer
    end_id: int
    id_kind: np.dtype  # of written ids
    tokenizer: str
    counts: DataFrame  # word, n
    hot: WordTable
    train_tokens: int
    words: int  # distinct ones
    end_count: int

    def log10(self, count: float) -> float:
        return float(np.log10((count + 1) / (self.train_tokens + self.words + 1)))


def _id_count(tokenizer: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return 1 + max(end_id, *Tokenizer.from_file(tokenizer).get_vocab().values())


def id_type(n_ids: int) -> np.dtype:
    """How an id is written: in two bytes, or in four if these don't hold all ids."""
    return np.dtype("<u2" if n_ids <= 1 << 16 else "<u4")


def encode_texts(docs: DataFrame, tokenizer: str, end_id: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, ids): every row with its ids (``id_type``, one after the other), the end id last. Written once."""
    read = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    names, kind = ["id", "text", "ids"], id_type(_id_count(tokenizer, end_id))
    held = docs.sparkSession.sparkContext.broadcast({})  # filled in each worker

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_encoder(held.value, tokenizer, PARTS_KEPT, often=True)
        for batch in batches:
            at = 0
            for texts in _texts(batch, 1):
                n = len(texts)
                ids, lengths = encoder.encode(texts, end_id)
                offsets = (np.concatenate([[0], np.cumsum(lengths)]) * kind.itemsize).astype(np.int32)
                written = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), written], names=names)
                at += n
        release()

    schema = f"id {docs.schema[id].dataType.simpleString()}, text string, ids binary"
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        encoded = write_once(read.mapInArrow(encode, schema)).withColumnsRenamed({"id": id, "text": text})
    held.unpersist()
    return encoded


def _ids_of(written: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows in a row, as they are written; the number of ids of each row."""
    written = written.cast(pa.large_binary())
    _, offsets, data = written.buffers()
    ends = np.frombuffer(offsets, np.int64)[written.offset : written.offset + len(written) + 1]
    body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
    return body.view(kind), np.diff(ends) // kind.itemsize


def _read_ids(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of whole texts and the number of ids of each, about ``CHUNK`` ids at a time."""
    held, n = [], 0
    for batch in batches:
        ids, sizes = _ids_of(batch.column(0), kind)
        ends = np.cumsum(sizes)
        for rows in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(ends // CHUNK)) + 1):
            if len(rows):
                some = ids[ends[rows[0]] - sizes[rows[0]] : ends[rows[-1]]]
                held.append((some.astype(np.int64), sizes[rows]))
                n += len(some)
            if n >= CHUNK:
                yield tuple(np.concatenate(c) for c in zip(*held))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def train_network(training: DataFrame, end_id: int, n_ids: int) -> attention.Scorer:
    """Learn from ``training`` (ids, round): sums for the classes, then rounds of descent."""
    kind = id_type(n_ids)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        codes, sums = attention.neighbour_codes(n_ids), np.zeros((n_ids, 1 + 2 * attention.CODES))
        for ids, lengths in _read_ids(batches, kind):
            sums += attention.neighbour_sums(ids, attention.inputs_of(ids, lengths, end_id), codes)
        return {"sums": sums}

    ids_of = training.select("ids")
    classes = attention.IdClasses(add_up(ids_of, neighbours).get("sums", np.zeros((n_ids, 1 + 2 * attention.CODES))))
    net, follow = attention.Network.first(classes.points), None
    for number in range(ROUNDS):

        def descend(batches: Iterator[pa.RecordBatch], before=net, number=number) -> dict[str, np.ndarray]:
            now = before.copy()
            trainer = attention.Trainer(now, classes.class_of, attention.RATE / 2**number, TaskContext.get().partitionId())
            met = np.zeros((n_ids, attention.KINDS), np.uint32)
            for ids, lengths in _read_ids(batches, kind):
                inputs = attention.inputs_of(ids, lengths, end_id)
                classes.count_follows(met, ids, inputs)
                trainer.learn(ids, inputs, lengths)
            if not trainer.steps:
                return {}
            out = {f"dense{k}": (a - b).reshape(len(a), -1) for k, (a, b) in enumerate(zip(now.dense(), before.dense()))}
            out |= {"rows": now.embedding - before.embedding, "touched": trainer.touched[:, None].astype(float), "tasks": np.ones((1, 1))}
            return out | {"follow": met.reshape(-1, 1)}  # few of its numbers are not 0

        sums = add_up(training.filter(F.col("round") == number).select("ids"), descend)
        if not sums:
            continue
        net = net.moved(sums)
        met = sums["follow"].reshape(n_ids, attention.KINDS)
        follow = met if follow is None else follow + met
    return attention.Scorer(net, classes, follow)


def fit_lm(training: DataFrame, tokenizer: str, end_id: int, id: str = "doc_id", text: str = "text", ids: str | None = None) -> LanguageModel:
    """Learn words and network from the rows of ``training``; ``ids`` names the column of ``encode_texts``, if it is there."""
    if ids is None:
        training, ids = encode_texts(training, tokenizer, end_id, id, text), "ids"
    read = training.select(F.col(id).cast("string").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(ids).alias("ids"))
    counts = word_counts(read)
    total, words, ends = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == END, F.col("n")))).first()
    total, words, ends = total or 0, words or 0, ends or 0
    hot = hot_words(counts)
    logs = np.log10((np.asarray(hot["n"], float) + 1) / (total + words + 1))
    n_ids = _id_count(tokenizer, end_id)
    learned = read if SHARE == 1 else read.filter(F.pmod(F.xxhash64("id", "text"), F.lit(SHARE)) == 0)
    dealt = learned.select("ids", F.pmod(F.xxhash64("text", "id"), F.lit(ROUNDS)).alias("round"))
    scorer = train_network(dealt, end_id, n_ids)
    return LanguageModel(scorer, end_id, id_type(n_ids), tokenizer, counts, WordTable(hot["word"].combine_chunks(), logs), total, words, ends)


# ---------------------------------------------------------------- scores


def score_texts(docs: DataFrame, model: LanguageModel, id: str = "doc_id", text: str = "text", ids: str | None = None) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``;
    ``ids`` names the column of ``encode_texts``, if it is there."""
    if ids is None:
        docs, ids = encode_texts(docs, model.tokenizer, model.end_id, id, text), "ids"
    end_id, id_kind = model.end_id, model.id_kind
    # Sent on its own: a worker holds it once, for all its tasks, and not beside its pickled form.
    sent = docs.sparkSession.sparkContext.broadcast((model.scorer, model.hot))
    end_log, end_known = model.log10(model.end_count), int(model.end_count > 0)
    names = ["key", "id", "n_tokens", "n_known", "base", "score", "word", "times"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        scorer, hot = sent.value
        for batch in batches:
            at = 0
            for texts in _texts(batch, 1):
                n = len(texts)
                ids, lengths = _ids_of(batch.column(2).slice(at, n), id_kind)
                logs = scorer.id_scores(ids.astype(np.int64), lengths, end_id)
                ends = np.cumsum(lengths)
                words, offsets = text_words(texts)
                codes, values = distinct(words)
                here, value_logs = hot.find(values)
                of_text = np.repeat(np.arange(n), np.diff(offsets))
                base = end_log + np.bincount(of_text, value_logs[codes], minlength=n)
                known = end_known + np.bincount(of_text, here[codes], minlength=n)
                keys = key + at + np.arange(n)
                rare = ~here[codes]
                pairs, times = np.unique(of_text[rare] * max(len(values), 1) + codes[rare], return_counts=True)
                m = len(pairs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys),
                        batch.column(0).slice(at, n),
                        pa.array(np.diff(offsets) + 1),
                        pa.array(known.astype(np.int64)),
                        pa.array(base),
                        pa.array(np.add.reduceat(logs, ends - lengths)),
                        pa.nulls(n, pa.string()),
                        pa.nulls(n, pa.int64()),
                    ],
                    names=names,
                )
                if m:
                    blank = [pa.nulls(m, t) for t in (batch.column(0).type, pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    rest = [values.take(pa.array(pairs % len(values))).cast(pa.string()), pa.array(times)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[pairs // len(values)]), *blank, *rest], names=names)
                at += n
            key += batch.num_rows
        release()

    read = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), F.col(ids).alias("ids"))
    kind = docs.schema[id].dataType.simpleString()
    schema = f"key long, id {kind}, n_tokens long, n_known long, base double, score double, word string, times long"
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        rows = write_once(read.mapInArrow(score, schema))
    own = rows.filter("word IS NULL").select("key", "id", "n_tokens", "n_known", "base", "score")
    total = F.lit(float(model.train_tokens + model.words + 1))
    rare = rows.filter("word IS NOT NULL").select("key", "word", "times").join(model.counts, "word", "left")
    rest = rare.groupBy("key").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / total)).alias("_base"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_known"),
    )
    return own.join(rest, "key", "left").select(
        F.col("id").alias(id),
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
