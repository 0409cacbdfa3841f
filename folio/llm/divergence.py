"""How far a source's words are from those of the other sources of its language.

Two passes over the texts. The first counts, exactly, in how many documents of a
language each term occurs; terms in ``LEAST_DOCS`` or more are kept. These are dealt by
hash into shards of about ``SHARD_BYTES``, and a task builds a minimal perfect hash of
each: levels of bits, a key being placed at the first level where no other key shares
its bit; its slot is the number of bits set before. At its slot a shard stores the key
itself, so a term that was not kept is told from one that was by comparing the two.

The second pass counts again. Shards are broadcast, as many at a time as make
``PASS_BYTES``; more of them take more passes over the texts. A task has one dense array
of slots for each group (language and source) it meets and adds to it; the arrays go out
in blocks of ``BLOCK`` slots when they hold ``MOST_CELLS``, and at the end. So a group with
a third of all rows costs each task as much as any other. Blocks are added up, and then
all groups of a language are compared block by block, in whole numbers: terms that a
group lacks count as well, because blocks are dense.

``p = 1 + floor(10^9 * (count + 2) / (N + 2 V))`` is a term's share in a group, smoothed;
``f = floor((p - q)^2 / (p + q))`` its part in the distance of two. Results: for each group
all other sources of its language, by distance, and the ten terms that it has most above
its language.

Defined results: null texts, languages and sources are ''; rows that share an id are
separate documents; a group without terms is compared like any other, and with a language
that keeps no term all distances are 0; ties are ordered by item in UTF-8; a language with
one source has no pairs; an empty table gives no rows; other columns, also ones with the
names used here, are ignored. A text of any length is read whole, alone if it is long.
Every pair of sources of a language is a row of the result, so a language's number of
sources must be one for which that is wanted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from folio.llm.texts import distinct, mixed, slices, split_words, translated
from folio.session import write_once

LEAST_DOCS = 10
TOP_TERMS = 10
SHARD_BYTES = 4 << 20  # of keys, as counted by ``_key_bytes``
PASS_BYTES = 64 << 20  # of keys broadcast at a time
KEY_COST = 32  # bytes of a key besides its text
MOST_CELLS = 5_000_000  # counts that a task holds
BLOCK = 256
MOST_PAIRS = 4_000_000  # distances of pairs that a task adds up before it puts them out
SCALE = 1_000_000_000
SLICE = 6 << 20
LEVELS = 48

# Bytes of terms: letters, A-Z lower-cased, and all bytes beyond ASCII; others are blanks.
TERM_BYTES = np.full(256, 0x20, np.uint8)
TERM_BYTES[0x61:0x7B] = np.arange(0x61, 0x7B)
TERM_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)
TERM_BYTES[0x80:] = np.arange(0x80, 0x100)


def text_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of all texts (no nulls) in a row; where each text's start."""
    return split_words(translated(texts, TERM_BYTES))


def key_hashes(lang: str, terms: pa.Array) -> np.ndarray:
    """Spark's ``xxhash64(lang, term)`` of each term, unsigned."""
    seed = xxhash.xxh64_intdigest(lang, 42)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(t, seed) for t in terms.to_pylist()), np.uint64, len(terms))


# ---------------------------------------------------------------- minimal perfect hash


@dataclass
class PerfectHash:
    """Distinct 64-bit keys to the numbers below their count, without a gap."""

    sizes: list[int]  # bits of each level
    words: np.ndarray  # the levels' bits, one after another, in 64-bit words
    before: np.ndarray  # bits set before each word

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash, and the keys it could not place: those that are equal."""
        sizes, bits, left = [], [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            sizes.append(-(-2 * len(left) // 64) * 64)
            at = cls._place(left, level, sizes[-1])
            alone = np.bincount(at, minlength=sizes[-1]) == 1
            bits.append(alone)
            left = left[~alone[at]]
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        words = np.packbits(flat, bitorder="little").view(np.uint64)
        set_bits = np.bitwise_count(words).astype(np.int64)
        return cls(sizes, words, (np.cumsum(set_bits) - set_bits).astype(np.int32)), left

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(mixed(keys + np.uint64(level + 1))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of one that was not built in, any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = start + self._place(keys[left], level, size)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            left, start = left[~hit], start + size
        return out


class Shard:
    """Kept terms of some languages: the place of a term in the order of (lang, term)."""

    def __init__(self, langs: list[str], widths: list[int], terms: pa.Array):
        self.langs, self.widths = langs, dict(zip(langs, widths))
        self.starts = dict(zip(langs, np.cumsum([0, *widths[:-1]]).tolist()))
        keys = np.concatenate([key_hashes(g, terms.slice(self.starts[g], self.widths[g])) for g in langs])
        self.hash, unplaced = PerfectHash.build(keys)
        slot = self.hash.slots(keys)
        odd = np.isin(keys, unplaced)
        # Stored keys, by slot: the term, and its place, which tells the language.
        self.place = np.zeros(int((~odd).sum()), np.int32)
        self.place[slot[~odd]] = np.flatnonzero(~odd)
        self.stored = terms.take(pa.array(self.place))
        # Terms whose 64-bit hashes are equal are kept as they are.
        lang_of = np.repeat(np.arange(len(langs)), widths)
        self.odd = {(langs[lang_of[k]], terms[k].as_py()): int(k) for k in np.flatnonzero(odd)}

    def places(self, lang: str, terms: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The place of each distinct term among its language's; -1 if it was not kept."""
        out = np.full(len(terms), -1, np.int64)
        if lang not in self.widths:
            return out
        start, width = self.starts[lang], self.widths[lang]
        slot = self.hash.slots(hashes)
        asked = np.flatnonzero(slot >= 0)
        place = self.place[slot[asked]]
        same = np.asarray(pc.equal(self.stored.take(pa.array(slot[asked])), terms.take(pa.array(asked))), bool)
        same &= (place >= start) & (place < start + width)
        out[asked[same]] = place[same] - start
        for (of, term), k in self.odd.items():
            if of == lang:
                at = pc.index(terms, pa.scalar(term, terms.type)).as_py()
                if at >= 0:
                    out[at] = k - start
        return out


# ---------------------------------------------------------------- first pass


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """Languages of a batch (column ``lang``), with the rows of each."""
    coded = batch.column("lang").dictionary_encode()
    codes = np.asarray(coded.indices)
    for k, lang in enumerate(coded.dictionary.to_pylist()):
        yield lang, np.flatnonzero(codes == k)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, rows in _by_lang(batch):
            for texts in slices(batch.column("text").take(pa.array(rows)), SLICE):
                terms, offsets = text_terms(texts)
                codes, values = distinct(terms)
                n = len(values)
                if not n:
                    continue
                of_text = np.repeat(np.arange(len(texts)), np.diff(offsets))
                docs = np.bincount(np.unique(of_text * n + codes) % n, minlength=n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), values.cast(pa.string()), pa.array(docs)], names=["lang", "term", "docs"])


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term) of the terms in ``least_docs`` or more documents of the language. Written once."""
    counted = docs.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, docs long")
    return write_once(counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term"))


# ---------------------------------------------------------------- shards

_SHARD = "shard int, bytes long, langs array<string>, widths array<int>, terms array<string>"


def _key_bytes():
    return F.octet_length("lang") + F.octet_length("term") + F.lit(KEY_COST)


def _gather_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shard from rows ordered by (shard, lang, term)."""
    now, parts = None, []

    def made() -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        coded = table["lang"].combine_chunks().dictionary_encode()
        widths = np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary))
        lists = [[coded.dictionary.to_pylist()], [widths.tolist()]]
        offsets = pa.array([0, table.num_rows], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([now], pa.int32()),
                pa.array([pc.sum(table["bytes"]).as_py()], pa.int64()),
                pa.array(lists[0], pa.list_(pa.string())),
                pa.array(lists[1], pa.list_(pa.int32())),
                pa.ListArray.from_arrays(offsets, table["term"].combine_chunks()),
            ],
            names=["shard", "bytes", "langs", "widths", "terms"],
        )

    for batch in batches:
        shards = np.asarray(batch.column("shard"))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b <= a:
                continue
            if parts and shards[a] != now:
                yield made()
                parts = []
            now = int(shards[a])
            parts.append(batch.slice(a, b - a))
    if parts:
        yield made()


def gather_shards(kept: DataFrame) -> tuple[DataFrame, int]:
    """A row per shard, with its terms in the order of (lang, term); how many shards. Written once."""
    total = kept.agg(F.sum(_key_bytes())).first()[0] or 0
    n = -(-total // SHARD_BYTES) or 1
    dealt = kept.select(F.pmod(F.xxhash64("lang", "term"), F.lit(n)).cast("int").alias("shard"), _key_bytes().cast("long").alias("bytes"), "lang", "term")
    ordered = dealt.repartition("shard").sortWithinPartitions("shard", "lang", "term")
    return write_once(ordered.mapInArrow(_gather_shards, _SHARD)), n


def _passes(shards: DataFrame) -> list[list[int]]:
    """Shards dealt into passes of at most ``PASS_BYTES``, one shard at least."""
    out, held = [], 0
    for row in shards.select("shard", "bytes").orderBy("shard").collect():  # one row for each SHARD_BYTES of keys
        if not out or held + row["bytes"] > PASS_BYTES:
            out.append([])
            held = 0
        out[-1].append(row["shard"])
        held += row["bytes"]
    return out


# ---------------------------------------------------------------- second pass

_BLOCKS = "lang string, shard int, block int, source string, counts binary"


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest type that holds them, its width first."""
    most = int(counts.max())
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def recount(docs: DataFrame, shards: DataFrame, chosen: list[int], n_shards: int) -> DataFrame:
    """Blocks of counts of the chosen shards' terms, a row for each task, group and block that has any."""
    rows = shards.filter(F.col("shard").isin(chosen)).toArrow()  # within PASS_BYTES
    held = {}
    for row in range(rows.num_rows):
        terms = rows["terms"].slice(row, 1).combine_chunks().flatten().cast(pa.large_string())
        held[rows["shard"][row].as_py()] = Shard(rows["langs"][row].as_py(), rows["widths"][row].as_py(), terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple[str, str, int], np.ndarray] = {}

        def put() -> Iterator[pa.RecordBatch]:
            for (lang, source, shard), counts in cells.items():
                firsts = np.arange(0, len(counts), BLOCK)
                some = [(int(a // BLOCK), _packed(counts[a : a + BLOCK])) for a in firsts if counts[a : a + BLOCK].any()]
                if some:
                    n = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * n), pa.array([shard] * n, pa.int32()), pa.array([b for b, _ in some], pa.int32()), pa.array([source] * n), pa.array([c for _, c in some], pa.binary())],
                        names=["lang", "shard", "block", "source", "counts"],
                    )
            cells.clear()

        n_cells = 0
        for batch in batches:
            for lang, rows in _by_lang(batch):
                if not any(lang in s.widths for s in held.values()):
                    continue
                sources = batch.column("source").take(pa.array(rows)).dictionary_encode()
                names, of_row, at = sources.dictionary.to_pylist(), np.asarray(sources.indices, np.int64), 0
                for texts in slices(batch.column("text").take(pa.array(rows)), SLICE):
                    terms, offsets = text_terms(texts)
                    codes, values = distinct(terms)
                    group = np.repeat(of_row[at : at + len(texts)], np.diff(offsets))
                    at += len(texts)
                    if not len(values):
                        continue
                    hashes = key_hashes(lang, values)
                    of_shard = hashes.view(np.int64) % n_shards
                    for number, shard in held.items():
                        mine = np.flatnonzero(of_shard == number)
                        place = np.full(len(values), -1, np.int64)
                        place[mine] = shard.places(lang, values.take(pa.array(mine)), hashes[mine])
                        hit = place[codes]
                        found = hit >= 0
                        width = shard.widths.get(lang, 0)
                        if not found.any():
                            continue
                        pairs, times = np.unique(group[found] * width + hit[found], return_counts=True)
                        of_group, slot = pairs // width, pairs % width
                        bounds = np.flatnonzero(np.diff(of_group, prepend=-1, append=-1))
                        for a, b in zip(bounds[:-1], bounds[1:]):
                            key = (lang, names[of_group[a]], number)
                            if key not in cells:
                                if n_cells + width > MOST_CELLS:
                                    yield from put()
                                    n_cells = 0
                                cells[key] = np.zeros(width, np.int64)
                                n_cells += width
                            cells[key][slot[a:b]] += times[a:b]
        yield from put()

    return docs.select("lang", "source", "text").mapInArrow(count, _BLOCKS)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (lang, shard, block, source) with its total, from rows in that order."""
    now, counts, rows = None, None, []

    def put() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 6
        rows.clear()
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "shard", "block", "source", "total", "counts"])

    for batch in batches:
        for key, data in zip(zip(*[batch.column(k).to_pylist() for k in range(4)]), batch.column(4).to_pylist()):
            if key != now:
                if now is not None:
                    rows.append((*now, int(counts.sum()), _packed(counts)))
                now, counts = key, np.zeros(len(_unpacked(data)), np.int64)
            counts += _unpacked(data)
        yield put()
    if now is not None:
        rows.append((*now, int(counts.sum()), _packed(counts)))
    yield put()


def group_counts(docs: DataFrame, shards: DataFrame, n_shards: int) -> DataFrame:
    """(lang, shard, block, source, total, counts), in passes over the texts. Written once."""
    done = []
    for chosen in _passes(shards):
        blocks = recount(docs, shards, chosen, n_shards)
        key = ["lang", "shard", "block"]
        dealt = blocks.repartition(*key).sortWithinPartitions(*key, "source")
        done.append(write_once(dealt.mapInArrow(_add_up, "lang string, shard int, block int, source string, total long, counts binary")))
    if not done:
        return docs.sparkSession.createDataFrame([], "lang string, shard int, block int, source string, total long, counts binary")
    return reduce(DataFrame.unionByName, done)


# ---------------------------------------------------------------- comparison


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(10^9 * (count + 2) / total)``, exact for totals below 9 * 10^15."""
    # Nine decimal digits by long division, three at a time.
    whole, left = np.divmod(counts + 2, total)
    for _ in range(3):
        digits, left = np.divmod(left * 1000, total)
        whole = whole * 1000 + digits
    return 1 + whole


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (lang, source, item, term, value): parts of distances of pairs (source before
    item, ``term`` false), and terms that may be among a group's first. A block's first row
    has its terms and the language's groups."""
    names = ["lang", "source", "item", "term", "value"]
    lang = sources = terms = totals = counts = None
    size, pairs = 0, None

    def put(source: list[str], item: list[str], is_term: bool, value: np.ndarray) -> pa.RecordBatch:
        n = len(value)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array([is_term] * n), pa.array(value, pa.int64())], names=names)

    def summed() -> Iterator[pa.RecordBatch]:
        if pairs is not None:
            for a in range(len(sources) - 1):
                yield put([sources[a]] * (len(sources) - 1 - a), sources[a + 1 :], False, pairs[a, a + 1 :])

    def block() -> Iterator[pa.RecordBatch]:
        of_lang = shares(counts.sum(axis=0), totals.sum() + 2 * size)
        p = shares(counts, (totals + 2 * size)[:, None])
        for a in range(len(sources)):
            if len(sources) > 1:
                apart = distance(p[a], p[a + 1 :]).sum(axis=1)
                if pairs is not None:
                    pairs[a, a + 1 :] += apart
                elif len(apart):
                    yield put([sources[a]] * len(apart), sources[a + 1 :], False, apart)
            above = np.flatnonzero((counts[a] > 0) & (p[a] > of_lang))
            value = distance(p[a], of_lang)[above]
            best = np.argsort(-value, kind="stable")[:TOP_TERMS]
            if len(best):
                yield put([sources[a]] * len(best), [terms[k] for k in above[best]], True, value[best])

    for batch in batches:
        for row in batch.to_pylist():
            if row["terms"] is not None:
                if terms is not None:
                    yield from block()
                if row["lang"] != lang:
                    yield from summed()
                    lang, sources, size = row["lang"], row["sources"], row["size"]
                    at = {s: k for k, s in enumerate(sources)}
                    totals = np.array(row["totals"], np.int64)
                    pairs = np.zeros((len(sources),) * 2, np.int64) if len(sources) ** 2 <= MOST_PAIRS else None
                terms = row["terms"]
                counts = np.zeros((len(sources), len(terms)), np.int64)
            else:
                counts[at[row["source"]]] = _unpacked(row["counts"])
    if terms is not None:
        yield from block()
        yield from summed()


def _term_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            at, out = 0, []
            for lang, width in zip(row["langs"], row["widths"]):
                out += [(lang, row["shard"], a // BLOCK, row["terms"][at + a : min(at + a + BLOCK, at + width)]) for a in range(0, width, BLOCK)]
                at += width
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["lang", "shard", "block", "terms"])


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has each other source of the
    language with its distance; part ``term`` the first terms that the group has above it."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    kept = kept_terms(read, least_docs)
    shards, n_shards = gather_shards(kept)
    counted = group_counts(read, shards, n_shards)

    groups = read.select("lang", "source").distinct()
    totals = counted.groupBy("lang", "source").agg(F.sum("total").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("size"))
    known = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    known = write_once(known.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("size", F.lit(0)).alias("size")))

    listed = F.array_sort(F.collect_list(F.struct("source", "total")))
    of_lang = known.filter("size > 0").groupBy("lang").agg(F.first("size").alias("size"), listed.alias("_g"))
    of_lang = of_lang.select("lang", "size", F.col("_g.source").alias("sources"), F.col("_g.total").alias("totals"))
    heads = shards.mapInArrow(_term_blocks, "lang string, shard int, block int, terms array<string>").join(of_lang, "lang")
    rows = heads.unionByName(counted.drop("total"), allowMissingColumns=True)
    key = ["lang", "shard", "block"]
    dealt = rows.repartition(*key).sortWithinPartitions(*key, F.col("source").asc_nulls_first())
    found = write_once(dealt.mapInArrow(_compare, "lang string, source string, item string, term boolean, value long"))

    half = found.filter("NOT term").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    none = known.filter("size = 0").select("lang", "source")
    apart = none.join(none.withColumnRenamed("source", "item"), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).unionByName(apart)
    terms = found.filter("term").select("lang", "source", "item", "value")

    def ranked(part: DataFrame, name: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return part.select("lang", "source", F.lit(name).alias("part"), "item", "value", rank.alias("rank"))

    return ranked(pairs, "pair").unionByName(ranked(terms, "term").filter(F.col("rank") <= TOP_TERMS))
