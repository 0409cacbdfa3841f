"""Similarity join of documents' sets of word n-grams, for near-duplicate groups.

A document's set: its distinct runs of ``SHINGLE`` words (A-Z lower-cased, words between
ASCII white space), hashed to 64 bits; with fewer words the whole sequence is the one
member. Two documents link when their sets' Jaccard similarity is ``PERCENT`` % or more.

Sets that are equal are one class. Pairs of classes that may link are found by size:

* light: both sets have at most ``boundary`` members. Sets of s >= t members that link
  share ``overlap(s, t)`` of them, so both enumerate their subsets of that fixed size and
  meet at an equal one.
* heavy: one set is larger. Sets that link share one of their first ``n - ceil(0.75 n) +
  1`` members in any common order, so just those are entered in inverted lists, members
  that few sets have first. The order is approximate: members found often within a
  task's chunk of texts are counted, the most frequent ``FREQUENT`` come last, and all
  others are ordered by hash. That decides costs only, never results.

The boundary is the one of least cost, from the number of sets of each small size: rows
of subsets against rows of list entries and what a list entry costs to scan.

A list of at most ``SHORT_LIST`` classes gives their pairs. A pair's lists are counted; what
is not among the first members of either set adds no more than a known number to the
overlap, so most pairs that only share a passage fall. A longer list names one class of
it, the least, as a group for all of them, and classes with the same group are gathered
once, however many lists they share. Lists of the frequent members, which may hold a
third of all documents, are never shuffled: their groups are known from the counts, a
table of bounded size.

The pairs left over and the groups are compared by exact overlaps. A group's sets are
split into blocks of about ``BLOCK_MEMBERS`` members, and every pair of blocks is one
piece of work. In it, sets meet in lists of their rarest members and are compared, until
no two classes that are apart are untested, and a spanning forest of the links is put
out: as many rows as classes, not as pairs.

Connected components of the forest's edges give the groups of near duplicates.

Defined results: null, empty and wordless texts have an empty set, link with nothing and
are their own group; rows that share a doc_id are compared like any others, and a
component's id is its smallest doc_id (null only if all are null); an empty table gives
no rows; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from folio.llm.components import components
from folio.llm.texts import mixed, release, slices, window_hashes, word_hashes
from folio.session import write_once

SHINGLE = 5
PERCENT = 75
FREQUENT = 1_000_000  # members, at most, that come last in the order; the table of them is sent to every task
SEEN = 2  # times in a chunk from which a member is counted
CHUNK_MEMBERS = 500_000
SHORT_LIST = 32  # classes in a list that gives pairs
SMALL = 12  # sizes that may be light
SCAN_COST = 8.0  # rows that one list entry is worth
BLOCK_MEMBERS = 500_000
BIT_WORDS = 2_000_000  # 64-bit words of members' bits in a piece of work
COMPARED = 500_000  # members of sets that are compared with one at a time


# ---------------------------------------------------------------- sets


def text_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of all texts (no nulls) in a row; where each text's start."""
    words, offsets = word_hashes(pc.ascii_lower(texts))
    counts = np.diff(offsets)
    of_word = np.repeat(np.arange(len(texts)), counts)
    full = window_hashes(words, SHINGLE)
    inside = of_word[: len(full)] == of_word[SHINGLE - 1 :] if len(full) else np.empty(0, bool)
    shingles, owner = full[inside], of_word[: len(full)][inside]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        whole = [mixed(window_hashes(words[offsets[k] : offsets[k + 1]], int(counts[k])) + np.uint64(counts[k]))[0] for k in short]
        at = np.searchsorted(owner, short)
        shingles, owner = np.insert(shingles, at, np.array(whole, np.uint64)), np.insert(owner, at, short)
    ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
    for a, b in zip(np.concatenate([[0], ends[:-1]]), ends):
        shingles[a:b].sort()
    first = np.ones(len(shingles), bool)
    first[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    sizes = np.bincount(owner[first], minlength=len(texts))
    return shingles[first], np.concatenate([[0], np.cumsum(sizes)])


def set_key(members: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh3_128_digest(members.tobytes())


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def overlap(s: int, t: int) -> int:
    """Members that sets of these sizes must share to link."""
    return -(-PERCENT * (s + t) // (100 + PERCENT))


def least_partner(s: int) -> int:
    return -(-PERCENT * s // 100)


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - -(-PERCENT * n // 100) + 1


def subset_rows(s: int, boundary: int) -> int:
    """Subsets that a set of ``s`` members enumerates."""
    as_larger = sum(comb(s, overlap(s, t)) for t in range(least_partner(s), s + 1))
    as_smaller = sum(comb(s, overlap(b, s)) for b in range(s + 1, boundary + 1) if least_partner(b) <= s)
    return as_larger + as_smaller


def choose_boundary(sizes: dict[int, int]) -> int:
    """The boundary of least cost, from the number of classes of each size up to ``SMALL``."""

    def cost(boundary: int) -> float:
        rows = sum(n * subset_rows(s, boundary) for s, n in sizes.items() if s <= boundary)
        lists = sum(n * int(prefix_length(np.int64(s))) for s, n in sizes.items() if s >= least_partner(boundary + 1))
        return rows + SCAN_COST * lists

    return min(range(1, SMALL + 1), key=cost)


def subset_keys(members: np.ndarray, boundary: int) -> list[int]:
    """A hash for each subset that a light set enumerates, with the sizes it is meant for."""
    s = len(members)
    roles = [(s, t) for t in range(least_partner(s), s + 1)] + [(b, s) for b in range(s + 1, boundary + 1) if least_partner(b) <= s]
    out = []
    for role in roles:
        salt = bytes(role)
        out += [xxhash.xxh3_64_intdigest(salt + np.array(c, np.uint64).tobytes()) for c in combinations(members.tolist(), overlap(*role))]
    return out


# ---------------------------------------------------------------- one pass for classes and frequent members


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text (its size, key and class), and for each member found often in a chunk (its count and a class)."""
    chunk: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held, seen = 0, set()

    def often() -> pa.RecordBatch:
        members = np.concatenate([m for m, _, _ in chunk])
        shorts = np.concatenate([np.repeat(s, n) for _, s, n in chunk])
        chunk.clear()
        order = np.argsort(members).astype(np.int32)
        members, shorts = members[order], shorts[order]
        del order
        starts = np.flatnonzero(np.concatenate([[True], members[1:] != members[:-1]]))
        counts = np.diff(np.append(starts, len(members)))
        least = np.minimum.reduceat(shorts, starts)
        kept = counts >= SEEN
        n = int(kept.sum())
        nothing = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [nothing, nothing, nothing, pa.nulls(n, pa.binary()), pa.array(members[starts][kept].view(np.int64)), pa.array(counts[kept]), pa.array(least[kept])],
            names=_MEASURED,
        )

    for batch in batches:
        at = 0
        for texts in slices(batch.column(2)):
            members, ends = text_sets(texts)
            sizes = np.diff(ends)
            keys = [set_key(members[a:b]) if b > a else None for a, b in zip(ends[:-1], ends[1:])]
            shorts = np.array([_short(k) if k else 0 for k in keys], np.int64)
            nothing = pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).slice(at, len(texts)) for k in (0, 1)], pa.array(sizes), pa.array(keys, pa.binary()), nothing, nothing, pa.array(shorts)],
                names=_MEASURED,
            )
            at += len(texts)
            new = np.zeros(len(texts), bool)
            for k, key in enumerate(keys):
                if key and key not in seen:
                    seen.add(key)
                    new[k] = True
            chunk.append((members[np.repeat(new, sizes)], shorts[new], sizes[new]))
            held += int(sizes[new].sum())
            if held >= CHUNK_MEMBERS:
                yield often()
                held, seen = 0, set()
    if held:
        yield often()
    chunk, seen = [], set()
    release()


_MEASURED = ["doc_id", "digest", "n_shingles", "key", "member", "often", "class"]


def measure(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``docs`` by (doc_id, digest of the text) with ``n_shingles`` and ``key``, and rows of frequent members. Written once."""
    chosen = docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("digest"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, digest long, n_shingles long, key binary, member long, often long, class long"
    return write_once(chosen.mapInArrow(_measure, schema))


def frequent_members(measured: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members, ranks (the rarer the lower) and groups of the most frequent ones, by member.

    All members of the lowest count that leaves no more than ``FREQUENT`` are taken.
    """
    counted = write_once(
        measured.filter("member IS NOT NULL").groupBy("member").agg(F.sum("often").alias("n"), F.min("class").alias("group"))
    )
    # One row per count, not per member.
    at_least, total = None, 0
    for n, members in counted.groupBy("n").count().orderBy(F.desc("n")).collect():
        total += members
        if total > FREQUENT:
            break
        at_least = n
    top = counted.filter(F.lit(False) if at_least is None else F.col("n") >= at_least).toArrow()
    members = np.asarray(top["member"], np.int64).view(np.uint64)
    rank = np.empty(len(members), np.int32)
    rank[np.lexsort((members, np.asarray(top["n"], np.int64)))] = np.arange(1, len(members) + 1)
    order = np.argsort(members)
    return members[order], rank[order], np.asarray(top["group"], np.int64)[order]


# ---------------------------------------------------------------- inverted lists and subsets


def entries(texts: pa.Array, frequent: tuple[np.ndarray, np.ndarray, np.ndarray], boundary: int, seen: set) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, class, n) of each text's class of n members: list entries and subsets. Where n is
    -1, ``class`` is a group that is known already, and ``list`` the class in it."""
    members, ends = text_sets(texts)
    sizes = np.diff(ends)
    known, ranks, groups = frequent
    keys = [set_key(members[a:b]) if b > a else None for a, b in zip(ends[:-1], ends[1:])]
    new = np.array([bool(k) and k not in seen for k in keys], bool)
    seen.update(k for k in keys if k)
    shorts = np.array([_short(k) if k else 0 for k in keys], np.int64)
    in_lists = new & (sizes >= least_partner(boundary + 1))

    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.minimum(np.searchsorted(known, members), max(len(known) - 1, 0))
    is_known = known[place] == members if len(known) else np.zeros(len(members), bool)
    rare = ~is_known
    rank_in_text = np.cumsum(rare) - np.concatenate([[0], np.cumsum(rare)])[ends[:-1]][owner] if len(members) else np.empty(0, np.int64)
    wanted = prefix_length(sizes)
    chosen = rare & (rank_in_text <= wanted[owner]) & in_lists[owner]
    out = [(members[chosen].view(np.int64), shorts[owner[chosen]], sizes[owner[chosen]])]
    n_rare = np.bincount(owner[rare], minlength=len(texts))
    for k in np.flatnonzero(in_lists & (n_rare < wanted)):
        a, b = ends[k], ends[k + 1]
        at = place[a:b][is_known[a:b]]
        mine = np.unique(groups[at[np.argsort(ranks[at])][: wanted[k] - n_rare[k]]])
        out.append((np.full(len(mine), shorts[k]), mine, np.full(len(mine), -1)))
    for k in np.flatnonzero(new & (sizes > 0) & (sizes <= boundary)):
        subsets = np.array(subset_keys(members[ends[k] : ends[k + 1]], boundary), np.uint64).view(np.int64)
        out.append((subsets, np.full(len(subsets), shorts[k]), np.full(len(subsets), sizes[k])))
    return tuple(np.concatenate(c) for c in zip(*out))


def meetings(lists: np.ndarray, classes: np.ndarray, sizes: np.ndarray, started: int | None) -> list[tuple[np.ndarray, ...]]:
    """(group, class, other, n_class, n_other) of whole sorted lists without repeated classes.
    Pairs have group 0 and are from short lists. ``started`` is the group of the first list
    if it is the rest of a long one."""
    starts = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]])) if len(lists) else np.empty(0, np.int64)
    lengths = np.diff(np.append(starts, len(lists)))
    out = []
    is_long = lengths > SHORT_LIST
    least = classes[starts] if len(starts) else classes
    if started is not None and len(starts):
        is_long[0], least = True, np.concatenate([[started], least[1:]])
    for m in range(2, SHORT_LIST + 1):
        at = starts[(lengths == m) & ~is_long]
        if len(at):
            i, j = np.triu_indices(m, 1)
            a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            fits = 100 * np.minimum(sizes[a], sizes[b]) >= PERCENT * np.maximum(sizes[a], sizes[b])
            a, b = a[fits], b[fits]
            out.append((np.zeros(len(a), np.int64), classes[a], classes[b], sizes[a], sizes[b]))
    of = np.repeat(np.arange(len(starts)), lengths)
    long = is_long[of] if len(starts) else np.empty(0, bool)
    zero = np.zeros(int(long.sum()), np.int64)
    out.append((least[of[long]] if len(zero) else zero, classes[long], zero, zero, zero))
    return out


_MET = ["group", "class", "other", "n_class", "n_other"]


def memberships(docs: DataFrame, text: str, frequent: tuple[np.ndarray, np.ndarray, np.ndarray], boundary: int) -> DataFrame:
    """(group, class): classes that must be compared within a group."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for texts in slices(batch.column(0)):
                if len(seen) > 200_000:
                    seen.clear()
                lists, classes, sizes = entries(texts, shared.value, boundary, seen)
                yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(classes), pa.array(sizes, pa.int64())], names=["list", "class", "n"])
        del seen
        release()

    entered = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(enter, "list long, class long, n long")
    dealt = entered.repartition("list").sortWithinPartitions("list", "class", "n")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.empty(0, np.int64) for _ in range(3))
        long_list = group = None

        def put(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*rows)], names=_MET)

        for batch in batches:
            now = [np.asarray(batch.column(k)) for k in range(3)]
            direct = now[2] < 0
            zero = np.zeros(int(direct.sum()), np.int64)
            rows = [(now[1][direct], now[0][direct], zero, zero, zero)]
            now = [np.concatenate([h, c[~direct]]) for h, c in zip(held, now)]
            new = np.ones(len(now[0]), bool)
            new[1:] = (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]) | (now[2][1:] != now[2][:-1])
            lists, classes, sizes = (c[new] for c in now)
            if not len(lists):
                yield put(rows)
                continue
            last = int(np.searchsorted(lists, lists[-1]))
            started = group if lists[0] == long_list else None
            if len(lists) - last > SHORT_LIST or lists[-1] == long_list:
                group = group if lists[-1] == long_list else int(classes[last])
                long_list, last = lists[-1], len(lists)
                held = tuple(np.empty(0, np.int64) for _ in range(3))
            else:
                held = (lists[last:], classes[last:], sizes[last:])
            yield put(rows + meetings(lists[:last], classes[:last], sizes[:last], started if last else None))
        yield put(meetings(*held, group if len(held[0]) and held[0][0] == long_list else None))
        release()

    met = dealt.mapInArrow(meet, ", ".join(f"{c} long" for c in _MET)).groupBy(*_MET).agg(F.count("*").alias("_lists"))
    larger, smaller = F.greatest("n_class", "n_other"), F.least("n_class", "n_other")
    needed = F.ceil(PERCENT * (larger + smaller) / (100 + PERCENT))
    beyond = F.ceil(PERCENT * larger / 100) - 1
    light = (larger <= boundary) & (smaller > 0)
    met = write_once(met.filter((F.col("n_class") == 0) | light | (F.col("_lists") + beyond >= needed)))
    pairs = met.filter("n_class > 0")
    return met.filter("n_class = 0").select("group", "class").union(
        pairs.select(F.col("class").alias("group"), F.explode(F.array("class", "other")).alias("class"))
    ).distinct()


# ---------------------------------------------------------------- exact overlaps within a group


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets.

    Sets that link share one of their first members in the order of this group, rarest
    first, so only those are in lists, and only sets that meet there are compared, by
    their whole overlap. A set is compared with those outside its tree; of two trees that
    meet the smaller one is relabelled. Sets of the largest tree so far are put off.
    Another tree may outgrow it, so those outside the tree that is largest at the end of
    the first round are tested then; the others lie in that tree, which only grows.
    """
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    ends = np.cumsum(sizes)
    _, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
    members = rank[codes]  # of all sets in a row, as ranks
    by_rank = np.sort(counts)
    del codes, counts
    for a, b in zip(ends - sizes, ends):
        members[a:b].sort()
    place = np.arange(len(members)) - np.repeat(ends - sizes, sizes)
    entered = (place < np.repeat(prefix_length(sizes), sizes)) & (by_rank[members] > 1)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)[entered]
    listed = members[entered]
    bounds = np.searchsorted(owner, np.arange(n + 1))  # entries of each set
    order = np.argsort(listed, kind="stable")
    postings = owner[order]
    starts = np.flatnonzero(np.diff(listed[order], prepend=-1))
    lengths = np.diff(np.append(starts, len(postings)))
    of_list = np.empty(len(listed), np.int32)
    of_list[order] = np.repeat(np.arange(len(starts), dtype=np.int32), lengths)
    del place, entered, listed, order

    # Bits of the most frequent members bound the overlap of two sets from above.
    n_bits = min(int((by_rank > 1).sum()), 16 * len(members) // n + 64, 64 * (BIT_WORDS // n + 1))
    bits = np.zeros((n, -(-n_bits // 64)), np.uint64)
    bit = len(by_rank) - 1 - members
    frequent = bit < n_bits
    owner = np.repeat(np.arange(n), sizes)
    np.bitwise_or.at(bits, (owner[frequent], bit[frequent] >> 6), np.uint64(1) << (bit[frequent] & 63).astype(np.uint64))
    others = np.bincount(owner[~frequent & (by_rank[members] > 1)], minlength=n)
    del bit, frequent, owner

    tree = np.arange(n)
    inside: dict[int, list[int]] = {}  # sets of each tree of more than one
    largest, most = -1, 1
    edges: list[tuple[int, int]] = []
    marked = np.zeros(len(by_rank), bool)

    def join(k: int, j: int) -> None:
        nonlocal largest, most
        a, b = int(tree[k]), int(tree[j])
        if len(inside.get(a, (a,))) < len(inside.get(b, (b,))):
            a, b = b, a
        moved = inside.pop(b, [b])
        tree[moved] = a
        whole = inside.setdefault(a, [a])
        whole += moved
        if len(whole) > most:
            largest, most = a, len(whole)
        edges.append((int(k), int(j)))

    def test(k: int) -> None:
        lists = of_list[bounds[k] : bounds[k + 1]]
        if not len(lists):
            return
        run = lengths[lists]
        total = np.cumsum(run)
        near = np.zeros(n, bool)
        near[postings[np.repeat(starts[lists] - (total - run), run) + np.arange(total[-1])]] = True
        near &= (tree != tree[k]) & (100 * np.minimum(sizes, sizes[k]) >= PERCENT * np.maximum(sizes, sizes[k]))
        found = np.flatnonzero(near)
        at_most = np.bitwise_count(bits[found] & bits[k]).sum(axis=1, dtype=np.int64) + np.minimum(others[found], others[k])
        found = found[100 * at_most >= PERCENT * (sizes[found] + sizes[k] - at_most)]
        if not len(found):
            return
        mine = members[ends[k] - sizes[k] : ends[k]]
        marked[mine] = True
        # As many at a time as make a bounded number of members.
        parts = np.split(found, np.flatnonzero(np.diff(np.cumsum(sizes[found]) // COMPARED)) + 1)
        for some in parts:
            some = some[tree[some] != tree[k]]
            if not len(some):
                continue
            m = sizes[some]
            at = np.repeat(ends[some] - np.cumsum(m), m) + np.arange(int(m.sum()))
            common = np.add.reduceat(marked[members[at]].astype(np.int64), np.cumsum(m) - m)
            for j in some[100 * common >= PERCENT * (sizes[k] + m - common)]:
                if tree[j] != tree[k]:
                    join(k, j)
        marked[mine] = False

    reach = np.bincount(np.repeat(np.arange(n), np.diff(bounds)), lengths[of_list].astype(float), minlength=n)
    put_off = []
    for k in np.argsort(-reach, kind="stable"):
        if tree[k] == largest:
            put_off.append(k)
        else:
            test(k)
    for k in put_off:
        if tree[k] != largest:
            test(k)
    return edges


def links(docs: DataFrame, classes: DataFrame, met: DataFrame, id: str, text: str) -> DataFrame:
    """(a, b): keys of classes that link, enough to connect all that do."""
    members = met.join(classes, "class").select("group", "key", "n_shingles", "rep")
    weights = members.groupBy("group").agg(F.sum("n_shingles").alias("_w"), F.count("*").alias("_n")).filter("_n > 1")
    blocks = F.ceil(F.col("_w") / F.lit(BLOCK_MEMBERS)).cast("int")
    placed = members.join(weights.select("group", blocks.alias("_b")), "group").withColumn("_own", F.pmod(F.xxhash64("key"), F.col("_b")).cast("int"))
    paired = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    work = F.struct("group", F.least("_own", "_other").alias("p"), F.greatest("_own", "_other").alias("q"))
    wanted = paired.groupBy("rep").agg(F.collect_set(work).alias("_work"))

    body = F.col(text).cast("string")
    keyed = docs.select(F.struct(F.col(id).cast("long").alias("doc_id"), F.xxhash64(body).alias("digest")).alias("rep"), body.alias("text"))
    sent = keyed.join(wanted, "rep").select(F.explode("_work").alias("w"), "text").select("w.group", "w.p", "w.q", "text")
    dealt = sent.repartition("group", "p", "q").sortWithinPartitions("group", "p", "q")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, {}

        def found() -> Iterator[pa.RecordBatch]:
            if len(sets) > 1:
                keys = list(sets)
                edges = forest(list(sets.values()))
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array([keys[e[k]] for e in edges], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            names = list(zip(*[batch.column(k).to_pylist() for k in range(3)]))
            at = 0
            for texts in slices(batch.column(3)):
                members, ends = text_sets(texts)
                for k in range(len(texts)):
                    if names[at + k] != now:
                        yield from found()
                        now, sets = names[at + k], {}
                    mine = members[ends[k] : ends[k + 1]]
                    sets[set_key(mine)] = mine.copy()
                at += len(texts)
        yield from found()
        sets = {}
        release()

    return dealt.mapInArrow(compare, "a binary, b binary")


# ---------------------------------------------------------------- the operator


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, n_shingles, component_id, keeper): a row for each row of ``docs``.
    ``digest`` is the xxhash64 of the text, which tells rows apart that share a doc_id;
    ``keeper`` marks one (doc_id, digest) of each component, that of the smallest doc_id."""
    measured = measure(docs, id, text)
    rows = measured.filter("n_shingles IS NOT NULL").select("doc_id", "digest", "n_shingles", "key", "class")
    classes = rows.filter("n_shingles > 0").groupBy("key", "class").agg(F.min(F.struct("doc_id", "digest")).alias("rep"), F.first("n_shingles").alias("n_shingles"))
    sizes = {r["n_shingles"]: r["count"] for r in classes.filter(F.col("n_shingles") <= SMALL).groupBy("n_shingles").count().collect()}
    met = memberships(docs, text, frequent_members(measured), choose_boundary(sizes))
    roots = components(write_once(links(docs, classes, met, id, text)))
    rooted = rows.join(roots, rows["key"] == roots["node"], "left").select("doc_id", "digest", "n_shingles", F.coalesce("root", "key").alias("_root"))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    least = rooted.filter("_root IS NOT NULL").groupBy("_root").agg(F.min(first).alias("_first"))
    joined = rooted.join(least, "_root", "left")
    return joined.select(
        "doc_id",
        "digest",
        "n_shingles",
        F.when(F.col("_root").isNull(), F.col("doc_id")).otherwise(F.col("_first.doc_id")).alias("component_id"),
        F.coalesce(first == F.col("_first"), F.lit(True)).alias("keeper"),
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near duplicates, with the columns of ``docs``. Of rows
    equal in id and text one stays; rows with an empty set all stay."""
    name = "_rep"
    while any(f"{name}{end}" in docs.columns for end in ("", "empty", "n")):
        name += "_"
    kept = near_groups(docs, id, text).filter("keeper").select(F.struct("doc_id", "digest").alias(name), (F.col("n_shingles") == 0).alias(f"{name}empty")).distinct()
    rep = F.struct(F.col(id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("digest"))
    copies = F.row_number().over(Window.partitionBy(name).orderBy(F.lit(0)))
    met = docs.withColumn(name, rep).join(kept, name).withColumn(f"{name}n", copies)
    return met.filter(F.col(f"{name}empty") | (F.col(f"{name}n") == 1)).select(*docs.columns)
