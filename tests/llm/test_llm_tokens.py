"""Token files and packing against the tokenizer itself; placement on shards."""

import random
import struct
import time
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folio.llm import packing, sharding, token_files
from folio.llm.encoding import Encoder, kept_encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "one two", "  a b", "a  b", " x ", "x\n\ny", "it's ok  \n b", "<|endoftext|> a", "Éa ñb\tc", "\x1c b", "中 文字 x", "a b c", "x" * 5000, "long text " * 3000]
SCHEMA = "doc_id long, text string, start string, ids string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def rows():
    docs = [(k, t, "s", "i") for k, t in enumerate(TEXTS)]
    return [*docs, (None, "no id", "s", "i"), (500, None, "s", "i"), (3, "again", "s", "i"), (501, "same", "s", "i"), (501, "same", "s", "i")]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_encoder_equals_library(tokenizer):
    random.seed(4)
    pieces = [" ", "  ", "\n", "a", "é", "'s", "1", "!", "\t", "\x1c", " ", "中", "b c", "Word", "<|endoftext|>", "\x85", "x.y"]
    texts = TEXTS + ["".join(random.choice(pieces) for _ in range(random.randint(0, 14))) for _ in range(2000)]
    ids, lengths = Encoder(PATH).encode(pa.array(texts, pa.large_string()), 9)
    want = [e.ids + [9] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for w in want for i in w]
    assert lengths.tolist() == [len(w) for w in want]


def plain_assign(lengths, capacity):
    """The cheapest sequence with room for the piece, else the cheapest with any room."""
    used, cost, out = [0] * -(-sum(lengths) // capacity), [0.0] * -(-sum(lengths) // capacity), []
    for piece in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
        start, left = 0, lengths[piece]
        while left:
            free = [s for s in range(len(used)) if used[s] < capacity]
            seq = min([s for s in free if capacity - used[s] >= left] or free, key=lambda s: (cost[s], s))
            take = min(left, capacity - used[seq])
            out.append((piece, start, take, seq, used[seq]))
            used[seq], cost[seq] = used[seq] + take, cost[seq] + packing.piece_cost(take, capacity)
            start, left = start + take, left - take
    return out


def test_pieces_go_to_the_cheapest_sequence_in_little_time():
    random.seed(6)
    for capacity in (1, 7, 100):
        lengths = [random.randint(0, capacity - 1) or 1 for _ in range(150)]
        assert packing.assign(lengths, capacity) == plain_assign(lengths, capacity)
    assert packing.assign([], 8) == []
    began = time.process_time()
    packing.assign([random.randint(1, 1023) for _ in range(12_000)], 1024)  # took 9 s with a heap
    assert time.process_time() - began < 3


def test_encoder_for_other_vocabularies():
    path = public_tokenizers.path("word_bpe_49k.json")
    ids, lengths = Encoder(path).encode(pa.array(["Hello World", ""], pa.large_string()), 7)
    want = [e.ids + [7] for e in Tokenizer.from_file(path).encode_batch(["Hello World", ""], add_special_tokens=False)]
    assert ids.tolist() == want[0] + want[1] and lengths.tolist() == [len(w) for w in want]


def test_new_parts_are_encoded_many_at_a_time(tokenizer):
    encoder, calls = Encoder(PATH), []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return tokenizer.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counted()
    text = " ".join(f"w{k}é\nx" if k % 3 else f"中{k}." for k in range(5000)) + " "
    ids, _ = encoder.encode(pa.array([text], pa.large_string()), 9)
    assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 9]
    assert 3 <= len(calls) <= 10


def test_token_files_round_trip(spark, tokenizer, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    path = str(tmp_path / "tokens")
    token_files.write_token_files(docs, path, PATH, end_id=2)
    read = token_files.read_token_files(spark, path)
    got = token_files.token_digests(read).orderBy("start").collect()
    assert len(got) == len(rows())
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    want = sorted((i is not None, i or 0, crc(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, *_ in rows())
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids_crc32"]) for r in got) == want
    some = read.filter(F.col("doc_id") == 2).collect()
    assert [r["ids"] for r in some] == [tokenizer.encode("one two", add_special_tokens=False).ids + [2]]


def test_token_files_have_bloom_filters(spark, tmp_path):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    path = tmp_path / "tokens"
    token_files.write_token_files(docs, str(path), PATH, end_id=2)
    read = token_files.read_token_files(spark, str(path)).filter("doc_id = 4321")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4321)]" in read._jdf.queryExecution().toString()
    assert read.count() == 1
    assert any(b"BLOOM" in f.read_bytes() or f.stat().st_size for f in path.glob("*.orc"))


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    token_files.write_token_files(none, str(tmp_path / "t"), PATH, end_id=2)
    assert token_files.token_digests(token_files.read_token_files(spark, str(tmp_path / "t"))).count() == 0
    assert packing.pack_documents(none, PATH, 0).count() == 0
    assert sharding.place(none, "doc_id", ["a"]).count() == 0


@pytest.mark.parametrize("capacity", [8, 1024])
def test_packing_keeps_every_id_once(spark, tokenizer, capacity):
    docs = spark.createDataFrame([r for r in rows() if r[0] != 3 and r[0] != 501], SCHEMA).repartition(2)
    pieces = packing.pack_documents(docs, PATH, 0, capacity, keep_ids=True).collect()
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t, *_ in rows() if i not in (3, 501)}
    for doc, ids in want.items():
        mine = sorted((p for p in pieces if p["doc_id"] == doc), key=lambda p: p["start"])
        assert [i for p in mine for i in p["ids"]] == ids
        assert all(p["doc_tokens"] == len(ids) and p["ids_crc32"] == crc(p["ids"]) and p["length"] == len(p["ids"]) for p in mine)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append(p)
    for members in sequences.values():
        at = 0
        for p in sorted(members, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    total = sum(map(len, want.values()))
    assert len(sequences) * capacity - total < 2 * capacity  # less than one sequence per task


def test_assign_balances_cost_and_wastes_less_than_one_sequence():
    random.seed(9)
    for _ in range(200):
        lengths = [random.randint(1, 100) for _ in range(random.randint(1, 60))]
        cuts = packing.assign(lengths, 100)
        assert len({c[3] for c in cuts}) <= -(-sum(lengths) // 100)
        for piece, n in enumerate(lengths):
            mine = sorted(c for c in cuts if c[0] == piece)
            assert [c[1] for c in mine] == [sum(c[2] for c in mine[:k]) for k in range(len(mine))] and sum(c[2] for c in mine) == n
    even = packing.assign([50] * 20, 100)
    assert all(sum(1 for c in even if c[3] == s) == 2 for s in range(10))


def test_lookup_table_is_even_and_stable():
    shards = [f"s{k}" for k in range(16)]
    table = sharding.fill_table(shards)
    counts = [table.count(k) for k in range(16)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == sharding.TABLE_SIZE
    fewer = sharding.fill_table(shards[:-1])
    moved = sum(a != b for a, b in zip(table, fewer) if a != 15)
    assert moved < 0.15 * sharding.TABLE_SIZE
    with pytest.raises(ValueError):
        sharding.fill_table(["a", "a"])
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 10)


def test_placement(spark):
    docs = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (2, None)], "doc_id long, _k string")
    got = {(r["doc_id"], r["_k"]): r["shard"] for r in sharding.place(docs, "doc_id", ["a", "b"]).collect()}
    assert len(got) == 4 and got[(1, "x")] == got[(1, "y")] and got[(None, "z")] is None and got[(2, None)] in ("a", "b")
    with pytest.raises(ValueError):
        sharding.place(docs.withColumn("slot", F.lit(1)), "doc_id", ["a"])


def test_tasks_of_a_worker_share_an_encoder():
    held = {}
    for texts in (["one two three", "two  three"], ["three four", "one five", ""]):
        encoder = kept_encoder(held, PATH, kept=3)
        ids, lengths = encoder.encode(pa.array(texts, pa.large_string()), 2)
        fresh_ids, fresh_lengths = Encoder(PATH).encode(pa.array(texts, pa.large_string()), 2)
        assert ids.tolist() == fresh_ids.tolist() and lengths.tolist() == fresh_lengths.tolist()
        assert kept_encoder(held, PATH) is encoder


def test_an_encoder_that_is_full_keeps_the_parts_used_most():
    encoder = Encoder(PATH, kept=40, often=True)
    rng = random.Random(3)
    often = [f"common{k}" for k in range(10)]
    for turn in range(12):
        texts = [" ".join([*often, *(f"rare{rng.random()}" for _ in range(4)), rng.choice(often)]) for _ in range(3)] + [f"opening{turn} common1", ""]
        ids, lengths = encoder.encode(pa.array(texts, pa.large_string()), 2)
        fresh_ids, fresh_lengths = Encoder(PATH).encode(pa.array(texts, pa.large_string()), 2)
        assert ids.tolist() == fresh_ids.tolist() and lengths.tolist() == fresh_lengths.tolist()
        assert set(often[1:]) <= set(encoder.later)
    assert len(encoder.later) + len(encoder.opening) < 100 and len(encoder.lengths) == len(encoder.uses)
