"""Line dedup and the Jaccard join against plain brute force; the pipeline; SQL comparison."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm import components, jaccard, line_dedup, oracles, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(oracles.ORACLES))
def test_same_rows_as_sql(spark, name):
    n, difference = oracle.compare(spark, oracle.duck(SF_DIR), queries.QUERIES[name], oracles.ORACLES[name], SF_DIR)
    assert not difference and n > 0


# ---------------------------------------------------------------- lines


def half(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def brute_repeats(docs, run=50, gram=25):
    """Runs along the diagonals of first places, document by document."""
    lines = {}
    for doc_id, text in docs:
        if text is None:
            continue
        doc = (doc_id is not None, doc_id or 0, half(text))
        kept = [(k, s) for k, s in ((k, p.strip(line_dedup.SPACE)) for k, p in enumerate(text.split("\n"))) if s]
        lines[doc] = [(k, half(s), len(re.split(f"[{line_dedup.SPACE}]+", s))) for k, s in kept]
    selected = set()
    for doc, rows in lines.items():
        grams = []
        for i in range(len(rows)):
            total, j = 0, i
            while j < len(rows) and total < gram:
                total += rows[j][2]
                j += 1
            grams.append((half(",".join(str(r[1]) for r in rows[i:j])), i, j) if total >= gram else None)
        for i in range(len(rows)):
            total, j = 0, i
            while j < len(rows) and total < run:
                total += rows[j][2]
                j += 1
            if total >= run:
                least = min(g for g in grams[i:j] if g and g[2] <= j)
                selected.add((doc, least[1], least[0]))
    first = {}
    for doc, pos, g in sorted(selected):
        first.setdefault(g, (doc, pos))
    gone = {}
    for doc, pos, g in selected:
        other, at = first[g]
        if (other, at) >= (doc, pos):
            continue
        shift, run_lines = at - pos, []
        for k, row in enumerate(lines[doc] + [(None, None, 0)]):
            if row[0] is not None and 0 <= k + shift < len(lines[other]) and lines[other][k + shift][1] == row[1]:
                run_lines.append(row)
            else:
                if sum(r[2] for r in run_lines) >= gram:
                    gone.setdefault(doc, set()).update(r[0] for r in run_lines)
                run_lines = []
    return {(d[1] if d[0] else None, d[2]): v for d, v in gone.items()}


def made_documents():
    random.seed(12)
    vocabulary = [f"w{k}" for k in range(300)]
    pool = [" ".join(random.choice(vocabulary) for _ in range(random.choice([3, 8, 20, 60]))) for _ in range(40)]
    docs = []
    for k in range(120):
        own = [" ".join(random.choice(vocabulary) for _ in range(random.choice([2, 10, 30]))) for _ in range(random.randint(0, 5))]
        at = random.randint(0, 35)
        shared = pool[at : at + random.randint(0, 5)]
        cut = random.randint(0, len(own))
        docs.append((k, "\n".join([*own[:cut], *shared, *random.choice([[], [""], [" \t"]]), *own[cut:]])))
    long = "\n".join(pool * 30)
    return [*docs, (5, docs[7][1]), (9, docs[9][1]), (None, docs[11][1]), (200, None), (201, ""), (202, long), (203, "  " + docs[13][1])]


def brute_runs(docs, run=50):
    """Lines of each run of ``run`` words or more that occurs earlier anywhere, by document."""
    lines = {}
    for doc_id, text in docs:
        if text is not None:
            kept = [(k, s) for k, s in ((k, p.strip(line_dedup.SPACE)) for k, p in enumerate(text.split("\n"))) if s]
            lines[(doc_id is not None, doc_id or 0, half(text))] = [(k, s, len(s.split())) for k, s in kept]
    places = [(doc, a) for doc in sorted(lines) for a in range(len(lines[doc]))]
    gone = {}
    for n in range(1, max(map(len, lines.values())) + 1):
        seen = set()
        for doc, a in places:
            some = lines[doc][a : a + n]
            if len(some) == n and sum(r[2] for r in some) >= run:
                key = tuple(r[1] for r in some)
                if key in seen:
                    gone.setdefault((doc[1] if doc[0] else None, doc[2]), set()).update(r[0] for r in some)
                seen.add(key)
    return gone


def brute_deleted(docs):
    want = {}
    for found in (brute_runs(docs), brute_repeats(docs)):
        for doc, v in found.items():
            want.setdefault(doc, set()).update(v)
    return want


def test_line_dedup_equals_its_definition(spark):
    docs = [d for d in made_documents() if d[0] != 202]
    frame = spark.createDataFrame([(*d, "x", k) for k, d in enumerate(docs)], "doc_id long, text string, _doc string, line_no int").repartition(5)
    want = brute_deleted(docs)
    got = line_dedup.delete_repeats(frame).collect()
    assert len(got) == len(docs)
    by_row = {r["line_no"]: r for r in got}
    for k, (doc_id, text) in enumerate(docs):
        gone = want.get((doc_id, half(text)), set()) if text is not None else set()
        assert by_row[k]["deleted_lines"] == sorted(gone)
        left = None if text is None else "\n".join(p for n, p in enumerate(text.split("\n")) if n not in gone)
        assert by_row[k]["text"] == left
    assert any(want.values())


def test_a_long_text_that_repeats_itself_keeps_each_passage_once(spark):
    docs = made_documents()
    got = {r["doc_id"]: r for r in line_dedup.delete_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    long = next(t for i, t in docs if i == 202)
    kept = [p for p in got[202]["text"].split("\n") if p]
    assert len(kept) <= len(set(long.split("\n"))) and len(got[202]["deleted_lines"]) + len(kept) == len(long.split("\n"))


def test_every_earlier_run_is_found(spark):
    random.seed(31)
    line = lambda n: " ".join(f"t{random.randint(0, 10**6)}" for _ in range(n))
    docs = [d for d in made_documents() if d[0] != 202]
    for k in range(1000, 1120, 3):
        x, y, ends = line(30), line(30), [line(49), "and", line(9)]
        docs += [(k, f"{x}\n{line(40)}"), (k + 1, "\n".join([line(7), x, y, line(60), *ends])), (k + 2, "\n".join([*ends, line(8), x, "", y, line(60)]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {(r["doc"][0], r["doc"][1]): set(r["lines"]) for r in line_dedup.find_repeats(frame).collect()}
    assert got == brute_deleted(docs)
    diagonals_only = brute_repeats(docs)
    assert any(v - set(diagonals_only.get(d, ())) for d, v in got.items() if (d[0] or 0) >= 1000)


def test_shared_passages_are_found_and_clean_documents_stay(spark):
    random.seed(3)
    line = lambda n: " ".join(f"t{random.randint(0, 10**6)}" for _ in range(n))
    passage, split_up = line(51), "\n".join(line(13) for _ in range(4))
    docs = [(k, "\n".join([line(30), passage if k % 2 else split_up, line(9)])) for k in range(40)]
    clean = [(100 + k, "\n".join([line(30), "a short line that many share", line(30)])) for k in range(20)]
    got = {r["doc_id"]: r for r in line_dedup.delete_repeats(spark.createDataFrame(docs + clean, "doc_id long, text string")).collect()}
    assert all(len(got[k]["deleted_lines"]) == (0 if k < 2 else 1 if k % 2 else 4) for k in range(40))
    assert all(got[d]["text"] == t for d, t in clean)


def test_line_dedup_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.delete_repeats(none).count() == 0
    with pytest.raises(ValueError):
        line_dedup.delete_repeats(none.withColumn("deleted_lines", F.lit(1)))


# ---------------------------------------------------------------- sets


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def brute_groups(docs):
    sets, parent = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(docs)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    groups = {}
    for k in range(len(docs)):
        groups.setdefault(find(k), []).append(docs[k][0])
    return sets, [find(k) for k in range(len(docs))], groups


def brute_components(docs):
    sets, root, groups = brute_groups(docs)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return [(docs[k][0], len(sets[k]), least[root[k]]) for k in range(len(docs))]


def near_documents():
    random.seed(21)
    words = [f"v{k}" for k in range(400)]
    docs = []
    for n in [5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 18, 20, 30, 60, 60, 200]:
        base = [random.choice(words) for _ in range(n)]
        for _ in range(14):
            copy = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
                what, at = random.randint(0, 2), random.randint(0, len(copy) - 1)
                copy[at : at + (what > 0)] = [] if what == 2 and len(copy) > 5 else [random.choice(words)]
            docs.append(" ".join(copy))
    shared = " ".join(random.choice(words) for _ in range(40))
    docs += [shared + " " + " ".join(random.choice(words) for _ in range(random.randint(5, 60))) for _ in range(40)]
    docs += ["one", "One", "one two", "one two", "", " \n", "ONE TWO three", "z " * 30, "z " * 50, "big " * 3 + " ".join(words * 60)]
    random.shuffle(docs)
    rows = [(k * 3, t) for k, t in enumerate(docs)]
    return [*rows, (None, rows[4][1]), (None, None), (9, rows[20][1]), (12, rows[4][1]), (12, rows[4][1])]


@pytest.mark.parametrize(("short_list", "frequent", "block"), [(8, 200_000, 2_000_000), (2, 0, 400), (3, 40, 100)])
def test_components_equal_brute_force(spark, monkeypatch, short_list, frequent, block):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short_list)
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    docs = near_documents()
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, key string").repartition(3)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(frame).collect()]
    assert sorted(got, key=repr) == sorted(brute_components(docs), key=repr)


@pytest.mark.parametrize("boundary", [1, 3, 6, 9, 12])
def test_any_boundary_gives_the_same(spark, monkeypatch, boundary):
    monkeypatch.setattr(jaccard, "choose_boundary", lambda sizes: boundary)
    docs = [d for d in near_documents() if len((d[1] or "").split()) < 22]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(frame).collect()]
    assert sorted(got, key=repr) == sorted(brute_components(docs), key=repr)


def test_forest_connects_all_links():
    random.seed(5)
    for _ in range(150):
        n = random.randint(2, 25)
        sets = [np.array(sorted(random.sample(range(14), random.randint(1, 12))), np.uint64) for _ in range(n)]
        tree = list(range(n))

        def find(k, tree=tree):
            while tree[k] != k:
                k = tree[k]
            return k

        for a, b in jaccard.forest(sets):
            assert find(a) != find(b)
            tree[find(a)] = find(b)
        for a, b in itertools.combinations(range(n), 2):
            common = len(set(sets[a]) & set(sets[b]))
            if 100 * common >= 75 * len(set(sets[a]) | set(sets[b])):
                assert find(a) == find(b)


def test_forest_tests_sets_put_off_in_a_tree_that_is_outgrown():
    core = list(range(300))
    k, j = [*core, *range(1000, 1080)], [*core, *range(2000, 2020)]
    a = [[*k, *range(3000, 3040), 5000 + i] for i in range(6)]
    b = [[*j, *range(4000, 4050), 6000 + i] for i in range(7)]
    sets = [np.array(sorted(s), np.uint64) for s in [*a, k, *b, j]]
    edges = jaccard.forest(sets)
    assert len(edges) == len(sets) - 1  # k and j link, so all are one group


def test_forest_of_many_sets_that_share_little_is_quick():
    rng = np.random.default_rng(1)
    sets = [np.sort(np.append(rng.integers(10, 1 << 60, 10), [1, 2, 3]).astype(np.uint64)) for _ in range(16_000)]
    began = time.process_time()
    assert jaccard.forest(sets) == []
    assert time.process_time() - began < 5  # well below the seconds that comparing all pairs takes


def test_boundary_follows_cost():
    assert jaccard.choose_boundary({}) == 1
    assert jaccard.choose_boundary({4: 1000}) >= 4
    assert jaccard.choose_boundary({12: 1000}) < 12
    for s in range(1, 13):
        for b in range(s, 13):
            members = np.arange(s, dtype=np.uint64)
            assert len(jaccard.subset_keys(members, b)) == jaccard.subset_rows(s, b)


def test_one_of_each_group_stays(spark):
    docs = near_documents()
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, _rep string").repartition(4)
    kept = jaccard.keep_one(frame)
    assert kept.columns == frame.columns
    got = kept.collect()
    sets, root, _ = brute_groups(docs)
    assert sum(1 for r in got if shingles(r["text"])) == len({r for s, r in zip(sets, root) if s})
    assert sum(1 for r in got if not shingles(r["text"])) == sum(1 for s in sets if not s)
    assert jaccard.keep_one(frame.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(f"c{k:03}", f"c{k + 1:03}") for k in range(60)] + [("s000", f"s{k:03}") for k in range(1, 50)] + [("x", "x"), ("p", "q"), ("q", "p")]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    want = {f"c{k:03}": "c000" for k in range(1, 61)} | {f"s{k:03}": "s000" for k in range(1, 50)} | {"q": "p"}
    assert got == want
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).toPandas(), docs.schema)
        assert docs.columns == columns
        assert docs.filter("n_chars <> length(text)").count() == 0
        assert 0.5 * before < docs.count() <= before
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert all(i == c for i, _, c in brute_components(rows))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert len(pieces) == len(rows) and all(p["n"] == p["all"] for p in pieces)
    assert corpus_pipeline.run(spark, SF_DIR).select("doc_id").distinct().count() == len(rows)


def test_pipeline_stages_on_odd_rows(spark):
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, " \n", "en", "s", 2), (3, "w", None, None, 1), (3, "w", None, None, 1), (4, "many words " * 30_000, "en", "s", 0)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, SF_DIR).columns == docs.columns
            stage(spark, rows, SF_DIR).collect()
        corpus_pipeline.STAGES[-1][1](spark, rows, SF_DIR).collect()
