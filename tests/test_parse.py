import pytest

from pyspark.sql import functions as F

from folio.operators import kb, ordered, parse

PAIRS = """防风  荆芥  各9g  未分类
相须药对
麻黄  桂枝  各10g  发汗解表
黄芪  茯苓  各15g
相使药对
黄芪  茯苓  各15g  益气利水  余
麻黄  桂枝  各6g  重订
桂枝  麻黄  各3g  反序
   
知母  黄柏  各9g  不读"""

FORMULAS = """1.桂枝汤方　附注
桂枝三两  芍药三两  甘草二两
右五味，以水七升，微火煮取三升。

2.麻黄汤
麻黄三两　　桂枝二两
先煮麻黄，以水九升。
又方加减
甘草一两"""


def lines(spark, *texts):
    docs = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, text string")
    return parse.text_lines(docs, "text")


def parsed_pairs(spark, **options):
    return parse.section_rows(lines(spark, PAIRS), ["相须药对", "相使药对"], **options)


def test_section_rows(spark):
    got = sorted(tuple(r)[1:] for r in parsed_pairs(spark).collect())
    assert got == [
        (0, "防风", "荆芥", "各9g", "未分类", "", None),
        (2, "麻黄", "桂枝", "各10g", "发汗解表", "相须药对", None),
        (3, "黄芪", "茯苓", "各15g", None, "相须药对", "fewer than 4 fields"),
        (5, "黄芪", "茯苓", "各15g", "益气利水", "相使药对", None),
        (6, "麻黄", "桂枝", "各6g", "重订", "相使药对", None),
        (7, "桂枝", "麻黄", "各3g", "反序", "相使药对", None),
    ]


def test_reading_on_after_a_blank_line(spark):
    got = {r.line_no: r.type for r in parsed_pairs(spark, stop_on_blank=False).collect()}
    assert got[9] == "相使药对" and 8 not in got


def test_strict_reading_raises(spark):
    with pytest.raises(ValueError, match="fewer than 4 fields"):
        parse.require_clean(parsed_pairs(spark))


def test_upsert_of_parsed_pairs(spark):
    rows = parse.accepted(parsed_pairs(spark))
    base = kb.kb_upsert(None, rows, ["line_no"])
    got = {(r.medicine_a, r.medicine_b): r for r in base.collect()}
    assert len(got) == 4
    assert (got["麻黄", "桂枝"].dosage, got["麻黄", "桂枝"].function) == ("各6g", "重订")
    assert got["麻黄", "桂枝"].type == "相使药对"
    again = kb.kb_upsert(base, rows, ["line_no"])
    assert sorted(again.select(*sorted(again.columns)).collect()) == sorted(base.select(*sorted(base.columns)).collect())


def test_upsert_keeps_id_and_untouched_rows(spark):
    target = spark.createDataFrame(
        [("t1", "a", "b", "old", "old", "old"), ("t2", "c", "d", "keep", "keep", "keep")], kb.SCHEMA
    )
    rows = spark.createDataFrame(
        [("n1", "a", "b", "x", "x", "x", 1), ("n2", "b", "a", "y", "y", "y", 2), ("n3", "b", "a", "z", None, "z", 3)],
        kb.SCHEMA + ", seq int",
    )
    got = sorted(tuple(r) for r in kb.kb_upsert(target, rows, ["seq"]).collect())
    assert got == [
        ("n2", "b", "a", "z", None, "z"),
        ("t1", "a", "b", "x", "x", "x"),
        ("t2", "c", "d", "keep", "keep", "keep"),
    ]


def test_lookup_with_a_pair_that_fills_a_third(spark, monkeypatch):
    from folio.operators import skew

    monkeypatch.setattr(skew, "HOT_KEYS", 2)
    keys = [("hot", "hot")] * 50 + [(f"k{i}", f"k{i}") for i in range(100)]
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "n int, medicine_a string, medicine_b string")
    base = spark.createDataFrame(
        [(f"id-{a}", a, b, "", "", "") for a, b in sorted(set(keys)) if a != "k7"], kb.SCHEMA
    )
    hot = skew.hot_keys(rows, kb.KEY, 2)
    got = {r.n: r.id for r in skew.lookup(rows, base, kb.KEY, hot=hot).collect()}
    assert got == {i: f"id-{a}" for i, (a, _) in enumerate(keys) if a != "k7"}
    left = {r.n: r.id for r in skew.lookup(rows, base, kb.KEY, "left", hot=hot).collect()}
    assert len(left) == 150 and left[57] is None


def test_formulas(spark):
    got = {r.formula_no: r for r in parse.formula_parse(lines(spark, FORMULAS)).collect()}
    assert got[1].name == "桂枝汤方"
    assert got[1].ingredients == ["桂枝三两", "芍药三两", "甘草二两"]
    assert got[1].methods == ["右五味，以水七升，微火煮取三升。"]
    assert got[2].name == "麻黄汤方"
    assert got[2].ingredients == ["麻黄三两", "桂枝二两", "甘草一两"]
    assert got[2].methods == ["先煮麻黄，以水九升。"]


def test_formula_qa(spark):
    qa = {r.formula_no: r for r in parse.formula_qa(parse.formula_parse(lines(spark, FORMULAS))).collect()}
    assert qa[2].input == "方剂组成：麻黄三两\n桂枝二两\n甘草一两\n制备方法：先煮麻黄，以水九升。"
    assert qa[2].output == "方剂名称：麻黄汤方"


def test_lines_before_the_first_header_are_rejects(spark):
    items = parse.formula_items(lines(spark, "题记方\n甘草一两\n" + FORMULAS))
    assert [(r.line_no, r.reject) for r in parse.rejected(items).collect()] == [(1, "before the first header")]
    assert parse.formula_parse(lines(spark, "题记方\n甘草一两\n" + FORMULAS)).count() == 2


def test_formula_without_items_is_kept(spark):
    got = parse.formula_parse(lines(spark, "1.空方\n2.甲方")).collect()
    assert sorted((r.name, r.ingredients, r.methods) for r in got) == [("甲方", [], []), ("空方", [], [])]


def test_qa_extract(spark):
    rows = [
        ("方剂组成：A\nB\n制备方法：M", "方剂名称：N"),
        ("方剂组成：A", "方剂名称：N"),
        ("制备方法：M 方剂组成：A", "方剂名称：N"),
        ("方剂组成：A制备方法：M", "N"),
        (None, "方剂名称：N"),
        ("", "方剂名称：N"),
    ]
    out = parse.qa_extract(spark.createDataFrame(rows, "input string, output string"))
    assert sorted(tuple(r) for r in parse.accepted(out).collect()) == [("A", "N"), ("AB", "N")]
    assert sorted(r.reject for r in parse.rejected(out).collect()) == ["missing value", "no name marker"]


@pytest.mark.parametrize("block_rows", [1, 3, 7, 1000])
def test_scan_does_not_depend_on_blocks(spark, block_rows):
    from pyspark.sql import functions as F

    data = [(p, n, f"t{n}" if n % 5 == 2 else f"r{n}") for p in ("x", "y") for n in range(-2, 30) if n != 4]
    df = spark.createDataFrame(data, "p string, n int, v string")
    title = F.col("v").startswith("t")
    got = ordered.scan_ordered(
        df, ["p"], "n", latest={"last": F.when(title, F.col("v"))}, running_count={"seen": title},
        first_seq={"first": F.col("n") > 10}, block_rows=block_rows,
    )
    rows = {(r.p, r.n): r for r in got.collect()}
    assert len(rows) == len(data)
    for p, n, _ in data:
        titles = [m for q, m, v in data if q == p and m <= n and v.startswith("t")]
        assert rows[p, n].last == (f"t{max(titles)}" if titles else None)
        assert rows[p, n].seen == len(titles)
        assert rows[p, n].first == 11


@pytest.mark.parametrize("block_rows", [1, 4, 100])
def test_cumulative_text_does_not_depend_on_blocks(spark, block_rows):
    df = spark.createDataFrame([("s", i, chr(97 + i)) for i in range(20)], "s string, n int, c string")
    got = {r.n: r.t for r in ordered.cumulative_text(df, ["s"], "n", "c", "t", block_rows).collect()}
    assert got == {i: "".join(chr(97 + j) for j in range(i + 1)) for i in range(20)}


def test_row_index_follows_the_order(spark):
    df = spark.range(0, 5000, numPartitions=7).selectExpr("id", "5000 - id AS k")
    got = ordered.with_row_index(df, ["k"], "n", start=10).collect()
    assert sorted((r.k, r.n) for r in got) == [(i + 1, i + 10) for i in range(5000)]


def test_sparse_numbers_do_not_make_a_block_each(spark):
    rows = spark.createDataFrame([("g", k * 10**9, k) for k in range(500)], "g string, seq long, v int")
    blocks = ordered._in_blocks(rows, ["g"], "seq", 100).select("_block").distinct().count()
    assert blocks == 5
    got = ordered.scan_ordered(rows, ["g"], "seq", running_count={"n": F.col("v") % 2 == 0}, block_rows=100)
    assert [r.n for r in got.orderBy("seq").collect()] == [k // 2 + 1 for k in range(500)]


def test_formulas_of_short_files_take_one_shuffle(spark):
    plan = parse.formula_parse(lines(spark, FORMULAS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_long_and_short_groups_are_scanned_alike(spark):
    data = [(g, n, n % 3 == 1) for g, size in (("long", 40), ("short", 5), (None, 4)) for n in range(size)]
    rows = spark.createDataFrame(data, "g string, n int, v boolean")
    got = ordered.scan_ordered(
        rows, ["g"], "n", latest={"last": F.when(F.col("v"), F.col("n"))}, running_count={"seen": F.col("v")},
        first_seq={"first": F.col("v") & (F.col("n") > 3)}, block_rows=7,
    )
    found = {(r.g, r.n): (r.last, r.seen, r.first) for r in got.collect()}
    assert len(found) == len(data)
    for g, n, _ in data:
        assert found[g, n] == ((n - 1) // 3 * 3 + 1 if n else None, (n + 2) // 3, None if g is None else 4)
