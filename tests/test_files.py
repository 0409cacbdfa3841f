import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from folio.operators import kb
from folio.plugins import decode_utf8_pages
from folio.sinks import files as K, tables
from folio.sources import books, files


def test_lines_keep_order_over_splits(spark, tmp_path):
    texts = {"a.txt": [f" 行{i}　" for i in range(3000)], "b.txt": ["x", "", "y"]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\r\n".join(lines), encoding="utf8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {}
        for r in files.read_lines(spark, str(tmp_path)).collect():
            got.setdefault(r.path.rsplit("/", 1)[1], {})[r.line_no] = r.line
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, lines in texts.items():
        assert got[name] == {i: line.strip() for i, line in enumerate(lines)}


def test_csv_round_trip_and_append(spark, tmp_path):
    rows = [('多行\n"引"', "a,b"), ("x", "y"), (" x ", "\ty"), ("p\n", "\nq"), ("", "empty"), ('"', "\\"), (None, "none")]
    df = spark.createDataFrame(rows, "input string, output string")
    path = str(tmp_path / "t.csv")
    K.write_csv(df, path)
    K.write_csv(df, path, "append")
    assert sorted((tuple(r) for r in files.read_csv(spark, path, "input string, output string").collect()), key=repr) == sorted(rows * 2, key=repr)
    K.write_csv(df, path)
    assert files.read_csv(spark, path, "input string, output string").count() == len(rows)


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "t.csv").write_text('input,output\n"a\nb",c\n', encoding="utf-8-sig")
    got = files.read_csv(spark, str(tmp_path / "t.csv"), "input string, output string").collect()
    assert [tuple(r) for r in got] == [("a\nb", "c")]


def test_splits_must_exist_and_have_columns(spark, tmp_path):
    a, b = str(tmp_path / "train"), str(tmp_path / "val")
    spark.range(3).write.parquet(a)
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        files.load_splits(spark, a, b, ["id"])
    spark.range(2).write.parquet(b)
    assert files.load_splits(spark, a, b, ["id"]).groupBy("split").count().count() == 2
    with pytest.raises(ValueError, match="formatted"):
        files.load_splits(spark, a, b, ["formatted"])


def test_instructions(spark, tmp_path):
    (tmp_path / "i.jsonl").write_text('{"instruction":"a","output":"b"}\n', encoding="utf8")
    assert files.load_instructions(spark, str(tmp_path / "i.jsonl")).count() == 1


def test_books(spark, tmp_path):
    source, out = tmp_path / "books", str(tmp_path / "out")
    (source / "deep").mkdir(parents=True)
    long = "甲" * 600
    (source / "a.v1.pdf").write_text(f"第一页\f{long}", encoding="utf8")
    (source / "deep" / "b.pdf").write_text("乙", encoding="utf8")
    (source / "deep" / "a.pdf").write_text("同名", encoding="utf8")
    (source / "C.PDF").write_text("不读", encoding="utf8")

    def run():
        found = books.not_extracted(books.scan_books(spark, str(source)), K.extracted_stems(spark, out))
        pages = books.decode_pages(found, decode_utf8_pages)
        K.write_books(books.book_text(pages), out)
        return pages

    pages = run()
    assert {r.stem: r.body for r in K.read_books(spark, out).collect()} == {"a": "第一页" + long[:500] + long[450:], "b": "乙"}
    run()
    assert K.read_books(spark, out).count() == 2
    (source / "d.pdf").write_text("丁", encoding="utf8")
    run()
    assert {r.stem for r in K.extracted_stems(spark, out).collect()} == {"a", "b", "d"}
    assert pages.schema["metadata"].dataType.simpleString() == "map<string,string>"


def test_collections_grow(spark):
    name = "chunks_of_test"
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "n int, document string").withColumn(
        "metadata", F.create_map(F.lit("page"), F.col("n").cast("string"))
    )
    tables.append_chunks(spark, name, df, ["n"])
    tables.append_chunks(spark, name, df, ["n"])
    got = sorted((int(r.id), r.document) for r in spark.table(name).collect())
    assert got == [(i + 1, f"t{i % 20}") for i in range(40)]
    assert tables.ensure_table(spark, name, "id string").count() == 40
    spark.sql(f"DROP TABLE {name}")


def test_versions(spark, tmp_path):
    root = str(tmp_path / "kb")
    assert tables.current_version(spark, root) == 0 and tables.read_version(spark, root).count() == 0
    row = lambda v, n: spark.createDataFrame([("a", "b", v, v, v, n)], "medicine_a string, medicine_b string, dosage string, function string, type string, n int")
    assert tables.publish_upsert(spark, root, row("x", 1), ["n"]) == 1
    assert tables.publish_upsert(spark, root, row("y", 1), ["n"]) == 2
    assert tables.publish_upsert(spark, root, row("y", 1), ["n"], version=2) == 2
    assert [r.dosage for r in tables.read_version(spark, root).collect()] == ["y"]
    assert [r.dosage for r in tables.read_version(spark, root, 1).collect()] == ["x"]
    assert tables.read_version(spark, root).first().id == tables.read_version(spark, root, 1).first().id
    assert kb.kb_lookup(row("q", 1).drop("dosage", "function", "type"), tables.read_version(spark, root)).count() == 1


def test_book_store_has_files_of_many_books(spark, tmp_path):
    folder, out = tmp_path / "books", str(tmp_path / "books")
    assert K.extracted_stems(spark, out).count() == 0 and K.read_books(spark, out).count() == 0
    stems = ["a b", "x+y", "1.2", "書", *[f"s{k:03}" for k in range(200)]]
    bodies = spark.createDataFrame([(s, f"{s}\nbody\n" if s != "x+y" else None) for s in stems], "stem string, body string")
    K.write_books(bodies.coalesce(1), out, per_file=60)
    assert len(list(folder.glob("books/*/part-*"))) == 4  # 204 books
    index = {r.stem: r for r in K.book_index(spark, out).collect()}
    assert sorted(index) == sorted(stems) and index["書"].n_chars == 7
    assert len({(r.file, r.place) for r in index.values()}) == len(stems) and max(r.place for r in index.values()) == 59
    K.write_books(spark.createDataFrame([("new", "n")], "stem string, body string"), out)
    assert {r.stem: r.body for r in K.read_books(spark, out).collect()} == {s: f"{s}\nbody\n" if s != "x+y" else None for s in stems} | {"new": "n"}
    some = K.read_books(spark, out, spark.createDataFrame([("new",), ("1.2",), ("none",)], "stem string"))
    assert sorted((r.stem, r.body) for r in some.collect()) == [("1.2", "1.2\nbody\n"), ("new", "n")]
    assert len(some.inputFiles()) <= 2
    K.export_books(K.read_books(spark, out).filter("stem IN ('new', '書')"), str(tmp_path / "texts"))
    texts = spark.read.schema("value string, stem string").text(str(tmp_path / "texts")).collect()
    assert ("n", "new") in {(r.value, r.stem) for r in texts} and {r.stem for r in texts} == {"new", "書"}


def pairs(spark, names, value):
    rows = [(a, "x", value, value, "t", k) for k, a in enumerate(names)]
    return spark.createDataFrame(rows, "medicine_a string, medicine_b string, dosage string, function string, type string, n long")


def test_an_upsert_writes_the_buckets_it_touches(spark, tmp_path):
    folder, root = tmp_path / "kb", str(tmp_path / "kb")
    names = [f"m{k}" for k in range(400)]
    tables.publish_upsert(spark, root, pairs(spark, names, "old"), ["n"], buckets=16)
    assert len(list(folder.glob("data/v00000001/bucket=*"))) == 16
    tables.publish_upsert(spark, root, pairs(spark, ["m7", "new"], "new"), ["n"], buckets=99)
    assert 1 <= len(list(folder.glob("data/v00000002/bucket=*"))) <= 2
    got = {r.medicine_a: r.dosage for r in tables.read_version(spark, root).collect()}
    assert got == {n: "old" for n in names} | {"m7": "new", "new": "new"}
    assert tables.read_version(spark, root, 1).count() == 400
    for k in range(4):
        tables.publish_upsert(spark, root, pairs(spark, [f"m{k}"], f"v{k}"), ["n"])
    tables.prune_versions(spark, root, keep=2)
    assert sorted(p.name for p in folder.glob("v*")) == ["v00000005", "v00000006"]
    now = {r.medicine_a: r.dosage for r in tables.read_version(spark, root).collect()}
    assert now == got | {f"m{k}": f"v{k}" for k in range(4)}
    assert len(list(folder.glob("data/v*/bucket=*"))) <= 17  # 16 buckets, and the last one's state before
    tables.publish_upsert(spark, root, pairs(spark, [], "none"), ["n"])
    assert tables.read_version(spark, root).count() == 401


def test_tables_of_a_scratch_go_when_it_ends(spark):
    from pathlib import Path

    from folio.session import checkpoint_dir, scratch, write_once

    place = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(place.iterdir())
    with scratch(spark):
        kept = write_once(spark.range(5))
        with scratch(spark):
            write_once(spark.range(2))
            assert len(set(place.iterdir()) - before) == 2
        assert len(set(place.iterdir()) - before) == 1 and kept.count() == 5
    assert set(place.iterdir()) == before


def test_first_of_repeated_pairs_is_updated(spark):
    held = spark.createDataFrame([("2", "a", "b", "old", "f", "t"), ("1", "a", "b", "older", "f", "t"), ("3", "c", "d", "x", "f", "t")], kb.SCHEMA)
    got = sorted(tuple(r)[:4] for r in kb.kb_upsert(held, pairs(spark, ["a"], "new").withColumn("medicine_b", F.lit("b")), ["n"]).collect())
    assert got == [("1", "a", "b", "new"), ("2", "a", "b", "old"), ("3", "c", "d", "x")]


def test_intermediate_tables_go_at_the_end(spark):
    from folio.session import write_once

    assert write_once(spark.range(3)).count() == 3
