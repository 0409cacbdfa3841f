import json
import time

import pytest

from folio.operators import retrieve
from folio.operators.answers import answer_assemble, message_log
from folio.plans import standins as S
from folio.sinks import files as sink_files, tables, text_index
from folio.sources import files
from folio.streaming import jobs
from folio.streaming.answers import assemble_stream

CHUNKS = [
    ("a", 0, "Question: x"),
    ("a", 1, "Answer: he"),
    ("a", 2, "llo"),
    ("b", 0, "zz"),
    ("b", 1, "yAnswer:1Answer:2"),
    ("b", 2, "!"),
    ("c", 0, "Ans"),
    ("c", 1, "wer: lost"),
    ("d", 0, "Answer:p"),
    ("d", 1, "q Answer:r"),
]
ANSWERS = {"a": " hello", "b": "1!", "c": "", "d": "pr"}


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf8")


def test_batch_answers(spark):
    df = spark.createDataFrame(CHUNKS, "session_id string, seq int, chunk string").repartition(4)
    got = {r.session_id: r.answer for r in answer_assemble(df, "session_id", "seq", "chunk").collect()}
    assert got == ANSWERS


@pytest.mark.parametrize("cuts", [[10], [2, 8], [1, 3, 6], [1] * 10])
def test_streamed_answers_equal_batch(spark, tmp_path, cuts):
    """Chunks of a session arrive in order, cut into micro-batches in several ways."""
    source, out, at = tmp_path / "in", str(tmp_path / "out"), 0
    for i, n in enumerate(cuts):
        rows = [dict(zip(("session_id", "seq", "chunk"), c)) for c in CHUNKS[at : at + n]]
        put(source, f"{i}.json", list(reversed(rows)))
        at += n
        stream = assemble_stream(files.stream_chunks(spark, str(source)), bounded=True)
        jobs.drain(jobs.write_answers(stream, out, str(tmp_path / "state")))
    snapshots = spark.read.parquet(out).collect()
    assert len(snapshots) == min(at, len(CHUNKS))
    last = {}
    for r in sorted(snapshots, key=lambda r: r.seq):
        last[r.session_id] = r.answer
    done = {s for s, _, _ in CHUNKS[:at]}
    assert last == {s: ANSWERS[s] for s in done} or at < len(CHUNKS)
    assert {r.answer for r in snapshots if r.session_id == "a"} == {"", " he", " hello"} or at < 3


def test_last_chunk_clears_the_session(spark, tmp_path):
    source = tmp_path / "in"
    schema = "session_id string, seq int, chunk string, is_last boolean"
    rows = [("s", 0, "Answer:a", False), ("s", 1, "b", True), ("s", 2, "Answer:c", False)]
    for i, r in enumerate(rows):
        put(source, f"{i}.json", [dict(zip(("session_id", "seq", "chunk", "is_last"), r))])
        stream = assemble_stream(files.stream_chunks(spark, str(source), schema))
        jobs.drain(jobs.write_answers(stream, str(tmp_path / "out"), str(tmp_path / "state")))
    got = {r.seq: r.answer for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: "a", 1: "ab", 2: "c"}


def test_idle_session_starts_anew(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    put(source, "0.json", [{"session_id": "s", "seq": 0, "chunk": "Answer:a"}])
    stream = assemble_stream(files.stream_chunks(spark, str(source)), idle_ms=1)
    query = jobs.write_answers(stream, out, str(tmp_path / "state"), every="500 milliseconds")
    try:
        until = time.time() + 60
        while (query.lastProgress or {}).get("batchId", 0) < 2 and time.time() < until:
            time.sleep(0.2)
        put(source, "1.json", [{"session_id": "s", "seq": 1, "chunk": "Answer:b"}])
        seen = {}
        while 1 not in seen and time.time() < until:
            time.sleep(0.5)
            seen = {r.seq: r.answer for r in spark.read.schema("session_id string, seq int, answer string").parquet(out).collect()}
    finally:
        query.stop()
    assert seen == {0: "a", 1: "b"}


def test_bytes_cut_inside_a_character(spark, tmp_path):
    source, raw = tmp_path / "in", "xAnswer:麻黄汤".encode()
    cuts = [raw[:9], raw[9:12], raw[12:16], raw[16:]]
    schema = "session_id string, seq int, chunk binary"
    for some in ([0, 1], [2, 3]):
        part = spark.createDataFrame([("s", i, cuts[i]) for i in some], schema)
        part.write.mode("append").parquet(str(source))
        answers = assemble_stream(spark.readStream.schema(schema).parquet(str(source)), bounded=True)
        jobs.drain(jobs.write_answers(answers, str(tmp_path / "out"), str(tmp_path / "state")))
    got = {r.seq: r.answer for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    assert got[3] == "麻黄汤"


def test_streamed_kb(spark, tmp_path):
    source, root = tmp_path / "books", str(tmp_path / "kb")
    source.mkdir()
    step = lambda: jobs.drain(jobs.load_kb(files.stream_books(spark, str(source)), root, str(tmp_path / "ck"), ["T"]))
    (source / "1.txt").write_text("T\na  b  1  x\nc  d  1  x\n", encoding="utf8")
    step()
    first = {(r.medicine_a, r.medicine_b): r for r in tables.read_version(spark, root).collect()}
    (source / "2.txt").write_text("a  b  2  y\n\nc  d  2  y\n", encoding="utf8")
    step()
    second = {(r.medicine_a, r.medicine_b): r for r in tables.read_version(spark, root).collect()}
    assert tables.current_version(spark, root) == 2
    assert second["a", "b"].dosage == "2" and second["a", "b"].type == "" and second["a", "b"].id == first["a", "b"].id
    assert second["c", "d"] == first["c", "d"]


def test_streamed_requests(spark, tmp_path):
    source = tmp_path / "requests"
    put(source, "1.json", [{"request_id": 1, "value": '{"question":"清热","model":"Qwen/reader-large"}'}])
    put(source, "2.json", [{"request_id": 2, "value": '{"question":"x","model":"none"}'}])
    base = spark.createDataFrame([(1, "t", "知母", "黄柏", "9g", "清热")], "id int, type string, medicine_a string, medicine_b string, dosage string, function string")
    jobs.drain(
        jobs.answer_requests(
            files.stream_requests(spark, str(source)), S.models(spark), base, str(tmp_path / "out"), str(tmp_path / "ck"), text="function"
        )
    )
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.request_id, r.prompt[:27]) for r in got] == [(1, "Context: 't  知母  黄柏  9g  清热")]


def test_requests_are_answered_from_a_growing_index(spark, tmp_path):
    source, root, out = tmp_path / "requests", str(tmp_path / "index"), str(tmp_path / "out")
    rows = [(1, "t", "知母", "黄柏", "9g", "清热 泻火"), (2, "t", "麻黄", "桂枝", "6g", "发汗 清热 解表")]
    base = spark.createDataFrame(rows, "id int, type string, medicine_a string, medicine_b string, dosage string, function string")
    ask = '{"question":"清热 解表","model":"reader-large"}'

    def run():
        arriving = files.stream_requests(spark, str(source))
        jobs.drain(jobs.answer_from_index(arriving, S.models(spark), base, root, out, str(tmp_path / "ck"), text="function"))

    text_index.append_texts(spark, root, base.filter("id = 1"), text="function")
    put(source, "1.json", [{"request_id": 1, "value": ask}, {"request_id": 2, "value": "{"}])
    run()
    text_index.append_texts(spark, root, base.filter("id = 2"), text="function")
    put(source, "2.json", [{"request_id": 3, "value": ask}, {"request_id": 4, "value": '{"question":"x","model":"none"}'}])
    run()
    prompts = {r.request_id: r.prompt for r in spark.read.parquet(f"{out}/prompts").collect()}
    assert set(prompts) == {1, 3} and "麻黄" not in prompts[1] and "麻黄" in prompts[3] and "知母" in prompts[3]
    assert {(r.request_id, r.reject) for r in spark.read.parquet(f"{out}/rejects").collect()} == {(2, "malformed"), (4, "no such model")}
    assert {(r.batch, r.version) for r in spark.read.json(f"{out}/versions").collect()} == {(0, 1), (1, 2)}


def test_an_index_is_made_ready_once_for_the_micro_batches_that_take_it(spark, tmp_path, monkeypatch):
    source, root, out = tmp_path / "requests", str(tmp_path / "index"), str(tmp_path / "out")
    rows = [(1, "t", "知母", "黄柏", "9g", "清热 泻火"), (2, "t", "麻黄", "桂枝", "6g", "发汗 清热 解表")]
    base = spark.createDataFrame(rows, "id int, type string, medicine_a string, medicine_b string, dosage string, function string")
    for k in range(4):
        put(source, f"{k}.json", [{"request_id": k, "value": '{"question":"清热 解表","model":"reader-large"}'}])
    text_index.append_texts(spark, root, base.filter("id = 1"), text="function")
    monkeypatch.setattr(retrieve, "HOT_TOKENS", 0)  # so that an index has a table of its own
    made, asked, read_index, base_version = [], [], text_index.read_index, tables.base_version

    def counted(spark, root, version):
        made.append(version)
        return read_index(spark, root, version)

    def growing(spark, versions, note):
        asked.append(note)
        if len(asked) == 3:
            text_index.append_texts(spark, root, base.filter("id = 2"), text="function")
        return base_version(spark, versions, note)

    monkeypatch.setattr(text_index, "read_index", counted)
    monkeypatch.setattr(tables, "base_version", growing)
    arriving = spark.readStream.schema("request_id long, value string").option("maxFilesPerTrigger", 1).json(str(source))
    jobs.drain(jobs.answer_from_index(arriving, S.models(spark), base, root, out, str(tmp_path / "ck"), text="function"))
    assert made == [1, 2] and len(asked) == 4
    prompts = {r.batch: r.prompt for r in spark.read.parquet(f"{out}/prompts").collect()}
    assert ["麻黄" in prompts[k] for k in range(4)] == [False, False, True, True]
    assert all("知母" in p for p in prompts.values())


def test_scratch_tables_do_not_add_up_over_micro_batches(spark, tmp_path):
    from pathlib import Path

    from folio.session import checkpoint_dir

    place = Path(checkpoint_dir(spark).removeprefix("file:"))
    source, root = tmp_path / "books", str(tmp_path / "kb")
    before = {p.name for p in place.iterdir()}
    for k in range(5):
        (source / f"{k}").mkdir(parents=True)
        (source / f"{k}" / "b.txt").write_text(f"ECONOMY\na{k}  b  9g  use\na  b  {k}g  use\n", encoding="utf8")
        jobs.drain(jobs.load_kb(files.stream_books(spark, str(source)), root, str(tmp_path / "ck"), ["ECONOMY"], keep=2))
    assert {p.name for p in place.iterdir()} == before
    got = {r.medicine_a: r.dosage for r in tables.read_version(spark, root).collect()}
    assert got == {"a": "4g"} | {f"a{k}": "9g" for k in range(5)}
    assert len(list((tmp_path / "kb").glob("v*"))) == 2


def test_frames(spark, tmp_path):
    put(tmp_path / "in", "1.json", [{"session_id": "s", "seq": 0, "chunk": "a\nb"}])
    for sse, frame in [(True, "data: a\nb\n\n"), (False, "a\nb")]:
        out = str(tmp_path / f"out-{sse}")
        jobs.drain(
            sink_files.stream_frames(files.stream_chunks(spark, str(tmp_path / "in")), "chunk", out, out + "-ck", sse)
        )
        assert [r.frame for r in spark.read.json(out).collect()] == [frame]


def test_message_log_keeps_both_sides(spark):
    q = spark.createDataFrame([("c", 0, "q0"), ("c", 1, "q1")], "conv string, at int, text string")
    a = spark.createDataFrame([("c", 0, "a0"), ("c", 1, "a1")], "conv string, at int, text string")
    got = sorted((r.position, r.sender, r.text) for r in message_log(q, a, "conv", "at").collect())
    assert got == [(0, "user", "q0"), (1, "bot", "a0"), (2, "user", "q1"), (3, "bot", "a1")]


def test_streamed_kb_goes_on_from_the_current_version(spark, tmp_path):
    """A root that holds versions already keeps their pairs, also after a restart."""
    root, source, state = str(tmp_path / "kb"), tmp_path / "in", str(tmp_path / "state")
    for name in "ab":
        rows = spark.createDataFrame([(f"i{name}", name, name, "1", "f", "t", 1)], "id string, medicine_a string, medicine_b string, dosage string, function string, type string, seq int")
        tables.publish_upsert(spark, root, rows, ["seq"])
    source.mkdir()
    for number, name in enumerate("cd"):
        (source / f"{name}.txt").write_text(f"T\n{name}  {name}  2  g", encoding="utf8")
        jobs.drain(jobs.load_kb(files.stream_books(spark, str(source)), root, state, ["T"]))
        assert tables.current_version(spark, root) == 3 + number
    assert sorted(r.medicine_a for r in tables.read_version(spark, root).collect()) == ["a", "b", "c", "d"]


def test_upsert_leaves_out_missing_keys(spark):
    from folio.operators import kb

    rows = spark.createDataFrame([(None, "x", "1", "f", "t", 1), ("x", None, "1", "f", "t", 2), ("x", "y", "1", "f", "t", 3)], "medicine_a string, medicine_b string, dosage string, function string, type string, seq int")
    once = kb.kb_upsert(None, rows, ["seq"])
    assert kb.kb_upsert(once, rows, ["seq"]).count() == 1
    assert [r.reject for r in kb.key_rejects(rows).collect()] == ["missing key"] * 2


def test_request_rejects(spark):
    from folio.operators import rag

    values = ["{bad", '{"model":"m"}', '{"question":"  "}', None, "", '{"question":"q"}', '{"question":"q","external_db":"x"}']
    raw = spark.createDataFrame(list(enumerate(values)), "request_id int, value string")
    faults = {r.request_id: r.reject for r in rag.request_rejects(raw).collect()}
    assert faults == {0: "malformed", 1: "no question", 2: "blank question", 3: "malformed", 4: "malformed"}
    assert sorted((r.request_id, r.external_db) for r in rag.parse_requests(raw).collect()) == [(5, True), (6, True)]


def test_streamed_answers_of_a_folder_table(spark, tmp_path):
    """A table of many part files is streamed like one file, over several micro-batches."""
    from folio.plans import catalogue

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(20, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.answers_streamed(spark, str(tmp_path))
    want = catalogue.answer_assemble(spark, str(tmp_path))
    assert got.count() == docs.count() and got.exceptAll(want.select(got.columns)).count() == 0


def test_a_stream_without_an_end_is_refused(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with pytest.raises(ValueError, match="never end"):
        assemble_stream(files.stream_chunks(spark, str(tmp_path / "in")))


def test_one_snapshot_per_batch(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    for i, part in enumerate((CHUNKS[:5], CHUNKS[5:])):
        put(source, f"{i}.json", [dict(zip(("session_id", "seq", "chunk"), c)) for c in part])
        stream = assemble_stream(files.stream_chunks(spark, str(source)), every_chunk=False, bounded=True)
        jobs.drain(jobs.write_answers(stream, out, str(tmp_path / "state")))
    rows = spark.read.parquet(out).collect()
    assert sorted((r.session_id, r.seq) for r in rows) == [("a", 2), ("b", 1), ("b", 2), ("c", 1), ("d", 1)]
    assert {r.session_id: r.answer for r in sorted(rows, key=lambda r: r.seq)} == ANSWERS
