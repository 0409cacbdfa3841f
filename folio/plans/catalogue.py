"""The registered queries: ``name -> f(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folio import constants as K
from folio.functions import arrays as A, prompts, text as X
from folio.functions.rows import unroll
from folio.operators import answers, chunk, dataset, kb, ordered, parse, pruned, rag, retrieve, tokens, vocabulary
from folio.plans import standins as S
from folio.session import checkpoint_dir, delete_at_end, write_once
from folio.sinks import completions, files as csv_files, tables, text_index
from folio.sources import books, files
from folio.streaming import jobs
from folio.streaming.answers import assemble_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# ---------------------------------------------------------------- text and chunks


@query
def corpus_lines(spark, d):
    return parse.text_lines(S.table(spark, d, "documents").select("doc_id", "text"), "text")


@query
def chunk_fixed(spark, d):
    return chunk.chunk_fixed(S.table(spark, d, "documents").select("doc_id", "text"), "text")


@query
def chunk_recursive(spark, d):
    return chunk.chunk_recursive(S.table(spark, d, "documents").select("doc_id", "text"), "text")


@query
def chunk_append_ids(spark, d):
    existing = S.table(spark, d, "benchmark").count()
    numbered = ordered.with_row_index(chunk_fixed(spark, d), ["doc_id", "chunk_no"], "n", start=existing + 1)
    return numbered.select(F.col("n").cast("string").alias("id"), "doc_id", "chunk_no", "chunk")


@query
def pages_text(spark, d):
    return S.table(spark, d, "pages").select("page_id", "url", X.markup_to_text(F.col("html")).alias("text"))


@query
def book_text(spark, d):
    docs = S.table(spark, d, "documents")
    pages = docs.select(
        F.concat(F.lit("/books/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".v1.pdf")).alias(
            "path"
        ),
        F.lit(0).alias("page_no"),
        F.col("text").alias("page_content"),
    )
    done = S.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("stem")).distinct()
    return books.book_text(books.not_extracted(pages, done), chunk.fixed_chunks)


# ---------------------------------------------------------------- parsers and knowledge base


@query
def section_rows(spark, d):
    return parse.accepted(parse.section_rows(S.pair_lines(spark, d), S.PART_TITLES))


@query
def section_rejects(spark, d):
    return parse.rejected(parse.section_rows(S.pair_lines(spark, d), S.PART_TITLES)).select(
        "path", "line_no", "medicine_a", "medicine_b", "dosage", "type", "reject"
    )


@query
def kb_upsert(spark, d):
    return kb.kb_upsert(S.pair_kb(spark, d), S.pair_rows(spark, d, "in-", S.SECOND_LOAD), ["seq"])


@query
def kb_lookup(spark, d):
    part = S.table(spark, d, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("medicine_a"), F.col("p_brand").alias("medicine_b")
    )
    rows = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, "l_partkey")
    # Both sides are read more than once, for the frequent keys and for the others.
    return kb.kb_lookup(write_once(rows), write_once(S.all_types_kb(spark, d))).select(
        "l_orderkey", "l_linenumber", "l_partkey", "id", "dosage", "type"
    )


@query
def formula_parse(spark, d):
    return parse.formula_parse(S.formula_lines(spark, d))


@query
def formula_rejects(spark, d):
    return parse.rejected(parse.formula_items(S.formula_lines(spark, d))).select("path", "line_no", "line", "reject")


@query
def formula_qa(spark, d):
    return parse.formula_qa(formula_parse(spark, d))


def _damaged_qa(spark, d):
    """The question/answer rows, four of five with something missing."""
    case = F.col("formula_no") % 5
    q, a = F.col("input"), F.col("output")
    return formula_qa(spark, d).select(
        "path",
        "formula_no",
        F.when(case == 1, X.remove(q, K.METHODS_MARK)).when(case == 2, F.lit("")).otherwise(q).alias("input"),
        F.when(case == 3, X.remove(a, K.NAME_MARK)).when(case == 4, F.lit(None)).otherwise(a).alias("output"),
    )


@query
def qa_extract(spark, d):
    return parse.accepted(parse.qa_extract(_damaged_qa(spark, d)))


@query
def qa_rejects(spark, d):
    return parse.rejected(parse.qa_extract(_damaged_qa(spark, d))).select("path", "formula_no", "reject")


# ---------------------------------------------------------------- datasets


@query
def split_exact(spark, d):
    return dataset.split_exact(S.table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"])


@query
def split_hash(spark, d):
    return dataset.split_hash(S.table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"])


@query
def dataset_summary(spark, d):
    docs = dataset.split_hash(S.table(spark, d, "documents").select("doc_id", "text"), ["doc_id"])
    return dataset.dataset_summary(docs, ["text"])


def _benchmark_qa(spark, d):
    return S.table(spark, d, "benchmark").select(
        "item_id",
        F.col("text").alias("input"),
        F.concat(F.lit(K.NAME_MARK), F.lit("方"), F.col("item_id").cast("string")).alias("output"),
    )


@query
def completion_prompts(spark, d):
    return dataset.completion_prompts(_benchmark_qa(spark, d)).select("item_id", "prompt")


def _fails_from(remainder):
    """A completer that fails for some prompts, by their hash."""

    def complete(batch):
        digests = [hashlib.md5(p.encode()).hexdigest() for p in batch]
        if any(int(h[:7], 16) % 4 >= remainder for h in digests):
            raise ValueError("busy")
        return batch.map(lambda p: hashlib.md5(p.encode()).hexdigest())

    return complete


@query
def completions_resumed(spark, d):
    """Three runs over the same prompts; each asks what the ones before did not get."""
    root = _work(spark, "completions")
    rows = completion_prompts(spark, d)
    for remainder in (1, 2, 3):
        completions.complete_missing(rows, root, _fails_from(remainder))
    delete_at_end(spark, root)
    return completions.with_responses(rows, root).select("item_id", "response", "reject", "attempts")


@query
def expand_variants(spark, d):
    t = F.col("input")
    response = F.concat(F.lit("1."), t, F.lit("\n2. "), F.replace(t, F.lit('e'), F.lit('E')), F.lit("3两\n10."), F.reverse(t))
    answered = _benchmark_qa(spark, d).withColumn("response", F.when(F.col("item_id") % 7 != 6, response))
    return dataset.expand_variants(answered)


@query
def template_augment(spark, d):
    return dataset.template_augment(_benchmark_qa(spark, d), ["item_id"])


@query
def chat_template(spark, d):
    return dataset.chat_template(S.table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


# ---------------------------------------------------------------- token arrays


@query
def tokenize_pad_mask(spark, d):
    """One text as input and label, padding masked, length 512."""
    rows = S.table(spark, d, "conversations").select("conv_id", "turn", "text")
    return tokens.tokenize_pad_mask(rows, "text", "text", 512)


@query
def tokenize_prompt_unmasked(spark, d):
    """A question as input, the name as label, padding left in the labels, length 128."""
    qa = formula_qa(spark, d).withColumn("prompt", prompts.name_question(F.col("input"))).drop("input")
    return tokens.tokenize_pad_mask(qa, "prompt", "output", 128, mask=False)


@query
def tokenize_pair_masked(spark, d):
    """Question as input, answer as label, padding masked, length 128."""
    return tokens.tokenize_pad_mask(formula_qa(spark, d), "input", "output", 128)


@query
def vocabulary_ranks(spark, d):
    """All words of the conversations with their counts; ids in order of frequency."""
    return vocabulary.fit_vocabulary(S.table(spark, d, "conversations"), "text")


VOCABULARY = 1_000


@query
def tokenize_vocabulary(spark, d):
    """Ids below ``VOCABULARY``, and the words that they turn back into."""
    rows = S.table(spark, d, "conversations").select("conv_id", "turn", "text")
    words = vocabulary.fit_vocabulary(rows, "text", size=VOCABULARY)
    ids = vocabulary.encode(rows, "text", words)
    back = vocabulary.decode(ids, "ids", words)
    return back.select("conv_id", "turn", "ids", F.array_join("words", " ", "?").alias("words"))


def _conversation_ids(spark, d):
    rows = S.table(spark, d, "conversations").select("conv_id", "turn", "text")
    return rows.select("conv_id", "turn", A.word_ids(F.col("text")).alias("ids"))


@query
def collate_batches(spark, d):
    return tokens.collate_batches(_conversation_ids(spark, d), "ids", ["conv_id", "turn"])


@query
def drop_prompt_prefix(spark, d):
    """Generated ids start with the prompt's ids; keep what follows."""
    rows = S.table(spark, d, "conversations")
    prompt = A.word_ids(F.concat(F.lit("role "), F.col("role")))
    both = rows.select("conv_id", "turn", prompt.alias("prompt"), A.word_ids(F.col("text")).alias("answer"))
    generated = F.concat("prompt", "answer")
    return both.select("conv_id", "turn", A.after_prefix(generated, F.col("prompt")).alias("answer_ids"))


# ---------------------------------------------------------------- requests and retrieval


def _work(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _requests(spark, d):
    return S.normalised(rag.parse_requests(S.raw_requests(spark, d)))


@query
def parse_requests(spark, d):
    return rag.parse_requests(S.raw_requests(spark, d))


@query
def request_rejects(spark, d):
    return rag.request_rejects(S.damaged_requests(spark, d))


@query
def route_requests(spark, d):
    return rag.route_requests(_requests(spark, d), S.models(spark))


@query
def route_rejects(spark, d):
    return rag.route_rejects(_requests(spark, d), S.models(spark))


@query
def near_vector(spark, d):
    """Neighbours of the first vector of each label, itself excluded."""
    e = S.table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    asked = e.groupBy("label").agg(F.min(F.struct(F.col("vec_id").alias("query_id"), "embedding")).alias("q"))
    found = retrieve.near_vector(
        asked.select("q.*"),
        e,
        query_vector="embedding",
        id="vec_id",
        vector="embedding",
        exclude_self=True,
    )
    return found.select("query_id", "vec_id", "rank")


@query
def near_vector_rows(spark, d):
    """Neighbours of every row whose id is divisible by 20, itself excluded."""
    e = S.table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = retrieve.near_vector(
        asked,
        e,
        query_vector="embedding",
        id="vec_id",
        vector="embedding",
        exclude_self=True,
    )
    return found.select("query_id", "vec_id", "rank")


@query
def near_vector_centroids(spark, d):
    """Vectors nearest to the mean vector of each label."""
    e = S.table(spark, d, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("x")
    )
    centroids = parts.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p.x).alias("vector")
    )
    found = retrieve.near_vector(centroids, e, query="label", id="vec_id", vector="embedding")
    return found.select("label", "vec_id", "rank")


def _asked(spark, d):
    return S.table(spark, d, "benchmark").select(F.col("item_id").alias("request_id"), F.col("text").alias("question"))


@query
def near_text(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    found = retrieve.near_text(_asked(spark, d), docs, query="request_id", id="doc_id")
    return found.select("request_id", "doc_id", "rank")


@query
def near_text_pairs(spark, d):
    """The same by letter pairs, the analyzer for text without spaces."""
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    found = retrieve.near_text(_asked(spark, d), docs, query="request_id", id="doc_id", analyzer="char2")
    return found.select("request_id", "doc_id", "rank")


@query
def near_text_pruned(spark, d):
    """The same answers, from blocks that can reach them."""
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    blocks = pruned.block_index(retrieve.index_text(docs, id="doc_id"))
    found = pruned.near_text_pruned(_asked(spark, d), blocks, query="request_id", id="doc_id").hits
    return found.select("request_id", "doc_id", "rank")


@query
def index_reused(spark, d):
    """The same answers, from an index saved with one half of the texts, to which the other was added."""
    root = _work(spark, "index")
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    for half in (0, 1):
        text_index.append_texts(spark, root, docs.filter(F.col("doc_id") % 2 == half), id="doc_id")
    delete_at_end(spark, root)
    found = retrieve.near_text(_asked(spark, d), text_index.read_index(spark, root), query="request_id", id="doc_id")
    return found.select("request_id", "doc_id", "rank")


@query
def rag_context(spark, d):
    base = S.document_kb(spark, d)
    hits = retrieve.near_text(_asked(spark, d), base, query="request_id", text="function")
    return rag.rag_context(hits, base)


@query
def rag_prompt(spark, d):
    routed = route_requests(spark, d)
    return rag.rag_prompt(routed, S.document_kb(spark, d), text="function").select(
        "request_id", "model", "external_db", "prompt"
    )


@query
def requests_streamed(spark, d):
    """Good, blank and damaged requests in four micro-batches, from a saved index; prompts and rejects."""
    work = _work(spark, "requests")
    base = S.document_kb(spark, d)
    for half in (0, 1):
        text_index.append_texts(spark, f"{work}/index", base.filter(F.col("id") % 2 == half), text="function")
    damaged = S.damaged_requests(spark, d).withColumn("request_id", F.col("request_id") + S.DAMAGED)
    S.raw_requests(spark, d).unionByName(damaged).repartition(4, "request_id").write.json(f"{work}/in")
    arriving = spark.readStream.schema("request_id long, value string").option("maxFilesPerTrigger", 1).json(f"{work}/in")
    jobs.drain(
        jobs.answer_from_index(arriving, S.models(spark), base, f"{work}/index", f"{work}/out", f"{work}/state", text="function")
    )
    delete_at_end(spark, work)
    prompts = spark.read.parquet(f"{work}/out/prompts").select("request_id", "model", "external_db", "prompt")
    rejects = spark.read.parquet(f"{work}/out/rejects").select("request_id", "reject")
    return prompts.unionByName(rejects, allowMissingColumns=True)


# ---------------------------------------------------------------- answers


DOCUMENT_MARK = "the"


@query
def answer_assemble(spark, d):
    return answers.answer_assemble(S.document_chunks(spark, d), "doc_id", "seq", "chunk", DOCUMENT_MARK)


@query
def cumulative_text(spark, d):
    return ordered.cumulative_text(S.document_chunks(spark, d), ["doc_id"], "seq", "chunk", "so_far").select(
        "doc_id", "seq", "so_far"
    )


@query
def byte_chunks_decoded(spark, d):
    """Texts cut every seven bytes, decoded chunk by chunk and put together again."""
    decoded = ordered.decode_chunks(S.byte_chunks(spark, d), ["doc_id"], "seq", "chunk", "text")
    return ordered.joined_text(decoded, ["doc_id"], ["seq"], "text", "text")


@query
def sse_frame(spark, d):
    return answers.sse_frames(S.document_chunks(spark, d), "chunk").select("doc_id", "seq", "frame")


@query
def chat_template_system(spark, d):
    """The same with a system turn before conversations that have none."""
    c = S.table(spark, d, "conversations")
    return dataset.chat_template(c, "conv_id", "turn", "role", "text", system=S.SYSTEM)


@query
def special_tokens(spark, d):
    """Chat prompts with their special tokens removed again."""
    return chat_template(spark, d).select("conv_id", X.drop_special_tokens(F.col("prompt")).alias("plain"))


@query
def message_log(spark, d):
    c = S.table(spark, d, "conversations")
    return answers.message_log(c.filter("role = 'user'"), c.filter("role <> 'user' OR role IS NULL"), "conv_id", "turn")


def _streamed(spark, d, every_chunk):
    """Rows of the stateful stream over the same chunks as ``answer_assemble``."""
    work = f"{checkpoint_dir(spark)}/answers-{uuid.uuid4().hex}"
    # A pattern, so that a table of one file and one of many are both read.
    docs = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 4).parquet(f"{d}/documents.parque[t]")
    chunks = unroll(docs, ["doc_id"], F.split("text", "\n"), "seq", "chunk")
    snapshots = assemble_stream(chunks, "doc_id", "seq", "chunk", DOCUMENT_MARK, every_chunk=every_chunk, bounded=True)
    jobs.drain(jobs.write_answers(snapshots, f"{work}/out", f"{work}/state"))
    delete_at_end(spark, work)
    return spark.read.schema("doc_id long, seq int, answer string").parquet(f"{work}/out")


@query
def answers_streamed(spark, d):
    """Final answers: the last snapshot of each session."""
    return _streamed(spark, d, False).groupBy("doc_id").agg(F.max_by("answer", "seq").alias("answer"))


@query
def answer_snapshots(spark, d):
    """The answer so far after each chunk."""
    return _streamed(spark, d, True).select("doc_id", "seq", "answer")


# ---------------------------------------------------------------- files and tables


@query
def kb_streamed(spark, d):
    """The first load in batch, then books of all types of the second one as a stream into the same versions."""
    root = _work(spark, "kb")
    tables.publish_upsert(spark, root, S.pair_rows(spark, d, "kb-", S.FIRST_LOAD), ["seq"], buckets=8)
    S.pair_books(spark, d).repartition("path").write.parquet(f"{root}/books")
    arriving = spark.readStream.schema("path string, text string").option("maxFilesPerTrigger", 3).parquet(f"{root}/books")
    jobs.drain(jobs.load_kb(arriving, root, f"{root}/checkpoint", S.SECOND_LOAD, keep=2))
    delete_at_end(spark, root)
    return tables.read_version(spark, root).select(*kb.KEY, *kb.VALUES)


@query
def csv_round_trip(spark, d):
    """Texts with white space and line breaks at both ends, empty and missing ones."""
    path = _work(spark, "csv")
    csv_files.write_csv(S.edged_messages(spark, d), path)
    delete_at_end(spark, path)
    return files.read_csv(spark, path, "conv_id long, turn long, role string, text string")


@query
def splits_loaded(spark, d):
    """Two CSV files read as the splits of one dataset."""
    work = _work(spark, "splits")
    items = S.table(spark, d, "benchmark")
    csv_files.write_csv(items.filter("item_id % 4 <> 0"), f"{work}/train")
    csv_files.write_csv(items.filter("item_id % 4 = 0"), f"{work}/validation")
    delete_at_end(spark, work)
    return files.load_splits(spark, f"{work}/train", f"{work}/validation", ["text"], "item_id long, text string")


@query
def books_round_trip(spark, d):
    """Books added to a store; the next run extracts what is not there yet."""
    folder = _work(spark, "books")
    docs = S.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("stem"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("body"))
    csv_files.write_books(docs.filter("doc_id % 3 = 0"), folder)
    csv_files.write_books(docs.join(csv_files.extracted_stems(spark, folder), "stem", "left_anti"), folder)
    delete_at_end(spark, folder)
    return csv_files.read_books(spark, folder)
