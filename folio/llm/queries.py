"""Registered queries of this subpackage: ``name -> f(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folio.llm import decontaminate, divergence, jaccard, language, line_dedup, lm, packing, pii, quality, sharding, token_files, toxicity, variants
from folio.session import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Where the vocabulary lies on every machine; a parameter of the operators.
TOKENIZER = os.environ.get("FOLIO_TOKENIZER", "")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def tokenizer_path() -> str:
    if TOKENIZER:
        return TOKENIZER
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontaminate(spark, d):
    found = decontaminate.find_hits(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
    n_hit = decontaminate.hit_words(F.col("hits"))
    ids = F.array_sort(F.transform("hits.items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "hits.n_words",
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query
def op2_token_files(spark, d):
    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, d, "documents"), path, tokenizer_path(), end_id=2)
    return token_files.token_digests(token_files.read_token_files(spark, path))


def _remainder(parts: int):
    """crc32 of the id's text, modulo ``parts``."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


@query
def op3_toxicity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    learned = table(spark, d, "labels").filter(_remainder(4) != 2)
    model = toxicity.fit_toxicity(docs, learned)
    judged = docs.select("doc_id", toxicity.toxicity(F.col("text"), model).alias("t"))
    return judged.select(
        "doc_id",
        F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"),
        "t.score",
        (F.col("t.score") >= toxicity.TOXIC_FROM).cast("int").alias("predicted"),
        F.size("t.passages").cast("long").alias("n_passages"),
    )


@query
def op4_language(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    model = language.fit_language(docs.filter(_remainder(3) != 1))
    judged = docs.select("doc_id", language.predict_language(F.col("text"), model).alias("p"))
    return judged.select(
        "doc_id",
        F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"),
        F.col("p.lang").alias("lang_pred"),
        "p.score",
        "p.rejected",
    )


@query
def op5_jaccard_join(spark, d):
    return jaccard.near_groups(table(spark, d, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op6_line_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    lines = F.size(F.split("text", "\n")).cast("long")
    counted = docs.withColumn("n_lines", F.coalesce(F.when(lines >= 0, lines), F.lit(0)))
    deleted = F.col("deleted_lines")
    return line_dedup.delete_repeats(counted).select(
        "doc_id",
        "n_lines",
        F.size(deleted).cast("long").alias("n_deleted"),
        F.array_join(F.transform(deleted, lambda k: k.cast("string")), ",").alias("deleted"),
        "text",
    )


LM_END = 50_256  # the vocabulary's own end of text
SHARDS = [f"shard-{k:02d}" for k in range(16)]


@query
def op7_sharding(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", SHARDS).select("doc_id", F.col("slot").cast("long").alias("slot"), "shard")


@query
def op8_packing(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), tokenizer_path(), end_id=0).drop("ids")


@query
def op9_pii(spark, d):
    found = table(spark, d, "documents").select("doc_id", pii.personal_data(F.col("text")).alias("found"))

    def count(kind):
        return F.size(F.filter("found.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in pii.KINDS],
        F.sha2(pii.span_text(F.col("found.base")), 256).alias("base_sha256"),
        pii.span_text(F.col("found.spans")).alias("spans"),
    )


@query
def op10_quality(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = quality.fit_rules(docs, table(spark, d, "labels"))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "anomaly", "kept"]
    judged = docs.select("doc_id", quality.rule_verdict(F.col("text"), model).alias("v"))
    return judged.select("doc_id", *[f"v.{c}" for c in columns])


@query
def op11_lm_scores(spark, d):
    docs = lm.encode_texts(table(spark, d, "documents"), tokenizer_path(), LM_END)
    model = lm.fit_lm(docs.filter(_remainder(7) != 2), tokenizer_path(), LM_END, ids="ids")
    held_out = F.coalesce(_remainder(7) == 2, F.lit(False)).alias("held_out")
    scored = lm.score_texts(docs, model, ids="ids")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op12_spelling_variants(spark, d):
    return variants.spelling_variants(table(spark, d, "documents"))


@query
def op13_divergence(spark, d):
    return divergence.source_divergence(table(spark, d, "documents"))
