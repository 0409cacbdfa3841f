"""Question/answer datasets: splits, paraphrases, templates and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from folio import constants as K
from folio.functions import prompts, text as X
from folio.functions.rows import unroll
from folio.plugins import Complete

SPLIT_HEX_DIGITS = 4  # 65,536 buckets


def _split_hash(keys: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def split_exact(
    df: DataFrame, keys: list[str], percent: int = K.HOLDOUT_PERCENT, seed: int = K.SPLIT_SEED
) -> DataFrame:
    """Add ``split``: exactly ⌈percent·n⌉ rows are 'validation', the rest 'train'.

    Rows are ordered by a hash of their (unique) key. The hash also deals them into
    equal buckets, so bucket sizes tell where the cut lies, and only the one bucket it
    falls into has to be ordered. All other rows are decided without a shuffle.
    """
    h = df.withColumn("_h", _split_hash(keys, seed)).withColumn(
        "_bucket", F.conv(F.substring("_h", 1, SPLIT_HEX_DIGITS), 16, 10).cast("int")
    )
    # At most 65,536 rows, however large the input.
    sizes = h.groupBy("_bucket").count()
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cuts = sizes.select(
        "_bucket",
        (F.sum("count").over(upto) - F.col("count")).alias("_before"),
        F.col("count").alias("_n"),
        F.ceil(F.sum("count").over(every) * percent / F.lit(100)).alias("_quota"),
    )
    placed = h.join(F.broadcast(cuts), "_bucket")
    inside = (F.col("_before") < F.col("_quota")) & (F.col("_before") + F.col("_n") > F.col("_quota"))
    clear = placed.filter(~inside).withColumn("_val", F.col("_before") < F.col("_quota"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", *keys))
    mixed = placed.filter(inside).withColumn("_val", F.col("_before") + rank <= F.col("_quota"))
    return clear.unionByName(mixed).select(
        *df.columns, F.when(F.col("_val"), "validation").otherwise("train").alias("split")
    )


def split_hash(
    df: DataFrame, keys: list[str], percent: int = K.HOLDOUT_PERCENT, seed: int = K.SPLIT_SEED
) -> DataFrame:
    """Add ``split`` by hash alone: about ``percent`` validation rows, no shuffle at all."""
    bucket = F.conv(F.substring(_split_hash(keys, seed), 1, 7), 16, 10).cast("int") % 100
    return df.withColumn("split", F.when(bucket < percent, "validation").otherwise("train"))


def union_splits(**splits: DataFrame) -> DataFrame:
    """One DataFrame with a ``split`` column out of several."""
    parts = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def dataset_summary(df: DataFrame, required: list[str]) -> DataFrame:
    """Row count and column names per split."""
    names = ",".join(c for c in df.columns if c != "split")
    return (
        require_columns(df, required)
        .groupBy("split")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("columns", F.lit(names))
    )


def completion_prompts(df: DataFrame, text: str = "input") -> DataFrame:
    return df.withColumn("prompt", prompts.paraphrase_prompt(F.col(text)))


def run_completion(df: DataFrame, complete: Complete, prompt: str = "prompt") -> DataFrame:
    """Add ``response``. Rows whose call fails get NULL; the others go on.

    ``complete`` takes a pandas Series of prompts; it is loaded once per Python worker.
    """

    @F.pandas_udf(T.StringType())
    def call(batch):
        try:
            return complete(batch)
        except Exception:
            # Find the rows at fault one by one, so that the rest of the batch is kept.
            return batch.map(lambda p: _try_one(complete, p))

    return df.withColumn("response", call(F.col(prompt)))


def _try_one(complete: Complete, prompt: str) -> str | None:
    import pandas as pd

    try:
        return complete(pd.Series([prompt])).iloc[0]
    except Exception:
        return None


def expand_variants(df: DataFrame, response: str = "response") -> DataFrame:
    """The original (variant 0) and each numbered item of the response.

    The marker in front of the answer is cut off by its length. Rows without a
    response give nothing.
    """
    items = X.numbered_items(X.remove(F.col(response), "\n", " "))
    variants = F.concat(F.array("input"), items)
    others = [c for c in df.columns if c not in ("input", "output", response, "prompt")]
    answer = F.substring(F.col("output"), F.lit(len(K.NAME_MARK) + 1), F.length("output"))
    answered = df.filter(F.col(response).isNotNull())
    return unroll(answered, [*others, answer.alias("output")], variants, "variant_no", "input")


def template_augment(
    df: DataFrame, keys: list[str], copies: int = K.TEMPLATE_COPIES, seed: int = K.SPLIT_SEED
) -> DataFrame:
    """``copies`` rewordings per row, plus the formatted chat text of each.

    Which wording a copy gets depends on the seed, the row's key and the copy number
    only. Question and answer are chosen independently.
    """
    others = [c for c in df.columns if c not in ("input", "output")]
    row = [F.col(k) for k in keys]

    def choice(templates: list[str], salt: str) -> Column:
        return X.hash_number(F.lit(f"{salt}{seed}"), *row, F.col("copy_no")) % F.lit(len(templates))

    def wording(templates: list[str], chosen: str, value: str) -> Column:
        c = F.col(chosen)
        out = F.when(c == 0, X.fill(templates[0], F.col(value)))
        for i, template in enumerate(templates[1:], 1):
            out = out.when(c == i, X.fill(template, F.col(value)))
        return out

    copied = df.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    chosen = copied.select(
        "*",
        choice(K.INPUT_TEMPLATES, "in").alias("_in"),
        choice(K.OUTPUT_TEMPLATES, "out").alias("_out"),
    )
    worded = chosen.select(
        *others,
        "copy_no",
        wording(K.INPUT_TEMPLATES, "_in", "input").alias("input"),
        wording(K.OUTPUT_TEMPLATES, "_out", "output").alias("output"),
    )
    return worded.withColumn("formatted", prompts.training_chat(F.col("input"), F.col("output")))


def chat_template(messages: DataFrame, conv: str, turn: str, role: str, text: str, system: str | None = None) -> DataFrame:
    """One prompt per conversation: its messages in order and the assistant's opening.

    With ``system``, a conversation whose first message is not the system's begins with it.
    """
    m = F.array_sort(
        F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")))
    )
    prompt = prompts.chat_prompt(m)
    if system is not None:
        opened = F.concat(F.lit(f"<|im_start|>system\n{system}<|im_end|>\n"), prompt)
        prompt = F.when(F.get(m, F.lit(0))["role"] == "system", prompt).otherwise(opened)
    return messages.groupBy(conv).agg(prompt.alias("prompt"))
