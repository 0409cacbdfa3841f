"""Token arrays: truncate, pad, mask and collate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from folio import constants as K
from folio.functions import arrays as A
from folio.operators.ordered import with_row_index
from folio.plugins import Tokenize


def tokenize(df: DataFrame, text: str, out: str, tokenizer: Tokenize | None = None) -> DataFrame:
    """Add token ids. The default stays in the JVM; a given tokenizer runs on Arrow batches."""
    if tokenizer is None:
        return df.withColumn(out, A.word_ids(F.col(text)))
    run = F.pandas_udf(lambda batch: tokenizer(batch), T.ArrayType(T.IntegerType()))
    return df.withColumn(out, run(F.col(text)))


def pad_mask(
    df: DataFrame, ids: str, target_ids: str, max_len: int, pad_id: int = 0, mask: bool = True
) -> DataFrame:
    """Fixed-length ``input_ids, attention_mask, labels`` in place of the two id columns."""
    length = F.lit(max_len)
    labels = A.right_pad(A.truncate(F.col(target_ids), max_len), length, pad_id)
    others = [c for c in df.columns if c not in (ids, target_ids)]
    return df.select(
        *others,
        A.right_pad(A.truncate(F.col(ids), max_len), length, pad_id).alias("input_ids"),
        A.attention(A.truncate(F.col(ids), max_len), length).alias("attention_mask"),
        (A.mask_value(labels, pad_id) if mask else labels).alias("labels"),
    )


def tokenize_pad_mask(
    df: DataFrame,
    text: str,
    target: str,
    max_len: int,
    pad_id: int = 0,
    mask: bool = True,
    tokenizer: Tokenize | None = None,
) -> DataFrame:
    """Tokenise, truncate, pad on the right, and build labels.

    With ``mask`` every label equal to the pad id becomes the ignored label, a real
    token of that value included.
    """
    same = text == target
    out = tokenize(df, text, "_ids", tokenizer)
    out = out.withColumn("_target", F.col("_ids")) if same else tokenize(out, target, "_target", tokenizer)
    return pad_mask(out.drop(text, target), "_ids", "_target", max_len, pad_id, mask)


def collate_batches(
    df: DataFrame,
    ids: str,
    order: list[str],
    batch_rows: int = K.BATCH_ROWS,
    multiple: int = K.PAD_MULTIPLE,
    pad_id: int = 0,
) -> DataFrame:
    """Batches of consecutive rows, each padded to its longest row, rounded up."""
    numbered = with_row_index(df, order, "_row").withColumn(
        "batch_id", F.floor(F.col("_row") / F.lit(batch_rows))
    )
    longest = F.max(F.size(ids)).over(Window.partitionBy("batch_id"))
    length = (F.ceil(longest / F.lit(multiple)) * multiple).cast("int")
    padded = A.right_pad(F.col(ids), F.col("_len"), pad_id)
    others = [c for c in df.columns if c != ids]
    return numbered.withColumn("_len", length).select(
        *others,
        "batch_id",
        padded.alias("input_ids"),
        A.attention(F.col(ids), F.col("_len")).alias("attention_mask"),
        A.right_pad(F.col(ids), F.col("_len"), K.IGNORED_LABEL).alias("labels"),
    )
