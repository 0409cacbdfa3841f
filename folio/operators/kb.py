"""Knowledge base of medicine pairs: lookup and keyed upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folio.operators.skew import lookup

KEY = ["medicine_a", "medicine_b"]
VALUES = ["dosage", "function", "type"]
SCHEMA = "id string, medicine_a string, medicine_b string, dosage string, function string, type string"


def pair_id(a: Column, b: Column) -> Column:
    """Id of a new pair. Pairs are ordered: (a, b) is not (b, a); neither side is NULL."""
    return F.md5(F.concat_ws("\x1f", a, b))


def kb_lookup(rows: DataFrame, kb: DataFrame) -> DataFrame:
    """Join each row to the entry with exactly its pair."""
    return lookup(rows, kb, KEY)


def _has_key() -> Column:
    return F.col(KEY[0]).isNotNull() & F.col(KEY[1]).isNotNull()


def with_key(rows: DataFrame) -> DataFrame:
    """Rows that have both sides of their pair."""
    return rows.filter(_has_key())


def key_rejects(rows: DataFrame) -> DataFrame:
    """Rows that an upsert leaves out, because a side of their pair is NULL."""
    return rows.filter(~_has_key()).withColumn("reject", F.lit("missing key"))


def last_write_wins(rows: DataFrame, seq: list[str]) -> DataFrame:
    """One row per pair: values of its last row, id of its first row.

    Both are aggregates that combine before the shuffle, so a pair that fills a third
    of the input still sends one row per task.
    """
    order = F.struct(*seq)
    rows = with_key(rows)
    ids = F.col("id") if "id" in rows.columns else pair_id(F.col("medicine_a"), F.col("medicine_b"))
    return (
        rows.withColumn("id", ids)
        .groupBy(*KEY)
        .agg(F.max_by(F.struct(*VALUES), order).alias("new"), F.min_by("id", order).alias("id"))
    )


def kb_upsert(target: DataFrame | None, rows: DataFrame, seq: list[str]) -> DataFrame:
    """The knowledge base after applying ``rows`` in ``seq`` order.

    A known pair keeps its id and gets the new values; a new pair is added. If the target
    has a pair more than once, its first entry by id is updated and the others stay.
    """
    new = last_write_wins(rows, seq)
    if target is None:
        return new.select("id", *KEY, "new.*")
    # The join shuffles by the same keys, so the rank costs a sort and no shuffle.
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy("id")) == 1
    old = target.select(*KEY, F.col("id").alias("old_id"), F.struct(*VALUES).alias("old"), first.alias("_first"))
    value = F.when(F.coalesce("_first", F.lit(True)), F.coalesce("new", "old")).otherwise(F.col("old"))
    return (
        old.join(new, KEY, "full_outer")
        .withColumn("v", value)
        .select(F.coalesce("old_id", "id").alias("id"), *KEY, *[f"v.{c}" for c in VALUES])
    )
