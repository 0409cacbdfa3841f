"""Completions that can be taken up again: a folder of runs, each with what it asked.

A run asks every distinct prompt that has no response yet and has not been asked
``attempts`` times. It is complete once Spark has written its _SUCCESS file; one that
broke off is written again under the same number, and only what it asked is asked anew.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from folio.plugins import Complete
from folio.session import scratch, write_once
from folio.sinks.tables import current_version, version_path

_RUN = "prompt string, response string, reject string"


def _ask(complete: Complete):
    """Responses and errors of a batch. A batch that fails is halved, so that one bad row
    does not have all the others asked again one by one."""
    def call(batch: pd.Series) -> list[tuple[str | None, str | None]]:
        if not len(batch):
            return []
        try:
            return [(r, None) if r is not None else (None, "no response") for r in complete(batch)]
        except Exception as error:
            if len(batch) == 1:
                return [(None, f"{type(error).__name__}: {error}")]
            half = len(batch) // 2
            return call(batch.iloc[:half]) + call(batch.iloc[half:])

    @F.pandas_udf("response string, reject string")
    def run(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(call(batch), columns=["response", "reject"])

    return run


def results(spark: SparkSession, root: str) -> DataFrame:
    """(prompt, response, reject, attempts) of every prompt that was asked: its response, or
    the error of its last attempt."""
    runs = [spark.read.schema(_RUN).parquet(version_path(root, n)).withColumn("run", F.lit(n)) for n in range(1, current_version(spark, root) + 1)]
    if not runs:
        return spark.createDataFrame([], f"{_RUN}, attempts long")
    asked = runs[0]
    for run in runs[1:]:
        asked = asked.unionByName(run)
    last = F.max_by(F.struct("response", "reject"), "run").alias("_last")
    return asked.groupBy("prompt").agg(last, F.count("*").alias("attempts")).select("prompt", "_last.*", "attempts")


def complete_missing(prompts: DataFrame, root: str, complete: Complete, prompt: str = "prompt", attempts: int = 3) -> int:
    """Ask what is missing among ``prompts``; the number of the run. Null prompts are not asked."""
    spark = prompts.sparkSession
    number = current_version(spark, root) + 1
    with scratch(spark):
        settled = results(spark, root).filter(F.col("response").isNotNull() | (F.col("attempts") >= attempts))
        wanted = prompts.select(F.col(prompt).alias("prompt")).filter("prompt IS NOT NULL").distinct()
        missing = write_once(wanted.join(settled, "prompt", "left_anti"))
        # Plugged-in functions need not give the same answer twice, so they run once, for the file.
        answered = missing.withColumn("_a", _ask(complete).asNondeterministic()(F.col("prompt")))
        answered.select("prompt", "_a.response", "_a.reject").write.mode("overwrite").parquet(version_path(root, number))
    return number


def with_responses(df: DataFrame, root: str, prompt: str = "prompt") -> DataFrame:
    """``df`` with ``response``, ``reject`` and ``attempts``; a prompt not asked yet has no attempts."""
    held = results(df.sparkSession, root).withColumnRenamed("prompt", prompt)
    return df.join(held, prompt, "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)).cast("int"))
