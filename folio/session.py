"""Session set-up and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "folio", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, skew joins)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a temporary folder, because there the driver is the only machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="folio-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside hands rows to Python at most ``rows`` at a time, for rows that hold whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_once(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet to the shared checkpoint folder and read it from there.

    For results that several later steps read: compressed, and read by column. It is
    deleted at the end of the innermost ``scratch`` of this thread, or of the application.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    scopes = _scopes.get(threading.get_ident())
    if scopes:
        scopes[-1].append(path)
    else:
        delete_at_end(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_scopes: dict[int, list[list[str]]] = {}  # by thread


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread writes with ``write_once`` inside are deleted on leaving.

    For work that ends in an output of its own, such as a micro-batch.
    """
    paths: list[str] = []
    try:
        with noted(paths):
            yield
    finally:
        for path in paths:
            delete_now(spark, path)


@contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """Tables that this thread writes with ``write_once`` inside are added to ``paths``; the
    caller deletes them. For what outlives a ``scratch`` that is open."""
    thread = threading.get_ident()
    _scopes.setdefault(thread, []).append(paths)
    try:
        yield
    finally:
        _scopes[thread].pop()
        if not _scopes[thread]:
            del _scopes[thread]


def delete_now(spark: SparkSession, path: str) -> None:
    """Delete a folder; nothing happens if it is not there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder that was written when the application ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
