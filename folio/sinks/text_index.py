"""Text indexes that outlive the session.

An index is a folder of immutable segments and of versions. A segment has the term counts
of the rows that were added with it, and how many of them have each token. A version is
a list of segments; it is complete once Spark has written its _SUCCESS file, and readers
take the newest complete one. Adding rows writes one segment and one version, and cuts
just the new texts into tokens. Document frequencies are added up when an index is
read, so answers are those of an index made in one go.

One writer at a time; readers of a version are not disturbed until it is pruned.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from folio.operators import retrieve
from folio.session import write_once
from folio.sinks.tables import current_version, version_path

_SEGMENT = "segment string, n long, analyzer string, id_type string"


def segments(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(segment, n, analyzer, id_type) of a version; no rows if there is none."""
    version = current_version(spark, f"{root}/versions") if version is None else version
    if version == 0:
        return spark.createDataFrame([], _SEGMENT)
    return spark.read.schema(_SEGMENT).json(version_path(f"{root}/versions", version))


def _publish(spark: SparkSession, root: str, rows: list[tuple]) -> int:
    version = current_version(spark, f"{root}/versions") + 1
    listed = spark.createDataFrame(rows, _SEGMENT).coalesce(1)
    listed.write.mode("overwrite").json(version_path(f"{root}/versions", version))
    return version


def _write_segment(spark: SparkSession, root: str, terms: DataFrame, analyzer: str) -> tuple:
    """Write term counts and their tokens' frequencies; the manifest's row."""
    name = f"segment-{uuid.uuid4().hex}"
    path = f"{root}/segments/{name}"
    terms.write.parquet(f"{path}/terms")
    written = spark.read.schema(terms.schema).parquet(f"{path}/terms")
    retrieve.token_frequencies(written).write.parquet(f"{path}/vocabulary")
    return name, written.count(), analyzer, terms.schema["id"].dataType.simpleString()


def append_texts(spark: SparkSession, root: str, base: DataFrame, *, id: str = "id", text: str = "text", analyzer: str = "word") -> int:
    """Add rows, whose ids must be new, as one segment; the number of the new version."""
    held = segments(spark, root).collect()  # a row for each segment; merge_segments keeps them few
    id_type = base.schema[id].dataType.simpleString()
    if any((s["analyzer"], s["id_type"]) != (analyzer, id_type) for s in held):
        raise ValueError(f"this index has {held[0]['id_type']} ids and the analyzer {held[0]['analyzer']}")
    terms = retrieve.term_counts(base.select(id, text), id, retrieve.ANALYZERS[analyzer](F.col(text)))
    return _publish(spark, root, [*map(tuple, held), _write_segment(spark, root, terms, analyzer)])


def _terms(spark: SparkSession, root: str, held: list) -> DataFrame:
    schema = f"id {held[0]['id_type']}, tokens array<string>, tfs array<int>"
    return spark.read.schema(schema).parquet(*[f"{root}/segments/{s['segment']}/terms" for s in held])


def read_index(spark: SparkSession, root: str, version: int | None = None) -> retrieve.TextIndex:
    """The index of a version, by default the newest; serves any number of query batches."""
    held = segments(spark, root, version).collect()
    if not held:
        raise ValueError(f"no index in {root}")
    parts = [spark.read.schema("token string, df long").parquet(f"{root}/segments/{s['segment']}/vocabulary") for s in held]
    vocabulary = parts[0]
    if len(parts) > 1:
        vocabulary = write_once(reduce(DataFrame.unionByName, parts).groupBy("token").agg(F.sum("df").alias("df")))
    return retrieve.make_index(_terms(spark, root, held), vocabulary, sum(s["n"] for s in held), held[0]["analyzer"])


def merge_segments(spark: SparkSession, root: str) -> int:
    """Make one segment of all; the number of the new version."""
    held = segments(spark, root).collect()
    if len(held) < 2:
        return current_version(spark, f"{root}/versions")
    return _publish(spark, root, [_write_segment(spark, root, _terms(spark, root, held), held[0]["analyzer"])])


def prune(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete all but the newest ``keep`` versions, and segments that none of these has."""
    newest = current_version(spark, f"{root}/versions")
    last = range(max(1, newest - keep + 1), newest + 1)
    used = {s["segment"] for v in last for s in segments(spark, root, v).collect()}
    kept_versions = {version_path("", v).strip("/") for v in last}
    for folder, kept in (("versions", kept_versions), ("segments", used)):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for entry in files.listStatus(path):
            if entry.getPath().getName() not in kept:
                files.delete(entry.getPath(), True)
