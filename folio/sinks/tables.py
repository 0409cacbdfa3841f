"""Tables that grow or change: collections and versions of the knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folio.operators import kb
from folio.operators.ordered import with_row_index
from folio.session import scratch, write_once

CHUNK_COLLECTION = "id string, document string, metadata map<string,string>"


def ensure_table(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """The table ``name``; created empty with the given schema if it does not exist."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")
    return spark.table(name)


def append_chunks(spark: SparkSession, name: str, chunks: DataFrame, order: list[str]) -> None:
    """Add chunks under the next free numbers. A repeated call adds them again.

    ``chunks`` has ``document`` and ``metadata`` besides the order columns.
    """
    held = ensure_table(spark, name, CHUNK_COLLECTION).count()
    numbered = with_row_index(chunks, order, "_n", start=held + 1)
    numbered.select(F.col("_n").cast("string").alias("id"), "document", "metadata").write.insertInto(name)


# A knowledge base is a folder of versions. Pairs are dealt by hash into buckets. A version
# is a manifest that says which folder holds each bucket; it is complete once Spark has
# written its _SUCCESS file, and readers take the newest complete one. An upsert writes the
# buckets that its rows touch, and a manifest that names the old folders of all others.

BUCKETS = 64
_MANIFEST = "bucket int, folder string, buckets int"


def version_path(root: str, version: int) -> str:
    return f"{root}/v{version:08d}"


def current_version(spark: SparkSession, root: str) -> int:
    """Number of the newest complete version, 0 if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return max((int(f.getPath().getParent().getName()[1:]) for f in found or []), default=0)


def _manifest(spark: SparkSession, root: str, version: int) -> dict[int, tuple[str, int]]:
    """Folder of each bucket that has rows, and the number of buckets there are."""
    if version == 0:
        return {}
    rows = spark.read.schema(_MANIFEST).json(version_path(root, version)).collect()  # a row for each bucket
    return {r["bucket"]: (r["folder"], r["buckets"]) for r in rows}


def _read_folders(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], kb.SCHEMA)
    return spark.read.schema(kb.SCHEMA).parquet(*[f"{root}/data/{f}" for f in folders])


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    version = current_version(spark, root) if version is None else version
    return _read_folders(spark, root, [folder for folder, _ in _manifest(spark, root, version).values()])


def base_version(spark: SparkSession, root: str, note: str) -> int:
    """The version that was current when this was first asked; ``note`` remembers it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{note}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        spark.range(1).select(F.lit(current_version(spark, root)).alias("version")).write.mode("overwrite").json(note)
    return spark.read.schema("version int").json(note).first()["version"]


def publish_upsert(
    spark: SparkSession, root: str, rows: DataFrame, seq: list[str], version: int | None = None, buckets: int = BUCKETS
) -> int:
    """Apply ``rows`` to the version before ``version`` and write the result as ``version``.

    Only buckets that ``rows`` touch are read and written. Writing the same version again
    gives the same result, so a failed job can be rerun. ``buckets`` counts for the first
    version of a knowledge base; later ones keep its number.
    """
    version = current_version(spark, root) + 1 if version is None else version
    held = _manifest(spark, root, version - 1)
    buckets = next((n for _, n in held.values()), buckets)
    with scratch(spark):
        bucket = F.pmod(F.xxhash64(*kb.KEY), F.lit(buckets)).cast("int")
        new = write_once(kb.with_key(rows).withColumn("_bucket", bucket))
        touched = {r["_bucket"] for r in new.select("_bucket").distinct().collect()}  # at most ``buckets`` numbers
        old = _read_folders(spark, root, [folder for b, (folder, _) in held.items() if b in touched])
        updated = kb.kb_upsert(old, new.drop("_bucket"), seq).withColumn("bucket", bucket)
        # Sorted ranges, so that a task writes few buckets and a large one has several tasks.
        dealt = updated.repartitionByRange("bucket", *kb.KEY).sortWithinPartitions("bucket", *kb.KEY)
        name = version_path("", version).strip("/")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/{name}")
    folders = {b: f for b, (f, _) in held.items()} | {b: f"{name}/bucket={b}" for b in touched}
    listed = spark.createDataFrame([(b, f, buckets) for b, f in sorted(folders.items())], _MANIFEST).coalesce(1)
    listed.write.mode("overwrite").json(version_path(root, version))
    return version


def prune_versions(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete all but the newest ``keep`` versions, and buckets that none of these names."""
    newest = current_version(spark, root)
    last = range(max(1, newest - keep + 1), newest + 1)
    used = {folder for v in last for folder, _ in _manifest(spark, root, v).values()}
    files = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def found(pattern: str) -> list:
        return list(files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}")) or [])

    for entry in found("data/v*/bucket=*"):
        path = entry.getPath()
        if f"{path.getParent().getName()}/{path.getName()}" not in used:
            files.delete(path, True)
    for entry in found("v*"):
        if entry.getPath().getName() not in {version_path("", v).strip("/") for v in last}:
            files.delete(entry.getPath(), True)
    for entry in found("data/v*"):
        if not found(f"data/{entry.getPath().getName()}/bucket=*"):
            files.delete(entry.getPath(), True)
