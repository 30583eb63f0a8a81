"""Snapshots on storage: parquet in and out, JSON lines out.

A snapshot is never overwritten in place: a mutation reads one version and
writes the next, ``<root>/<table>/v=<n>``.  A version counts once its write has
been committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from webloom.operators.search import rows_of_page
from webloom.schemas import PAGE_SIZE


def versions(spark: SparkSession, root: str, table: str) -> list[int]:
    """Committed versions of a table, oldest first."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("v=") and fs.exists(done):
            found.append(int(name[2:]))
    return sorted(found)


def commit_manifest(rows: DataFrame, root: str) -> int:
    """Write ``rows`` as the next version of the manifest of a table; returns its number.

    Fails if somebody else has written that version meanwhile.
    """
    version = max(versions(rows.sparkSession, root, "manifest"), default=0) + 1
    rows.coalesce(1).write.mode("error").parquet(f"{root}/manifest/v={version}")
    return version


def save_version(df: DataFrame, root: str, table: str, version: int, cluster_by: str | None = None) -> None:
    """Write one version; writing the same version again replaces it.

    ``cluster_by`` orders the files by a column, so that range scans on it
    skip files and row groups by their statistics.
    """
    if cluster_by:
        df = df.repartitionByRange(cluster_by).sortWithinPartitions(cluster_by)
    df.write.mode("overwrite").parquet(f"{root}/{table}/v={version}")


def load_version(
    spark: SparkSession, root: str, table: str, schema: StructType, version: int | None = None
) -> DataFrame:
    """A version of a table, the newest by default; an empty table before the first."""
    if version is None:
        known = versions(spark, root, table)
        if not known:
            return spark.createDataFrame([], schema)
        version = known[-1]
    return spark.read.schema(schema).parquet(f"{root}/{table}/v={version}")


def save_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Store a table bucketed and sorted by ``key``: joins on it do not shuffle it.

    The rows are brought to their bucket first, so there is one file a bucket.
    """
    (
        df.repartition(buckets, key)
        .write.mode("overwrite")
        .format("parquet")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .saveAsTable(name)
    )
    return df.sparkSession.table(name)


def index_json(docs: DataFrame, offset: int = 0, limit: int = PAGE_SIZE, after: str | None = None) -> DataFrame:
    """A page of all documents as JSON objects ``ID, URL, PageScore``; of those
    after the id ``after`` if it is given, without an offset."""
    row = F.struct(
        F.col("link_id").alias("ID"), F.col("url").alias("URL"), F.col("pagerank").alias("PageScore")
    )
    rows = docs.select("link_id", "url", "pagerank")
    if after is not None:
        rows = rows.where(F.col("link_id") > after)
    page = rows_of_page(rows, [F.col("link_id").asc()], 0 if after is not None else offset, limit)
    return page.select("link_id", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


def export_index_json(docs: DataFrame, path: str, offset: int = 0, limit: int = PAGE_SIZE) -> None:
    """K7 as JSON lines on storage."""
    index_json(docs, offset, limit).select("json").write.mode("overwrite").text(path)
