"""Tables in buckets of their key: an upsert rewrites the buckets it touches.

Rows lie in folders by the hash of their key.  A merge looks which buckets the keys of
its batch fall in, reads and joins only those, and writes them anew beside the old ones;
a manifest says which folder each bucket is read from now.  It is the last thing written,
so a reader goes on with the version it started with, and a merge that fails leaves
nothing that counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from webloom.operators.upserts import known_documents, touch_edges, upsert_documents, upsert_links
from webloom.schemas import DOCUMENT, EDGE, LINK
from webloom.sources.tables import commit_manifest, versions

_MANIFEST = "bucket int, name string, buckets int"


@dataclass(frozen=True)
class BucketTable:
    """A table below ``root`` in ``buckets`` buckets of the column ``key``.

    There is a manifest row for each bucket with rows, so their number is also that of
    the folders a scan lists; choose it so that a bucket is about one file.
    """

    spark: SparkSession
    root: str
    schema: StructType
    key: str
    buckets: int

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def folders(self, version: int | None = None) -> dict[int, str]:
        """The folder name of each bucket of a version, the newest by default."""
        known = versions(self.spark, self.root, "manifest")
        if not known:
            return {}
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/v={version or known[-1]}").collect()
        if any(r["buckets"] != self.buckets for r in rows):
            raise ValueError(f"the table has {rows[0]['buckets']} buckets, not {self.buckets}")
        return {r["bucket"]: r["name"] for r in rows}

    def _read(self, folders: dict[int, str]) -> DataFrame:
        paths = [f"{self.root}/data/{name}/bucket={bucket}" for bucket, name in sorted(folders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def load(self, version: int | None = None) -> DataFrame:
        return self._read(self.folders(version))

    def _write(self, rows: DataFrame, kept: dict[int, str], allowed: set[int] | None) -> int:
        name = uuid.uuid4().hex
        path = f"{self.root}/data/{name}"
        placed = rows.select(*self.schema.fieldNames(), self.bucket_of(F.col(self.key)).alias("bucket"))
        # One file a bucket, in the order of the key.
        dealt = placed.repartition("bucket").sortWithinPartitions("bucket", self.key)
        dealt.write.partitionBy("bucket").parquet(path)
        stored = self.spark.read.schema(StructType([*self.schema.fields, StructField("bucket", IntegerType())])).parquet(path)
        written = {r["bucket"] for r in stored.select("bucket").distinct().collect()}
        if allowed is not None and not written <= allowed:
            raise ValueError("a merge may not add rows of keys that its batch does not name")
        entries = [(b, n, self.buckets) for b, n in sorted((kept | dict.fromkeys(written, name)).items())]
        return commit_manifest(self.spark.createDataFrame(entries, _MANIFEST), self.root)

    def replace(self, rows: DataFrame) -> int:
        """Store ``rows`` as the next version, all buckets anew; returns the version."""
        return self._write(rows, {}, None)

    def merge(self, keys: DataFrame, fold: Callable[[DataFrame], DataFrame]) -> int:
        """Fold a batch into the buckets of its ``keys``; returns the new version.

        ``fold`` gets the old rows of these buckets and returns the new ones.  Other
        buckets are neither read nor written.  ``keys`` has the key column; nulls in it
        are ignored, as no row has a null key.
        """
        before = self.folders()
        found = keys.select(self.bucket_of(F.col(self.key)).alias("bucket")).where(F.col(self.key).isNotNull())
        touched = {r["bucket"] for r in found.distinct().collect()}
        old = self._read({b: n for b, n in before.items() if b in touched})
        return self._write(fold(old), {b: n for b, n in before.items() if b not in touched}, touched)

    def forget(self, keep: int = 2) -> int:
        """Delete the folders that the ``keep`` newest versions do not read; returns their number.

        No merge may be running, as its folder is in no manifest yet.
        """
        known = versions(self.spark, self.root, "manifest")
        needed = {(n, b) for v in known[-keep:] for b, n in self.folders(v).items()}
        path_of = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path_of(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        dropped = 0
        for folder in fs.listStatus(path_of(f"{self.root}/data")):
            name = folder.getPath().getName()
            inside = [s.getPath() for s in fs.listStatus(folder.getPath()) if s.getPath().getName().startswith("bucket=")]
            unused = [p for p in inside if (name, int(p.getName()[7:])) not in needed]
            for path in [folder.getPath()] if len(unused) == len(inside) else unused:
                fs.delete(path, True)
            dropped += len(unused)
        for version in known[:-keep]:
            fs.delete(path_of(f"{self.root}/manifest/v={version}"), True)
        return dropped


def link_table(spark: SparkSession, root: str, buckets: int) -> BucketTable:
    """K1: links by url."""
    return BucketTable(spark, root, LINK, "url", buckets)


def edge_table(spark: SparkSession, root: str, buckets: int) -> BucketTable:
    """K2: edges by source, as expiry is by source too."""
    return BucketTable(spark, root, EDGE, "src", buckets)


def document_table(spark: SparkSession, root: str, buckets: int) -> BucketTable:
    """K4: documents by id."""
    return BucketTable(spark, root, DOCUMENT, "link_id", buckets)


def merge_links(table: BucketTable, batch: DataFrame) -> int:
    """``upsert_links`` into the buckets of the urls of the batch.

    The batch is read twice, as in the others; give a written one.
    """
    return table.merge(batch.select("url"), lambda old: upsert_links(old, batch))


def merge_edges(table: BucketTable, batch: DataFrame, as_of: datetime) -> int:
    """K2: ``touch_edges`` into the buckets of the sources; the ends are known to exist."""
    return table.merge(batch.select("src"), lambda old: touch_edges(old, batch, as_of))


def merge_documents(table: BucketTable, batch: DataFrame, as_of: datetime) -> int:
    """K4: ``upsert_documents`` into the buckets of the ids; rows without one are left out."""
    valid = known_documents(batch)
    return table.merge(valid.select("link_id"), lambda old: upsert_documents(old, valid, as_of)[0])
