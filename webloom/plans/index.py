"""The inverted index kept up by passes: X1, A15.

The index is a row of segments.  A pass analyses the documents that are new or changed
and writes their postings as the next segment, beside the ids of all documents that it
replaces or removes; what older segments hold of these no longer counts.  No segment is
ever changed.  When several neighbouring segments are of a similar size they are merged
into one, so the number of segments grows with the logarithm of the number of passes.

A version is a small manifest of the segments it consists of, written last: a search
goes on reading the version it started with while passes and merges write others.
``forget`` deletes the segments that none of the versions to be kept refers to.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.operators.postings import build_postings, small_ids, write_postings
from webloom.schemas import POSTING
from webloom.sources.tables import commit_manifest, versions

#: Neighbours of one size that are merged, and the rows up to which segments count as small.
FACTOR, SMALL_ROWS = 4, 1_000_000

_MANIFEST = T.StructType([T.StructField("number", T.LongType()), T.StructField("name", T.StringType()), T.StructField("rows", T.LongType())])
_GONE = T.StructType([T.StructField("link_id", T.StringType())])


@dataclass(frozen=True)
class Segment:
    """Postings and replaced ids of one pass, or of several that were merged.

    ``number`` is that of the last pass in it: its ids are gone from all segments of a
    lower number.
    """

    number: int
    name: str
    rows: int

    @property
    def tier(self) -> int:
        return max(0, math.floor(math.log(max(1, self.rows) / SMALL_ROWS, FACTOR)) + 1)


def segments(spark: SparkSession, root: str, version: int | None = None) -> list[Segment]:
    """The segments of a version, the newest by default, oldest first; none before the first."""
    known = versions(spark, root, "manifest")
    if not known:
        return []
    rows = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest/v={known[-1] if version is None else version}").collect()
    return sorted((Segment(**r.asDict()) for r in rows), key=lambda s: s.number)


def _commit(spark: SparkSession, root: str, held: list[Segment]) -> int:
    return commit_manifest(spark.createDataFrame([(s.number, s.name, s.rows) for s in held], _MANIFEST), root)


def _postings(spark: SparkSession, root: str, segment: Segment) -> DataFrame:
    return spark.read.schema(POSTING).parquet(f"{root}/postings/{segment.name}")


def _gone(spark: SparkSession, root: str, segment: Segment) -> DataFrame:
    return spark.read.schema(_GONE).parquet(f"{root}/gone/{segment.name}")


def _name(number: int) -> str:
    # A name of its own for each attempt: one that failed leaves nothing that counts.
    return f"{number:06d}-{uuid.uuid4().hex}"


def add_pass(
    spark: SparkSession, root: str, changed: DataFrame, removed: DataFrame | None = None, english: bool = True
) -> int:
    """Index the documents ``changed``, forget those of ``removed(link_id)``; returns the version.

    Documents that are in neither are not read, nor are their postings.
    """
    held = segments(spark, root)
    number = held[-1].number + 1 if held else 0
    name = _name(number)
    gone = changed.select("link_id")
    if removed is not None:
        gone = gone.unionByName(removed.select("link_id"))
    # Before the first segment there is nothing to replace.
    gone = gone.distinct() if held else gone.limit(0)
    gone.write.parquet(f"{root}/gone/{name}")
    write_postings(build_postings(changed, english, dealt=True), f"{root}/postings/{name}")
    rows = _postings(spark, root, Segment(number, name, 0)).count()
    return _commit(spark, root, [*held, Segment(number, name, rows)])


def _live(spark: SparkSession, root: str, some: list[Segment], held: list[Segment]) -> DataFrame:
    """Postings of ``some`` segments that none of the later ones of ``held`` replaces.

    A filter on terms reaches the scans.  The replaced ids are broadcast, so postings stay
    where they are; if they are too many the join is on the id by which a search groups.
    """
    found = reduce(
        DataFrame.unionByName,
        [_postings(spark, root, s).withColumn("_number", F.lit(s.number).cast("long")) for s in some],
    )
    later = [s for s in held if s.number > some[0].number]
    if not later:
        return found.drop("_number")
    ids = reduce(DataFrame.unionByName, [_gone(spark, root, s).withColumn("_until", F.lit(s.number).cast("long")) for s in later])
    last = ids.groupBy("link_id").agg(F.max("_until").alias("_until"))
    kept = found.join(small_ids(last, ids.count()), "link_id", "left").where(F.col("_until").isNull() | (F.col("_until") <= F.col("_number")))
    return kept.select(*POSTING.fieldNames())


def load_postings(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The postings of a version as one table, as a rebuild would give them."""
    held = segments(spark, root, version)
    return _live(spark, root, held, held) if held else spark.createDataFrame([], POSTING)


def _similar(held: list[Segment], factor: int) -> list[Segment]:
    """The newest ``factor`` or more neighbours of one tier; smaller ones between them go along."""
    run: list[Segment] = []
    for segment in reversed(held):
        if run and segment.tier > run[-1].tier:
            if len([s for s in run if s.tier == run[-1].tier]) >= factor:
                break
        run.append(segment)
    top = run[-1].tier if run else 0
    return run[::-1] if len([s for s in run if s.tier == top]) >= factor else []


def merge(spark: SparkSession, root: str, factor: int = FACTOR, everything: bool = False) -> int | None:
    """Merge segments of a similar size, or all; returns the new version, None if there is nothing to do.

    Replaced postings are left out.  The ids that are gone are kept as long as an older
    segment may hold them.  The segments that were merged stay where they are.
    """
    held = segments(spark, root)
    run = held if everything else _similar(held, factor)
    if len(run) < 2:
        return None
    number, name = run[-1].number, _name(run[-1].number)
    write_postings(_live(spark, root, run, held), f"{root}/postings/{name}")
    ids = reduce(DataFrame.unionByName, [_gone(spark, root, s) for s in run]).distinct()
    (ids.limit(0) if run[0] == held[0] else ids).write.parquet(f"{root}/gone/{name}")
    merged = Segment(number, name, _postings(spark, root, Segment(number, name, 0)).count())
    at = held.index(run[0])
    return _commit(spark, root, [*held[:at], merged, *held[at + len(run) :]])


def forget(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete what none of the ``keep`` newest versions refers to; returns the names of the segments.

    Attempts that never became part of a version are deleted too, so no pass may be
    running.
    """
    known = versions(spark, root, "manifest")
    needed = {s.name for v in known[-keep:] for s in segments(spark, root, v)}
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(root).getFileSystem(spark._jsc.hadoopConfiguration())
    dropped = set()
    for folder in ("postings", "gone"):
        for status in fs.listStatus(path_of(f"{root}/{folder}")):
            name = status.getPath().getName()
            if name not in needed:
                fs.delete(status.getPath(), True)
                dropped.add(name)
    for version in known[:-keep]:
        fs.delete(path_of(f"{root}/manifest/v={version}"), True)
    return sorted(dropped)


def index_pass(spark: SparkSession, root: str, docs: DataFrame, crawled: DataFrame, english: bool = True) -> int:
    """Bring the index up to date after a crawl pass: ``docs`` are the documents after it,
    ``crawled(url)`` the pages it fetched.  Merges segments when they are due."""
    changed = docs.join(crawled.select("url").distinct(), "url", "left_semi")
    version = add_pass(spark, root, changed, english=english)
    return merge(spark, root) or version
