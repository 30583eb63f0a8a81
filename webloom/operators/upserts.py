"""Mutations as old snapshot + batch -> new snapshot: K1-K5, K8, J1, J2, J5-J7.

Spark has no row-level writes on parquet, so a mutation is a plan that yields
the new snapshot.  Each one is idempotent for a fixed ``as_of`` and does not
depend on the order of its batch.

Keys are unique on the snapshot side, and batches are reduced by a partial
aggregate before they are shuffled, so a url, source or document that fills a
third of a batch costs one row per task.  A snapshot bucketed by its key
(``sources.tables.save_bucketed``) is joined without being shuffled at all.
The endpoint checks and the expiry join rows by ``src`` or ``dst``, where one
hub may hold a large share; they split hubs (``skew.lookup_join``).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import parse_uuid, uuid_of
from webloom.operators.scans import ntz
from webloom.operators.skew import lookup_join
from webloom.schemas import DOCUMENT_COLUMNS, NIL_ID
from webloom.session import shared_dir


def upsert_links(links: DataFrame, batch: DataFrame) -> DataFrame:
    """Add or refresh links by url; the later time wins.

    ``batch`` has ``(url, retrieved_at)``; an id in it is ignored, the id of a
    known url stays, a new one is derived from the url.  NULL times lose
    against any time, and NULL urls in the batch are dropped.
    """
    latest = (
        batch.where(F.col("url").isNotNull())
        .groupBy("url")
        .agg(F.max("retrieved_at").alias("_seen"))
    )
    return links.join(latest, "url", "full_outer").select(
        F.coalesce("id", uuid_of(F.col("url"))).alias("id"),
        "url",
        F.greatest("retrieved_at", "_seen").alias("retrieved_at"),
    )


def mark_ends(edges: DataFrame, links: DataFrame) -> DataFrame:
    """``edges`` with ``_known``, whether both ends exist."""
    ids = links.select(F.col("id").alias("_key"))
    marked = lookup_join(edges, ids.withColumn("_src_known", F.lit(True)), "src", "left")
    marked = lookup_join(marked, ids.withColumn("_dst_known", F.lit(True)), "dst", "left", counted=edges)
    known = F.col("_src_known").isNotNull() & F.col("_dst_known").isNotNull()
    return marked.withColumn("_known", known).drop("_src_known", "_dst_known")


def known_ends(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Edges whose two ends exist.  Also the cascade after a link is gone."""
    ids = links.select(F.col("id").alias("_key"))
    return lookup_join(
        lookup_join(edges, ids, "src", "left_semi"), ids, "dst", "left_semi", counted=edges
    )


def unknown_ends(edges: DataFrame, links: DataFrame) -> DataFrame:
    """The rejects, edges with at least one end that does not exist."""
    return mark_ends(edges, links).where(~F.col("_known")).drop("_known")


def distinct_edges(batch: DataFrame) -> DataFrame:
    """One row per ``(src, dst)``."""
    return batch.select("src", "dst").distinct()


def touch_edges(edges: DataFrame, batch: DataFrame, as_of: datetime) -> DataFrame:
    """K2 without the endpoint check: every edge in ``batch`` gets ``as_of``."""
    touched = distinct_edges(batch).withColumn("_new", F.lit(True))
    return edges.join(touched, ["src", "dst"], "full_outer").select(
        F.coalesce("id", uuid_of(F.concat_ws(">", "src", "dst"))).alias("id"),
        "src",
        "dst",
        F.when(F.col("_new"), ntz(as_of)).otherwise(F.col("update_at")).alias("update_at"),
    )


def upsert_edges(
    edges: DataFrame, batch: DataFrame, links: DataFrame, as_of: datetime
) -> tuple[DataFrame, DataFrame]:
    """New edge snapshot and the rejected edges.

    The time of the caller is ignored, as every edge written gets ``as_of``.  The
    ends are looked up once, for both results.
    """
    shared_dir(edges.sparkSession)
    marked = mark_ends(distinct_edges(batch).checkpoint(), links).checkpoint()
    known, rejects = (marked.where(c).drop("_known") for c in (F.col("_known"), ~F.col("_known")))
    return touch_edges(edges, known, as_of), rejects


def delete_stale_edges(edges: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Drop edges of a source older than its cutoff.

    ``cutoffs`` has ``(src, cutoff)``; when a source is listed more than once
    the latest cutoff covers the others.  An edge without a time stays.
    """
    limit = cutoffs.groupBy(F.col("src").alias("_key")).agg(F.max("cutoff").alias("_cutoff"))
    return lookup_join(edges, limit, "src", "left_anti", F.col("update_at") < F.col("_cutoff"))


def cascade_edges(edges: DataFrame, links: DataFrame) -> DataFrame:
    """What is left of ``edges`` when only ``links`` exist."""
    return known_ends(edges, links)


def latest_documents(batch: DataFrame) -> DataFrame:
    """One version per document, the one indexed last."""
    row = F.struct("indexed_at", "url", "title", "content", "pagerank")
    return (
        batch.groupBy("link_id")
        .agg(F.max(row).alias("_row"))
        .select("link_id", "_row.*")
        .select(*DOCUMENT_COLUMNS)
    )


def known_documents(batch: DataFrame) -> DataFrame:
    """P5: the rows of a batch that name a document."""
    return batch.where(F.col("link_id").isNotNull() & (F.col("link_id") != NIL_ID))


def upsert_documents(docs: DataFrame, batch: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """K4, P5: new document snapshot and the rejected rows.

    A known document gets the new url, title and content (NULLs included) and
    ``as_of``, and keeps its rank; a new one is taken as given.  Documents that
    are not in the batch are passed on by an anti join on the id alone, so
    their text is not shuffled when the batch is small enough to broadcast.
    """
    ok = F.col("link_id").isNotNull() & (F.col("link_id") != NIL_ID)
    fresh = latest_documents(batch.where(ok))
    old = docs.select("link_id", F.col("pagerank").alias("_rank"), F.lit(True).alias("_known"))
    written = fresh.join(old, "link_id", "left").select(
        "link_id",
        "url",
        "title",
        "content",
        F.when(F.col("_known"), ntz(as_of)).otherwise(F.col("indexed_at")).alias("indexed_at"),
        F.when(F.col("_known"), F.col("_rank")).otherwise(F.col("pagerank")).alias("pagerank"),
    )
    ids = batch.where(ok).select("link_id").distinct()
    kept = docs.join(ids, "link_id", "left_anti").select(*DOCUMENT_COLUMNS)
    return kept.unionByName(written), batch.where(~F.coalesce(ok, F.lit(False)))


def update_rank(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """Set the rank by link id; ids without a document do nothing."""
    new = scores.select("link_id", F.col("score").alias("_score"), F.lit(True).alias("_set"))
    return docs.join(new, "link_id", "left").select(
        "link_id",
        "url",
        "title",
        "content",
        "indexed_at",
        F.when(F.col("_set"), F.col("_score")).otherwise(F.col("pagerank")).alias("pagerank"),
    )


def update_ranks(ranks: DataFrame, scores: DataFrame) -> DataFrame:
    """K5, J5 for ranks kept apart, ``(link_id, pagerank)``: no text is read or written.

    Store the result bucketed by ``link_id`` beside the documents; searches and
    ``with_ranks`` join it where a page needs it.
    """
    new = scores.select("link_id", F.col("score").alias("_score"), F.lit(True).alias("_set"))
    return ranks.join(new, "link_id", "left").select(
        "link_id", F.when(F.col("_set"), F.col("_score")).otherwise(F.col("pagerank")).alias("pagerank")
    )


def with_ranks(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The documents with ranks that are kept apart; those without a rank keep their own."""
    new = ranks.select("link_id", F.col("pagerank").alias("_rank"), F.lit(True).alias("_ranked"))
    rank = F.when(F.col("_ranked"), F.col("_rank")).otherwise(F.col("pagerank")).alias("pagerank")
    return docs.join(new, "link_id", "left").select(*[c for c in DOCUMENT_COLUMNS if c != "pagerank"], rank)


def persist_ranks(ranks: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K8, F17 for ranks kept apart: new ranks and the vertex scores whose id is no link id."""
    parsed = scores.select("id", "score", parse_uuid(F.col("id")).alias("link_id"))
    return (
        update_ranks(ranks, parsed.where(F.col("link_id").isNotNull())),
        parsed.where(F.col("link_id").isNull()).select("id", "score"),
    )


def persist_scores(docs: DataFrame, ranks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write vertex scores ``(id, score)`` back; bad ids are rejects."""
    parsed = ranks.select("id", "score", parse_uuid(F.col("id")).alias("link_id"))
    return (
        update_rank(docs, parsed.where(F.col("link_id").isNotNull())),
        parsed.where(F.col("link_id").isNull()).select("id", "score"),
    )
