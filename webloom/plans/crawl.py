"""The crawl pass as one batch plan: K6, A13, R5.

A pass turns parsed pages into a delta of link times, edges, expiry cutoffs and
documents, and folds the delta into the snapshots.  Every rule of the fold is a
maximum or a newest-wins, so deltas of several passes can be stored as they
come and be folded together later: the result is the same as folding one by
one.  A stream relies on that, as it may not rewrite the snapshots each minute.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import uuid_of
from webloom.operators.postings import update_postings
from webloom.operators.scans import ntz
from webloom.operators.skew import lookup_join
from webloom.operators.upserts import delete_stale_edges, upsert_documents, upsert_links
from webloom.schemas import DOCUMENT_COLUMNS, NEVER
from webloom.session import shared_dir


@dataclass
class Snapshot:
    """The three tables."""

    links: DataFrame
    edges: DataFrame
    docs: DataFrame


@dataclass
class CrawlDelta:
    """What one or more passes observed, by url: ids are the store's to give."""

    links: DataFrame  # url, retrieved_at
    edges: DataFrame  # src_url, dst_url, update_at
    cutoffs: DataFrame  # url, cutoff
    docs: DataFrame  # url, title, content, indexed_at (the time of the pass), pagerank


def crawl_delta(crawled: DataFrame, as_of: datetime) -> CrawlDelta:
    """The writes of a pass over ``crawled`` pages.

    ``crawled`` is read four times; pass a written table or a checkpoint, so
    that pages are parsed once.
    """
    now = ntz(as_of)
    found = crawled.select(F.col("url").alias("src_url"), F.explode("found_urls").alias("dst_url"))
    links = crawled.select("url", now.alias("retrieved_at")).unionByName(
        found.select(F.col("dst_url").alias("url"), ntz(NEVER).alias("retrieved_at"))
    )
    return CrawlDelta(
        links=links.groupBy("url").agg(F.max("retrieved_at").alias("retrieved_at")),
        edges=found.select("src_url", "dst_url", now.alias("update_at")).distinct(),
        cutoffs=crawled.select("url", now.alias("cutoff")).distinct(),
        docs=crawled.select("url", "title", "content", now.alias("indexed_at"), F.lit(0.0).alias("pagerank")),
    )


def fold_delta(snapshot: Snapshot, delta: CrawlDelta) -> Snapshot:
    """K1 to K4, J1 for one delta or the union of several.

    Links are folded first and written, as everything else looks its ids up in
    them: a url that the store knows keeps the id it has there, whatever made
    it.  Edges, cutoffs and documents whose url is no link are not written.

    Edges of a fetched page that the page no longer holds are older than the
    start of its latest pass and expire; that includes pages without links.
    """
    shared_dir(snapshot.links.sparkSession)
    links = upsert_links(snapshot.links, delta.links).checkpoint()
    ids = links.select(F.col("url").alias("_key"), "id")
    # Read for both lookups and the counts of their keys, so written first.
    observed = delta.edges.checkpoint()
    total = observed.count()
    known = lookup_join(observed, ids.withColumnRenamed("id", "src"), "src_url", "inner", total=total)
    known = lookup_join(known, ids.withColumnRenamed("id", "dst"), "dst_url", "inner", counted=observed, total=total)
    seen = known.groupBy("src", "dst").agg(F.max("update_at").alias("_seen"))
    edges = snapshot.edges.join(seen, ["src", "dst"], "full_outer").select(
        F.coalesce("id", uuid_of(F.concat_ws(">", "src", "dst"))).alias("id"),
        "src",
        "dst",
        F.greatest("update_at", "_seen").alias("update_at"),
    )
    by_url = links.select("url", "id")
    cutoffs = delta.cutoffs.join(by_url, "url").select(F.col("id").alias("src"), "cutoff")
    edges = delete_stale_edges(edges, cutoffs)
    batch = delta.docs.join(by_url, "url").withColumnRenamed("id", "link_id").select(*DOCUMENT_COLUMNS)
    docs, _ = upsert_documents(snapshot.docs, batch, F.col("indexed_at"))
    return Snapshot(links, edges, docs)


def pass_report(crawled: DataFrame) -> DataFrame:
    """Pages fetched, and writes of links and edges dispatched for them."""
    return crawled.agg(
        F.count(F.lit(1)).alias("fetched"),
        F.coalesce(F.sum(2 * F.size("found_urls")), F.lit(0)).alias("dispatched"),
    )


def apply_crawl(snapshot: Snapshot, crawled: DataFrame, as_of: datetime) -> Snapshot:
    """K6: the snapshots after one pass."""
    return fold_delta(snapshot, crawl_delta(crawled, as_of))


def crawl_postings(postings: DataFrame, after: Snapshot, crawled: DataFrame, english: bool = True) -> DataFrame:
    """The index after a pass: the pages of the pass are analysed anew, others are not read."""
    changed = after.docs.join(crawled.select("url").distinct(), "url", "left_semi")
    return update_postings(postings, changed, english=english)
