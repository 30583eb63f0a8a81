"""Scans and point lookups of the link graph: S1-S4, P1-P4, P11.

Bounds are plain comparisons with literals, so they reach the parquet reader.
An upper id bound is exclusive (the all-``f`` id is never in a full scan), time
bounds are strict, and a NULL time never matches.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from webloom.schemas import DOCUMENT_COLUMNS, MAX_ID, NIL_ID, RECRAWL_DAYS


def ntz(moment: datetime | Column) -> Column:
    """A zone-less timestamp literal; zone-aware values become UTC."""
    if isinstance(moment, Column):
        return moment
    if moment.tzinfo is not None:
        moment = (moment - moment.utcoffset()).replace(tzinfo=None)
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def in_id_range(column: str, low: str, high: str) -> Column:
    """``low <= column < high``."""
    return (F.col(column) >= low) & (F.col(column) < high)


def scan_links(links: DataFrame, before: datetime | Column, low: str = NIL_ID, high: str = MAX_ID) -> DataFrame:
    """Links of an id range fetched before ``before``."""
    return links.where(in_id_range("id", low, high) & (F.col("retrieved_at") < ntz(before)))


def scan_edges(edges: DataFrame, before: datetime | Column, low: str = NIL_ID, high: str = MAX_ID) -> DataFrame:
    """Edges whose source is in an id range, updated before ``before``."""
    return edges.where(in_id_range("src", low, high) & (F.col("update_at") < ntz(before)))


def crawl_frontier(links: DataFrame, as_of: datetime, recrawl_days: float = RECRAWL_DAYS) -> DataFrame:
    """Links not fetched for ``recrawl_days``."""
    return scan_links(links, as_of - timedelta(days=recrawl_days))


def rank_input(links: DataFrame, edges: DataFrame, as_of: datetime | Column) -> tuple[DataFrame, DataFrame]:
    """Links and edges older than one common moment."""
    return scan_links(links, as_of), scan_edges(edges, as_of)


def lookup_link(links: DataFrame, link_id: str) -> DataFrame:
    """The link with this id; no row means not found."""
    return links.where(F.col("id") == link_id)


def lookup_document(docs: DataFrame, link_id: str) -> DataFrame:
    """The document with this link id; no row means not found."""
    return docs.where(F.col("link_id") == link_id).select(*DOCUMENT_COLUMNS)


def get_one(found: DataFrame) -> Row:
    """The row of a point lookup, ``LookupError`` when there is none."""
    rows = found.take(1)
    if not rows:
        raise LookupError("not found")
    return rows[0]
