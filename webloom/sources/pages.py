"""Fetched pages and submitted URLs as inputs: S5, S7, F20."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.html import page_fields
from webloom.functions.text import let
from webloom.functions.urls import base_parts, is_web_url, normalise_url, resolve_from, uuid_of
from webloom.schemas import NEVER


def extract_pages(pages: DataFrame) -> DataFrame:
    """Fetched pages ``(url, html)`` to ``(link_id, url, title, content, found_urls)``.

    Found URLs are absolute, without fragment, http or https, each once, in
    page order.  Other columns of ``pages`` are passed on.
    """
    url = normalise_url(F.col("url"))
    rest = [c for c in pages.columns if c not in ("url", "html")]
    found = let(
        base_parts(F.col("url")),
        lambda base: F.filter(
            F.transform(F.col("_page.hrefs"), lambda h: resolve_from(h, base)), is_web_url
        ),
    )
    parsed = pages.where(is_web_url(F.col("url"))).withColumn("_page", page_fields(F.col("html")))
    return parsed.select(
        uuid_of(url).alias("link_id"),
        url.alias("url"),
        F.col("_page.title").alias("title"),
        F.col("_page.content").alias("content"),
        F.array_distinct(found).alias("found_urls"),
        *rest,
    )


def submitted_links(submissions: DataFrame) -> DataFrame:
    """Accepted URLs ``(url, retrieved_at)``, never fetched so far."""
    return submissions.where(is_web_url(F.col("url"))).select(
        normalise_url(F.col("url")).alias("url"), F.lit(str(NEVER)).cast("timestamp_ntz").alias("retrieved_at")
    )


def rejected_submissions(submissions: DataFrame) -> DataFrame:
    """What ``submitted_links`` does not accept."""
    return submissions.where(~is_web_url(F.col("url")))
