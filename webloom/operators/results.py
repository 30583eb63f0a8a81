"""The search result page: X6, T4, T7, F9, F22, P10."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import highlight, html_escape, is_phrase, match_summary, shown_title
from webloom.functions.urls import page_link
from webloom.operators.search import search
from webloom.schemas import MAX_SUMMARY_LENGTH, PAGE_SIZE, RESULTS_PER_PAGE, SEARCH_ENDPOINT


class ResultPage:
    """Hits in order and the one-row page details; the hits are found when asked for."""

    def __init__(self, details: DataFrame, fetch: Callable[[], DataFrame]):
        self.details, self._fetch = details, fetch

    @cached_property
    def hits(self) -> DataFrame:
        return self._fetch()


def hit_columns(page: DataFrame, text: str, max_summary_length: int = MAX_SUMMARY_LENGTH) -> DataFrame:
    """A hit shows its title, or its url, and a highlighted summary.

    Only the documents of the page are summarised.
    """
    return page.select(
        "*",
        shown_title(F.col("title"), F.col("url")).alias("_title"),
        highlight(html_escape(match_summary(F.col("content"), text, max_summary_length)), text).alias(
            "summary_html"
        ),
    )


def page_details(
    total: DataFrame,
    text: str,
    offset: int = 0,
    limit: int = PAGE_SIZE,
    results_per_page: int = RESULTS_PER_PAGE,
    endpoint: str = SEARCH_ENDPOINT,
) -> DataFrame:
    """First and last position, total, links to the pages before and after.

    The number of hits on the page follows from the total, so no second pass
    over the matches is needed.  Quotes of a phrase stay in the links.
    """
    shown = F.greatest(F.least(F.lit(limit), F.col("total") - offset), F.lit(0))
    query, last = F.lit(text), F.lit(offset) + shown
    return total.select(
        F.lit(offset + 1).cast("bigint").alias("from_pos"),
        last.cast("bigint").alias("to_pos"),
        "total",
        (page_link(endpoint, query, F.lit(offset - results_per_page)) if offset > 0 else F.lit("")).alias(
            "prev_link"
        ),
        F.when(last < F.col("total"), page_link(endpoint, query, last)).otherwise(F.lit("")).alias("next_link"),
    )


def search_results(
    docs: DataFrame,
    postings: DataFrame,
    text: str,
    offset: int = 0,
    results_per_page: int = RESULTS_PER_PAGE,
    max_summary_length: int = MAX_SUMMARY_LENGTH,
    relevance_order: str = "asc",
    english: bool = True,
    endpoint: str = SEARCH_ENDPOINT,
    ranking: str = "ts_rank",
) -> ResultPage:
    """Search, summarise, highlight and page.

    A text in double quotes is a phrase search.  A page holds ten hits, or
    ``results_per_page`` when that is less (T4).
    """
    if results_per_page <= 0:
        results_per_page = RESULTS_PER_PAGE
    limit = min(PAGE_SIZE, results_per_page)
    found = search(
        docs, postings, text, is_phrase(text), offset, limit, relevance_order=relevance_order, english=english, ranking=ranking
    )

    def fetch() -> DataFrame:
        return hit_columns(found.page, text, max_summary_length).select(
            "link_id", "url", F.col("_title").alias("title"), "summary_html", "rank_pos"
        )

    return ResultPage(page_details(found.total, text, offset, limit, results_per_page, endpoint), fetch)
