"""Link, document and graph tables derived from the given test tables.

* links, edges, documents: from ``pages``
* search corpus: from ``documents``
* trade graph: customers and suppliers, from ``orders`` and ``lineitem``
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.html import page_hrefs
from webloom.functions.urls import uuid_of
from webloom.operators.scans import ntz
from webloom.operators.upserts import upsert_links
from webloom.schemas import DOCUMENT, LINK, NEVER
from webloom.sources.pages import extract_pages

# The times the queries run "at".
AS_OF = datetime(2024, 2, 1, 12)
FRONTIER_AS_OF = datetime(2024, 1, 11)
SCAN_BEFORE = datetime(2024, 1, 6)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hours_after_start(hours: Column) -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=hours.cast("int"))


def crawled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed pages with ``page_id`` and the time ``fetched_at`` of the fetch."""
    return extract_pages(table(spark, sf_dir, "pages")).withColumn(
        "fetched_at", hours_after_start(F.col("page_id"))
    )


def after_fetches(crawled: DataFrame) -> Column:
    """``AS_OF`` or, if pages were fetched since, an hour after the last of them.

    A pass at that time sees every link and edge.  Between fetches it would see edges
    whose ends it does not know, as a link takes the time of its last fetch.
    """
    last = crawled.agg(F.max("fetched_at").cast("string").alias("last")).first()["last"]
    return F.greatest(ntz(AS_OF), F.lit(last).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(1)))


def root_of(url: Column) -> Column:
    """The start page of the host of ``url``."""
    return F.concat(F.regexp_extract(url, "^[a-z]+://[^/?]*", 0), F.lit("/"))


def link_times(crawled: DataFrame) -> DataFrame:
    """Fetched pages at their time, found pages and host start pages never fetched."""
    never = F.lit(str(NEVER)).cast("timestamp_ntz")
    return (
        crawled.select("url", F.col("fetched_at").alias("retrieved_at"))
        .unionByName(crawled.select(F.explode("found_urls").alias("url"), never.alias("retrieved_at")))
        .unionByName(crawled.select(root_of(F.col("url")).alias("url"), never.alias("retrieved_at")))
    )


def page_links(spark: SparkSession, crawled: DataFrame) -> DataFrame:
    return upsert_links(spark.createDataFrame([], LINK), link_times(crawled))


def found_edges(crawled: DataFrame) -> DataFrame:
    """``(src, dst, update_at)`` of pages and the pages they link to."""
    return crawled.select(
        F.col("link_id").alias("src"),
        F.explode("found_urls").alias("_url"),
        F.col("fetched_at").alias("update_at"),
    ).select("src", uuid_of(F.col("_url")).alias("dst"), "update_at")


def root_edges(crawled: DataFrame) -> DataFrame:
    """``(src, dst, update_at)`` of pages and the start pages of their hosts."""
    return crawled.select(
        F.col("link_id").alias("src"),
        uuid_of(root_of(F.col("url"))).alias("dst"),
        F.col("fetched_at").alias("update_at"),
    )


def as_edges(pairs: DataFrame) -> DataFrame:
    """The edge table of ``(src, dst, update_at)`` rows, the latest time of each pair."""
    return (
        pairs.groupBy("src", "dst")
        .agg(F.max("update_at").alias("update_at"))
        .select(uuid_of(F.concat_ws(">", "src", "dst")).alias("id"), "src", "dst", "update_at")
    )


def page_edges(crawled: DataFrame) -> DataFrame:
    """Found edges, their reverses, and edges to the start pages."""
    found = found_edges(crawled)
    back = found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "update_at")
    return as_edges(found.unionByName(back).unionByName(root_edges(crawled)))


def page_documents(crawled: DataFrame) -> DataFrame:
    """An older version of each page, to be replaced by a new crawl.

    Several pages may share a url without its fragment; the first one counts.
    """
    return (
        crawled.groupBy("link_id", "url")
        .agg(F.min("page_id").alias("page_id"), F.min("fetched_at").alias("indexed_at"))
        .select(
            "link_id",
            "url",
            F.concat(F.lit("old "), F.col("page_id")).alias("title"),
            F.lit(None).cast("string").alias("content"),
            "indexed_at",
            (F.col("page_id") / 1000.0).alias("pagerank"),
        )
    )


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search corpus in the document schema."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        uuid_of(F.concat(F.lit("doc"), F.col("doc_id"))).alias("link_id"),
        F.concat(F.lit("https://docs.example/"), F.col("doc_id")).alias("url"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("content"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias(
            "indexed_at"
        ),
        (F.pmod(F.col("doc_id"), F.lit(97)) / 97.0).alias("pagerank"),
    )


def trade_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers; a customer links to the suppliers of its orders,
    a supplier to the customers that returned its goods."""
    c, s = (lambda col: F.concat(F.lit("c"), col)), (lambda col: F.concat(F.lit("s"), col))
    vertices = (
        table(spark, sf_dir, "customer")
        .select(c(F.col("c_custkey")).alias("id"))
        .unionByName(table(spark, sf_dir, "supplier").select(s(F.col("s_suppkey")).alias("id")))
    )
    bought = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
        .select(c(F.col("o_custkey")).alias("c"), s(F.col("l_suppkey")).alias("s"), "l_returnflag")
    )
    # Each line yields its links in the same pass over the join.
    both = F.array(
        F.struct(F.col("c").alias("src"), F.col("s").alias("dst")),
        F.when(F.col("l_returnflag") == "R", F.struct(F.col("s").alias("src"), F.col("c").alias("dst"))),
    )
    edges = bought.select(F.inline(F.array_compact(both))).distinct()
    return vertices, edges


def hrefs_of(pages: DataFrame) -> DataFrame:
    """Link targets as written in the pages, ``(url)``."""
    return pages.select(F.explode(page_hrefs(F.col("html"))).alias("url"))
