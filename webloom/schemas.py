"""Table schemas and the fixed constants of the data model.

Ids are UUIDs kept as lower-case canonical strings: their byte order equals
their string order, so half-open id ranges keep their meaning.  Timestamps are
zone-less and hold UTC.  Every "now" is an explicit ``as_of`` argument.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import types as T

# -- fixed values -----------------------------------------------------------
NIL_ID = "00000000-0000-0000-0000-000000000000"
MAX_ID = "ffffffff-ffff-ffff-ffff-ffffffffffff"
NEVER = datetime(1970, 1, 1)  # retrieved_at of a link that was found, not fetched
RECRAWL_DAYS = 7
CRAWL_INTERVAL = "1 minute"
PAGE_SIZE = 10
RESULTS_PER_PAGE = 10
MAX_SUMMARY_LENGTH = 256
DAMPING = 0.85
TOLERANCE = 0.001
SEARCH_ENDPOINT = "/search"
# ---------------------------------------------------------------------------

LINK = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("url", T.StringType()),
        T.StructField("retrieved_at", T.TimestampNTZType()),
    ]
)

EDGE = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("src", T.StringType(), False),
        T.StructField("dst", T.StringType(), False),
        T.StructField("update_at", T.TimestampNTZType()),
    ]
)

DOCUMENT = T.StructType(
    [
        T.StructField("link_id", T.StringType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("indexed_at", T.TimestampNTZType(), False),
        T.StructField("pagerank", T.DoubleType()),
    ]
)

FETCHED = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

CRAWLED = T.StructType(
    [
        T.StructField("link_id", T.StringType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("found_urls", T.ArrayType(T.StringType())),
    ]
)

POSTING = T.StructType(
    [
        T.StructField("link_id", T.StringType(), False),
        T.StructField("term", T.StringType(), False),
        T.StructField("tf", T.IntegerType(), False),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
    ]
)

DOCUMENT_COLUMNS = DOCUMENT.fieldNames()
