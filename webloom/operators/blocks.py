"""Posting blocks: intersections that skip, and first pages that end early.

A block holds the postings of one term for one range of documents as arrays, beside
their number and the least and greatest frequency.  Several blocks may hold parts of the
same range, as they are made where the postings lie.  A document's range comes from the
hash of its id, so ranges are even, the same for all terms, and need no numbering that
would have to be kept up as documents come and go.

A search reads the small columns of its terms first.  A range can hold a match only if
every wanted word of some alternative has a block there: the blocks of a frequent word
are decoded only in the ranges of the rarest one.  For a first page the small columns
also bound the score of every range.  The most promising ranges are decoded first, and
then those alone whose bound is no worse than the last row of the page found so far, so
the page is that of a full sort, ties included.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators.ranking import is_near, log_tf, most_near, rank_often, rank_sizes, terms_in_order
from webloom.operators.search import Operand, SearchResult, fetch_page, matches, read_phrase, read_query, search, search_order
from webloom.schemas import PAGE_SIZE
from webloom.session import planning

DOCS_PER_BLOCK = 4096
#: Postings that are grouped into blocks at a time.
ROWS_AT_ONCE = 200_000
#: More of them are held at a time than a batch has, so batches end by rows; to end them by
#: bytes too, Spark would measure a batch anew with each of its rows.
_BY_ROWS = {"spark.sql.execution.arrow.maxBytesPerBatch": 2**31 - 1}
#: Ranges decoded at first for a page; their bounds come to the driver.
FIRST_RANGES = 32
#: A page beyond this is not worth ending early.
MOST_ROWS = 1000

Query = list[list[Operand]]


@dataclass(frozen=True)
class Blocks:
    """Stored blocks, and the number of bits of a hash that make a range."""

    frame: DataFrame
    bits: int

    def range_of(self, link_id: Column) -> Column:
        return _range_of(link_id, self.bits)

    def postings(self, terms: list[str], ranges: DataFrame | list[int]) -> DataFrame:
        """The postings of some terms in some ranges; no other block is decoded."""
        found = self.frame.where(F.col("term").isin(terms))
        if isinstance(ranges, list):
            found = found.where(F.col("range").isin(ranges))
        else:
            found = found.join(ranges.select("range"), "range", "left_semi")
        held = F.explode(F.arrays_zip("ids", "tfs", "positions")).alias("held")
        return found.select("term", held).select(
            F.col("held.ids").alias("link_id"), "term", F.col("held.tfs").alias("tf"), F.col("held.positions").alias("positions")
        )


def _range_of(link_id: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(link_id), 64 - bits).cast("int")


def write_blocks(postings: DataFrame, path: str, documents: int, docs_per_block: int = DOCS_PER_BLOCK) -> Blocks:
    """Store stored ``postings`` as blocks of about ``docs_per_block`` documents, clustered by term.

    Each task groups the postings that it reads, and nothing is shuffled.  Postings that
    were built ``dealt`` lie by ranges of the same hash, so their blocks are nearly whole;
    others give smaller blocks.
    """
    bits = max(1, math.ceil(math.log2(max(2, documents / docs_per_block))))
    placed = postings.select("term", _range_of(F.col("link_id"), bits).alias("range"), "link_id", "tf", "positions")
    with planning(postings.sparkSession, _BY_ROWS):
        rows = placed.mapInArrow(_grouped, _BLOCK)
        rows.write.mode("overwrite").option("parquet.dictionary.page.size", 4 << 20).parquet(f"{path}/bits={bits}")
    return load_blocks(postings.sparkSession, path)


_BLOCK = (
    "term string, range int, n long, least_tf int, most_tf int, least_counted int, most_counted int,"
    " ids array<string>, tfs array<int>, positions array<array<int>>"
)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of postings that follow each other."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= ROWS_AT_ONCE:
            yield from _blocks_of(held)
            held, size = [], 0
    yield from _blocks_of(held)


def _blocks_of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held).combine_chunks() if held else None
    if not rows:
        return
    rows = rows.sort_by([("term", "ascending"), ("range", "ascending"), ("link_id", "ascending")]).combine_chunks()
    column = {name: rows.column(name).chunk(0) for name in rows.column_names}
    term = column["term"].dictionary_encode().indices.to_numpy(zero_copy_only=False)
    place, tf = (column[c].to_numpy(zero_copy_only=False) for c in ("range", "tf"))
    counted = rank_sizes(column["positions"])
    new = (np.diff(term) != 0) | (np.diff(place) != 0)
    first = np.concatenate([[0], np.flatnonzero(new) + 1])
    edges = pa.array(np.concatenate([first, [len(term)]]), pa.int32())
    starts = pa.array(first)
    bounds = [f.reduceat(v, first).astype(np.int32) for v in (tf, counted) for f in (np.minimum, np.maximum)]
    columns = [
        column["term"].take(starts),
        column["range"].take(starts),
        pa.array(np.diff(edges.to_numpy()), pa.int64()),
        *[pa.array(b) for b in bounds],
        *[pa.ListArray.from_arrays(edges, column[c]) for c in ("link_id", "tf", "positions")],
    ]
    names = ["term", "range", "n", "least_tf", "most_tf", "least_counted", "most_counted", "ids", "tfs", "positions"]
    yield pa.RecordBatch.from_arrays(columns, names)


def load_blocks(spark: SparkSession, path: str) -> Blocks:
    """The blocks stored at a path."""
    frame = spark.read.parquet(path)
    first = frame.select("bits").first()
    return Blocks(frame.drop("bits"), first["bits"] if first else 1)


def rank_bounds(blocks: Blocks, ranks: DataFrame) -> DataFrame:
    """``(range, best)``: the greatest rank of a range, infinite if a document has none.

    Store it with the ranks of a pass: among equal scores it tells which ranges matter.
    """
    best = F.coalesce("pagerank", F.lit(float("inf")))
    return ranks.groupBy(blocks.range_of(F.col("link_id")).alias("range")).agg(F.max(best).alias("best"))


def _wanted(group: list[Operand]) -> set[str]:
    return {t for op in group if not op.negated for t, _ in op.terms}


def bounded_ranges(blocks: Blocks, query: Query, ranking: str = "ts_rank", order: str = "asc") -> DataFrame:
    """``(range, bound)`` of the ranges that may hold a match, from the small columns.

    No match in the range comes before ``bound`` in the order: it is a least score, or
    for a descending order a greatest one, negated.
    """
    terms = terms_in_order(query)
    known = ("least_tf", "most_tf", "least_counted", "most_counted")

    def of_term(term: str) -> Column:
        here = {c: F.when(F.col("term") == term, F.col(c)) for c in known}
        bounds = [(F.min(v) if c.startswith("least") else F.max(v)).alias(c) for c, v in here.items()]
        return F.when(F.count(here["most_tf"]) > 0, F.struct(*bounds))

    # A range may have several blocks of a term.
    per_term = [of_term(t).alias(f"t{i}") for i, t in enumerate(terms)]
    found = blocks.frame.select("term", "range", *known).where(F.col("term").isin(terms)).groupBy("range").agg(*per_term)
    index = {t: f"t{i}" for i, t in enumerate(terms)}

    def value(term: str, which: str) -> Column:
        return F.col(f"{index[term]}.{which}")

    def score(present: set[str], which: str) -> Column:
        """The score of a document with just these words, each as often as told."""
        if ranking == "log_tf":
            wanted = sorted({t for group in query for t in _wanted(group)})
            return log_tf([value(t, f"{which}_tf") for t in wanted if t in present])
        counts = [value(t, f"{which}_counted") if t in present else F.lit(None).cast("int") for t in terms]
        if not is_near(query):
            return rank_often(counts).cast("double")
        return most_near(counts) if which == "most" else F.lit(0.0)

    may = F.lit(False)
    least = []
    for group in query:
        holds = F.lit(True)
        for t in _wanted(group):
            holds = holds & F.col(index[t]).isNotNull()
        may = may | holds
        least.append(F.when(holds, score(_wanted(group), "least")))
    if order == "asc":
        bound = F.least(*least) if len(least) > 1 else least[0]
    else:
        bound = -score(set(terms), "most")
    return found.where(may).select("range", bound.alias("bound"))


def _skips(query: Query) -> bool:
    """Whether every alternative has a wanted word; else a match may be in no block at all."""
    return bool(query) and all(_wanted(group) for group in query)


def block_matches(docs: DataFrame, blocks: Blocks, query: Query, ranking: str = "log_tf") -> DataFrame:
    """As ``search.matches``: all matches, from the blocks of ranges that may hold one."""
    terms = terms_in_order(query)
    if not _skips(query):
        every = blocks.frame.select("range").distinct()
        return matches(docs, blocks.postings(terms, every), query, ranking)
    return matches(docs, blocks.postings(terms, bounded_ranges(blocks, query, ranking)), query, ranking)


@dataclass
class TopPage:
    """A first page, and how many of the ranges that may hold a match were decoded for it."""

    page: DataFrame
    ranges: int
    decoded: int


def search_top(
    docs: DataFrame,
    blocks: Blocks,
    text: str,
    phrase: bool = False,
    limit: int = PAGE_SIZE,
    relevance_order: str = "asc",
    english: bool = True,
    ranks: DataFrame | None = None,
    best_ranks: DataFrame | None = None,
    ranking: str = "ts_rank",
) -> TopPage:
    """The first page of ``search``, row by row the same, from as few blocks as will do.

    ``best_ranks`` are those of ``rank_bounds`` for the same ranks.  Without them no range
    is left out that may hold a score equal to that of the last row.
    """
    if not 0 < limit <= MOST_ROWS:
        raise ValueError(f"a page has 1 to {MOST_ROWS} rows")
    query = [] if text == "" else (read_phrase if phrase else read_query)(docs, text, english)
    if not _skips(query):
        postings = blocks.postings(terms_in_order(query), blocks.frame.select("range").distinct())
        found: SearchResult = search(docs, postings, text, phrase, 0, limit, relevance_order, english, ranks, ranking=ranking)
        every = blocks.frame.select("range").distinct().count()
        return TopPage(found.page, every, every)
    current = (docs if ranks is None else ranks).select("link_id", "pagerank")
    order, terms = search_order(relevance_order), terms_in_order(query)
    bounds = bounded_ranges(blocks, query, ranking, relevance_order)
    if best_ranks is None:
        bounds = bounds.withColumn("best", F.lit(float("inf")))
    else:
        bounds = bounds.join(best_ranks.select("range", "best"), "range", "left").na.fill({"best": float("inf")})
    bounds = bounds.persist()
    seen: list[int] = []
    top: list = []

    def decode(ranges: DataFrame | list[int]) -> list:
        found = matches(docs, blocks.postings(terms, ranges), query, ranking).join(current, "link_id")
        return sorted([*top, *found.orderBy(*order).limit(limit).collect()], key=_sort_key(relevance_order))[:limit]

    try:
        total = bounds.count()
        # The most promising ranges, and some more if they do not fill the page.
        for size in (FIRST_RANGES, 8 * FIRST_RANGES):
            if len(top) < limit and len(seen) < total:
                some = bounds.where(~F.col("range").isin(seen)).orderBy("bound", F.col("best").desc(), "range").limit(size)
                chosen = [r["range"] for r in some.collect()]
                seen += chosen
                top = decode(chosen)
        # Of the others those that may hold a row of the page, in one go.
        rest = bounds.where(~F.col("range").isin(seen))
        if len(top) == limit:
            last = top[-1]
            score = last["relevance"] if relevance_order == "asc" else -last["relevance"]
            rank = float("inf") if last["pagerank"] is None else last["pagerank"]
            rest = rest.where((F.col("bound") < score) | ((F.col("bound") == score) & (F.col("best") >= rank)))
        more = rest.count() if len(seen) < total else 0
        if more:
            top = decode(rest)
    finally:
        bounds.unpersist()
    found_rows = docs.sparkSession.createDataFrame(
        [(r["link_id"], r["relevance"], r["pagerank"]) for r in top], "link_id string, relevance double, pagerank double"
    )
    extra = {"relevance": "double", "pagerank": "double"}
    return TopPage(fetch_page(docs, found_rows, order, 0, limit, extra), total, len(seen) + more)


def _sort_key(relevance_order: str):
    sign = 1 if relevance_order == "asc" else -1
    return lambda r: (sign * r["relevance"], r["pagerank"] is not None, -(r["pagerank"] or 0), r["link_id"])
