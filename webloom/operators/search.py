"""Search over postings: X2-X5, P14, J10, A1, A2, T1-T3.

The search text is an argument.  It becomes a list of alternatives, each a list
of operands that must all hold, and that becomes one condition over one
aggregate of the postings: the terms of the query are filtered in the scan, and
a single shuffle by document brings the few remaining rows together.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.stem import stem
from webloom.functions.text import STOP_WORDS, tokens
from webloom.operators.ranking import is_near, log_tf, rank_often, rank_positions, terms_in_order, ts_rank
from webloom.schemas import DOCUMENT_COLUMNS, PAGE_SIZE
from webloom.session import shared_dir

#: Rows of a page that are fetched as literals; a larger page is joined.
LITERAL_ROWS = 1000
#: Offset and page up to which rows are skipped by one task; beyond it they are counted by range.
HEAP_ROWS = 10_000
RANKINGS = ("ts_rank", "log_tf")


@dataclass(frozen=True)
class Operand:
    """Terms with their distances from the first one; one term or a phrase."""

    terms: tuple[tuple[str, int], ...]
    negated: bool = False


class SearchResult:
    """One page of documents in search order and the one-row total.

    The page is found when it is first asked for, so a caller that needs the
    total alone runs no job for the page.
    """

    def __init__(self, total: DataFrame, fetch: Callable[[], DataFrame]):
        self.total, self._fetch = total, fetch

    @cached_property
    def page(self) -> DataFrame:
        return self._fetch()


def _analyse(docs: DataFrame, chunks: list[str], english: bool) -> list[tuple[tuple[str, int], ...]]:
    """Terms and positions of each chunk of the search text, by the index's own rules.

    The chunks are literals, so this is one row of constants, not a job over data.
    """

    if not chunks:
        return []

    def terms_of(chunk: Column) -> Column:
        return F.transform(
            tokens(chunk),
            lambda w, i: F.struct(w.alias("word"), (stem(w) if english else w).alias("term"), i.alias("at")),
        )

    found = F.transform(F.array(*[F.lit(c) for c in chunks]), terms_of)
    out: list[tuple[tuple[str, int], ...]] = []
    for terms in docs.sparkSession.sql("SELECT 1").select(found).first()[0]:
        kept = [(t["term"], t["at"]) for t in terms if not (english and t["word"] in STOP_WORDS)]
        out.append(tuple((term, at - kept[0][1]) for term, at in kept))
    return out


def read_query(docs: DataFrame, text: str, english: bool = True) -> list[list[Operand]]:
    """Alternatives of a web-style search text.

    Words are joined by AND, ``"..."`` is a phrase (up to the end when it is
    not closed), ``or`` between operands separates alternatives, a leading
    ``-`` negates.  A word that holds several tokens is a phrase of them.
    Stop words drop out.  No text is an error.
    """
    parts = re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', text)
    operands = _analyse(docs, [quoted or word for _, quoted, word in parts], english)
    groups: list[list[Operand]] = [[]]
    for (minus, _, word), terms in zip(parts, operands):
        if word.lower() == "or" and not minus:
            groups.append([])
        elif terms:
            groups[-1].append(Operand(terms, bool(minus)))
    return [group for group in groups if group]


def read_phrase(docs: DataFrame, text: str, english: bool = True) -> list[list[Operand]]:
    """The whole text is one phrase."""
    (terms,) = _analyse(docs, [text], english)
    return [[Operand(terms)]] if terms else []


def _shift(positions: Column, distance: int) -> Column:
    return F.transform(positions, lambda p: p - distance)


def _holds(operand: Operand, index: dict[str, int]) -> Column:
    """Whether a document with columns ``tf_i`` and ``pos_i`` has the operand."""
    if len(operand.terms) == 1:
        found = F.col(f"tf_{index[operand.terms[0][0]]}").isNotNull()
    else:
        # Where the phrase would have to start for each term; all must agree.
        starts = None
        for term, distance in operand.terms:
            shifted = _shift(F.col(f"pos_{index[term]}"), distance)
            starts = shifted if starts is None else F.array_intersect(starts, shifted)
        found = F.coalesce(F.size(starts) > 0, F.lit(False))
    return ~found if operand.negated else found


def matches(docs: DataFrame, postings: DataFrame, query: list[list[Operand]], ranking: str = "log_tf") -> DataFrame:
    """``(link_id, relevance)`` of the documents a query matches.

    Relevance is the sum of ``1 + ln(tf)`` over the distinct wanted terms, which reads no
    positions but those of phrases, or that of PostgreSQL's ``ts_rank`` over the positions
    of all terms.  Where that only asks how often a term occurs, the positions are counted
    where the postings lie, and those of phrases alone are shuffled.
    """
    if ranking not in RANKINGS:
        raise ValueError(f"ranking must be one of {RANKINGS}")
    terms = sorted({t for group in query for op in group for t, _ in op.terms})
    if not terms:
        return docs.select("link_id", F.lit(0.0).alias("relevance")).where(F.lit(False))
    index = {term: i for i, term in enumerate(terms)}
    near = ranking == "ts_rank" and is_near(query)
    counted = ranking == "ts_rank" and not near
    in_phrase = {t for group in query for op in group if near or len(op.terms) > 1 for t, _ in op.terms}
    wanted = {t for group in query for op in group if not op.negated for t, _ in op.terms}

    def only(term: str, column: str) -> Column:
        return F.when(F.col("term") == term, F.col(column))

    hits = postings.where(F.col("term").isin(terms))
    # A document has one posting per term, so max() sees one value.
    tfs = [F.max(only(t, "tf")).alias(f"tf_{i}") for t, i in index.items()]
    kept = [f"tf_{i}" for i in index.values()]
    if counted:
        hits = hits.withColumn("_counted", F.when(F.col("positions").isNotNull(), F.size(rank_positions(F.col("positions")))))
        tfs += [F.max(only(t, "_counted")).alias(f"counted_{i}") for t, i in index.items()]
        kept += [f"counted_{i}" for i in index.values()]
    if in_phrase:
        # Positions are gathered as a list, which is hashed; the maximum of an array would be sorted.
        held = F.collect_list(F.when(F.col("term").isin(*sorted(in_phrase)), F.struct("term", "positions")))
        gathered = hits.groupBy("link_id").agg(*tfs, held.alias("_held"))

        def of_term(t: str) -> Column:
            return F.element_at(F.filter("_held", lambda h: h["term"] == t), 1)["positions"]

        per_doc = gathered.select(
            "link_id", *kept, *[F.when(F.col(f"tf_{index[t]}").isNotNull(), of_term(t)).alias(f"pos_{index[t]}") for t in sorted(in_phrase)]
        )
    else:
        per_doc = hits.groupBy("link_id").agg(*tfs)
    if any(all(op.negated for op in group) for group in query):
        # An alternative without a wanted term can hold where no posting is.
        per_doc = docs.select("link_id").join(per_doc, "link_id", "left")
    condition = F.lit(False)
    for group in query:
        all_hold = F.lit(True)
        for operand in group:
            all_hold = all_hold & _holds(operand, index)
        condition = condition | all_hold
    if counted:
        relevance = rank_often([F.col(f"counted_{index[t]}") for t in terms_in_order(query)]).cast("double")
    elif near:
        relevance = ts_rank(query, {t: F.col(f"pos_{i}") for t, i in index.items()}).cast("double")
    else:
        relevance = log_tf([F.col(f"tf_{index[t]}") for t in sorted(wanted)])
    return per_doc.where(condition).select("link_id", relevance.alias("relevance"))


def search(
    docs: DataFrame,
    postings: DataFrame,
    text: str,
    phrase: bool = False,
    offset: int = 0,
    limit: int | None = PAGE_SIZE,
    relevance_order: str = "asc",
    english: bool = True,
    ranks: DataFrame | None = None,
    after: tuple[float, float | None, str] | str | None = None,
    ranking: str = "ts_rank",
) -> SearchResult:
    """All documents for an empty text, else a phrase or a web-style match.

    A match is ordered by relevance (least relevant first unless
    ``relevance_order="desc"``), then by falling rank with unranked documents
    first, then by id (T1).  The page has the document columns and ``rank_pos``,
    a match also ``relevance``, which ``ranking`` chooses (``matches``).

    ``ranks(link_id, pagerank)`` are the current ranks where they are kept apart
    from the documents; bucketed by ``link_id`` they are joined without being
    shuffled.  ``after`` is the key of the last row of the page before (relevance,
    rank and id, or the id alone for an empty text): rows up to it are filtered
    out, and ``offset`` only numbers the page.  ``limit=None`` takes all rows.
    """
    if relevance_order not in ("asc", "desc"):
        raise ValueError("relevance_order must be 'asc' or 'desc'")
    if text == "":
        total = docs.agg(F.count(F.lit(1)).alias("total"))
        return SearchResult(total, lambda: match_all(docs, offset, limit, after))
    query = read_phrase(docs, text, english) if phrase else read_query(docs, text, english)
    found = matches(docs, postings, query, ranking)

    def fetch() -> DataFrame:
        # Ordering needs the rank only, so no text is read or sorted for it.
        current = (docs if ranks is None else ranks).select("link_id", "pagerank")
        ranked = found.join(current, "link_id")
        if after is not None:
            ranked = ranked.where(follows(after, relevance_order))
        extra = {"relevance": "double", "pagerank": "double"}
        return fetch_page(docs, ranked, search_order(relevance_order), offset, limit, extra, skip=after is None)

    return SearchResult(found.agg(F.count(F.lit(1)).alias("total")), fetch)


def search_order(relevance_order: str = "asc") -> list[Column]:
    """T1."""
    relevance = F.col("relevance")
    return [
        relevance.asc() if relevance_order == "asc" else relevance.desc(),
        F.col("pagerank").desc_nulls_first(),
        F.col("link_id").asc(),
    ]


def follows(key: tuple[float, float | None, str], relevance_order: str) -> Column:
    """Rows that come after ``key`` in search order."""
    relevance, rank, link_id = key
    found, held = F.col("relevance"), F.col("pagerank")
    lower = held.isNotNull() if rank is None else held < rank
    later = lower | (held.eqNullSafe(F.lit(rank)) & (F.col("link_id") > link_id))
    return (found > relevance if relevance_order == "asc" else found < relevance) | ((found == relevance) & later)


def match_all(docs: DataFrame, offset: int = 0, limit: int | None = PAGE_SIZE, after: str | None = None) -> DataFrame:
    """A page of all documents by id; those after the id ``after`` if it is given."""
    ids = docs.select("link_id")
    if after is not None:
        ids = ids.where(F.col("link_id") > after)
    return fetch_page(docs, ids, [F.col("link_id").asc()], offset, limit, skip=after is None)


def rows_of_page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """The rows ``offset`` to ``offset + limit`` in order.

    A small page is the heap of a single task.  For a deep one the rows are cut
    into ranges of the order and written; the sizes of the ranges tell which of
    them hold the page, and only those are read.
    """
    if offset + limit <= HEAP_ROWS:
        return rows.orderBy(*order).offset(offset).limit(limit)
    shared_dir(rows.sparkSession)
    part = F.spark_partition_id()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", part).checkpoint()
    sizes = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
    at, wanted, skipped = 0, [], 0
    for number in sorted(sizes):
        if at + sizes[number] <= offset:
            skipped = at + sizes[number]
        elif at < offset + limit:
            wanted.append(number)
        at += sizes[number]
    held = ranged.where(F.col("_part").isin(wanted)).drop("_part")
    return held.orderBy(*order).offset(offset - skipped).limit(limit)


def numbered_page(rows: DataFrame, order: list[Column], offset: int, limit: int | None, first: int = 1) -> DataFrame:
    """The rows ``offset`` to ``offset + limit`` in order, all after ``offset`` without a
    limit, with their number ``rank_pos`` from ``first``.

    The rows are cut into ranges of the order and written with their place in the
    range; the sizes of the ranges before tell where each begins.
    """
    shared_dir(rows.sparkSession)
    # The second is partition << 33 | place in it.
    placed = {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(placed).checkpoint()
    sizes = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
    starts, at = [], 0
    for number in range(max(sizes, default=0) + 1):
        starts.append(at)
        at += sizes.get(number, 0)
    place = F.array(*[F.lit(n).cast("long") for n in starts])[F.col("_part")] + F.col("_at")
    numbered = ranged.withColumn("_place", place).where(F.col("_place") >= offset)
    if limit is not None:
        numbered = numbered.where(F.col("_place") < offset + limit)
    return numbered.withColumn("rank_pos", (F.col("_place") - offset + first).cast("int")).drop("_part", "_at", "_place")


def fetch_page(
    docs: DataFrame,
    rows: DataFrame,
    order: list[Column],
    offset: int,
    limit: int | None,
    extra: dict[str, str] | None = None,
    skip: bool = True,
) -> DataFrame:
    """The documents of one page of ``rows`` in ``order``, with ``rank_pos``.

    The ids of a page are fetched first: as literals they are pushed into the
    scan of the documents, which then reads the row groups that may hold them in
    place of the text of every document.  A page of more than ``LITERAL_ROWS``
    is joined, and one without a limit or beyond ``HEAP_ROWS`` is numbered by
    ranges of the order.  ``extra`` names the columns of ``rows`` to keep, with their
    types.  Without ``skip`` the page starts with the first row.
    """
    if limit is not None and limit <= 0:
        raise ValueError("a page has one row at least")
    if offset < 0:
        raise ValueError("the offset must not be negative")
    extra = extra or {}
    rows = rows.select("link_id", *extra)
    start = offset if skip else 0
    given = docs.select(*DOCUMENT_COLUMNS)
    columns = [*DOCUMENT_COLUMNS, *[c for c in extra if c not in DOCUMENT_COLUMNS], "rank_pos"]
    if limit is None or limit > LITERAL_ROWS and start + limit > HEAP_ROWS:
        numbered = numbered_page(rows, order, start, limit, offset + 1)
        return given.drop(*extra).join(numbered, "link_id").select(*columns).orderBy("rank_pos")
    page = rows_of_page(rows, order, start, limit)
    if limit > LITERAL_ROWS:
        # The window sorts the rows of one page.
        numbered = page.withColumn("rank_pos", (F.row_number().over(Window.orderBy(*order)) + offset).cast("int"))
        return given.drop(*extra).join(numbered, "link_id").select(*columns).orderBy("rank_pos")
    found = page.collect()

    def of_row(values: list, kind: str) -> Column:
        pairs = [F.lit(x).cast(t) for r, v in zip(found, values) for x, t in ((r["link_id"], "string"), (v, kind))]
        return F.create_map(*pairs)[F.col("link_id")] if pairs else F.lit(None).cast(kind)

    added = {name: of_row([r[name] for r in found], kind) for name, kind in extra.items()}
    added["rank_pos"] = of_row([offset + n + 1 for n in range(len(found))], "int")
    given = given.where(F.col("link_id").isin([r["link_id"] for r in found]))
    return given.withColumns(added).select(*columns).orderBy("rank_pos")
