"""The inverted index as a table of postings.

One row per document and term with the number and the positions of its
occurrences.  Positions count all words, stop words included, so phrases keep
their distances.

A document is one row, so its words are grouped where it lies and no text is shuffled.
Some documents at a time become a chunk: their words as numbers, and the distinct
words, which are then stemmed once for all of them.  Python workers are handed documents
and chunks as rows of a few words, so that a batch of rows is small however much a task reads.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.stem import stem
from webloom.functions.text import STOP_WORDS, let, search_text, tokens
from webloom.session import planning

#: Words of the documents that are analysed together, if they are more than one.
CHUNK_WORDS = 400_000
#: Words in a row that a Python worker is handed: the 10,000 rows of a batch are some 10 MB.
ROW_WORDS = 128
#: Documents that went are looked up by broadcast up to this number, some 100 bytes each.
MOST_BROADCAST = 1_000_000
#: A stored index is written by tasks that sort the postings of so many bytes of text in
#: memory, whatever number of partitions the session has, and a small one by all cores.
TEXT_PER_TASK, LEAST_TEXT = 24_000_000, 1_000_000
#: Other stored postings are merged in tasks of this size.
_TASKS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def build_postings(
    docs: DataFrame, english: bool = True, partitions: int | None = None, dealt: bool = False
) -> DataFrame:
    """Postings ``(link_id, term, tf, positions)`` of ``docs(link_id, title, content)``.

    With ``english`` stop words are dropped and terms are stems, otherwise all
    words are kept as they are.

    Nothing is shuffled, unless the input has fewer partitions than the session has
    cores, as a single small file has: its texts are then dealt anew.  ``partitions``
    deals them into so many in any case.  With ``dealt`` the texts are dealt by ranges of the
    hash of their ids, as an index is stored: text is several times smaller than its postings.
    Without ``partitions`` there are as many ranges as the size of the texts asks for, which is
    summed up by a job of its own.
    """
    texts = docs.select("link_id", search_text(F.col("title"), F.col("content")).alias("_text"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if dealt:
        texts = texts.repartitionByRange(partitions or _tasks(texts, cores), F.xxhash64("link_id"))
    elif partitions or _is_scan(texts) and texts.rdd.getNumPartitions() < cores:
        texts = texts.repartition(partitions or cores)
    words = texts.select("link_id", F.inline(_cut(tokens(F.col("_text")))))
    rows = "link_id string, term string, tf int, positions array<int>"
    if not english:
        # Words are terms, so one worker a task does both steps.
        return words.mapInArrow(partial(_one_by_one, _coded_grouped), rows)
    coded = words.mapInArrow(
        partial(_one_by_one, _coded), "ids array<string>, lengths array<int>, codes array<int>, words array<string>, first boolean"
    )
    term = F.transform("words", lambda w: F.when(~w.isin(*STOP_WORDS), stem(w)))
    coded = coded.select("ids", "lengths", "codes", term.alias("terms"), "first")
    return coded.mapInArrow(partial(_one_by_one, _grouped), rows)


def _cut(words: Column) -> Column:
    """Pieces ``(words, first)`` of at most ``ROW_WORDS`` words, one at least."""

    def pieces(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(ROW_WORDS))
        return F.transform(starts, lambda k: F.struct(F.slice(w, k + 1, ROW_WORDS).alias("words"), (k == 0).alias("first")))

    return let(words, pieces)


def _tasks(texts: DataFrame, cores: int) -> int:
    size = texts.agg(F.sum(F.octet_length("_text")).alias("size")).first()["size"] or 0
    return max(1, math.ceil(size / TEXT_PER_TASK), min(cores, math.ceil(size / LEAST_TEXT)))


def _is_scan(df: DataFrame) -> bool:
    """Whether the number of partitions is known without running a job."""
    return "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, cut where a row is ``first`` of its document or chunk, so that none is torn.

    A batch is given back before the next one is read; of its last item a copy is kept.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        starts = _starts(batch)
        cut = int(starts[-1]) if len(starts) else 0
        if len(starts) and (held or cut):
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.take(pa.array(np.arange(cut, len(batch)))))
        del batch
        pa.default_memory_pool().release_unused()
    if held:
        yield pa.concat_batches(held)


def _one_by_one(of_batch: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of each batch of whole documents or chunks."""
    for batch in _whole(batches):
        yield from of_batch(batch)
        del batch


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    return np.flatnonzero(batch.column("first").to_numpy(zero_copy_only=False))


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, pa.DictionaryArray]]:
    """Ids of several documents, their numbers of words, and all their words one after another."""
    starts, words = _starts(batch), batch.column("words")
    ids, flat = batch.column("link_id").take(pa.array(starts)), words.flatten()
    lengths = np.add.reduceat(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64), starts)
    ends = np.cumsum(lengths)
    # A chunk begins wherever the running number of words passes a multiple.
    edges = [0, *(np.flatnonzero(np.diff((ends - lengths) // CHUNK_WORDS)) + 1).tolist(), len(lengths)]
    for low, high in zip(edges[:-1], edges[1:]):
        at = int(ends[low] - lengths[low])
        yield ids.slice(low, high - low), lengths[low:high], flat.slice(at, int(ends[high - 1]) - at).dictionary_encode()


def _coded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of each chunk: all have some of its words as numbers, the first one has the
    ids and lengths of the documents and the distinct words beside them."""
    for ids, lengths, words in _chunks(batch):
        count = max(1, math.ceil(len(words) / ROW_WORDS))
        once = lambda values: pa.ListArray.from_arrays(pa.array([0, *[len(values)] * count], pa.int32()), values)
        cuts = np.minimum(np.arange(count + 1) * ROW_WORDS, len(words))
        columns = [
            once(ids),
            once(pa.array(lengths, pa.int32())),
            pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words.indices.cast(pa.int32())),
            once(words.dictionary),
            pa.array(np.arange(count) == 0),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["ids", "lengths", "codes", "words", "first"])


def _coded_grouped(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for ids, lengths, words in _chunks(batch):
        yield from _postings(ids, lengths, words.indices.to_numpy(), words.dictionary)


def _grouped(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Postings of such chunks."""
    edges = [*_starts(batch).tolist(), len(batch)]
    for low, high in zip(edges[:-1], edges[1:]):
        ids, lengths, codes, terms = (batch.column(c).slice(low, high - low).flatten() for c in range(4))
        yield from _postings(ids, lengths.to_numpy(), codes.to_numpy(), terms)


def _postings(ids: pa.Array, lengths: np.ndarray, codes: np.ndarray, terms: pa.Array) -> Iterator[pa.RecordBatch]:
    """Postings of a chunk by term and document; a word without a term is left out and keeps its place.

    Where a task sorts its postings it has but to merge those of some chunks.
    """
    term = terms.dictionary_encode()
    names, by_id = pc.array_sort_indices(term.dictionary), pc.array_sort_indices(ids)
    # The place of each term and document in their orders; one number too many for no term.
    at = np.append(_places(names), -1)
    number = at[pc.fill_null(term.indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)][codes]
    doc = np.repeat(_places(by_id), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    kept = number >= 0
    if not kept.any():
        return
    key, place = (number * len(lengths) + doc)[kept], place[kept]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    ends = np.concatenate([first, [len(key)]]).astype(np.int32)
    group = key[first]
    columns = [
        ids.take(by_id.take(pa.array(group % len(lengths)))),
        term.dictionary.take(names.take(pa.array(group // len(lengths)))),
        pa.array(np.diff(ends), pa.int32()),
        pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order].astype(np.int32))),
    ]
    yield pa.RecordBatch.from_arrays(columns, ["link_id", "term", "tf", "positions"])


def _places(order: pa.Array) -> np.ndarray:
    """Where each value comes in ``order``, the indices of the sorted values."""
    places = np.empty(len(order), np.int64)
    places[order.to_numpy()] = np.arange(len(order))
    return places


def update_postings(
    postings: DataFrame, changed: DataFrame, removed: DataFrame | None = None, english: bool = True
) -> DataFrame:
    """Postings after some documents changed, are new or went; the others are not analysed.

    ``changed`` are documents as they are now, ``removed`` has the ``link_id`` of
    those that are gone.  The result is that of a rebuild; store it as the next
    version, as searches may still read this one.
    """
    gone = changed.select("link_id")
    if removed is not None:
        gone = gone.unionByName(removed.select("link_id"))
    gone = gone.distinct()
    kept = postings.join(small_ids(gone, gone.count()), "link_id", "left_anti")
    return kept.select("link_id", "term", "tf", "positions").unionByName(build_postings(changed, english))


def small_ids(ids: DataFrame, at_most: int) -> DataFrame:
    """``ids``, to be broadcast if they are not too many: the postings they are looked up
    from then stay where they are.  Beyond that Spark chooses, and may shuffle both."""
    return F.broadcast(ids) if at_most <= MOST_BROADCAST else ids


def write_postings(postings: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """Store postings so that a search reads only the pages of its terms.

    Each task sorts what it holds by term and document and writes it; nothing is
    shuffled unless ``partitions`` asks for so many ranges of (term, document), whose
    bounds take a second pass over the input.  A file
    holds the postings of some documents: their ids are repeated by number, and a
    term that is in every document lies in every file.  Postings that are built ``dealt``
    come in tasks of a size that is sorted in memory.  Give each version of an index a
    path of its own.
    """
    keys = ("term", "link_id")
    with planning(postings.sparkSession, _TASKS):
        held = postings.repartitionByRange(partitions, *keys) if partitions else postings
        rows = held.sortWithinPartitions(*keys).write.mode("overwrite")
        rows.option("parquet.dictionary.page.size", 4 << 20).parquet(path)
    return postings.sparkSession.read.schema(postings.schema).parquet(path)
