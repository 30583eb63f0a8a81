"""Maximal periodic runs of words, by common extensions in suffix trees.

A run is a stretch of words with a smallest period that occurs in it several times
and that no neighbouring word extends.  Every run holds a Lyndon root: for one of the
two orders of the words, the longest Lyndon word that starts at a place of the run has
the length of the period.  So a text of n words has at most 2n candidates, and each is
extended as far as its period holds, to the right by the longest common extension of
two suffixes and to the left by that of two prefixes.  Extensions are looked up in the
suffix trees of the text and of its reversal, built by Ukkonen's method: the common
extension of two suffixes is the depth of the lowest common ancestor of their leaves.

A run of four periods holds each of its words four times.  Words that are rarer cannot
be in one, nor can a run reach across them, so a text is first cut at such words, again
and again inside the pieces, and trees are built for what is left.  That loses no run.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from webloom.llm.common import unused

#: Least length of a run in words, and in periods.
LEAST_LENGTH, LEAST_PERIODS = 6, 4

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

Run = tuple[int, int, int]


def words_of(text: bytes) -> list[bytes]:
    """Runs of bytes other than blank, tab, line feed, vertical tab, form feed and return."""
    return text.split()


# -- suffix trees -------------------------------------------------------------


class SuffixTree:
    """The suffix tree of a sequence of small numbers, with common extensions in constant time.

    Edges lie in arrays by the node they lead to; the child of a node by a symbol is
    one dictionary entry.  The sequence ends with a symbol that is smaller than all
    others, so every suffix has a leaf.
    """

    def __init__(self, symbols: Sequence[int]):
        self.text = [s + 1 for s in symbols] + [0]
        self.size = len(self.text)
        self._build()
        self._tour()

    def _build(self) -> None:
        """Ukkonen: one symbol after the other, with suffix links and an open end for leaves."""
        text, size = self.text, self.size
        width = max(text) + 1
        child: dict[int, int] = {}
        low, high, link = [0], [0], [0]
        node, edge, length, waiting = 0, 0, 0, 0
        for i, symbol in enumerate(text):
            waiting += 1
            inner = -1
            while waiting:
                if not length:
                    edge = i
                key = node * width + text[edge]
                to = child.get(key)
                if to is None:
                    child[key] = len(low)
                    low.append(i)
                    high.append(size)
                    link.append(0)
                    if inner > 0:
                        link[inner] = node
                    inner = -1
                else:
                    end = high[to]
                    span = (i + 1 if end == size else end) - low[to]
                    if length >= span:
                        edge += span
                        length -= span
                        node = to
                        continue
                    if text[low[to] + length] == symbol:
                        if inner > 0 and node:
                            link[inner] = node
                        length += 1
                        break
                    split = len(low)
                    low.append(low[to])
                    high.append(low[to] + length)
                    link.append(0)
                    child[key] = split
                    child[split * width + symbol] = split + 1
                    low.append(i)
                    high.append(size)
                    link.append(0)
                    low[to] += length
                    child[split * width + text[low[to]]] = to
                    if inner > 0:
                        link[inner] = split
                    inner = split
                waiting -= 1
                if not node and length:
                    length -= 1
                    edge = i - waiting + 1
                elif node:
                    node = link[node]
        self._child, self._width, self._low, self._high = child, width, low, high

    def _tour(self) -> None:
        """Leaves in the order of their suffixes, and a table for the depths between them.

        An Euler tour visits an inner node between the leaves of its children.  The
        lowest common ancestor of two leaves is the shallowest node visited between
        them, so of the tour only the shallowest depth between neighbouring leaves is
        kept, with the minima of all stretches of 1, 2, 4, ... of them.
        """
        suffixes, between = self._leaves(mirrored=False)
        self.rank = self._ranks(suffixes)
        self._least = [np.array(between, dtype=np.int32)]
        while 2 * (step := 1 << (len(self._least) - 1)) <= self.size:
            last = self._least[-1]
            self._least.append(np.minimum(last[:-step], last[step:]))

    def _ranks(self, suffixes: list[int]) -> np.ndarray:
        rank = np.empty(self.size, dtype=np.int64)
        rank[suffixes] = np.arange(self.size)
        return rank

    def mirrored_rank(self) -> np.ndarray:
        """Ranks of the suffixes if the symbols are ordered the other way round.

        The end of the text stays smaller than all symbols, so a suffix that another
        one goes on from still comes first.
        """
        return self._ranks(self._leaves(mirrored=True)[0])

    def _leaves(self, mirrored: bool) -> tuple[list[int], list[int]]:
        """(suffix of each leaf, least depth since the leaf before) along a tour of the tree."""
        size, low, high = self.size, self._low, self._high
        keys = np.fromiter(self._child, np.int64, len(self._child))
        to = np.fromiter(self._child.values(), np.int64, len(keys))
        parents, symbols = keys // self._width, keys % self._width
        if mirrored:
            symbols = np.where(symbols == 0, 0, self._width - symbols)
        # The greatest symbol first, as a stack takes the last one off.
        order = np.lexsort((-symbols, parents))
        children: dict[int, list[int]] = {}
        for parent, node in zip(parents[order].tolist(), to[order].tolist()):
            children.setdefault(parent, []).append(node)
        suffixes, between = [], []
        shallowest = 0
        stack = [(0, 0, 0)]
        while stack:
            node, above, depth = stack.pop()
            shallowest = min(shallowest, above)
            below = children.get(node)
            if below is None:
                between.append(shallowest)
                suffixes.append(size - depth)
                shallowest = depth
            else:
                stack.extend([(c, depth, depth + high[c] - low[c]) for c in below])
        return suffixes, between

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``a`` and at ``b``, a != b."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), dtype=np.int64)
        for k in np.unique(level):
            at, row = level == k, self._least[k]
            out[at] = np.minimum(row[low[at]], row[high[at] + 1 - (1 << k)])
        return out


# -- runs ---------------------------------------------------------------------


def _longest_lyndon(rank: Sequence[int]) -> list[int]:
    """Length of the longest Lyndon word from each place: up to the next smaller suffix."""
    size = len(rank)
    out, held = [0] * size, []
    for i in range(size - 1, -1, -1):
        while held and rank[held[-1]] > rank[i]:
            held.pop()
        out[i] = (held[-1] if held else size) - i
        held.append(i)
    return out


def runs_of(symbols: np.ndarray, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> list[Run]:
    """(start, length, period) of the runs of a sequence of numbers from 0, by start and period."""
    size = len(symbols)
    if size < max(least_length, 2):
        return []
    ahead, back = SuffixTree(symbols.tolist()), SuffixTree(symbols[::-1].tolist())
    found: list[np.ndarray] = []
    places = np.arange(size)
    for rank in (ahead.rank, ahead.mirrored_rank()):
        period = np.array(_longest_lyndon(rank[:size].tolist()))
        # The root [i, i + q) is extended as far as words q apart are the same.
        fits = places + period < size
        i, q = places[fits], period[fits]
        right = ahead.common(i, i + q)
        left = np.zeros_like(i)
        inner = i > 0
        left[inner] = back.common(size - i[inner], size - i[inner] - q[inner])
        found.append(np.stack([i - left, left + q + right, q], axis=1))
    rows = np.concatenate(found)
    kept = rows[rows[:, 1] >= np.maximum(least_length, least_periods * rows[:, 2])]
    return [tuple(r) for r in np.unique(kept, axis=0).tolist()] if len(kept) else []


def _pieces(codes: np.ndarray, least_length: int, least_periods: int) -> list[tuple[int, int]]:
    """The stretches that may hold a run: each word of them is in them often enough."""
    done, waiting = [], [(0, len(codes))]
    while waiting:
        low, high = waiting.pop()
        if high - low < least_length:
            continue
        part = codes[low:high] - codes[low:high].min()
        rare = np.flatnonzero(np.bincount(part)[part] < least_periods)
        if not len(rare):
            done.append((low, high))
            continue
        edges = np.concatenate([[-1], rare, [high - low]]) + low
        long = np.flatnonzero(np.diff(edges) > least_length)
        waiting.extend((int(edges[k]) + 1, int(edges[k + 1])) for k in long)
    return done


def find_runs(words: Sequence[bytes], least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> list[Run]:
    """(start, length, period) of all runs of a text's words, by start and period.

    A run has at least ``least_length`` words and ``least_periods`` periods, which are
    two at least.
    """
    if least_periods < 2:
        raise ValueError("a run has two periods at least")
    if len(words) < least_length:
        return []
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words])
    if len(codes) - len(number) < (least_periods - 1):
        return []
    found: list[Run] = []
    for low, high in _pieces(codes, least_length, least_periods):
        _, small = np.unique(codes[low:high], return_inverse=True)
        found.extend((low + start, length, period) for start, length, period in runs_of(small, least_length, least_periods))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(words: Sequence[bytes], runs: Sequence[Run]) -> list[bytes]:
    """The words that are not in a run after its first period."""
    if not runs:
        return list(words)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    inside = np.cumsum(edges[:-1]) > 0
    return [w for w, gone in zip(words, inside.tolist()) if not gone]


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def with_runs(docs: DataFrame, text_col: str = "text", least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """``docs`` with ``runs``, an array of (start, length, period), and ``collapsed``, the
    text's kept words joined by one blank.

    Every row is worked on by itself, where it lies.  A null or empty text has no runs
    and collapses to the empty text; a very long one needs memory in proportion to its
    longest stretch of repeated words.  Columns named ``runs`` or ``collapsed`` in
    ``docs`` raise ValueError.  An empty table gives an empty one.
    """
    taken = {"runs", "collapsed"} & {c.lower() for c in docs.columns}
    if taken:
        raise ValueError(f"the input already has {sorted(taken)}")
    text, names = unused(docs, "whole_text"), list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [words_of(t) for t in _texts(batch.column(text))]
            runs = [find_runs(w, least_length, least_periods) for w in split]
            kept = [b" ".join(kept_words(w, r)).decode("utf-8", "replace") for w, r in zip(split, runs)]
            listed = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(listed, RUNS), pa.array(kept, pa.string())], [*names, "runs", "collapsed"])

    added = from_arrow_schema(pa.schema([("runs", RUNS), ("collapsed", pa.string())]))
    schema = T.StructType(docs.schema.fields + added.fields)
    return docs.withColumn(text, docs[text_col].cast("string")).mapInArrow(run, schema)


# -- planted runs and their digests -------------------------------------------


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document with a periodic tail planted into every tenth, by the digest of its id."""
    size, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not size:
        return words
    g = h // 10
    at = g % size
    period = 1 + (size - at) // (3 + g % 8)
    return words[:at] + [words[at + k % period] for k in range(size - at)]


@dataclass(frozen=True)
class Summary:
    """What is told of the runs of one document."""

    n_runs: int
    start: int | None
    length: int | None
    period: int | None
    exponent_milli: int | None
    runs_sha256: str
    collapsed_sha256: str


def summary_of(words: Sequence[bytes], runs: Sequence[Run]) -> Summary:
    """The longest run (of equal ones the first, then that of the smallest period), all runs and the kept words."""
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    joined = b" ".join(kept_words(words, runs))
    return Summary(
        len(runs),
        start,
        length,
        period,
        None if not runs else 1000 * length // period,
        hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(joined).hexdigest(),
    )


SUMMARY = pa.schema(
    [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64())]
    + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
)


def summarise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = True) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256).

    One row per row of ``docs``, each worked on where it lies; ``plant`` plants runs
    into every tenth document first, none where the id is null.  A null or empty text
    has no runs, four nulls and the digests of the empty text.  Further columns of
    ``docs`` may have any name; an empty table gives an empty one.
    """
    text = unused(docs, "text")
    given = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for doc_id, value in zip(ids, _texts(batch.column(1))):
                words = words_of(value)
                if plant:
                    words = planted(words, doc_id)
                rows.append(summary_of(words, find_runs(words)))
            columns = [pa.array([getattr(r, f.name) for r in rows], f.type) for f in SUMMARY]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *SUMMARY.names])

    kinds = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return given.mapInArrow(run, f"doc_id long, {kinds}")
