"""Benchmark passages in documents, by one Aho-Corasick automaton.

Document and benchmark texts are normalised alike: ASCII letters in lower case,
words of digits, letters and any character beyond ASCII, one space between words.
Every window of consecutive item words is a pattern of the automaton, which reads
a normalised text once; positions map back to words and to the original text.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import append, narrow, unused
from webloom.session import fresh_path

WINDOW_WORDS = 13
#: Benchmark text in one automaton; a larger benchmark is read in several passes.
BLOCK_BYTES = 8_000_000

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

FOUND = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.list_(pa.int64()))),
    ]
)


def words_of(text: str) -> list[bytes]:
    """Normalised words as UTF-8; no byte of a longer character is a separator."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def windows_of(words: list[bytes], size: int) -> Iterator[list[bytes]]:
    """Every window, or the whole of fewer words; none for no words."""
    if words:
        for at in range(max(1, len(words) - size + 1)):
            yield words[at : at + size]


class Automaton:
    """Finds item windows in word lists."""

    def __init__(self, items: list[tuple[str | None, str]], size: int = WINDOW_WORDS):
        owners: dict[str, tuple[int, set[str]]] = {}
        for item, text in items:
            for window in windows_of(words_of(text), size):
                key = b" ".join([b"", *window, b""]).decode("latin-1")
                held = owners.setdefault(key, (len(window), set()))[1]
                if item is not None:
                    held.add(item)
        self.trie = ahocorasick.Automaton()
        for key, (length, found) in owners.items():
            self.trie.add_word(key, (length, frozenset(found)))
        self.empty = not owners
        if owners:
            self.trie.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged word intervals [start, end) inside any window, and their items."""
        if self.empty or not words:
            return [], set()
        text = b" ".join([b"", *words, b""])
        hits = list(self.trie.iter(text.decode("latin-1")))
        if not hits:
            return [], set()
        spaces = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 0x20)
        ends = np.searchsorted(spaces, [end for end, _ in hits])  # the space after a window's last word
        spans: list[list[int]] = []
        for low, high in sorted((int(e) - value[0], int(e)) for e, (_, value) in zip(ends, hits)):
            if spans and low <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], high)
            else:
                spans.append([low, high])
        return spans, set().union(*(value[1] for _, value in hits))


def merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of about ``block_bytes``; one block at a time is on the driver."""
    items = narrow(benchmark, item=id_col, text=text_col).select(F.col("item").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    items = items.where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        yield [(r.item, r.text) for r in part.collect()]


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW_WORDS,
    block_bytes: int = BLOCK_BYTES,
    prefix: str = "",
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted ids) and spans of each whole text.

    A word is hit if any item window that occurs in the text covers it; ``spans``
    are [start, end) characters of the original text.  Null texts have no words.
    Items of null text are ignored, those of null id hit words and are no item of the
    list, items of one id count once.  An empty benchmark hits nothing, an empty table
    gives an empty one.  ``prefix`` goes before the names of the new columns; if one of
    them is in ``docs`` already, that is a ValueError.  A very long text is searched whole.

    The benchmark is broadcast in blocks of ``block_bytes``.  With more than one
    block, a pass per block adds to the word intervals of the pass before, which
    is written to the shared folder in between.
    """
    spark = docs.sparkSession
    keep = list(docs.columns) if keep is None else keep
    blocks = list(_block_broadcasts(docs, benchmark, item_id_col, item_text_col, block_bytes, size))
    names = [prefix + n for n in FOUND.names]
    fields = pa.schema([f.with_name(n) for n, f in zip(names, FOUND)])
    if len(blocks) == 1:
        return append(docs, text_col, fields, lambda: _finder(blocks[0]), keep)
    step = docs.select(*dict.fromkeys([*keep, text_col]))
    for k, block in enumerate(blocks):
        own = unused(step, f"__found{k}")
        found = append(step, text_col, pa.schema([(own, pa.string())]), lambda block=block: _partial(block))
        path = fresh_path(spark, "passages")
        found.write.parquet(path)
        step = spark.read.parquet(path)
    parts = step.columns[-len(blocks) :]
    joined = unused(step, "__parts")
    step = step.withColumn(joined, F.concat_ws("\n", F.col(text_col).isNull().cast("string"), *parts, F.coalesce(F.col(text_col), F.lit(""))))
    return append(step, joined, fields, lambda: _joiner(len(blocks)), keep)


def _block_broadcasts(docs, benchmark, id_col, text_col, block_bytes, size):
    for items in _blocks(benchmark, id_col, text_col, block_bytes):
        yield docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items, size))


_automata: dict[str, Automaton] = {}


def _automaton(block) -> Automaton:
    """The automaton of a broadcast, built once in a Python worker."""
    name, items, size = block.value
    if name not in _automata:
        _automata.clear()
        _automata[name] = Automaton(items, size)
    return _automata[name]


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 4, FOUND)]


def _row(text: str, n_words: int, spans: list[list[int]], items: set[str]) -> tuple:
    hit = sum(high - low for low, high in spans)
    if spans:
        places = [m.span() for m in _WORD.finditer(text)]
        spans = [[places[low][0], places[high - 1][1]] for low, high in spans]
    return n_words, hit, sorted(items), spans


def _finder(block) -> Callable[[list[str]], list[pa.Array]]:
    automaton = _automaton(block)

    def find(texts: list[str]) -> list[pa.Array]:
        rows = []
        for text in texts:
            words = words_of(text)
            rows.append(_row(text, len(words), *automaton.find(words)))
        return _columns(rows)

    return find


def _partial(block) -> Callable[[list[str]], list[pa.Array]]:
    automaton = _automaton(block)

    def find(texts: list[str]) -> list[pa.Array]:
        found = [automaton.find(words_of(t)) for t in texts]
        return [pa.array([json.dumps([s, sorted(i)]) for s, i in found], pa.string())]

    return find


def _joiner(blocks: int) -> Callable[[list[str]], list[pa.Array]]:
    def find(texts: list[str]) -> list[pa.Array]:
        rows = []
        for given in texts:
            _, *parts = given.split("\n", blocks + 1)
            text = parts.pop()
            found = [json.loads(p) for p in parts]
            spans = merge([s for f in found for s in f[0]])
            rows.append(_row(text, len(words_of(text)), spans, {i for f in found for i in f[1]}))
        return _columns(rows)

    return find


def contaminated(n_hit: F.Column, n_words: F.Column) -> F.Column:
    """At least a twentieth of the words is hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)
