"""Licence texts and notices in documents, by Dice coefficient over word bigrams.

A document is compared as a whole, by paragraph and by line, so a notice is found
inside other text.  Two sets of distinct bigrams of sizes a and b can only reach a
Dice coefficient t if t / (2 - t) * b <= a <= (2 - t) / t * b; templates outside
these bounds are not compared.  A set that reaches t also holds at least
t / (2 - t) of a template's bigrams, so a text without any of a few of them, its
key bigrams, is not taken apart at all.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from webloom.llm.common import append
from webloom.llm.decontaminate import words_of
from webloom.llm.license_templates import templates

LEAST_DICE = 0.8

Bigram = tuple[bytes, bytes]


def words(text: str) -> list[bytes]:
    """Words as elsewhere, and the British spelling as the American."""
    found = words_of(text)
    return [w.replace(b"licence", b"license") if b"licence" in w else w for w in found]


def bigrams(found: list[bytes]) -> frozenset[Bigram]:
    return frozenset(zip(found, found[1:]))


def dice(one: frozenset, other: frozenset) -> float:
    total = len(one) + len(other)
    return 2 * len(one & other) / total if total else 0.0


def units(text: str) -> Iterator[tuple[int, int]]:
    """[start, end) of the text, its paragraphs and its lines, each once."""
    seen = set()
    for mark in (None, "\n\n", "\n"):
        at = 0
        for part in [text] if mark is None else text.split(mark):
            span = (at, at + len(part))
            if part and span not in seen:
                seen.add(span)
                yield span
            at = span[1] + len(mark or "")


@dataclass(frozen=True)
class Match:
    license: str
    dice: float
    start: int
    end: int


class LicenseScanner:
    def __init__(self, given: list[tuple[str, str]], least: float = LEAST_DICE):
        if not 0 < least <= 1:
            raise ValueError("a least Dice coefficient above 0 and up to 1 is needed")
        self.least = least
        made = sorted({(len(b), name, b) for name, text in given if (b := bigrams(words(text)))}, key=lambda x: (x[0], x[1], sorted(x[2])))
        self.sizes = [size for size, _, _ in made]
        self.named = [(name, b) for _, name, b in made]
        keys: set[Bigram] = set()
        for _, b in self.named:
            spare = len(b) - math.ceil(len(b) * least / (2 - least) - 1e-9)
            keys.update(sorted(b, key=lambda g: (-len(g[0]) - len(g[1]), g))[: spare + 1])
        self.keys = frozenset(keys)
        self.key_words = frozenset(g[0] for g in keys)

    def candidates(self, size: int) -> list[tuple[str, frozenset[Bigram]]]:
        """Templates within the size bounds."""
        low, high = size * self.least / (2 - self.least), size * (2 - self.least) / self.least
        return self.named[bisect_left(self.sizes, low - 1e-9) : bisect_right(self.sizes, high + 1e-9)]

    def _may_match(self, found: list[bytes]) -> bool:
        return not self.key_words.isdisjoint(found) and not self.keys.isdisjoint(zip(found, found[1:]))

    def scan(self, text: str) -> list[Match]:
        """The best licence of every unit that reaches the bound, in order; ties by name."""
        if not self._may_match(words(text)):
            return []
        out = []
        for start, end in units(text):
            found = words(text[start:end])
            if not self._may_match(found):
                continue
            own = bigrams(found)
            scores = [(-dice(own, b), name) for name, b in self.candidates(len(own))]
            if scores and -min(scores)[0] >= self.least:
                score, name = min(scores)
                out.append(Match(name, -score, start, end))
        return out


_MATCHES = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_licenses(
    docs: DataFrame,
    text_col: str = "text",
    given: list[tuple[str, str]] | None = None,
    least: float = LEAST_DICE,
    matches_col: str = "matches",
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with the licence matches of each whole text, an empty list for none.

    Null and empty texts match nothing; templates of fewer than two words are not
    used.  The templates are a fixed list, so they are sent to the tasks as they are.
    """
    known = templates() if given is None else given
    LicenseScanner(known, least)  # refuse a wrong bound here and not in a task

    def start() -> Callable[[list[str]], list[pa.Array]]:
        scanner = LicenseScanner(known, least)
        return lambda texts: [pa.array([[vars(m) for m in scanner.scan(t)] for t in texts], _MATCHES)]

    return append(docs, text_col, pa.schema([(matches_col, _MATCHES)]), start, keep)
