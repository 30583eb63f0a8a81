"""Relevance of a match: F13, X4.

``ts_rank`` follows the published definition of PostgreSQL's function of that name,
with equal weights for all words and in single precision, so that scores and ties come
out the same.  It looks at the whole text of the query: if that is one conjunction or
one phrase of several words, the nearness of their occurrences counts, else how often
each of them occurs.  ``log_tf`` is a plain sum over the wanted words.

Scores are columns over the positions of each term in a document, in the JVM.
"""

from __future__ import annotations

import math
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values of the definition ------------------------------------------
WEIGHT = np.float32(0.1)
LAST_POSITION = 16383
MOST_POSITIONS = 255
FAR = 100
FAR_NEARNESS = np.float32(1e-30)
SUM_OF_INVERSE_SQUARES = 1.64493406685
LEAST_SCORE = np.float32(1e-20)
# ---------------------------------------------------------------------------


class Operand(Protocol):
    terms: tuple[tuple[str, int], ...]
    negated: bool


def _nearness(distance: int) -> np.float32:
    return FAR_NEARNESS if distance > FAR else np.float32(1 / (1.005 + 0.05 * math.exp(distance / 1.5 - 2)))


def _pair_score(distance: int) -> np.float32:
    """What two occurrences at a distance add."""
    return np.float32(math.sqrt(WEIGHT * WEIGHT * _nearness(distance)))


def _often_score(n: int) -> float:
    """What a word that occurs n times adds: the sum of weight / j^2, set to its limit."""
    total = np.float32(0)
    for j in range(1, n + 1):
        total = np.float32(total + np.float32(WEIGHT / np.float32(j * j)))
    return float(np.float32(np.float32(WEIGHT + total) - WEIGHT)) / SUM_OF_INVERSE_SQUARES


def _floats(values: list[np.float32]) -> Column:
    return F.array(*[F.lit(float(v)).cast("float") for v in values])


def rank_positions(positions: Column) -> Column:
    """Positions as the definition counts them: from 1, the last ones as one, not too many."""
    return F.slice(F.array_distinct(F.transform(positions, lambda p: F.least(p + 1, F.lit(LAST_POSITION)))), 1, MOST_POSITIONS)


def rank_sizes(positions: pa.Array) -> np.ndarray:
    """The sizes of ``rank_positions``, of lists in Python; a null one has none, as an empty one."""
    lengths = pc.fill_null(pc.list_value_length(positions), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = positions.flatten().to_numpy(zero_copy_only=False)
    place = np.minimum(flat + 1, LAST_POSITION)
    of = np.repeat(np.arange(len(lengths)), lengths)
    if not ((np.diff(flat) > 0) | (np.diff(of) > 0)).all():
        # Positions that are not in order, each once.
        order = np.lexsort((place, of))
        of, place = of[order], place[order]
    new = np.ones(len(place), bool)
    new[1:] = (np.diff(of) > 0) | (np.diff(place) != 0)
    return np.minimum(np.bincount(of[new], minlength=len(lengths)), MOST_POSITIONS)


def rank_near(positions: list[Column]) -> Column:
    """Score of a conjunction or phrase: 1 - prod(1 - s) over all pairs of occurrences of
    different words, s falling with their distance; a missing word has no pairs.

    ``positions`` are in the byte order of the words, which is the order of the rounding.
    """
    near, far = _floats([_pair_score(d) for d in range(1, FAR + 1)]), F.lit(float(_pair_score(FAR + 1))).cast("float")
    one, none = F.lit(1.0), F.lit(-1.0).cast("float")

    def add(score: Column, distance: Column) -> Column:
        pair = F.when(distance > FAR, far).otherwise(F.get(near, distance - 1))
        joined = (one - (one - score.cast("double")) * (one - pair.cast("double"))).cast("float")
        return F.when(distance == 0, score).when(score < 0, pair).otherwise(joined)

    score = none
    for i, here in enumerate(positions):
        for there in positions[:i]:

            def over(found: Column, here: Column = here, there: Column = there) -> Column:
                return F.aggregate(here, found, lambda s, x: F.aggregate(there, s, lambda t, y: add(t, F.abs(x - y))))

            score = F.when(here.isNotNull() & there.isNotNull(), over(score)).otherwise(score)
    return F.when(score < 0, F.lit(float(LEAST_SCORE)).cast("float")).otherwise(score)


def rank_often(counts: list[Column]) -> Column:
    """Score of alternatives or one word: the mean over all words of the query of how
    often they occur, each occurrence counting less than the one before.

    ``counts`` are the numbers of counted positions, null for a missing word.  The score
    grows with each of them, rounding included.
    """
    often = F.array(*[F.lit(_often_score(n)) for n in range(1, MOST_POSITIONS + 1)])
    score = F.lit(0.0).cast("float")
    for n in counts:
        found = (score.cast("double") + F.get(often, n - 1)).cast("float")
        score = F.when(n.isNotNull(), found).otherwise(score)
    return (score.cast("double") / len(counts)).cast("float") if counts else score


def most_near(counts: list[Column]) -> Column:
    """No less than ``rank_near`` of words that occur so often: all pairs as near as can be."""
    pairs = F.lit(0)
    for i, n in enumerate(counts):
        for m in counts[:i]:
            pairs = pairs + F.coalesce(n * m, F.lit(0))
    return 1 - F.pow(F.lit(1 - float(_pair_score(1))), pairs) + 1e-5


def is_near(query: list[list[Operand]]) -> bool:
    """Whether nearness counts: the whole query is one conjunction or phrase of several words."""
    terms = {t for group in query for op in group for t, _ in op.terms}
    (first, *others), *more = query
    return len(terms) > 1 and not more and (bool(others) or (len(first.terms) > 1 and not first.negated))


def terms_in_order(query: list[list[Operand]]) -> list[str]:
    """All terms of a query in byte order, negated ones included."""
    return sorted({t for group in query for op in group for t, _ in op.terms}, key=lambda t: t.encode())


def ts_rank(query: list[list[Operand]], position_of: dict[str, Column]) -> Column:
    """The score of a document under a whole query, negated words included."""
    terms = terms_in_order(query)
    counted = [F.when(position_of[t].isNotNull(), rank_positions(position_of[t])) for t in terms]
    return rank_near(counted) if is_near(query) else rank_often([F.when(c.isNotNull(), F.size(c)) for c in counted])


def log_tf(wanted: list[Column]) -> Column:
    """Sum of ``1 + ln(tf)`` over the wanted words that occur."""
    score = F.lit(0.0)
    for tf in wanted:
        score = score + F.coalesce(1 + F.log(tf), F.lit(0.0))
    return F.round(score, 6)
