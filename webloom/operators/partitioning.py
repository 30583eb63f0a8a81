"""Contiguous id ranges: G1-G3, F18, J8."""

from __future__ import annotations

from uuid import UUID

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.text import let
from webloom.schemas import MAX_ID, NIL_ID


def range_bounds(start: str, end: str, parts: int) -> list[tuple[str, str]]:
    """``parts`` ranges ``[low, high)`` that cover ``[start, end)``."""
    low, high = UUID(start).int, UUID(end).int
    if low >= high:
        raise ValueError("the start of an id range must be below its end")
    if parts <= 0:
        raise ValueError("the number of parts must be at least 1")
    width = (high - low + 1) // parts
    cuts = [low + width * i for i in range(parts)] + [high]
    ids = [str(UUID(int=cut)) for cut in cuts]
    return list(zip(ids, ids[1:]))


def extents(bounds: list[tuple[str, str]], part: int) -> tuple[str, str]:
    """The range of one part."""
    if not 0 <= part < len(bounds):
        raise IndexError("invalid part")
    return bounds[part]


def id_ranges(spark: SparkSession, parts: int, start: str = NIL_ID, end: str = MAX_ID) -> DataFrame:
    """G1 as a table ``(part, lo, hi)``."""
    rows = [(i, lo, hi) for i, (lo, hi) in enumerate(range_bounds(start, end, parts))]
    return spark.createDataFrame(rows, "part int, lo string, hi string")


def assign_partition(
    df: DataFrame, column: str, parts: int, start: str = NIL_ID, end: str = MAX_ID
) -> DataFrame:
    """Add ``part``, the range an id falls in, NULL outside ``[start, end)``.

    Ranges are of equal width, so the leading 52 bits of an id tell its part up to one;
    the bounds beside that are looked up and compared with the id itself.  The work for
    a row does not grow with the number of parts.  Ranges too narrow for that are
    searched by halves, written as nested conditions.
    """
    bounds = range_bounds(start, end, parts)
    value = F.col(column)
    inside = (value >= start) & (value < end)

    def search(first: int, last: int) -> Column:
        if last - first == 1:
            return F.lit(first)
        middle = (first + last) // 2
        return F.when(value < bounds[middle][0], search(first, middle)).otherwise(search(middle, last))

    low, width = UUID(start).int, UUID(bounds[0][1]).int - UUID(start).int
    if width < 2**80:
        return df.withColumn("part", F.when(inside, search(0, parts)))
    leading = F.conv(F.substr(F.replace(value, F.lit("-")), F.lit(1), F.lit(13)), 16, 10).cast("double")
    about = F.floor((leading - low / 2**76) / (width / 2**76)).cast("int")
    lows = F.array(*[F.lit(b[0]) for b in bounds])

    def placed(guess: Column) -> Column:
        first = F.greatest(F.least(guess, F.lit(parts - 1)), F.lit(0))
        return let(
            first,
            lambda k: F.when(value < F.get(lows, k), k - 1).when((k < parts - 1) & (value >= F.get(lows, k + 1)), k + 1).otherwise(k),
        )

    return df.withColumn("part", F.when(inside, placed(about)))
