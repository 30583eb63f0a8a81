"""Lookups from many rows into a table with one row per key, hubs included.

A hub may hold a third of all rows.  Adaptive execution does not split its
partition when the looked-up side is an aggregate on the same key, so hot keys
are split here: the rows of a key with more than ``rows_per_task`` rows are
spread over as many sub-keys as needed, and the one row they look for is
repeated for each.  Nothing is dropped, and cold keys keep a single sub-key.

Counting the rows per key is combined per task before it is shuffled.  ``hot_keys``
counts before the lookups, and hashes in place of keys: a key is counted by itself only if
its hash has too many rows, so rows without a hub cost a few numbers per task.  There
are at most ``rows / rows_per_task`` hot keys: 400,000 of them, some 24 MB, for
the 2 * 10^12 rows that make up 100 TB, so they can be broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.session import planning

ROWS_PER_TASK = 5_000_000
#: Hashes that ``hot_keys`` counts for each column.
HASHES = 8192


def hot_keys(rows: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> tuple[dict[str, DataFrame | None], int]:
    """The values of each of the columns ``keys`` with more than ``rows_per_task`` rows, for
    ``lookup_join``, and the number of rows.

    ``(_hot, _parts)``, or None if a column has no such value.  ``rows`` are read by a job of
    its own, and once more for a column with hot values, so they should be stored.
    """

    def hashed(key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(HASHES))

    every = F.array(*[F.struct(F.lit(k).alias("_of"), hashed(k).alias("_hash")) for k in keys])
    # A few numbers per task need no more partitions than there are cores.
    spark = rows.sparkSession
    with planning(spark, {"spark.sql.shuffle.partitions": spark.sparkContext.defaultParallelism}):
        found = rows.select(F.inline(every)).groupBy("_of", "_hash").agg(F.count(F.lit(1)).alias("_n")).collect()
    known: dict[str, DataFrame | None] = {}
    for k in keys:
        full = [r["_hash"] for r in found if r["_of"] == k and r["_n"] > rows_per_task]
        known[k] = _hot(rows.where(hashed(k).isin(full)), k, rows_per_task).checkpoint() if full else None
    return known, sum(r["_n"] for r in found if r["_of"] == keys[0])


def _hot(rows: DataFrame, key: str, rows_per_task: int) -> DataFrame:
    counts = rows.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > rows_per_task).select("_hot", F.ceil(F.col("_n") / rows_per_task).alias("_parts"))


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    how: str,
    condition: Column | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    counted: DataFrame | None = None,
    total: int | None = None,
    known: Mapping[str, DataFrame | None] | None = None,
) -> DataFrame:
    """``rows`` joined to ``table`` on ``rows[key] = table["_key"]``.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``; further
    ``condition``s may be given.  The column ``_key`` of ``table`` is not in
    the result.  Keys are counted in ``counted``, which may hold more rows than
    ``rows``: with lookups in a row, give the rows that the first one starts
    from, so that no lookup is run again to count for the next.  If ``total``, the
    number of ``rows`` at most, is given and one task can hold them all, no key is hot
    and none is counted.  Nor are they if ``known`` has what ``hot_keys`` has found.
    """
    if total is not None and total <= rows_per_task or known is not None and known[key] is None:
        same = F.col(key) == F.col("_key")
        return rows.join(table, same if condition is None else same & condition, how).drop("_key")
    hot = F.broadcast(_hot(rows if counted is None else counted, key, rows_per_task) if known is None else known[key])
    others = [c for c in rows.columns if c != key] or [key]
    split = (
        rows.join(hot, F.col(key) == F.col("_hot"), "left")
        .withColumn("_sub", F.coalesce(F.pmod(F.xxhash64(*others), "_parts"), F.lit(0)))
        .drop("_hot", "_parts")
    )
    repeated = (
        table.join(hot, F.col("_key") == F.col("_hot"), "left")
        .withColumn("_rep", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        .drop("_hot", "_parts")
    )
    same = (F.col(key) == F.col("_key")) & (F.col("_sub") == F.col("_rep"))
    if condition is not None:
        same = same & condition
    return split.join(repeated, same, how).drop("_sub", "_rep", "_key")
