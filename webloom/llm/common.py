"""Helpers shared by the corpus operators.

Every operator reads only the columns it names, so further columns of its input
may carry any name.  A null text counts as an empty one unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

#: ASCII lower case only, as the text rules ask for; other letters stay.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns only, under the operator's own names."""
    return df.select(*[df[given].alias(own) for own, given in columns.items()])


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id long, text string, never null)."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of an Arrow column, nulls as empty."""
    found = column.to_pylist()
    return [s or "" for s in found] if column.null_count else found


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_splits(docs: DataFrame, parts: int) -> list[int]:
    """At most ``parts - 1`` rising ids that cut ``docs`` into even ranges.

    Only the id column is read, and the list is as long as the number of
    partitions, whatever the input holds.
    """
    ids = docs.where("doc_id is not null").select("doc_id")
    if parts < 2:
        return []
    found = ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)
    return sorted({int(x) for x in found})


def range_of(ids: np.ndarray | pd.Series, splits: Sequence[int]) -> np.ndarray:
    """The range each id falls in: the number of splits up to it."""
    return np.searchsorted(np.asarray(splits, dtype=np.int64), np.asarray(ids), side="right")


def range_column(id_col: Column, splits: Sequence[int]) -> Column:
    """``range_of`` as a column; null ids go to range 0."""
    bounds = np.asarray(splits, dtype=np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        out = np.zeros(len(ids), dtype=np.int32)
        out[known.to_numpy()] = np.searchsorted(bounds, ids[known].astype("int64"), side="right")
        return pd.Series(out)

    return place(id_col)


def append(
    docs: DataFrame,
    text_col: str,
    fields: pa.Schema,
    start: Callable[[], Callable[[list[str]], Sequence[pa.Array]]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``docs`` with columns computed from each text, row by row, where it lies.

    ``start`` runs once a task and returns the function that turns a batch of
    texts (null as empty) into one array per field.  ``keep`` names the input
    columns to return, all by default.
    """
    keep = list(docs.columns) if keep is None else list(keep)
    given = docs.select(*[docs[c] for c in keep], docs[text_col].alias("__text")) if text_col not in keep else docs.select(*keep)
    source = text_col if text_col in keep else "__text"
    names = [*keep, *fields.names]
    if len(set(names)) < len(names):
        raise ValueError(f"the input already has one of {fields.names}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            made = compute(strings(batch.column(source)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=names)

    schema = T.StructType(docs.select(*keep).schema.fields + from_arrow_schema(fields).fields)
    return given.mapInArrow(run, schema)


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, so that no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
