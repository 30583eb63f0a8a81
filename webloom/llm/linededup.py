"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

A line counts under its key: white space stripped at both ends, ASCII letters in
lower case.  Keys are spread over shards by a 128-bit digest.  A shard holds an
exact table, key -> number of references with the smallest and largest document,
and a cuckoo filter of the table's keys.  A batch of documents is inserted or
deleted shard by shard: a key that the filter does not know is new and is added
without a look into the table; the others update their row.  A count that falls to
zero leaves table and filter, so deleting a batch restores what was there before.

Documents are combined to one row per key and task before anything is shuffled,
so a line that a third of all documents share is a few rows in its shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import shuffle_partitions, strings, unused
from webloom.session import fresh_path

MIN_CODE_POINTS = 10
STRIPPED = " \t\n\x0b\x0c\r"
#: References a task combines at once.
COMBINE_ROWS = 1_000_000

PARTIAL = "shard int, hi long, lo long, n long, min_doc long, max_doc long, kind int, filter binary"
_PARTIAL = pa.schema(
    [("shard", pa.int32())] + [(n, pa.int64()) for n in ("hi", "lo", "n", "min_doc", "max_doc")] + [("kind", pa.int32()), ("filter", pa.binary())]
)
#: What a row of a shard is: a filter, a row of the table, references that are added
#: or taken away, a row whose smallest and largest document were found anew.
FILTER, TABLE, ADD, REMOVE, RENEW = range(5)


def key_of(line: str) -> bytes:
    return line.strip(STRIPPED).encode("utf-8", "surrogatepass").lower()


def digest_of(line: str, least: int = MIN_CODE_POINTS) -> bytes | None:
    """16 bytes, or None for a line that is too short to count."""
    key = line.strip(STRIPPED)
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= least else None


class CuckooFilter:
    """Four slots a bucket, 16-bit fingerprints, filled from the front."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / self.SLOTS / 0.8))))
        self.table = np.zeros((buckets, self.SLOTS), dtype=np.uint16) if table is None else table

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray, capacity: int = 0) -> CuckooFilter:
        """A filter of distinct keys, as large as they need."""
        capacity = max(capacity, len(hi))
        while True:
            made = cls(capacity)
            if made.insert(hi, lo):
                return made
            capacity *= 2

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = len(self.table) - 1
        prints = ((lo.astype(np.uint64) >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = (hi.astype(np.uint64) >> np.uint64(8)).astype(np.int64) & mask
        return prints, first, self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ ((prints.astype(np.int64) * 0x5BD1E995) & (len(self.table) - 1))

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """False if some key finds no place; the filter is then to be made anew."""
        prints, first, second = self._places(hi, lo)
        left = np.arange(len(hi))
        for bucket in (first, second):
            left = left[np.argsort(bucket[left], kind="stable")]
            own = bucket[left]
            rank = np.arange(len(own)) - np.searchsorted(own, own)
            slot = (self.table[own] > 0).sum(axis=1) + rank
            fits = slot < self.SLOTS
            self.table[own[fits], slot[fits]] = prints[left[fits]]
            left = left[~fits]
        return all(self._kick(int(first[i]), prints[i]) for i in left)

    def _kick(self, bucket: int, own: np.uint16) -> bool:
        for turn in range(self.KICKS):
            used = int((self.table[bucket] > 0).sum())
            if used < self.SLOTS:
                self.table[bucket, used] = own
                return True
            slot = turn % self.SLOTS
            own, self.table[bucket, slot] = self.table[bucket, slot], own
            bucket = int(self._other(np.array(bucket), np.array(own)))
        return False

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """True for every key inserted; for others almost never."""
        prints, first, second = self._places(hi, lo)
        wanted = prints[:, None]
        return (self.table[first] == wanted).any(axis=1) | (self.table[second] == wanted).any(axis=1)

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Take out keys that are in; the last slot of a bucket fills the gap."""
        for own, *places in zip(*self._places(hi, lo)):
            for bucket in places:
                slots = np.flatnonzero(self.table[bucket] == own)
                if len(slots):
                    last = int((self.table[bucket] > 0).sum()) - 1
                    self.table[bucket, slots[0]] = self.table[bucket, last]
                    self.table[bucket, last] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(raw, dtype="<u2").reshape(-1, cls.SLOTS).copy())


# -- references and shards ----------------------------------------------------


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_CODE_POINTS) -> DataFrame:
    """(doc_id, hi, lo): the distinct line keys of each row; rows of null id or text have none."""
    return _with_text(docs, id_col, text_col).mapInArrow(lambda batches: _keys(batches, least), "doc_id long, hi long, lo long")


def _with_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    given = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return given.where("doc_id is not null and text is not null")


def _keys(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text"))):
            found = {digest_of(line, least) for line in text.split("\n")} - {None}
            keys += found
            ids += [doc] * len(found)
        raw = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw[:, 0]), pa.array(raw[:, 1])], ["doc_id", "hi", "lo"])


def _reduced(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row a key: counts added, the smallest and the largest document."""
    order = np.lexsort((lo, hi))
    hi, lo, n, low, high = (a[order] for a in (hi, lo, n, low, high))
    starts = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])) if len(hi) else np.zeros(0, dtype=np.int64)
    if not len(starts):
        return hi, lo, n, low, high
    return hi[starts], lo[starts], np.add.reduceat(n, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)


def _rows(shard: np.ndarray | int, kind: int, hi, lo, n, low, high) -> pa.RecordBatch:
    size = len(hi)
    shard = np.full(size, shard) if np.isscalar(shard) else shard
    return pa.RecordBatch.from_arrays(
        [pa.array(shard, pa.int32()), *(pa.array(a, pa.int64()) for a in (hi, lo, n, low, high)), pa.array(np.full(size, kind), pa.int32()), pa.nulls(size, pa.binary())],
        schema=_PARTIAL,
    )


def _combine(refs: Iterator[pa.RecordBatch], shards: int, kind: int) -> Iterator[pa.RecordBatch]:
    """References as one row per key and task."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        doc, hi, lo = (np.concatenate(c) for c in zip(*held))
        hi, lo, n, low, high = _reduced(hi, lo, np.ones(len(hi), dtype=np.int64), doc, doc)
        return _rows((hi % shards).astype(np.int32), kind, hi, lo, n, low, high)

    for batch in refs:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        size += batch.num_rows
        if size >= COMBINE_ROWS:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _added(docs: DataFrame, shards: int, id_col: str, text_col: str, least: int = MIN_CODE_POINTS) -> DataFrame:
    """The combined references of documents, in one pass of one Python worker a task."""
    return _with_text(docs, id_col, text_col).mapInArrow(lambda batches: _combine(_keys(batches, least), shards, ADD), PARTIAL)


def _removed(refs: DataFrame, shards: int) -> DataFrame:
    return refs.select("doc_id", "hi", "lo").mapInArrow(lambda batches: _combine(batches, shards, REMOVE), PARTIAL)


def _find(hi: np.ndarray, lo: np.ndarray, table_hi: np.ndarray, table_lo: np.ndarray) -> np.ndarray:
    """Place of each key in a table sorted by (hi, lo), -1 if it is not there."""
    kind = np.dtype([("hi", "<i8"), ("lo", "<i8")])
    table, keys = np.empty(len(table_hi), dtype=kind), np.empty(len(hi), dtype=kind)
    table["hi"], table["lo"], keys["hi"], keys["lo"] = table_hi, table_lo, hi, lo
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _merge_shard(shard: int, parts: dict[int, list], blob: bytes | None) -> Iterator[pa.RecordBatch]:
    """The new table and filter of one shard."""

    def all_of(kind: int) -> tuple[np.ndarray, ...]:
        if kind not in parts:
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
        return _reduced(*(np.concatenate(c) for c in zip(*parts[kind])))

    table = list(all_of(TABLE))
    known = CuckooFilter.from_bytes(blob) if blob else None
    hi, lo, n, low, high = all_of(ADD)
    if len(hi):
        maybe = known.contains(hi, lo) if known and len(table[0]) else np.zeros(len(hi), dtype=bool)
        at = np.full(len(hi), -1)
        at[maybe] = _find(hi[maybe], lo[maybe], table[0], table[1])
        old, new = at >= 0, at < 0
        table[2][at[old]] += n[old]
        table[3][at[old]] = np.minimum(table[3][at[old]], low[old])
        table[4][at[old]] = np.maximum(table[4][at[old]], high[old])
        table = list(_reduced(*(np.concatenate([a, b[new]]) for a, b in zip(table, (hi, lo, n, low, high)))))
        if known is not None and not known.insert(hi[new], lo[new]):
            known = None  # full: made anew from the table
    hi, lo, n, _, _ = all_of(REMOVE)
    if len(hi):
        at = _find(hi, lo, table[0], table[1])
        table[2][at[at >= 0]] -= n[at >= 0]
        gone = table[2] <= 0
        if known is not None:
            known.delete(table[0][gone], table[1][gone])
        table = [a[~gone] for a in table]
    hi, lo, _, low, high = all_of(RENEW)
    if len(hi):
        at = _find(hi, lo, table[0], table[1])
        table[3][at[at >= 0]], table[4][at[at >= 0]] = low[at >= 0], high[at >= 0]
    if known is None:
        known = CuckooFilter.of(table[0], table[1])
    yield _rows(shard, TABLE, *table)
    yield pa.RecordBatch.from_pylist([{"shard": shard, "kind": FILTER, "filter": known.to_bytes()}], _PARTIAL)


def _merged(rows: DataFrame, shards: int) -> DataFrame:
    """Bring the rows of each shard together; a shard is one task's work."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, dict[int, list]] = {}
        blobs: dict[int, bytes] = {}
        for batch in batches:
            shard, kind = (batch.column(c).to_numpy() for c in ("shard", "kind"))
            for f in np.flatnonzero(kind == FILTER):
                blobs[int(shard[f])] = batch.column("filter")[int(f)].as_py()
            # Filter rows have nulls here; filled, the digests stay integers.
            values = [batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("hi", "lo", "n", "min_doc", "max_doc")]
            for s in np.unique(shard):
                for k in np.unique(kind[shard == s]):
                    if k != FILTER:
                        own = (shard == s) & (kind == k)
                        parts.setdefault(int(s), {}).setdefault(int(k), []).append([v[own] for v in values])
        for s in sorted({*parts, *blobs}):
            yield from _merge_shard(s, parts.get(s, {}), blobs.get(s))

    return rows.repartitionById(shards, "shard").mapInArrow(merge, PARTIAL)


@dataclass
class LineIndex:
    """The exact tables and filters of all shards, and the references by document."""

    state: DataFrame
    refs: DataFrame
    shards: int

    @property
    def counts(self) -> DataFrame:
        return self.state.where(F.col("kind") == TABLE).select("shard", "hi", "lo", "n", "min_doc", "max_doc")

    @property
    def filters(self) -> DataFrame:
        return self.state.where(F.col("kind") == FILTER).select("shard", "filter")

    @property
    def repeated(self) -> DataFrame:
        """(hi, lo, min_doc): keys of two documents or more, and the one that keeps them."""
        return self.counts.where("min_doc < max_doc").select("hi", "lo", "min_doc")


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, least: int = MIN_CODE_POINTS) -> LineIndex:
    """The index of a batch, not stored yet.  Rows of one id are one document; an
    empty table gives an empty index."""
    shards = shards or shuffle_partitions(docs.sparkSession)
    refs = references(docs, id_col, text_col, least)
    return LineIndex(_merged(_added(docs, shards, id_col, text_col, least), shards), refs, shards)


def insert(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """Add documents that the index does not hold."""
    refs = references(docs, id_col, text_col)
    added = _added(docs, index.shards, id_col, text_col)
    return LineIndex(_merged(index.state.unionByName(added), index.shards), index.refs.unionByName(refs), index.shards)


def delete(index: LineIndex, doc_ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
    """Take documents out; ids that the index does not hold change nothing.

    Only keys whose smallest or largest document goes look at other references.
    """
    gone = doc_ids.select(doc_ids[id_col].cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    removed = index.refs.join(gone, "doc_id", "left_semi")
    rest = index.refs.join(gone, "doc_id", "left_anti")
    ends = index.counts.join(removed, ["hi", "lo"]).where("doc_id = min_doc or doc_id = max_doc").select("hi", "lo").distinct()
    shard = F.pmod("hi", F.lit(index.shards)).cast("int").alias("shard")
    renewed = rest.join(ends, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.min("doc_id").alias("min_doc"), F.max("doc_id").alias("max_doc"))
    renewed = renewed.select(shard, "hi", "lo", F.lit(0).cast("long").alias("n"), "min_doc", "max_doc", F.lit(RENEW).alias("kind"), F.lit(None).cast("binary").alias("filter"))
    rows = index.state.unionByName(_removed(removed, index.shards)).unionByName(renewed)
    return LineIndex(_merged(rows, index.shards), rest, index.shards)


def store(index: LineIndex, path: str | None = None) -> LineIndex:
    """Write tables, filters and references to the shared folder, and read them from there."""
    spark: SparkSession = index.state.sparkSession
    path = path or fresh_path(spark, "lines")
    index.state.write.partitionBy("kind").parquet(f"{path}/state")
    index.refs.write.parquet(f"{path}/refs")
    fields = [f.split()[0] for f in PARTIAL.split(", ")]
    state = spark.read.schema(PARTIAL).parquet(f"{path}/state").select(*fields)
    return LineIndex(state, spark.read.schema("doc_id long, hi long, lo long").parquet(f"{path}/refs"), index.shards)


def drop_repeated(
    docs: DataFrame,
    index: LineIndex,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = MIN_CODE_POINTS,
    lines_col: str = "n_lines",
    dropped_col: str = "n_dropped",
) -> DataFrame:
    """``docs`` without the lines that an earlier document holds.

    Adds n_lines (before) and n_dropped, under the names given; if ``docs`` has one of
    them already, that is a ValueError.  A key that two or more documents of the
    index hold stays in the smallest of them only; the other lines stay and are
    joined again by line feeds.  Null texts stay null and count as one empty line;
    rows of null id stay as they are.
    """
    if {lines_col.lower(), dropped_col.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the input already has {lines_col} or {dropped_col}")
    names = {c: unused(docs, c) for c in ("__key", "__drop")}
    key, drop = names["__key"], names["__drop"]
    lost = (
        references(docs, id_col, text_col, least)
        .join(index.repeated, ["hi", "lo"])
        .where("doc_id <> min_doc")
        .groupBy(F.col("doc_id").alias(key))
        .agg(F.collect_set(F.struct("hi", "lo")).alias(drop))
    )
    joined = docs.join(lost, docs[id_col].cast("long") == lost[key], "left").select(*[docs[c] for c in docs.columns], lost[drop])
    given_columns = list(docs.columns)
    schema = T.StructType(list(docs.schema.fields)).add(lines_col, "long").add(dropped_col, "long")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, keys in zip(batch.column(text_col).to_pylist(), batch.column(drop).to_pylist()):
                given = (text or "").split("\n")
                if keys:
                    out = {np.array([k["hi"], k["lo"]], dtype="<i8").tobytes() for k in keys}
                    kept = [line for line in given if digest_of(line, least) not in out]
                    text = "\n".join(kept)
                    dropped.append(len(given) - len(kept))
                else:
                    dropped.append(0)
                texts.append(text)
                lines.append(len(given))
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in given_columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*given_columns, lines_col, dropped_col])

    return joined.mapInArrow(rewrite, schema)
