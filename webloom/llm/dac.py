"""Token files of directly addressable codes.

Ids are split into chunks of eight bits.  Level 0 holds the low chunk of every
id; a bitmap of the level says which ids go on, and the next level holds the next
chunk of those only.  A rank directory counts the set bits before every block of
512, so the place of an id on the next level is one lookup and one population
count: any token is read without decoding the ones before it.

A file holds whole documents in rising order of their ids:

    magic, length of the header, header (JSON: counts and section offsets),
    document ids, null flags, first token of each document,
    and for each level its chunks, bitmap words and rank directory.

All sections start at multiples of eight bytes and are little-endian, so a reader
can map the file into memory.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.common import id_splits, keyed_texts, range_of, shuffle_partitions, strings
from webloom.llm.tokens import encoder

MAGIC = b"WLDAC001"
CHUNK_BITS = 8
BLOCK_BITS = 512
#: Tokens after which a shard begins another file; a document is never split.
FILE_TOKENS = 4_000_000

MANIFEST = "shard int, part int, path string, n_docs long, n_tokens long, bytes long"
ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


# -- the file format ----------------------------------------------------------


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap words, rank directory) of each level; at least one level."""
    rest, levels = np.asarray(ids, dtype=np.uint64), []
    while True:
        chunks = (rest & np.uint64(255)).astype(np.uint8)
        rest = rest >> np.uint64(CHUNK_BITS)
        on = rest > 0
        bits = np.zeros(-(-max(len(on), 1) // BLOCK_BITS) * BLOCK_BITS, dtype=np.uint8)
        bits[: len(on)] = on
        per_block = bits.reshape(-1, BLOCK_BITS).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([[0], np.cumsum(per_block)]).astype("<u8")
        levels.append((chunks, np.packbits(bits, bitorder="little"), ranks))
        rest = rest[on]
        if not len(rest):
            return levels


def encode_file(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    sections: list[tuple[str, np.ndarray]] = [
        ("doc_ids", np.array([i or 0 for i in doc_ids], dtype="<i8")),
        ("null_ids", np.array([i is None for i in doc_ids], dtype=np.uint8)),
        ("starts", np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype("<i8")),
    ]
    levels = encode_levels(ids)
    for k, (chunks, bitmap, ranks) in enumerate(levels):
        sections += [(f"chunks{k}", chunks), (f"bitmap{k}", bitmap), (f"ranks{k}", ranks)]
    header: dict = {"n_docs": len(doc_ids), "n_tokens": len(ids), "levels": len(levels), "sections": {}}
    body, at = [], 0
    for name, values in sections:
        raw = values.tobytes()
        header["sections"][name] = [at, len(raw)]
        raw += bytes(-len(raw) % 8)
        body.append(raw)
        at += len(raw)
    head = json.dumps(header).encode()
    head += b" " * (-len(head) % 8)
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *body])


class TokenFile:
    """Random access to one file, given as bytes or a memory map."""

    def __init__(self, raw: bytes | memoryview):
        view = memoryview(raw)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(view[8:16], "little")
        header = json.loads(bytes(view[16 : 16 + size]))
        self.n_docs, self.n_tokens = header["n_docs"], header["n_tokens"]

        def section(name: str, kind: str) -> np.ndarray:
            at, length = header["sections"][name]
            return np.frombuffer(view[16 + size + at : 16 + size + at + length], dtype=kind)

        self.doc_ids, self.null_ids = section("doc_ids", "<i8"), section("null_ids", "u1")
        self.starts = section("starts", "<i8")
        self.levels = [
            (section(f"chunks{k}", "u1"), section(f"bitmap{k}", "u1"), section(f"ranks{k}", "<u8"))
            for k in range(header["levels"])
        ]

    def _rank(self, level: int, at: int) -> int:
        """Set bits before position ``at`` of a level's bitmap."""
        _, bitmap, ranks = self.levels[level]
        block = at // BLOCK_BITS
        inside = bitmap[block * BLOCK_BITS // 8 : -(-at // 8)]
        tail = np.unpackbits(inside, count=at - block * BLOCK_BITS, bitorder="little") if len(inside) else inside
        return int(ranks[block]) + int(tail.sum())

    def token(self, at: int) -> int:
        """The id at a position, by one step per level."""
        if not 0 <= at < self.n_tokens:
            raise IndexError(at)
        value, level = 0, 0
        while True:
            chunks, bitmap, _ = self.levels[level]
            value |= int(chunks[at]) << (CHUNK_BITS * level)
            if not bitmap[at // 8] >> (at % 8) & 1:
                return value
            at, level = self._rank(level, at), level + 1

    def tokens(self, low: int, high: int) -> np.ndarray:
        """The ids of a range; on every level they are neighbours."""
        values, places = np.zeros(high - low, dtype=np.uint64), np.arange(high - low)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if high == low:
                break
            values[places] |= chunks[low:high].astype(np.uint64) << np.uint64(CHUNK_BITS * level)
            bits = np.unpackbits(bitmap[low // 8 : -(-high // 8)], bitorder="little")[low % 8 :][: high - low]
            places = places[bits == 1]
            low = self._rank(level, low)
            high = low + len(places)
        return values.astype("<u4")

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


# -- jobs ---------------------------------------------------------------------


def _store(path: str, name: str, raw: bytes) -> str:
    """Write a file whole or not at all; a retried task puts the same bytes there."""
    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)
    half = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(half) as out:
        out.write(raw)
    store.move(half, f"{folder}/{name}")
    return f"{path}/{name}"


def _load(path: str) -> bytes:
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_stream(name) as file:
        return file.read()


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = None,
    file_tokens: int = FILE_TOKENS,
) -> DataFrame:
    """Encode whole texts and write them below ``path``; returns the manifest.

    ``path`` is a folder that every executor reaches under the same name.  Each
    text is encoded where it is read; only its ids, two bytes each where the
    vocabulary allows, are shuffled, into ranges of document ids.  Documents of
    equal id follow each other in the order of their ids' bytes; null ids come
    first.  A null text is an empty one and keeps its end id.  An empty table
    gives an empty manifest.
    """
    spark = docs.sparkSession
    rows = keyed_texts(docs, id_col, text_col)
    shards = shards or shuffle_partitions(spark)
    splits = id_splits(rows, shards)
    wide = encoder(tokenizer).tokenizer.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
    kind = "<u4" if wide else "<u2"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            ids = [enc.ids(t, end_id).astype(kind).tobytes() for t in strings(batch.column("text"))]
            where = range_of([-(1 << 63) if k is None else k for k in keys], splits).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(where), batch.column("doc_id"), pa.array(ids, pa.binary())], ["shard", "doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, keys, ids, held = None, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            found = np.frombuffer(b"".join(ids), dtype=kind)
            raw = encode_file(keys, [len(x) // int(kind[2]) for x in ids], found)
            name = _store(path, f"shard-{shard:06d}-{part:04d}.dac", raw)
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "part": part, "path": name, "n_docs": len(keys), "n_tokens": len(found), "bytes": len(raw)}],
                pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bytes", pa.int64())]),
            )

        for batch in batches:
            for s, k, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if keys and (s != shard or held >= file_tokens):
                    yield flush()
                    part, keys, ids, held = (part + 1 if s == shard else 0), [], [], 0
                shard = s
                keys.append(k)
                ids.append(x)
                held += len(x) // int(kind[2])
        if keys:
            yield flush()

    coded = rows.mapInArrow(encode, "shard int, doc_id long, ids binary")
    dealt = coded.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "ids")
    manifest = f"{path}/manifest"
    dealt.mapInArrow(write, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from its file.

    ``start`` counts the ids of all documents before it: the counts of the files
    before, from the manifest, and the place inside the file.
    """
    order = Window.orderBy("shard", "part")
    before = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).alias("first"), F.row_number().over(order).alias("n"))
    spark: SparkSession = manifest.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                file = TokenFile(_load(path))
                crcs = [zlib.crc32(file.document(k).tobytes()) for k in range(file.n_docs)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(file.doc_ids, mask=file.null_ids.astype(bool)),
                        pa.array(file.starts[:-1] + first),
                        pa.array(np.diff(file.starts)),
                        pa.array(crcs, pa.int64()),
                    ],
                    schema=ROWS,
                )

    dealt = files.repartitionById(shuffle_partitions(spark), "n")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
