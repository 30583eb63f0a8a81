"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into segments.  Two fingerprints that differ in at
most ``distance`` bits differ in at most ``distance // segments`` bits in one
segment at least.  The anchors of a segment are the words of a covering code: the
[15, 11] Hamming code, whose words are within one bit of every 15-bit value,
beside the segment's other bits as they are.  A fingerprint has its home at the
nearest anchor, and a copy of it goes to every anchor within the covering radius
plus the segment's distance; so the home of either of two close fingerprints holds
a copy of the other, and only homes and visitors of an anchor are compared, on all
64 bits.

Equal fingerprints are one node from the start.  An anchor gives a star for each
group of linked fingerprints that it sees, not their pairs, and the stars are
joined to components by alternating large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import keyed_texts, shuffle_partitions, strings
from webloom.session import fresh_path

SEED = 42
COVERING_RADIUS = 1
#: Distinct fingerprints up to which three segments compare less than two.
THREE_SEGMENTS = 50_000_000
#: Fingerprints at an anchor that one task compares; more are dealt over several.
ANCHOR_ROWS = 8_192


# -- fingerprints -------------------------------------------------------------


def fingerprint(text: str, words: int = 4) -> int:
    """Majority of the bits of the shingle hashes; zero without words."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(words, len(found)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[: len(found) - span].tolist(), ends[span:].tolist())], dtype="<u8"
    )
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    major = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(major, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long.  Null texts have no words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in strings(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(rows, "doc_id long, fp long")


# -- anchors ------------------------------------------------------------------

#: Parity checks of the [15, 11] Hamming code: the syndrome is the index of the
#: bit to turn, from 1 on.
_SYNDROME = np.zeros(1 << 15, dtype=np.int64)
for _bit in range(15):
    _SYNDROME ^= np.where(np.arange(1 << 15) >> _bit & 1, _bit + 1, 0)


def nearest_anchor(values: np.ndarray) -> np.ndarray:
    """The anchor of each segment value: its low 15 bits decoded, the others kept."""
    low = values & 0x7FFF
    wrong = _SYNDROME[low]
    return np.where(wrong > 0, values ^ (1 << np.maximum(wrong - 1, 0)), values)


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment of 64 bits."""
    widths = [64 // segments + (k < 64 % segments) for k in range(segments)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def anchors_within(values: np.ndarray, width: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor at most ``radius`` bits from a segment value.

    An anchor is a value with a zero syndrome, so they are found by turning up to
    ``radius`` bits.
    """
    rows, anchors = [], []
    for turned in range(radius + 1):
        for bits in combinations(range(width), turned):
            moved = values ^ sum(1 << b for b in bits)
            at = np.flatnonzero(_SYNDROME[moved & 0x7FFF] == 0)
            rows.append(at)
            anchors.append(moved[at])
    return np.concatenate(rows), np.concatenate(anchors)


def _replicated(nodes: DataFrame, distance: int, segments: int) -> DataFrame:
    """(anchor, fp, home): each fingerprint at every anchor that can see it."""
    reach = distance // segments
    bounds = segment_bounds(segments)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for at in range(0, len(fps), 2000):
                part = fps[at : at + 2000]
                for k, (shift, width) in enumerate(bounds):
                    values = ((part.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
                    home = nearest_anchor(values)
                    row, anchor = anchors_within(values, width, COVERING_RADIUS + reach)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor | k << 33), pa.array(part[row]), pa.array(home[row] == anchor)], ["anchor", "fp", "home"]
                    )

    return nodes.select("fp").mapInArrow(rows, "anchor long, fp long, home boolean")


def _stars(fps: np.ndarray, homes: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links between ``homes`` and ``fps`` (distinct values), as (member, smallest of its group)."""
    root = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    for home in homes:
        near = fps[np.bitwise_count((fps ^ home).view(np.uint64)) <= distance]
        if len(near) > 1 or len(near) and near[0] != home:
            own = find(int(home))
            for other in near.tolist():
                other = find(other)
                if other != own:
                    low, high = min(own, other), max(own, other)
                    root[high] = own = low
    members = list(root)
    return members, [find(m) for m in members]


def _compare(rows: DataFrame, distance: int, most: int) -> DataFrame:
    """(kind 0: a, b linked; kind 1: a row of an anchor above ``most`` rows)."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("home", pa.bool_())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_anchor, held, full = None, [], False

        def out(kind: int, a, b, home) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(home, pa.bool_())], schema=schema)

        def overflow() -> Iterator[pa.RecordBatch]:
            for fps, homes in held:
                yield out(1, np.full(len(fps), held_anchor), fps, homes)
            held.clear()

        def close() -> Iterator[pa.RecordBatch]:
            if full:
                yield from overflow()
            elif held:
                fps, homes = (np.concatenate(c) for c in zip(*held))
                if len(fps) > 1 and homes.any():
                    a, b = _stars(fps, fps[homes], distance)
                    if a:
                        yield out(0, a, b, [False] * len(a))
                held.clear()

        for batch in batches:
            anchors, fps, homes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.concatenate([[0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, [len(anchors)]])
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low == high:
                    continue
                if anchors[low] != held_anchor:
                    yield from close()
                    held_anchor, full = int(anchors[low]), False
                held.append((fps[low:high], homes[low:high]))
                full = full or sum(len(f) for f, _ in held) > most
                if full:
                    yield from overflow()
        yield from close()

    return rows.mapInArrow(compare, "kind int, a long, b long, home boolean")


def _compare_full(rows: DataFrame, distance: int, most: int, parts: int) -> DataFrame:
    """Links at anchors above ``most`` rows: their rows are cut into chunks, and
    every pair of chunks is one piece of work."""
    sizes = rows.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int")
    dealt = (
        rows.join(sizes, "a")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("a", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", F.col("b").alias("fp"), "home")
    )
    order = ["a", "i", "j"]
    sorted_rows = dealt.repartition(parts, *order).sortWithinPartitions(*order)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                fps, homes = np.array([h[0] for h in held], dtype=np.int64), np.array([h[1] for h in held])
                a, b = _stars(fps, fps[homes], distance)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                held.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("a", "i", "j", "fp", "home"))):
                if row[:3] != held_key:
                    yield from close()
                    held_key = row[:3]
                held.append(row[3:])
        yield from close()

    return sorted_rows.mapInArrow(compare, "a long, b long")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read from there: lineage ends at stored files."""
    spark: SparkSession = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def links(nodes: DataFrame, distance: int = 4, segments: int | None = None, most: int = ANCHOR_ROWS) -> DataFrame:
    """Stars over distinct fingerprints (column fp): a is linked with b through links
    of at most ``distance`` bits.  No link is lost, and a group is never paired out."""
    spark = nodes.sparkSession
    segments = segments or (3 if nodes.count() <= THREE_SEGMENTS else 2)
    if not 2 <= segments <= 4:
        raise ValueError("two to four segments have room for the code's 15 bits")
    parts = shuffle_partitions(spark)
    dealt = _replicated(nodes, distance, segments).repartition(parts, "anchor").sortWithinPartitions("anchor")
    found = _kept(_compare(dealt, distance, most), "anchors")
    stars = found.where("kind = 0").select("a", "b")
    full = found.where("kind = 1").select("a", "b", "home")
    if not full.isEmpty():
        stars = stars.unionByName(_compare_full(full, distance, most, parts))
    return stars.where("a <> b").distinct()


# -- components ---------------------------------------------------------------
#
# A node may have a third of all links.  The smallest neighbours are written before
# they are joined: then both sides of the join are plain exchanges, and adaptive
# execution splits the partition of such a node.


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of a node with the smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _kept(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "smallest")
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours with the smallest one."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = _kept(down.groupBy("a").agg(F.min("b").alias("m")), "smallest")
    moved = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each linked node's component, without the roots."""
    edges, before = _kept(edges, "stars"), None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or not mark[0]:
            return edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
        before = tuple(mark)
        edges = _kept(_small_star(_large_star(edges)), "stars")


def near_duplicates(
    docs: DataFrame,
    words: int = 4,
    distance: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    segments: int | None = None,
    most: int = ANCHOR_ROWS,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    ``component_id`` is the smallest id that links reach, its own included.  Texts
    without words, null texts among them, have fingerprint zero and are linked like
    others.  A row of null id belongs to its component but is never the smallest; if
    no id is there, the component is null.  Repeated rows are repeated in the result.
    """
    marked = _kept(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = _kept(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "nodes")
    roots = components(links(nodes, distance, segments, most))
    own = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    own = _kept(own, "roots")
    smallest = _kept(own.groupBy("root").agg(F.min("first_doc").alias("component_id")), "smallest")
    of_print = own.join(smallest, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(of_print, "fp").select("doc_id", hexed, "component_id")
