"""I-Match fingerprints over randomised lexicons.

The lexicon holds the terms within a band of inverse document frequency: common
terms say nothing, rare ones are often slips.  A document keeps its distinct terms
of the lexicon, sorted, and hashes the part of them in each of several random
subsets of it; two documents are alike in as many hashes as are equal.

Documents have from a few to many thousands of terms, and a subset tells them apart
best if it holds one or two of a document's terms.  Subsets are therefore drawn at
falling rates, ``PER_RATE`` of each, and a document keeps the hashes of the lowest
rates that give it ``ENOUGH`` non-empty ones.

Document frequencies count distinct texts, so copies do not make a text's terms
common.  Where the lexicon holds too little of a text it does not stand for it (a
rare language, text that many others share), so every document also keeps the same
hashes of all its terms, and these decide if the lexicon stands for one side only.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import id_splits, keyed_texts, range_of, shuffle_partitions, strings
from webloom.llm.decontaminate import words_of

#: The band, in document frequency by the number of documents.  From the lower end
#: follows the bound of the lexicon: terms by document / RAREST.
RAREST, COMMONEST = 1 / 2000, 1 / 20
#: The band stands for documents with so many terms in it and such a share of all.
FEWEST_TERMS, LEAST_SHARE = 4, 1 / 4
RATES, PER_RATE, ENOUGH = 6, 32, 12
#: Distinct terms a task counts before it hands them on.
COUNTED_TERMS = 400_000
#: Bits of a text's hash that mark it as perhaps repeated: a bitmap of 8 MB.
MARK_BITS = 26

_ODD = np.array([int.from_bytes(hashlib.sha256(b"lexicon %d" % k).digest()[:8], "little") | 1 for k in range(PER_RATE)], dtype=np.uint64)


def term_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in set(words)], dtype=np.uint64)


@dataclass(frozen=True)
class Lexicon:
    """Sorted term hashes within the band."""

    terms: np.ndarray

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.zeros(len(hashes), dtype=bool)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return self.terms[at] == hashes

    def fingerprint(self, text: str) -> str:
        """Hashes of the terms in the band, ``|``, hashes of all terms; empty without words.

        Either is ``rate:hash,hash,...`` by rate, ``-`` for an empty subset.  The first
        is empty if the band does not stand for the text.
        """
        terms = np.sort(term_hashes(words_of(text)))
        if not len(terms):
            return ""
        kept = terms[self.holds(terms)]
        stands = len(kept) >= max(FEWEST_TERMS, LEAST_SHARE * len(terms))
        return f"{_levels(kept) if stands else ''}|{_levels(terms)}"


def _levels(kept: np.ndarray) -> str:
    draws = (kept[:, None] * _ODD[None, :]) >> np.uint64(40)
    levels, full = [], 0
    for rate in range(RATES - 1, -1, -1):
        inside = draws < np.uint64((1 << 24) >> (2 * rate))
        some = inside.any(axis=0)
        hashes = [xxhash.xxh32_hexdigest(kept[inside[:, k]].tobytes()) if some[k] else "-" for k in range(PER_RATE)]
        full += int(some.sum())
        if full:
            levels.append(f"{rate}:{','.join(hashes)}")
        if full >= ENOUGH:
            break
    return ";".join(levels)


def likeness(one: str, other: str) -> float:
    """Equal hashes by hashes that are not empty on both sides, at the rates both have.

    Hashes of terms in the band if both sides have them, of all terms otherwise.  1 for equal fingerprints, two empty ones included; 0 if only one is empty.
    """
    if one == other:
        return 1.0
    if not one or not other:
        return 0.0
    parts = [f.split("|") for f in (one, other)]
    at = 0 if all(p[0] for p in parts) else 1
    mine, yours = (dict(level.split(":") for level in p[at].split(";")) for p in parts)
    least = max(min(map(int, mine)), min(map(int, yours)))
    none = ",".join(["-"] * PER_RATE)
    equal = total = 0
    for rate in range(least, RATES):
        for a, b in zip(mine.get(str(rate), none).split(","), yours.get(str(rate), none).split(",")):
            total += a != "-" or b != "-"
            equal += a == b != "-"
    return equal / total if total else 0.0


def repeated_marks(hashes: DataFrame) -> np.ndarray:
    """A bit for every value of a hash's first ``MARK_BITS``, set if a hash occurs twice."""
    slot = F.shiftrightunsigned("hash", 64 - MARK_BITS) + 1
    repeated = hashes.groupBy("hash").count().where(F.col("count") > 1)
    marked = repeated.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    bitmap = np.zeros(1 << (MARK_BITS - 3), dtype=np.uint8)
    for bucket, bits in marked.collect():
        at = (bucket - 1) * len(bits)
        bitmap[at : at + len(bits)] = np.frombuffer(bits, dtype=np.uint8)
    return bitmap


def lexicon(docs: DataFrame, text_col: str = "text", rarest: float = RAREST, commonest: float = COMMONEST) -> Lexicon:
    """Count the distinct texts of every term over the whole table and keep the band.

    Hashes tell which texts may be repeated, in a bitmap of fixed size; only those
    texts are shuffled, compressed, to leave one of each, after copies are dropped
    in the tasks.
    Counts are combined in the tasks before they are shuffled.  What reaches the
    driver is the band alone: a document has a bounded number of terms and each kept
    term is in ``rarest`` of all documents at least, so its size does not grow with
    the number of documents.
    """
    given = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    hashed = given.select("text", F.xxhash64("text").alias("hash"))
    total = hashed.select("hash").distinct().count()
    marks = docs.sparkSession.sparkContext.broadcast(repeated_marks(hashed.select("hash")))

    def part(repeated: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slot = batch.column("hash").to_numpy().view(np.uint64) >> np.uint64(64 - MARK_BITS)
                marked = (marks.value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                yield batch.select(["text"]).filter(pa.array(marked == repeated))

        return choose

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = zstandard.ZstdCompressor(level=9)
        for batch in part(True)(batches):
            texts = [packed.compress(t.encode("utf-8", "surrogatepass")) for t in strings(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["packed"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = [packed.decompress(t).decode("utf-8", "surrogatepass") for t in batch.column("packed").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            digest = xxhash.xxh64_intdigest
            terms = np.array([digest(w) for w in seen], dtype=np.uint64).view(np.int64)
            made = pa.RecordBatch.from_arrays([pa.array(terms), pa.array(list(seen.values()), pa.int64())], ["term", "n"])
            seen.clear()
            return made

        for batch in batches:
            for text in strings(batch.column("text")):
                seen.update(set(words_of(text)))
                if len(seen) >= COUNTED_TERMS:
                    yield flush()
        yield flush()

    once = hashed.mapInArrow(lambda batches: count(part(False)(batches)), "term long, n long")
    copies = hashed.mapInArrow(pack, "packed binary").distinct().mapInArrow(lambda batches: count(unpack(batches)), "term long, n long")
    found = once.union(copies).groupBy("term").agg(F.sum("n").alias("n"))
    band = found.where((F.col("n") >= rarest * total) & (F.col("n") <= max(commonest * total, 1)))
    terms = band.select("term").toArrow().column("term").to_numpy().view(np.uint64)
    return Lexicon(np.sort(terms))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the head of ``following``."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)
_NULL = -(1 << 63)


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likeness to it and to
    the next document's.

    Documents follow each other by id, null ids first, equal ids by text; the first
    follows the last.  A null text is an empty one.  Texts are shuffled once, into
    ranges of ids; the first document of a range is also sent to the range before.
    """
    spark = docs.sparkSession
    rows = keyed_texts(docs, id_col, text_col)
    parts = parts or shuffle_partitions(spark)
    splits = id_splits(rows, parts)
    known = spark.sparkContext.broadcast(lexicon(docs, text_col))
    key = F.coalesce("doc_id", F.lit(_NULL))

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(range_of(keys, splits).astype(np.int32))

    firsts = rows.select(key.alias("key")).groupBy(place("key").alias("part")).agg(F.min("key").alias("first")).collect()
    firsts = sorted((r.part, r.first) for r in firsts)
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}
    heads = np.array(sorted(before), dtype=np.int64)
    targets = np.array([before[h] for h in sorted(before)], dtype=np.int32)

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series) -> pd.Series:
        """The range of a key; for the head of a range also the one before, as -1 - range."""
        own = range_of(keys, splits)
        at = np.minimum(np.searchsorted(heads, keys), len(heads) - 1)
        head = heads[at] == keys.to_numpy()
        return pd.Series([[int(p), -1 - int(targets[a])] if h else [int(p)] for p, h, a in zip(own, head, at)])

    dealt = (
        rows.withColumn("key", key)
        .withColumn("place", F.explode(places("key")))
        .select("doc_id", "text", "key", (F.col("place") < 0).alias("ahead"), F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("part"))
        .repartitionById(parts, "part")
        .sortWithinPartitions("part", "ahead", "key", "text")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (id, text, fingerprint) that waits for the document after it
        for batch in batches:
            out = []
            for doc, text, ahead in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text")), batch.column("ahead").to_pylist()):
                if ahead and held is None:
                    continue
                own = known.value.fingerprint(text)
                if held is not None:
                    doc0, text0, own0 = held
                    changed = edited(text0, text)
                    other = known.value.fingerprint(changed) if changed != text0 else own0
                    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((doc0, len(text0), sha, own0, other, likeness(own0, other), likeness(own0, own)))
                held = None if ahead else (doc, text, own)
            columns = zip(*out) if out else [()] * len(_OUT)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("doc_id", "text", "ahead").mapInArrow(compare, schema)
