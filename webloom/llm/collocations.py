"""Collocations by SON partitioning: phrases that are frequent in some shard, counted everywhere.

Documents are dealt to a few shards of equal expected size.  A phrase that occurs
``least`` times in all occurs at least ``least / shards`` times in one of them, so each
shard is mined completely at that lower support, the phrases that are frequent in any
shard are joined into one set of candidates, and a last pass counts every candidate
over all documents.  Inside a shard phrases are mined by length, from two words on: a
longer one can be frequent only if both phrases without its first and its last word are.

Until the last pass a phrase is a 64-bit hash.  Candidates become a bitmap, which is all
that the next pass needs: what it lets through besides candidates is counted as exactly
as these and falls to the support.  The bitmap grows with the candidates up to
``MOST_BITS``; beyond that it lets more phrases through, which costs shuffle and no
result.  Words, phrases and shards are combined inside a task before anything is
shuffled, so a phrase that many documents share is a few rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.common import LOWER, UPPER
from webloom.session import fresh_path

#: Words of a phrase, least frequency, shards, rows a language returns, and the share of
#: its occurrences inside one longer phrase, in hundredths, at which a phrase is dropped.
MOST_WORDS, LEAST, SHARDS, TOP, CONTAINED = 3, 10, 3, 2000, 50
NO_LANG = "und"
#: Tokens a task works on at once, words it counts before it hands them on, and the bits
#: of a bitmap: 8 KB to 32 MB.
CHUNK_TOKENS, HELD_WORDS = 500_000, 200_000
LEAST_BITS, MOST_BITS, BITS_PER_CANDIDATE = 1 << 16, 1 << 28, 32

#: A piece ends at one of these; words end at blank and tab.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_ENDS + b"\t" + UPPER.encode(), b"." * len(_ENDS) + b" " + LOWER.encode())
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29))


def tokens_of(text: bytes) -> list[bytes]:
    """Words in ASCII lower case; a full stop, which no word holds, after each piece."""
    return text.translate(_TABLE).replace(b".", b" . ").split()


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of its start and its last word."""
    x = (left ^ (left >> _MIX[2])) * _MIX[0] + right * _MIX[1]
    return x ^ (x >> np.uint64(32))


class Chunk:
    """Tokens of some documents of one language and shard, as numbers and hashes."""

    def __init__(self, tokens: list[bytes], lang: str):
        found = pa.array(tokens, pa.binary()).dictionary_encode()
        self.words = found.dictionary.to_pylist()
        self.codes = found.indices.to_numpy().astype(np.int64)
        seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
        hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words], dtype=np.uint64)
        self.hashes = hashes[self.codes]
        ends = np.array([w == b"." for w in self.words], dtype=bool)
        self.is_word = ~ends[self.codes]

    def phrases(self, size: int, frequent: dict[int, Bitmap]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the phrase that starts at each place, whether it may be frequent).

        It may be if both phrases that are one word shorter are in their bitmap.
        """
        hashes, may = self.hashes, self.is_word
        for n in range(2, size + 1):
            if n - 1 in frequent:
                may = may & frequent[n - 1].holds(hashes)
            may = may[:-1] & may[1:]
            hashes = _mixed(hashes[: len(may)], self.hashes[n - 1 :][: len(may)])
        return hashes, may


class Bitmap:
    """A set of hashes by some of their bits; may hold more, never less."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits.bit_length() + 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _chunks(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[tuple[int, str, Chunk]]:
    """The documents of a task by shard and language, some tokens at a time."""
    held: dict[tuple[int, str], list[bytes]] = {}
    n = 0
    for batch in batches:
        langs, places = batch.column("lang").to_pylist(), batch.column("shard").to_pylist()
        for lang, shard, text in zip(langs, places, batch.column("text").cast(pa.binary())):
            tokens = tokens_of(text.as_py() or b"")
            if tokens:
                mine = held.setdefault((shard if shards else 0, lang), [])
                mine += tokens
                mine.append(b".")
                n += len(tokens)
            if n >= CHUNK_TOKENS:
                for key, tokens in held.items():
                    yield *key, Chunk(tokens, key[1])
                held, n = {}, 0
    for key, tokens in held.items():
        yield *key, Chunk(tokens, key[1])


def _sent(spark: SparkSession, frequent: dict[int, Bitmap]) -> Broadcast:
    return spark.sparkContext.broadcast({n: (m.bits, m.words) for n, m in frequent.items()})


def _mined(texts: DataFrame, size: int, frequent: dict[int, Bitmap], shards: int, least: int) -> DataFrame:
    """(hash): the phrases of ``size`` words that some shard holds often enough."""

    maps = _sent(texts.sparkSession, frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {n: Bitmap(*m) for n, m in maps.value.items()}
        for shard, _, chunk in _chunks(batches, shards):
            hashes, may = chunk.phrases(size, held)
            # The lowest bits tell the shard.
            keys = hashes[may] & ~np.uint64(_shard_mask(shards)) | np.uint64(shard)
            found, times = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times.astype(np.int32))], ["key", "n"])

    counted = texts.mapInArrow(run, "key long, n int").groupBy("key").agg(F.sum("n").alias("n"))
    often = counted.where(F.col("n") * shards >= least)
    return often.select(F.col("key").bitwiseAND(F.lit(~_shard_mask(shards))).alias("hash")).distinct()


def _shard_mask(shards: int) -> int:
    return (1 << (shards - 1).bit_length()) - 1


def _bitmap(hashes: DataFrame) -> Bitmap:
    """The bitmap of a table of distinct hashes: at most 32 MB, gathered as words of 64 bits."""
    spark = hashes.sparkSession
    path = fresh_path(spark, "candidates")
    hashes.write.parquet(path)
    held = spark.read.schema("hash long").parquet(path)
    wanted = max(1, held.count()) * BITS_PER_CANDIDATE
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (wanted - 1).bit_length()))
    at = F.shiftrightunsigned("hash", 64 - bits.bit_length() + 1)
    word = F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("word")
    found = held.select(at.alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("place")).agg(word).toArrow()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[found.column("place").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return Bitmap(bits, words)


def _counted(texts: DataFrame, frequent: dict[int, Bitmap], most_words: int, least: int) -> DataFrame:
    """(lang, size, phrase, n): the exact frequency of all words and phrases that have the
    support; phrases of size 0 tell the number of words of a language."""
    maps = _sent(texts.sparkSession, frequent)

    def rows(lang: str, size: int, phrases: list[bytes], times: list[int]) -> pa.RecordBatch:
        columns = [pa.array([lang] * len(times), pa.string()), pa.array([size] * len(times), pa.int32()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "size", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {n: Bitmap(*m) for n, m in maps.value.items()}
        counts: dict[str, Counter[bytes]] = defaultdict(Counter)
        for _, lang, chunk in _chunks(batches, 0):
            words, codes = chunk.words, chunk.codes
            yield rows(lang, 0, [b""], [int(chunk.is_word.sum())])
            found, times = np.unique(codes[chunk.is_word], return_counts=True)
            mine = counts[lang]
            for code, n in zip(found.tolist(), times.tolist()):
                mine[words[code]] += n
            if len(mine) >= HELD_WORDS:
                yield rows(lang, 1, list(mine), list(mine.values()))
                mine.clear()
            # Equal phrases have equal numbers, made of those of start and last word.
            numbers = codes
            for size in range(2, most_words + 1):
                last = codes[size - 1 :]
                numbers = np.unique(numbers[: len(last)] * len(words) + last, return_inverse=True)[1]
                hashes, may = chunk.phrases(size, held)
                at = np.flatnonzero(may & held[size].holds(hashes))
                _, first, n = np.unique(numbers[at], return_index=True, return_counts=True)
                phrases = [b" ".join([words[c] for c in codes[p : p + size].tolist()]) for p in at[first].tolist()]
                yield rows(lang, size, phrases, n.tolist())
        for lang, mine in counts.items():
            yield rows(lang, 1, list(mine), list(mine.values()))

    every = texts.mapInArrow(run, "lang string, size int, phrase string, n long")
    counts = every.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return counts.where((F.col("n") >= least) | (F.col("size") == 0))


def phrase_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    most_words: int = MOST_WORDS,
    least: int = LEAST,
    shards: int = SHARDS,
) -> DataFrame:
    """(lang, size, phrase, n): frequency of every word and phrase that occurs ``least`` times.

    Size 0 holds the number of words of a language.  A null text is an empty one, a
    null language ``und``; a repeated row counts again, and a null id changes no count.
    Further columns may have any name.  An empty table gives an empty one.  A very long
    text is held whole by its task.
    """
    spark = docs.sparkSession
    given = docs.select(
        F.coalesce(docs[lang_col].cast("string"), F.lit(NO_LANG)).alias("lang"),
        docs[text_col].cast("string").alias("text"),
        F.pmod(F.xxhash64(docs[id_col]), F.lit(shards)).cast("int").alias("shard"),
    )
    frequent: dict[int, Bitmap] = {}
    for size in range(2, most_words + 1):
        frequent[size] = _bitmap(_mined(given, size, frequent, shards, least))
    path = fresh_path(spark, "phrases")
    _counted(given, frequent, most_words, least).write.parquet(path)
    return spark.read.schema("lang string, size int, phrase string, n long").parquet(path)


def _exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in decimals; a is at most l and r, so it is at most 1000000."""
    top = (a.cast("decimal(16,0)") * a.cast("decimal(16,0)")).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    below = left.cast("decimal(19,0)") * right.cast("decimal(19,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), below.cast("decimal(38,0)"))


def scored(counts: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(lang, size, phrase, a, k, l, r, score): each phrase by its lowest-scoring cut.

    A phrase is cut after its first k words.  Its parts are as frequent as it is at
    least, so they are among ``counts``.
    """
    phrases = counts.where("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    start = F.array_join(F.slice("w", F.lit(1), F.col("k")), " ")
    rest = F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ")
    cut = cuts.select("lang", "size", "phrase", "a", "k", start.alias("start"), rest.alias("rest"))
    parts = counts.where(f"size between 1 and {most_words - 1}")

    def part(name: str, as_: str) -> DataFrame:
        return parts.select("lang", F.col("phrase").alias(name), F.col("n").alias(as_))

    found = cut.join(part("start", "l"), ["lang", "start"]).join(part("rest", "r"), ["lang", "rest"])
    score = _exact_score(F.col("a"), F.col("l"), F.col("r"))
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return found.groupBy("lang", "size", "phrase", "a").agg(best).select("lang", "size", "phrase", "a", "best.*")


def inside_longer(counts: DataFrame, contained: int = CONTAINED) -> DataFrame:
    """(lang, phrase): phrases of which some longer one has ``contained`` hundredths at least."""
    longer = counts.where("size >= 3").select("lang", "size", F.col("n").alias("longer"), F.split("phrase", " ").alias("w"))
    length = longer.withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    place = length.withColumn("p", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    within = place.select("lang", F.array_join(F.slice("w", F.col("p"), F.col("m")), " ").alias("phrase"), "longer")
    most = within.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    phrases = counts.where("size >= 2").select("lang", "phrase", "n")
    share = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("n").cast("decimal(20,0)") * contained
    return phrases.join(most, ["lang", "phrase"]).where(share).select("lang", "phrase")


def collocations(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    most_words: int = MOST_WORDS,
    least: int = LEAST,
    shards: int = SHARDS,
    top: int = TOP,
    contained: int = CONTAINED,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    Phrases of 2 to ``most_words`` words that occur ``least`` times, but not mostly
    inside one longer phrase, by score descending, frequency descending, phrase
    ascending in byte order; ties are thus settled.  Nulls and odd rows are as of
    ``phrase_counts``.  Each task keeps its own first ``top`` before they are ranked.
    """
    counts = phrase_counts(docs, id_col, text_col, lang_col, most_words, least, shards)
    kept = scored(counts, most_words).join(inside_longer(counts, contained), ["lang", "phrase"], "left_anti")
    words = counts.where("size = 0").select("lang", "n")
    return _first(kept, top, counts.count()).join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _first(phrases: DataFrame, top: int, rows: int) -> DataFrame:
    """The first ``top`` of each language with their ``rank``.

    A language may hold most phrases, so they are ranked in groups of some 200,000
    first, and the first ``top`` of these once more.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    group = F.pmod(F.xxhash64("phrase"), F.lit(max(8, math.ceil(rows / 200_000))))
    grouped = phrases.withColumn("group", group)
    some = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order))).where(F.col("rank") <= top)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return last.where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long")).drop("group")
