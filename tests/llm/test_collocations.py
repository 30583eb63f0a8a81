"""Collocations against counting every phrase in one dictionary."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from helpers import ODD_DOCS, sorted_rows
from webloom.llm import collocations as C

RULES = {"most_words": 3, "least": 10, "top": 2000, "contained": 50}


def plain(rows, most_words=3, least=10, top=2000, contained=50):
    counts, words = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            counts.update((lang, tuple(w[i : i + m])) for m in range(1, most_words + 1) for i in range(len(w) - m + 1))
    frequent = {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= least}
    within = Counter()
    for (lang, w), n in frequent.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                within[lang, w[i : i + m]] = max(within[lang, w[i : i + m]], n)
    out = []
    for (lang, w), a in frequent.items():
        if 100 * within[lang, w] >= contained * a:
            continue
        cuts = [(counts[lang, w[:k]], counts[lang, w[k:]], k) for k in range(1, len(w))]
        score, _, left, right = min((1_000_000 * a * a // (x * y), k, x, y) for x, y, k in cuts)
        out.append((lang, " ".join(w), a, left, right, words[lang], score))
    rows_out = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        rows_out += [(lang, k + 1, *r[1:]) for k, r in enumerate(mine[:top])]
    return sorted(rows_out, key=repr)


def table(spark, rows):
    """Columns that the operator might use for itself are there with other contents."""
    given = [(*r, 7, -1, "x", 0.5) for r in rows]
    return spark.createDataFrame(given, "doc_id long, text string, lang string, shard int, n int, phrase string, score double")


def corpus(seed=1, docs=300):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "日本", "Don't", "a\x0bb", "x-y", "ZETA"]
    rows = []
    for k in range(docs):
        words = rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "! "]) for w in words)
        rows.append((k, text + rng.choice(["", "New York City Hall ", "New York. "]), rng.choice(["en", "de", None, "und"])))
    return rows


def test_collocations_equal_counting_every_phrase(spark):
    rows = corpus() + [(i, t, "odd") for i, t in ODD_DOCS]
    found = C.collocations(table(spark, rows))
    want = plain(rows)
    assert sorted_rows(found, *found.columns) == want
    assert len(want) > 60 and {r[0] for r in want} >= {"en", "de", "und"}
    assert not any(r[2] == "york city" for r in want)


def test_other_lengths_supports_and_bounds(spark):
    rows = corpus(2, 150)
    for rules in ({"most_words": 4, "least": 3, "top": 50, "contained": 70}, {"most_words": 2, "least": 7, "top": 5, "contained": 1}):
        for shards in (1, 3, 5):
            found = C.collocations(table(spark, rows), shards=shards, **rules)
            assert sorted_rows(found, *found.columns) == plain(rows, **rules)


def test_a_phrase_that_is_frequent_only_over_all_shards_is_found(spark):
    rows = [(k, f"rare pair here{k}", "en") for k in range(10)]
    found = C.collocations(table(spark, rows))
    assert sorted_rows(found, *found.columns) == plain(rows) == [("en", 1, "rare pair", 10, 10, 10, 30, 1_000_000)]
    assert C.collocations(table(spark, rows[:9])).count() == 0


def test_equal_scores_and_one_text_in_most_rows(spark):
    rows = [(k, "b a. a b. c d e", "en") for k in range(400)] + corpus(3, 60)
    found = C.collocations(table(spark, rows))
    assert sorted_rows(found, *found.columns) == plain(rows)


def test_empty_table_and_texts_without_words(spark):
    assert C.collocations(table(spark, [])).collect() == []
    assert C.collocations(table(spark, [(1, None, None), (None, " .,\n", "en"), (2, "", "en")])).collect() == []


def test_scores_beyond_64_bits(spark):
    counts = spark.createDataFrame(
        [("en", 1, "a", 3 * 10**12), ("en", 1, "b", 2 * 10**12), ("en", 2, "a b", 10**12 + 1)], "lang string, size int, phrase string, n long"
    )
    (row,) = C.scored(counts).collect()
    assert row.score == 1_000_000 * (10**12 + 1) ** 2 // (3 * 10**12 * 2 * 10**12)


def test_a_full_bitmap_costs_no_result(spark, monkeypatch):
    monkeypatch.setattr(C, "LEAST_BITS", 64)
    monkeypatch.setattr(C, "MOST_BITS", 64)
    rows = corpus(4, 100)
    found = C.collocations(table(spark, rows))
    assert sorted_rows(found, *found.columns) == plain(rows)


def test_bitmap_holds_all_that_went_in(spark):
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    frame = spark.createDataFrame([(int(h),) for h in hashes.view(np.int64)], "hash long").select(F.col("hash"))
    held = C._bitmap(frame)
    assert held.holds(hashes).all()
    others = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    assert held.holds(others).mean() < 0.1
