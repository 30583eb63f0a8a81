"""The segmented index against a rebuild."""

import os
import random

import pytest
from pyspark.sql import functions as F

from test_documents import T0, docs
from webloom.operators import search
from webloom.operators.postings import build_postings
from webloom.plans import index
from webloom.session import fresh_path
from webloom.sources import tables

WORDS = "cat dog bird fox running houses quickly the of".split()


class Corpus:
    """Documents that change by passes, and the index that follows them."""

    def __init__(self, spark, seed=0, most_words=12):
        self.spark, self.rng, self.texts, self.most_words = spark, random.Random(seed), {}, most_words
        self.root = fresh_path(spark, "segments").removeprefix("file:")

    def table(self, keys=None):
        chosen = self.texts if keys is None else keys
        return docs(self.spark, [(k, f"u/{k}", None, self.texts[k], T0, 0.1) for k in chosen])

    def change(self, keys, gone=()):
        for key in keys:
            self.texts[key] = " ".join(self.rng.choices(WORDS, k=self.rng.randint(0, self.most_words)))
        for key in gone:
            self.texts.pop(key, None)
        removed = self.spark.createDataFrame([(k,) for k in gone], "link_id string") if gone else None
        return index.add_pass(self.spark, self.root, self.table(keys), removed)

    def want(self):
        return sorted(build_postings(self.table()).collect())

    def found(self, version=None):
        return sorted(index.load_postings(self.spark, self.root, version).collect())


def files(root):
    return {os.path.join(p, n): os.stat(os.path.join(p, n)).st_mtime_ns for p, _, names in os.walk(root) for n in names}


def size(root):
    return sum(os.path.getsize(path) for path in files(root) if path.endswith(".parquet"))


def test_a_pass_writes_the_changed_documents_only(spark):
    corpus = Corpus(spark, most_words=300)
    assert corpus.found() == []
    corpus.change([f"d{k}" for k in range(400)])
    before, bytes_before = files(corpus.root), size(corpus.root)
    corpus.change(["d3", "d400"], gone=["d5", "unknown"])
    corpus.change(["d3", "d7"])
    assert before.items() <= files(corpus.root).items()
    assert size(corpus.root) - bytes_before < bytes_before / 2
    held = index.segments(spark, corpus.root)
    assert [s.number for s in held] == [0, 1, 2] and max(s.rows for s in held[1:]) < 20
    assert corpus.found() == corpus.want()


def test_searches_over_segments_equal_a_rebuild(spark):
    corpus = Corpus(spark, 1)
    corpus.change([f"d{k}" for k in range(60)])
    corpus.change([f"d{k}" for k in range(10, 30)], gone=["d40", "d41"])
    corpus.change([f"d{k}" for k in range(25, 35)] + ["new"])
    table, postings = corpus.table(), index.load_postings(spark, corpus.root)
    rebuilt = build_postings(table)
    for text in ("cat dog", "fox or -bird", '"cat dog"', "running house -quickly"):
        for phrase in (False, True):
            a, b = (search.search(table, p, text, phrase, limit=None) for p in (postings, rebuilt))
            assert [tuple(r) for r in a.page.collect()] == [tuple(r) for r in b.page.collect()]
            assert a.total.collect() == b.total.collect()
    plan = search.matches(table, postings, search.read_query(table, "cat"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(term,cat)") >= 3


def test_merges_leave_running_searches_alone(spark):
    corpus = Corpus(spark, 2)
    for k in range(6):
        corpus.change([f"d{j}" for j in range(k * 7, k * 7 + 20)], gone=[f"d{k}"] if k else ())
    running, want = index.load_postings(spark, corpus.root), corpus.want()
    version = index.segments(spark, corpus.root)
    assert index.merge(spark, corpus.root) is not None
    merged = index.segments(spark, corpus.root)
    assert len(merged) < len(version) and merged[-1].number == version[-1].number
    assert corpus.found() == sorted(running.collect()) == want
    corpus.change(["d1", "d2"], gone=["d20"])
    assert corpus.found() == corpus.want() and sorted(running.collect()) == want
    assert index.merge(spark, corpus.root, everything=True)
    assert corpus.found() == corpus.want() and len(index.segments(spark, corpus.root)) == 1
    assert index.merge(spark, corpus.root) is None


def test_ids_that_are_gone_outlive_a_merge_of_newer_segments(spark, monkeypatch):
    monkeypatch.setattr(index, "SMALL_ROWS", 8)
    corpus = Corpus(spark, 3)
    corpus.change([f"d{k}" for k in range(200)])
    for k in range(4):
        corpus.change([f"d{k}"], gone=[f"d{k + 50}"])
    assert index.segments(spark, corpus.root)[0].tier > 2
    assert index.merge(spark, corpus.root)
    held = index.segments(spark, corpus.root)
    assert [s.number for s in held] == [0, 4]
    assert corpus.found() == corpus.want()
    corpus.change(["d50", "d1"])
    assert corpus.found() == corpus.want()


def test_tiers_of_neighbours(monkeypatch):
    monkeypatch.setattr(index, "SMALL_ROWS", 10)

    def picked(*rows):
        return [s.rows for s in index._similar([index.Segment(k, str(k), n) for k, n in enumerate(rows)], 3)]

    assert picked() == picked(5) == picked(900, 5, 5) == []
    assert picked(900, 5, 5, 5) == [5, 5, 5]
    assert picked(5, 900, 5, 5, 5) == [5, 5, 5]
    assert picked(900, 30, 30, 30, 5) == [30, 30, 30, 5]
    assert picked(900, 900, 900, 5, 5) == [900, 900, 900, 5, 5]


def test_forget_keeps_what_versions_need(spark):
    corpus = Corpus(spark, 4)
    for k in range(4):
        corpus.change([f"d{k}"])
    index.merge(spark, corpus.root)
    before = size(corpus.root)
    dropped = index.forget(spark, corpus.root, keep=1)
    assert len(dropped) == 4 and size(corpus.root) < before
    assert corpus.found() == corpus.want()
    assert corpus.change(["d9"]) == 6 and corpus.found() == corpus.want()


def test_two_writers_do_not_overwrite_each_other(spark, monkeypatch):
    corpus = Corpus(spark, 5)
    corpus.change(["a"])
    seen = index.versions(spark, corpus.root, "manifest")
    corpus.change(["b"])
    monkeypatch.setattr(tables, "versions", lambda *args: seen)
    with pytest.raises(Exception, match="(?i)already exists"):
        corpus.change(["c"])
    monkeypatch.undo()
    corpus.texts.pop("c")
    assert corpus.found() == corpus.want()


def test_index_pass_follows_a_crawl(spark):
    corpus = Corpus(spark, 6)
    corpus.change([f"d{k}" for k in range(5)])
    corpus.texts |= {"d2": "new words", "d9": "another cat"}
    crawled = spark.createDataFrame([("u/d2",), ("u/d9",), ("u/d9",)], "url string")
    index.index_pass(spark, corpus.root, corpus.table(), crawled)
    assert corpus.found() == corpus.want()
    gone = index._gone(spark, corpus.root, index.segments(spark, corpus.root)[-1])
    assert gone.agg(F.count(F.lit(1))).first()[0] == 2
