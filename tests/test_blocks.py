"""Posting blocks against postings, and first pages against full sorts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from test_documents import T0, docs
from webloom.operators import blocks as B
from webloom.operators import search
from webloom.operators.postings import build_postings, write_postings
from webloom.session import fresh_path

WORDS = ["the", "cat", "dog", "bird", "fox", "rare"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    rows = []
    for k in range(400):
        words = rng.choices(WORDS[:5], weights=[9, 6, 4, 2, 1], k=rng.randint(1, 30))
        if k in (17, 230, 231):
            words[rng.randrange(len(words))] = "rare"
        if k % 50 == 0:
            words += ["dog"] * rng.randint(5, 40)
        rows.append((f"d{k:03d}", f"u/{k}", None, " ".join(words), T0, None if k % 97 == 5 else rng.randint(0, 40) / 40))
    table = docs(spark, rows).persist()
    postings = write_postings(build_postings(table), fresh_path(spark, "postings")).persist()
    return table, postings, B.write_blocks(postings, fresh_path(spark, "blocks"), 400, docs_per_block=8)


def test_blocks_hold_the_postings(spark, corpus):
    _, postings, blocks = corpus
    assert blocks.bits == 6
    every = blocks.frame.select("range").distinct()
    held = blocks.postings([t for (t,) in postings.select("term").distinct().collect()], every)
    assert sorted(held.collect()) == sorted(postings.select("link_id", "term", "tf", "positions").collect())
    for row in blocks.frame.where("term = 'dog'").collect():
        assert row.n == len(row.ids) and row.ids == sorted(row.ids)
        assert (row.least_tf, row.most_tf) == (min(row.tfs), max(row.tfs)) == (row.least_counted, row.most_counted)
    assert B.load_blocks(spark, blocks.frame.inputFiles()[0].rsplit("/bits=", 1)[0]).bits == 6


@pytest.mark.parametrize("text", ["cat rare", "fox or rare -dog", '"cat dog" bird', "rare or -cat", "unseen", "the"])
@pytest.mark.parametrize("ranking", ["log_tf", "ts_rank"])
def test_matches_equal_those_of_postings(corpus, text, ranking):
    table, postings, blocks = corpus
    query = search.read_query(table, text)
    want = search.matches(table, postings, query, ranking).collect() if query else []
    got = B.block_matches(table, blocks, query, ranking).collect() if query else []
    assert sorted(got) == sorted(want)


def test_only_ranges_of_the_rarest_word_are_decoded(corpus):
    table, postings, blocks = corpus
    ranges = B.bounded_ranges(blocks, search.read_query(table, "the cat rare"))
    rare = postings.where("term = 'rare'").select(blocks.range_of(F.col("link_id")).alias("range")).distinct()
    found = {r.range for r in ranges.collect()}
    assert found <= {r.range for r in rare.collect()} and len(found) <= 3
    held = blocks.postings(["cat", "rare"], ranges)
    assert held.where("term = 'cat'").count() < postings.where("term = 'cat'").count() / 5
    plan = ranges._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan and "positions:" not in plan


@pytest.mark.parametrize("text", ["cat or fox", "cat dog", "rare or fox -the", "-dog"])
@pytest.mark.parametrize(("order", "ranking"), [("asc", "log_tf"), ("desc", "log_tf"), ("asc", "ts_rank"), ("desc", "ts_rank")])
def test_first_pages_equal_full_sorts(corpus, monkeypatch, text, order, ranking):
    table, postings, blocks = corpus
    monkeypatch.setattr(B, "FIRST_RANGES", 3)
    want = [tuple(r) for r in search.search(table, postings, text, relevance_order=order, ranking=ranking).page.collect()]
    best = B.rank_bounds(blocks, table) if ranking == "log_tf" else None
    found = B.search_top(table, blocks, text, relevance_order=order, ranking=ranking, best_ranks=best)
    assert [tuple(r) for r in found.page.collect()] == want
    assert 0 <= found.decoded <= found.ranges <= 64


def test_a_frequent_word_ends_early(corpus, monkeypatch):
    table, _, blocks = corpus
    monkeypatch.setattr(B, "FIRST_RANGES", 4)
    often = B.search_top(table, blocks, "dog", relevance_order="desc", limit=3, ranking="log_tf")
    assert often.decoded < often.ranges / 2
    # Nearly all ranges hold the least score, so the ranks must tell them apart.
    tied = B.search_top(table, blocks, "cat", limit=3, best_ranks=B.rank_bounds(blocks, table), ranking="log_tf")
    without = B.search_top(table, blocks, "cat", limit=3, ranking="log_tf")
    assert tied.decoded <= without.decoded and tied.decoded < tied.ranges and [r.link_id for r in tied.page.collect()] == [r.link_id for r in without.page.collect()]
    with pytest.raises(ValueError):
        B.search_top(table, blocks, "cat", limit=0)


def test_an_index_is_stored_without_dealing_its_postings(spark, corpus):
    """Postings and blocks are written where their documents lie."""
    table, postings, _ = corpus
    path = fresh_path(spark, "dealt")
    stored = write_postings(build_postings(table, partitions=3, dealt=True), path)
    assert sorted(stored.collect()) == sorted(postings.collect())
    files = {}
    for row in stored.select(F.input_file_name().alias("file"), "link_id", "term").collect():
        files.setdefault(row.file, []).append((row.term, row.link_id))
    assert len(files) == 3 and all(rows == sorted(rows) for rows in files.values())
    held = [{link_id for _, link_id in rows} for rows in files.values()]
    assert sum(map(len, held)) == len(set().union(*held))
    assert not spark._jvm.java.io.File(f"{path}-staged").exists()
    # Ranges are not torn apart: nearly every block of a range and term is whole.
    blocks = B.write_blocks(stored, fresh_path(spark, "blocks"), 400, docs_per_block=8)
    pairs = blocks.frame.groupBy("term", "range").count()
    assert blocks.frame.count() <= 1.1 * pairs.count()
    every = blocks.frame.select("range").distinct()
    assert sorted(blocks.postings(WORDS, every).collect()) == sorted(postings.where(F.col("term").isin(WORDS)).select("link_id", "term", "tf", "positions").collect())


def test_bounds_of_a_range_in_several_blocks(spark):
    rows = [(f"d{k}", f"u/{k}", None, " ".join(["cat"] * (k + 1)), T0, 0.5) for k in range(6)]
    table = docs(spark, rows)
    stored = write_postings(build_postings(table, partitions=6), fresh_path(spark, "torn"))
    blocks = B.write_blocks(stored.repartition(6, "tf"), fresh_path(spark, "blocks"), 1)
    assert blocks.frame.count() > blocks.frame.select("range").distinct().count()
    for order in ("asc", "desc"):
        want = [tuple(r) for r in search.search(table, stored, "cat", limit=2, relevance_order=order, ranking="log_tf").page.collect()]
        found = B.search_top(table, blocks, "cat", limit=2, relevance_order=order, ranking="log_tf")
        assert [tuple(r) for r in found.page.collect()] == want
    bounds = B.bounded_ranges(blocks, search.read_query(table, "cat"), "log_tf", "desc")
    best = stored.groupBy(blocks.range_of(F.col("link_id")).alias("range")).agg(F.max("tf").alias("tf"))
    for row in bounds.join(best, "range").collect():
        assert -row.bound == pytest.approx(1 + math.log(row.tf), abs=1e-6)


def test_replaced_ids_do_not_shuffle_the_postings(spark, corpus, monkeypatch):
    from webloom.operators import postings as P

    table, postings, _ = corpus
    stored = write_postings(postings, fresh_path(spark, "postings"))
    changed = table.where("link_id < 'd100'")

    def plan(settings):
        with P.planning(spark, settings):
            return P.update_postings(stored, changed)._jdf.queryExecution().sparkPlan().toString()

    small = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    assert "BroadcastHashJoin" in plan(small)
    monkeypatch.setattr(P, "MOST_BROADCAST", 10)
    assert "BroadcastHashJoin" not in plan(small)
