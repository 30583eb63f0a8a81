"""What a posting costs as an index and its blocks are built."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from test_documents import T0, docs
from webloom.operators import blocks as B
from webloom.operators.postings import build_postings
from webloom.operators.ranking import rank_positions, rank_sizes
from webloom.session import fresh_path


def test_chunks_come_sorted_by_term_and_document(spark):
    draw = random.Random(4)
    rows = [(f"d{k}", "u", None, " ".join(draw.choices(["Zoo", "fox", "été", "cat", "dog1"], k=40)), T0, 0.1) for k in (3, 1, 12, 2, 1)]
    for english in (True, False):
        got = build_postings(docs(spark, rows).coalesce(1), english, partitions=1).select("term", "link_id").collect()
        order = [(r.term.encode(), r.link_id) for r in got]
        # The last document of a task is a chunk of its own.
        assert sum(a > b for a, b in zip(order, order[1:])) <= 1 and {d for _, d in order} == {"d1", "d2", "d3", "d12"}
        assert len([r for r in got if r.link_id == "d1"]) == 2 * len([r for r in got if r.link_id == "d2"])


LISTS = [[0], [5, 5, 4, 5], list(range(300)), list(range(16300, 16500)), [16381, 16382, 16383], [9, 3, 9, 3], [], [16382] * 3, list(range(254)) + [20000, 20001]]


def test_sizes_are_those_of_the_positions_that_count(spark):
    asked = spark.createDataFrame([(i, p) for i, p in enumerate(LISTS)], "i int, positions array<int>")
    want = [r.n for r in asked.select("i", F.size(rank_positions(F.col("positions"))).alias("n")).orderBy("i").collect()]
    kind = pa.list_(pa.int32())
    assert rank_sizes(pa.array(LISTS, kind)).tolist() == want
    for i, given in enumerate(LISTS):  # alone, where lists may all be in order
        assert rank_sizes(pa.array([[1], given], kind).slice(1)).tolist() == [want[i]]
    assert rank_sizes(pa.array([], kind)).tolist() == []


def test_blocks_count_positions_where_they_are_grouped(spark, monkeypatch):
    given = [("a", f"d{i}", len(p), p) for i, p in enumerate(LISTS) if p] + [("b", "d0", 1, [7])]
    postings = spark.createDataFrame(given, "term string, link_id string, tf int, positions array<int>")
    kind, handed = type(postings), []
    of_frame = kind.mapInArrow

    def seen(df, *args):
        handed.append((df.columns, spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")))
        return of_frame(df, *args)

    monkeypatch.setattr(kind, "mapInArrow", seen)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    blocks = B.write_blocks(postings.coalesce(1), fresh_path(spark, "blocks"), 1)
    # Nothing is worked out for each posting beforehand, and no batch is measured anew with each row.
    assert handed == [(["term", "range", "link_id", "tf", "positions"], str(2**31 - 1))]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    rows = blocks.frame.where("term = 'a'").agg(F.sum("n"), F.min("least_counted"), F.max("most_counted")).first()
    assert tuple(rows) == (len(LISTS) - 1, 1, 255)
