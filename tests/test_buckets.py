"""Merges into buckets against the outer join over the whole table."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from test_documents import docs
from webloom.operators import upserts
from webloom.schemas import LINK
from webloom.session import fresh_path
from webloom.sources import buckets, tables

T0, HOUR = datetime(2024, 1, 1), timedelta(hours=1)


def links(spark, rows):
    return spark.createDataFrame([(f"id-{u}", u, t) for u, t in rows], LINK)


def batch(spark, rows):
    return spark.createDataFrame(rows, "url string, retrieved_at timestamp_ntz")


def new_links(spark, n=60):
    table = buckets.link_table(spark, fresh_path(spark, "links").removeprefix("file:"), 8)
    old = links(spark, [(f"http://h.x/{k}", T0) for k in range(n)])
    table.replace(old)
    return table, old


def files(root):
    return {os.path.join(p, f) for p, _, names in os.walk(root) for f in names if f.endswith(".parquet") and "/data/" in p}


def test_a_batch_of_one_url_rewrites_one_bucket(spark):
    table, old = new_links(spark)
    before, folders = files(table.root), table.folders()
    assert len(folders) == 8
    one = batch(spark, [("http://h.x/7", T0 + HOUR), (None, T0)])
    buckets.merge_links(table, one)
    (added,) = files(table.root) - before
    after = table.folders()
    assert before <= files(table.root) and sum(folders[b] != after[b] for b in folders) == 1
    rows = spark.read.parquet(added)
    assert rows.count() < 20 and rows.where("url = 'http://h.x/7'").first().retrieved_at == T0 + HOUR
    assert sorted(table.load().collect()) == sorted(upserts.upsert_links(old, one).collect())


def test_merges_equal_outer_joins(spark):
    table, want = new_links(spark)
    for k in range(3):
        rows = [(f"http://h.x/{j}", T0 + (j % 5 - 2) * HOUR) for j in range(k * 25, k * 25 + 40)]
        given = batch(spark, rows + [(rows[0][0], None), ("http://new.x", T0)])
        want = upserts.upsert_links(want, given).persist()
        buckets.merge_links(table, given)
    assert sorted(table.load().collect()) == sorted(want.collect())
    assert sorted(table.load(1).collect()) == sorted(new_links(spark)[1].collect())


def test_readers_keep_their_version_and_forget_deletes_the_rest(spark):
    table, old = new_links(spark)
    running = table.load()
    for k in range(3):
        buckets.merge_links(table, batch(spark, [(f"http://h.x/{k}", T0 + HOUR)]))
    assert sorted(running.collect()) == sorted(old.collect())
    now, held = sorted(table.load().collect()), len(files(table.root))
    dropped = table.forget(keep=1)
    assert dropped == held - len(files(table.root)) == held - 8 and sorted(table.load().collect()) == now
    assert buckets.merge_links(table, batch(spark, [("http://h.x/9", T0 + HOUR)])) == 5


def test_empty_tables_batches_and_wrong_uses(spark, monkeypatch):
    table = buckets.link_table(spark, fresh_path(spark, "links"), 4)
    assert table.load().collect() == [] and table.folders() == {}
    buckets.merge_links(table, batch(spark, []))
    assert table.load().collect() == []
    buckets.merge_links(table, batch(spark, [("u", T0)]))
    assert [r.url for r in table.load().collect()] == ["u"]
    with pytest.raises(ValueError, match="buckets"):
        buckets.link_table(spark, table.root, 5).load()
    with pytest.raises(ValueError, match="does not name"):
        table.merge(spark.createDataFrame([("u",)], "url string"), lambda old: links(spark, [(f"x{k}", T0) for k in range(40)]))
    seen = tables.versions(spark, table.root, "manifest")
    monkeypatch.setattr(tables, "versions", lambda *args: seen[:-1])
    with pytest.raises(Exception, match="(?i)already exists"):
        buckets.merge_links(table, batch(spark, [("v", T0)]))
    monkeypatch.undo()
    assert [r.url for r in table.load().collect()] == ["u"]


def test_edges_and_documents(spark):
    root = fresh_path(spark, "tables")
    pairs = spark.createDataFrame([(f"s{k % 9}", f"d{k}") for k in range(40)], "src string, dst string")
    edges, some = buckets.edge_table(spark, f"{root}/edges", 4), pairs.where("dst < 'd2'")
    first = upserts.touch_edges(spark.createDataFrame([], edges.schema), some, T0)
    edges.replace(first)
    buckets.merge_edges(edges, pairs, T0 + HOUR)
    assert sorted(edges.load().collect()) == sorted(upserts.touch_edges(first, pairs, T0 + HOUR).collect())
    old = docs(spark, [(f"k{k}", f"u{k}", "t", "c", T0, 0.5) for k in range(20)])
    new = docs(spark, [("k3", "v", None, None, T0, 0.0), ("k3", "w", "t", "c", T0 - HOUR, 0.0), ("n", "n", "t", "c", T0, 0.1), (upserts.NIL_ID, "x", "t", "c", T0, 0.1)])
    table = buckets.document_table(spark, f"{root}/docs", 4)
    table.replace(old)
    buckets.merge_documents(table, new, T0 + HOUR)
    want, _ = upserts.upsert_documents(old, new, T0 + HOUR)
    assert sorted(table.load().collect(), key=repr) == sorted(want.collect(), key=repr)
    assert table.load().where(F.col("link_id") == "k3").first().pagerank == 0.5
