import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webloom import session
from webloom.functions.urls import uuid_of
from webloom.operators.postings import build_postings
from webloom.operators.search import search
from webloom.operators.upserts import upsert_links
from webloom.plans.crawl import Snapshot, apply_crawl, crawl_delta, fold_delta, pass_report
from webloom.plans.rank import rank_pass
from webloom.schemas import CRAWLED, DOCUMENT, EDGE, LINK, NEVER
from webloom.sources.pages import extract_pages
from webloom.sources.tables import load_version
from webloom.streaming import ingest

T0 = datetime(2024, 1, 1)
DAY = timedelta(days=1)


def empty(spark):
    return Snapshot(*[spark.createDataFrame([], s) for s in (LINK, EDGE, DOCUMENT)])


def uid(spark, text):
    return spark.sql("select 1").select(uuid_of(F.lit(text))).first()[0]


def crawled(spark, pages):
    rows = [(uid(spark, url), url, title, title, found) for url, title, found in pages]
    return spark.createDataFrame(rows, CRAWLED)


def view(snapshot):
    links = {r.url: r.retrieved_at for r in snapshot.links.collect()}
    names = {r.id: r.url for r in snapshot.links.collect()}
    edges = {(names[r.src], names[r.dst]): r.update_at for r in snapshot.edges.collect()}
    docs = {r.url: (r.title, r.indexed_at, r.pagerank) for r in snapshot.docs.collect()}
    return links, edges, docs


FIRST = [("a", "A", ["b", "c"]), ("b", "B", ["a"])]
SECOND = [("a", "A2", ["c", "d"]), ("b", "B2", [])]


def test_crawl_pass_and_recrawl(spark):
    one = apply_crawl(empty(spark), crawled(spark, FIRST), T0)
    links, edges, docs = view(one)
    assert links == {"a": T0, "b": T0, "c": NEVER}
    assert edges == {("a", "b"): T0, ("a", "c"): T0, ("b", "a"): T0}
    assert docs == {"a": ("A", T0, 0.0), "b": ("B", T0, 0.0)}
    ranked = Snapshot(one.links, one.edges, one.docs.withColumn("pagerank", F.lit(0.5)))
    links, edges, docs = view(apply_crawl(ranked, crawled(spark, SECOND), T0 + DAY))
    assert links == {"a": T0 + DAY, "b": T0 + DAY, "c": NEVER, "d": NEVER}
    # Edges a page no longer holds expire, also when it holds none at all.
    assert edges == {("a", "c"): T0 + DAY, ("a", "d"): T0 + DAY}
    assert docs == {"a": ("A2", T0 + DAY, 0.5), "b": ("B2", T0 + DAY, 0.5)}


def test_deltas_fold_together_as_one_by_one(spark):
    deltas = [crawl_delta(crawled(spark, p), T0 + i * DAY) for i, p in enumerate((FIRST, SECOND))]
    step = fold_delta(fold_delta(empty(spark), deltas[0]), deltas[1])
    both = deltas[1].__class__(
        **{n: getattr(deltas[1], n).unionByName(getattr(deltas[0], n)) for n in ("links", "edges", "cutoffs", "docs")}
    )
    together = view(fold_delta(empty(spark), both))
    want = view(step)
    assert together[0] == want[0] and together[1] == want[1]
    assert {u: d[0] for u, d in together[2].items()} == {u: d[0] for u, d in want[2].items()}
    replayed = view(fold_delta(step, deltas[1]))
    assert replayed == want


ONE, TWO = "11111111-1111-1111-1111-111111111111", "22222222-2222-2222-2222-222222222222"


def test_a_pass_keeps_the_ids_of_the_store(spark):
    store = Snapshot(
        spark.createDataFrame([(ONE, "http://h.x/a", NEVER), (TWO, "http://h.x/right", NEVER)], LINK),
        spark.createDataFrame([("e", ONE, TWO, T0), ("f", ONE, ONE, T0)], EDGE),
        spark.createDataFrame([(ONE, "http://h.x/a", "old", "old", T0, 0.5)], DOCUMENT),
    )
    page = spark.createDataFrame([(1, "http://h.x/a", '<title>t</title><a href="/right">r</a><a href="/new">n</a>')], "page_id long, url string, html string")
    after = apply_crawl(store, extract_pages(page).drop("page_id"), T0 + DAY)
    links, edges, docs = view(after)
    assert {r.url: r.id for r in after.links.collect()}["http://h.x/a"] == ONE
    assert edges == {("http://h.x/a", "http://h.x/right"): T0 + DAY, ("http://h.x/a", "http://h.x/new"): T0 + DAY}
    assert {r.id for r in after.edges.collect()} >= {"e"}
    assert docs == {"http://h.x/a": ("t", T0 + DAY, 0.5)} and after.docs.first().link_id == ONE
    done = rank_pass(after.links, after.edges, after.docs, T0 + 2 * DAY)
    assert done.rejects.count() == 0 and done.docs.first().pagerank not in (0.0, 0.5)


def test_half_written_batches_are_invisible_and_compaction_goes_on(spark, tmp_path):
    store, root = str(tmp_path / "store"), str(tmp_path / "deltas")
    assert ingest.compact_store(spark, store, root) == -1
    ingest.write_delta(crawl_delta(crawled(spark, FIRST), T0), root, 0)
    assert ingest.compact_store(spark, store, root) == 0
    half = crawl_delta(crawled(spark, SECOND), T0 + DAY)
    half.cutoffs.write.parquet(f"{root}/cutoffs/batch_id=1")
    assert ingest.committed(spark, root) == [0] and ingest.compact_store(spark, store, root) == 0
    ingest.write_delta(half, root, 1)
    delta, last = ingest.read_deltas(spark, root, after=0)
    assert last == 1 and {r.cutoff for r in delta.cutoffs.collect()} == {T0 + DAY}
    ingest.forget(spark, root, 0)
    assert ingest.compact_store(spark, store, root) == 1 and ingest.compact_store(spark, store, root) == 1
    stored = Snapshot(*[load_version(spark, store, n, s, 2) for n, s in ingest.TABLES.items()])
    assert view(stored) == view(apply_crawl(apply_crawl(empty(spark), crawled(spark, FIRST), T0), crawled(spark, SECOND), T0 + DAY))


def test_submissions_and_rejects(spark, tmp_path):
    folder, root = tmp_path / "inbox", str(tmp_path / "out")
    folder.mkdir()
    (folder / "one.json").write_text('{"url": "HTTP://h/a#x"}\n{"url": "ftp://h"}\n{"url": "http://h:abc/"}\n{"other": 1}\n{"url": "http://h/a"}\n')
    stream = ingest.submission_stream(spark, str(folder))
    ingest.submission_sink(stream, root, str(tmp_path / "cp"), None).start().awaitTermination()
    assert [r.url for r in ingest.read_link_deltas(spark, root).collect()] == ["http://h/a"]
    assert sorted(str(r.url) for r in ingest.read_rejects(spark, root).collect()) == ["None", "ftp://h", "http://h:abc/"]


def test_report(spark):
    assert tuple(pass_report(crawled(spark, FIRST)).first()) == (2, 6)


def test_rank_pass_changes_the_search_order(spark):
    snap = apply_crawl(empty(spark), crawled(spark, [("a", "page", ["b"]), ("b", "page", []), ("c", "page", ["b"])]), T0)
    assert {r.pagerank for r in snap.docs.collect()} == {0.0}
    done = rank_pass(snap.links, snap.edges, snap.docs, T0 + DAY)
    assert done.rejects.count() == 0
    ranks = {r.url: r.pagerank for r in done.docs.collect()}
    assert ranks["b"] > ranks["a"] and sum(ranks.values()) == pytest.approx(1)
    found = search(done.docs, build_postings(done.docs), "page").page.collect()
    assert found[0].url == "b"
    # Nothing is older than the first pass itself.
    assert rank_pass(snap.links, snap.edges, snap.docs, NEVER).result.vertices.count() == 0


def write_pages(spark, folder, rows, mode="append"):
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.mode(mode).parquet(folder)


def test_page_stream_equals_batch_and_replay(spark, tmp_path):
    folder, root = str(tmp_path / "pages"), str(tmp_path / "deltas")
    times = iter([T0, T0 + DAY, T0 + 2 * DAY])
    passes = [
        [(1, "http://h/a", '<a href="/b">b</a><a href="/c">c</a>'), (2, "http://h/b", "")],
        [(3, "http://h/a", '<a href="/c">c</a>')],
    ]
    clock = lambda: next(times)
    for rows in passes:
        write_pages(spark, folder, rows)
        stream = ingest.page_stream(spark, folder)
        ingest.crawl_sink(stream, root, str(tmp_path / "cp"), clock, None).start().awaitTermination()
    links, edges, docs = view(ingest.compact(empty(spark), root))
    assert links == {"http://h/a": T0 + DAY, "http://h/b": T0, "http://h/c": NEVER}
    assert edges == {("http://h/a", "http://h/c"): T0 + DAY}
    assert set(docs) == {"http://h/a", "http://h/b"}
    # A batch written again replaces itself.
    delta = crawl_delta(crawled(spark, []), T0)
    ingest.write_delta(delta, root, 1)
    assert set(view(ingest.compact(empty(spark), root))[1]) == {("http://h/a", "http://h/b"), ("http://h/a", "http://h/c")}


def test_late_times_never_move_a_link_back(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "url string, retrieved_at timestamp_ntz"
    for rows in ([("u", T0)], [("u", T0 - DAY), ("v", T0)], [("u", T0 + DAY)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        sink = ingest.link_sink(ingest.latest_links(stream), root, str(tmp_path / "cp"), None)
        sink.start().awaitTermination()
    links = upsert_links(spark.createDataFrame([], LINK), ingest.read_link_deltas(spark, root))
    assert {r.url: r.retrieved_at for r in links.collect()} == {"u": T0 + DAY, "v": T0}


def test_link_times_are_kept_on_disk(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    schema, before = "url string, retrieved_at timestamp_ntz", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for rows in ([("u", T0), ("w", T0)], [("u", T0 - DAY), ("v", T0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        query = ingest.start_links(ingest.latest_links(stream), root, str(tmp_path / "cp"), None)
        query.awaitTermination()
        metrics = query.recentProgress[0].stateOperators[0].customMetrics
        assert any(name.startswith("rocksdb") for name in metrics)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    changelogs = [f for _, _, names in os.walk(tmp_path / "cp" / "state") for f in names if f.endswith(".changelog")]
    assert changelogs
    links = upsert_links(spark.createDataFrame([], LINK), ingest.read_link_deltas(spark, root))
    assert {r.url: r.retrieved_at for r in links.collect()} == {"u": T0, "v": T0, "w": T0}


class Stub:
    """A session that only answers what ``shared_dir`` asks."""

    def __init__(self, master, named=None):
        self.master, self.named = master, named
        self.sparkContext = self.conf = self

    def get(self, key, default=None):
        return self.named if key == "spark.checkpoint.dir" else default

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, path):
        self.used = path


def test_shared_folder_is_the_one_the_cluster_names():
    stub = Stub("yarn", "hdfs://folder/")
    assert session.shared_dir(stub) == "hdfs://folder" and stub.used == "hdfs://folder/"
    with pytest.raises(ValueError):
        session.shared_dir(Stub("yarn"))
