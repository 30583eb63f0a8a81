import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webloom.functions.urls import uuid_of
from webloom.operators import results, scans, search, upserts
from webloom.operators.postings import build_postings, update_postings, write_postings
from webloom.schemas import DOCUMENT, NIL_ID
from webloom.sources import tables

T0 = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENT)


@pytest.fixture(scope="module")
def five(spark):
    rows = [
        (f"id{i}", f"www.example_{i}.com", f"example_{i}", f"content example_{i}", T0, float(i)) for i in range(5)
    ]
    table = docs(spark, rows).persist()
    return table, build_postings(table).persist()


def ids(result):
    return [r.link_id for r in result.page.collect()]


def test_match_phrase_and_all(five):
    table, postings = five
    by_rank = [f"id{i}" for i in (4, 3, 2, 1, 0)]
    for text, phrase in (("example", False), ("example", True)):
        found = search.search(table, postings, text, phrase)
        assert found.total.first().total == 5 and ids(found) == by_rank
    everything = search.search(table, postings, "")
    assert everything.total.first().total == 5 and ids(everything) == by_rank[::-1]


def test_find_and_update_rank(spark, five):
    table, _ = five
    assert scans.get_one(scans.lookup_document(table, "id3")).pagerank == 3
    with pytest.raises(LookupError):
        scans.get_one(scans.lookup_document(table, "none"))
    scores = spark.createDataFrame([("id0", 0.8), ("none", 0.5)], "link_id string, score double")
    after = {r.link_id: r.pagerank for r in upserts.update_rank(table, scores).collect()}
    assert after == {"id0": 0.8, "id1": 1, "id2": 2, "id3": 3, "id4": 4}


def test_upsert_keeps_the_rank_and_takes_nulls(spark):
    old = docs(spark, [("a", "u", "t", "c", T0, 0.7), ("b", "u2", "t2", "c2", T0, None)])
    new = docs(
        spark,
        [
            ("a", "v", None, None, T0, 0.0),
            ("a", "older", "x", "x", T0 - HOUR, 0.0),
            ("n", "w", "t", "c", T0 - HOUR, 0.3),
            (NIL_ID, "nil", "t", "c", T0, 0.0),
        ],
    )
    out, rejects = upserts.upsert_documents(old, new, T0 + HOUR)
    rows = {r.link_id: tuple(r)[1:] for r in out.collect()}
    assert rows == {
        "a": ("v", None, None, T0 + HOUR, 0.7),
        "b": ("u2", "t2", "c2", T0, None),
        "n": ("w", "t", "c", T0 - HOUR, 0.3),
    }
    assert [r.url for r in rejects.collect()] == ["nil"]
    again, _ = upserts.upsert_documents(out, new.where("link_id = 'a'"), T0 + HOUR)
    assert {r.link_id: tuple(r)[1:] for r in again.collect()} == rows


def test_persist_scores_rejects_bad_ids(spark):
    known = spark.sql("select 1").select(uuid_of(F.lit("x"))).first()[0]
    table = docs(spark, [(known, "u", "t", "c", T0, 0.0)])
    ranks = spark.createDataFrame([(known.upper(), 0.4), ("no id", 0.6)], "id string, score double")
    out, rejects = upserts.persist_scores(table, ranks)
    assert out.first().pagerank == 0.4 and rejects.first().id == "no id"


CORPUS = [
    ("d1", "Quick foxes", "The quick brown fox jumps over the lazy dog."),
    ("d2", None, "A dog and a fox; the fox was quick and quick."),
    ("d3", "", "Brown dogs jumping."),
    ("d4", "Cats of the dogs", "Nothing about the other animal."),
    ("d5", "Empty", None),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"u/{i}", t, c, T0, None if i == "d3" else 0.5) for i, t, c in CORPUS]
    table = docs(spark, rows).persist()
    return table, build_postings(table).persist()


def test_postings(corpus):
    _, postings = corpus
    rows = {(r.link_id, r.term): (r.tf, r.positions) for r in postings.collect()}
    assert rows["d1", "fox"] == (2, [1, 5])  # foxes and fox
    assert rows["d1", "quick"] == (2, [0, 3])
    assert rows["d1", "jump"] == (1, [6]) and ("d1", "the") not in rows
    assert rows["d4", "dog"] == (1, [3])
    assert rows["d5", "empti"] == (1, [0])


@pytest.mark.parametrize(
    "text, want",
    [
        ("fox", {"d1", "d2"}),
        ("Foxes DOG", {"d1", "d2"}),
        ("fox -lazy", {"d2"}),
        ("cat or jumped", {"d1", "d3", "d4"}),
        ("cat or brown fox", {"d1", "d4"}),
        ('"brown fox"', {"d1"}),
        ('"quick fox"', {"d1"}),
        ('-"brown fox" dog', {"d2", "d3", "d4"}),
        ('"cats of the dog"', {"d4"}),
        ('"cats dog"', set()),
        ("brown-fox", {"d1"}),
        ("-dog", {"d5"}),
        ("empty or -dog", {"d5"}),
        ("the", set()),
        ("   ", set()),
        ("the fox", {"d1", "d2"}),
        ('"brown fox', {"d1"}),
        ("unseen", set()),
    ],
)
def test_web_search(corpus, text, want):
    table, postings = corpus
    found = search.search(table, postings, text)
    assert set(ids(found)) == want and found.total.first().total == len(want)


def test_order_by_relevance_rank_and_id(corpus):
    table, postings = corpus
    # d3 and d4 hold the term once, d3 has no rank and comes first.
    assert ids(search.search(table, postings, "dog")) == ["d3", "d1", "d2", "d4"]
    quick = search.search(table, postings, "quick dog", relevance_order="desc", ranking="log_tf")
    assert ids(quick) == ["d1", "d2"]
    page = search.search(table, postings, "dog", offset=2, limit=1).page.collect()
    assert [(r.link_id, r.rank_pos) for r in page] == [("d2", 3)]
    with pytest.raises(ValueError):
        search.search(table, postings, "dog", relevance_order="up")


def test_stored_postings_give_the_same_and_prune(spark, corpus, tmp_path):
    table, postings = corpus
    stored = write_postings(postings, str(tmp_path / "postings"), 3)
    assert sorted(stored.collect()) == sorted(postings.collect())
    hits = search.matches(table, stored, search.read_query(table, "fox -lazy"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [fox,lazi])" in plan and "positions" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_a_page_is_fetched_by_pushed_ids(spark, corpus, tmp_path):
    table, postings = corpus
    path = str(tmp_path / "docs")
    table.write.parquet(path)
    stored = spark.read.schema(DOCUMENT).parquet(path)
    page = search.search(stored, postings, "cat or lazy").page
    assert [r.link_id for r in page.collect()] == ["d1", "d4"]
    assert "In(link_id, [d1,d4])" in page._jdf.queryExecution().executedPlan().toString()
    for bad in ({"limit": 0}, {"offset": -1}):
        with pytest.raises(ValueError):
            search.match_all(table, **bad)


def test_a_page_without_a_limit_holds_all_matches(spark, corpus, monkeypatch):
    table, postings = corpus
    want = [(r.link_id, r.rank_pos) for r in search.search(table, postings, "dog").page.collect()]
    every = search.search(table, postings, "dog", limit=None).page
    assert "Window" not in every._jdf.queryExecution().executedPlan().toString()
    assert [(r.link_id, r.rank_pos) for r in every.collect()] == want
    assert search.search(table, postings, "nowhere", limit=None).page.count() == 0
    monkeypatch.setattr(search, "HEAP_ROWS", 1)
    monkeypatch.setattr(search, "LITERAL_ROWS", 1)
    for offset in range(5):
        for limit in (2, None):
            page = search.search(table, postings, "dog", offset=offset, limit=limit).page
            assert [(r.link_id, r.rank_pos) for r in page.collect()] == want[offset:][:limit]


def test_large_pages_deep_offsets_and_seeks(spark, corpus, monkeypatch):
    table, postings = corpus
    want = [(r.link_id, r.rank_pos) for r in search.search(table, postings, "dog").page.collect()]
    assert len(want) == 4
    large = search.search(table, postings, "dog", limit=10**6).page
    assert [(r.link_id, r.rank_pos) for r in large.collect()] == want
    monkeypatch.setattr(search, "HEAP_ROWS", 2)
    for offset in range(5):
        deep = search.search(table, postings, "dog", offset=offset, limit=2).page
        assert [(r.link_id, r.rank_pos) for r in deep.collect()] == want[offset : offset + 2]
        assert [r.link_id for r in search.match_all(table, offset, 2).collect()] == [f"d{k}" for k in range(1, 6)][offset : offset + 2]
    monkeypatch.setattr(search, "HEAP_ROWS", 10_000)
    for order in ("asc", "desc"):
        rows = search.search(table, postings, "quick or dog", relevance_order=order).page.collect()
        for k, last in enumerate(rows):
            key = (last.relevance, last.pagerank, last.link_id)
            rest = search.search(table, postings, "quick or dog", offset=k + 1, relevance_order=order, after=key).page
            assert [(r.link_id, r.rank_pos) for r in rest.collect()] == [(r.link_id, r.rank_pos) for r in rows[k + 1 :]]
    assert [r.link_id for r in search.match_all(table, 3, 2, after="d3").collect()] == ["d4", "d5"]
    plan = search.rows_of_page(table.where("link_id > 'd3'").select("link_id"), [F.col("link_id").asc()], 0, 10)
    assert "limit=10," in plan._jdf.queryExecution().executedPlan().toString()


def test_total_runs_no_job_for_the_page(corpus, monkeypatch):
    table, postings = corpus
    monkeypatch.setattr(search, "fetch_page", None)
    assert search.search(table, postings, "dog").total.first().total == 4
    assert results.search_results(table, postings, "dog").details.first().total == 4


def test_ranks_kept_apart(spark, corpus, tmp_path):
    table, postings = corpus
    ranks = spark.createDataFrame([(f"d{k}", k / 10) for k in range(1, 6)], "link_id string, pagerank double")
    stored = tables.save_bucketed(ranks, "bucketed_ranks", str(tmp_path / "r"), "link_id", 8)
    try:
        page = search.search(table, postings, "dog", ranks=stored).page.collect()
        assert [(r.link_id, r.pagerank) for r in page] == [("d4", 0.4), ("d3", 0.3), ("d2", 0.2), ("d1", 0.1)]
        scores = spark.createDataFrame([("d1", 0.8)], "link_id string, score double")
        updated = upserts.update_ranks(stored, scores)
        plan = updated._jdf.queryExecution().executedPlan().toString()
        assert "content" not in plan
        assert {r.link_id: r.pagerank for r in upserts.with_ranks(table, updated).collect()}["d1"] == 0.8
        assert upserts.persist_ranks(stored, spark.createDataFrame([("bad", 0.1)], "id string, score double"))[1].count() == 1
    finally:
        spark.sql("drop table bucketed_ranks")


def test_updated_postings_equal_a_rebuild(spark, corpus):
    table, postings = corpus
    changed = table.where("link_id in ('d1', 'd4')").withColumn("content", F.lit("new words about foxes"))
    added = table.where("link_id = 'd2'").withColumn("link_id", F.lit("d9"))
    gone = table.where("link_id = 'd5'").select("link_id")
    now = table.where("link_id in ('d2', 'd3')").unionByName(changed).unionByName(added)
    updated = update_postings(postings, changed.unionByName(added), gone)
    assert sorted(updated.collect()) == sorted(build_postings(now).collect())
    assert sorted(update_postings(postings, table.limit(0)).collect()) == sorted(postings.collect())


def test_results_page(corpus):
    table, postings = corpus
    page = results.search_results(table, postings, "dog", results_per_page=2)
    hits = page.hits.orderBy("rank_pos").collect()
    assert [(h.link_id, h.title) for h in hits] == [("d3", "u/d3"), ("d1", "Quick foxes")]
    assert hits[0].summary_html == "" and hits[1].summary_html == ""
    details = page.details.first()
    assert tuple(details) == (1, 2, 4, "", "/search?q=dog&offset=2")
    second = results.search_results(table, postings, "dog", offset=2, results_per_page=2).details.first()
    assert tuple(second) == (3, 4, 4, "/search?q=dog", "")
    third = results.search_results(table, postings, "dog", offset=3, results_per_page=2).details.first()
    assert third.prev_link == "/search?q=dog&offset=1"
    phrase = results.search_results(table, postings, '"brown fox"')
    assert phrase.hits.first().summary_html == (
        "The quick <em>brown</em> <em>fox</em> jumps over the lazy dog."
    )
    assert phrase.details.first().total == 1


def test_index_json(spark, tmp_path, corpus):
    table, _ = corpus
    path = str(tmp_path / "json")
    tables.export_index_json(table, path, offset=1, limit=2)
    rows = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert sorted(rows, key=str) == [
        {"ID": "d2", "URL": "u/d2", "PageScore": 0.5},
        {"ID": "d3", "URL": "u/d3", "PageScore": None},
    ]


def test_versions(spark, tmp_path):
    root = str(tmp_path)
    assert tables.load_version(spark, root, "docs", DOCUMENT).count() == 0
    for version, rows in ((1, [("a", "u", "t", "c", T0, 0.0)]), (2, [])):
        tables.save_version(docs(spark, rows), root, "docs", version, cluster_by="link_id")
    assert tables.versions(spark, root, "docs") == [1, 2]
    assert tables.load_version(spark, root, "docs", DOCUMENT).count() == 0
    assert tables.load_version(spark, root, "docs", DOCUMENT, 1).count() == 1


def test_bucketed_table_is_not_shuffled(spark, tmp_path):
    rows = [(f"id{i}", f"u{i}", "t", "c", T0, 0.0) for i in range(20)]
    stored = tables.save_bucketed(docs(spark, rows), "bucketed_docs", str(tmp_path / "b"), "link_id", 4)
    scores = spark.createDataFrame([("id1", 0.8)], "link_id string, score double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = upserts.update_rank(stored, scores)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("drop table bucketed_docs")


def test_a_stored_index_is_dealt_by_its_size(spark, corpus, monkeypatch):
    """Tasks sort a bounded size of text, whatever number of partitions the session has."""
    from webloom.operators import postings as P
    from webloom.session import planning

    table, _ = corpus
    monkeypatch.setattr(P, "TEXT_PER_TASK", 40)
    with planning(spark, {"spark.sql.shuffle.partitions": 1}):
        dealt = build_postings(table, dealt=True)
        assert dealt.rdd.getNumPartitions() > 2
    plain = build_postings(table)
    assert dealt.exceptAll(plain).count() == 0 == plain.exceptAll(dealt).count()


def test_plain_postings_take_one_worker_a_task(corpus):
    table, _ = corpus
    plan = build_postings(table, english=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
