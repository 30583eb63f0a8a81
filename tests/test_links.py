import bisect
import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from webloom.functions.urls import is_web_url, normalise_url, parse_uuid, resolve_url, uuid_of
from webloom.operators import partitioning, scans, upserts
from webloom.operators.skew import hot_keys, lookup_join
from webloom.session import planning, shared_dir
from webloom.schemas import EDGE, LINK, MAX_ID, NEVER, NIL_ID
from webloom.sources.pages import extract_pages, rejected_submissions, submitted_links

T0 = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)


def links(spark, rows=()):
    return spark.createDataFrame(list(rows), LINK)


def edges(spark, rows=()):
    return spark.createDataFrame(list(rows), EDGE)


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "url string, retrieved_at timestamp_ntz")


def test_upsert_link_keeps_id_and_later_time(spark):
    first = upserts.upsert_links(links(spark), batch(spark, ("u", T0 - 10 * HOUR)))
    one = first.first()
    assert one.id != NIL_ID and one.retrieved_at == T0 - 10 * HOUR
    newer = upserts.upsert_links(first, batch(spark, ("u", T0))).first()
    assert (newer.id, newer.retrieved_at) == (one.id, T0)
    known = links(spark, [("x" * 36, "u", T0)])
    older = upserts.upsert_links(known, batch(spark, ("u", T0 - HOUR), ("foo", None), (None, T0)))
    rows = {r.url: (r.id, r.retrieved_at) for r in older.collect()}
    assert rows["u"] == ("x" * 36, T0) and rows["foo"][1] is None and len(rows) == 2
    filled = upserts.upsert_links(links(spark, [("i", "u", None)]), batch(spark, ("u", T0))).first()
    assert filled.retrieved_at == T0


def test_upsert_links_any_order_and_twice(spark):
    rows = [("a", T0), ("b", T0 + HOUR), ("a", T0 + 2 * HOUR), ("b", T0)]
    whole = upserts.upsert_links(links(spark), batch(spark, *rows))
    step = links(spark)
    for row in reversed(rows):
        step = upserts.upsert_links(step, batch(spark, row))
    again = upserts.upsert_links(whole, batch(spark, *rows))
    assert sorted(whole.collect()) == sorted(step.collect()) == sorted(again.collect())


def test_upsert_edges_moves_time_and_rejects_unknown_ends(spark):
    known = links(spark, [(str(i), f"u{i}", NEVER) for i in range(3)])
    wanted = spark.createDataFrame([("0", "1"), ("0", "1"), ("0", "9"), ("9", "1")], "src string, dst string")
    out, rejects = upserts.upsert_edges(edges(spark), wanted, known, T0)
    (one,) = out.collect()
    assert (one.src, one.dst, one.update_at) == ("0", "1", T0)
    assert sorted((r.src, r.dst) for r in rejects.collect()) == [("0", "9"), ("9", "1")]
    later, _ = upserts.upsert_edges(out, wanted.limit(1), known, T0 + HOUR)
    (moved,) = later.collect()
    assert moved.id == one.id and moved.update_at == T0 + HOUR
    untouched, _ = upserts.upsert_edges(out, wanted.where("src = '9'"), known, T0 + HOUR)
    assert untouched.collect() == [one]


def test_delete_stale_edges_is_strict_and_per_source(spark):
    rows = [("1", "a", "x", T0), ("2", "a", "y", T0 + HOUR), ("3", "b", "x", T0), ("4", "a", "z", None)]
    cut = spark.createDataFrame([("a", T0 + HOUR), ("a", T0)], "src string, cutoff timestamp_ntz")
    left = upserts.delete_stale_edges(edges(spark, rows), cut)
    assert sorted(r.id for r in left.collect()) == ["2", "3", "4"]


def test_cascade(spark):
    rows = [("1", "a", "b", T0), ("2", "b", "c", T0), ("3", "c", "a", T0)]
    left = upserts.cascade_edges(edges(spark, rows), links(spark, [("a", "u", T0), ("b", "v", T0)]))
    assert [r.id for r in left.collect()] == ["1"]


def test_lookup(spark):
    table = links(spark, [("i", "u", T0)])
    assert scans.get_one(scans.lookup_link(table, "i")).url == "u"
    with pytest.raises(LookupError):
        scans.get_one(scans.lookup_link(table, NIL_ID))


def test_time_filter_is_strict(spark):
    table = links(spark, [(f"a{i}", f"u{i}", T0 + i * HOUR) for i in range(3)] + [("a9", "n", None)])
    for i in range(4):
        found = scans.scan_links(table, T0 + i * HOUR).collect()
        assert sorted(r.id for r in found) == [f"a{k}" for k in range(i)]
    aware = (T0 + HOUR).replace(tzinfo=timezone.utc).astimezone(timezone(timedelta(hours=5)))
    assert [r.id for r in scans.scan_links(table, aware).collect()] == ["a0"]


def test_full_scan_excludes_the_last_id_and_nothing_else(spark):
    rows = [(NIL_ID, "a", T0), (MAX_ID, "b", T0)] + [
        (partitioning.range_bounds(NIL_ID, MAX_ID, 100)[i][0], f"u{i}", T0) for i in range(1, 100)
    ]
    table = links(spark, rows)
    assert scans.scan_links(table, T0 + HOUR).count() == 100
    pieces = [scans.scan_links(table, T0 + HOUR, lo, hi) for lo, hi in partitioning.range_bounds(NIL_ID, MAX_ID, 10)]
    seen = [r.id for piece in pieces for r in piece.collect()]
    assert len(seen) == len(set(seen)) == 100


def test_frontier(spark):
    table = links(spark, [("1", "new", T0), ("2", "old", T0 - timedelta(days=8)), ("3", "never", NEVER)])
    assert sorted(r.url for r in scans.crawl_frontier(table, T0).collect()) == ["never", "old"]


def test_scans_reach_the_reader(spark, tmp_path):
    path = str(tmp_path / "links")
    links(spark, [("1", "u", T0)]).write.parquet(path)
    scan = scans.scan_links(spark.read.schema(LINK).parquet(path), T0, "0", "2").select("id")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,0)" in plan and "LessThan(retri" in plan and "url" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize(
    "parts, cuts",
    [
        (1, []),
        (2, ["80000000-0000-0000-0000-000000000000"]),
        (3, ["55555555-5555-5555-5555-555555555555", "aaaaaaaa-aaaa-aaaa-aaaa-aaaaaaaaaaaa"]),
        (4, [f"{x}0000000-0000-0000-0000-000000000000" for x in "48c"]),
    ],
)
def test_range_bounds(parts, cuts):
    bounds = partitioning.range_bounds(NIL_ID, MAX_ID, parts)
    assert [hi for _, hi in bounds] == [*cuts, MAX_ID]
    assert [lo for lo, _ in bounds] == [NIL_ID, *cuts]


def test_range_bounds_beyond_256_and_from_a_start():
    bounds = partitioning.range_bounds(NIL_ID, MAX_ID, 257)
    assert [bounds[i][1][:8] for i in range(3)] == ["00ff00ff", "01fe01fe", "02fd02fd"]
    start = "40000000-0000-0000-0000-000000000000"
    low, high = partitioning.range_bounds(start, "80000000-0000-0000-0000-000000000000", 2)
    assert low[0] == start and low[1] == high[0] == "60000000-0000-0000-0000-000000000000"
    for bad in ((MAX_ID, NIL_ID, 2), (NIL_ID, NIL_ID, 2), (NIL_ID, MAX_ID, 0)):
        with pytest.raises(ValueError):
            partitioning.range_bounds(*bad)
    with pytest.raises(IndexError):
        partitioning.extents(bounds, 257)
    assert partitioning.extents(bounds, 0)[0] == NIL_ID


@pytest.mark.parametrize(("start", "end", "parts"), [(0, 2**128 - 1, 3), (0, 2**128 - 1, 4099), (2**100 + 7, 2**127 + 3, 17), (10, 5000, 9), (2**90, 2**90 + 2**84, 7)])
def test_parts_of_ids_beside_the_bounds(spark, start, end, parts):
    first, last = (str(uuid.UUID(int=x)) for x in (start, end))
    bounds = partitioning.range_bounds(first, last, parts)
    cuts = [uuid.UUID(lo).int for lo, _ in bounds[:: max(1, parts // 60)]] + [start, end - 1]
    numbers = sorted({min(max(c + d, 0), 2**128 - 1) for c in cuts for d in (-1, 0, 1, 2**70)})
    ids = spark.createDataFrame([(str(uuid.UUID(int=n)),) for n in numbers], "id string")
    lows = [lo for lo, _ in bounds]
    for row in partitioning.assign_partition(ids, "id", parts, first, last).collect():
        want = bisect.bisect_right(lows, row.id) - 1 if first <= row.id < last else None
        assert row.part == want, row


def test_assign_partition_matches_the_range_table(spark):
    ids = spark.range(500).select(uuid_of(F.col("id").cast("string")).alias("id")).union(
        spark.createDataFrame([(NIL_ID,), (MAX_ID,)], "id string")
    )
    table = partitioning.id_ranges(spark, 13)
    by_join = ids.join(table, (F.col("id") >= F.col("lo")) & (F.col("id") < F.col("hi")), "left").select("id", "part")
    assert sorted(partitioning.assign_partition(ids, "id", 13).collect(), key=str) == sorted(by_join.collect(), key=str)


def test_url_rules(spark):
    rows = [
        ("HTTP://a.b/x#frag", True, "http://a.b/x"),
        ("https://a.b/#", True, "https://a.b/"),
        ("https://a.b/?q=%zz", True, "https://a.b/?q=%zz"),
        ("ftp://a.b/", False, None),
        ("/relative", False, None),
        ("http://a.b/%zz", False, None),
        ("http://a b/", False, None),
        ("http://a.b/\x01", False, None),
        (None, False, None),
    ]
    df = spark.createDataFrame(rows, "url string, ok boolean, want string")
    got = df.select("url", "ok", "want", is_web_url(F.col("url")).alias("got"), normalise_url(F.col("url")).alias("norm"))
    for r in got.collect():
        assert r.got == r.ok, r.url
        if r.ok:
            assert r.norm == r.want
    plain = df.select("url")
    assert submitted_links(plain).count() + rejected_submissions(plain).count() == len(rows)
    assert submitted_links(plain).first().retrieved_at == NEVER


def test_resolve_url(spark):
    base = "https://a.b/dir/page?x=1#top"
    rows = {
        "/r": "https://a.b/r",
        "r": "https://a.b/dir/r",
        "//c.d/e": "https://c.d/e",
        "HTTP://z/#q": "http://z/",
        "?y=2": "https://a.b/dir/page?y=2",
        "#f": "https://a.b/dir/page?x=1",
        "": "https://a.b/dir/page?x=1",
    }
    df = spark.createDataFrame(list(rows.items()), "href string, want string")
    assert df.where(resolve_url(F.col("href"), F.lit(base)) != F.col("want")).count() == 0


def test_parse_uuid(spark):
    df = spark.createDataFrame([(NIL_ID.upper(),), (MAX_ID.upper(),), ("x",)], "t string")
    assert [r[0] for r in df.select(parse_uuid(F.col("t"))).collect()] == [NIL_ID, MAX_ID, None]


def test_extract_pages(spark):
    html = """<html><head><TITLE> A &amp;
      B </TITLE><script>var t="<p>no</p>";</script></head><body><!-- <a href="/no">no</a> -->
      <a class="x" href="/one#f">One</a> <A HREF='two'>Two</A><a href=/one>again</a>
      <a href="mailto:x@y">mail</a> &lt;b&gt; &amp;lt;</body>"""
    row = extract_pages(spark.createDataFrame([("HTTP://h.x/d/p#z", html)], "url string, html string")).first()
    assert row.url == "http://h.x/d/p" and row.title == "A & B"
    assert row.found_urls == ["http://h.x/one", "http://h.x/d/two"]
    assert "var" not in row.content and "One" in row.content and row.content.endswith("<b> &lt;")


def test_a_hub_is_split_and_nothing_is_lost(spark):
    """Two thirds of the rows share a key; no task gets much more than its share."""
    rows = spark.range(60000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hub")).otherwise(F.concat(F.lit("s"), F.col("id"))).alias("src"),
        F.concat(F.lit("d"), F.col("id")).alias("dst"),
    )
    table = rows.where("src <> 's3'").groupBy(F.col("src").alias("_key")).agg(F.max("dst").alias("best"))
    with planning(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        for how, want in (("left_semi", 59999), ("left_anti", 1), ("inner", 59999), ("left", 60000)):
            joined = lookup_join(rows, table, "src", how, rows_per_task=1000)
            assert joined.count() == want, how
            plain = rows.join(table, rows["src"] == table["_key"], how).drop("_key")
            assert joined.exceptAll(plain).count() == 0, how
        sizes = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 60000 / 3
    limited = lookup_join(rows, table, "src", "left_semi", F.col("dst") == F.col("best"), 1000)
    assert limited.count() == table.count()


def test_hubs_are_found_before_the_lookups(spark):
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hub")).when(F.col("id") > 30, F.concat(F.lit("s"), F.col("id"))).alias("src"),
        F.concat(F.lit("d"), F.col("id")).alias("dst"),
    )
    shared_dir(spark)
    known, total = hot_keys(rows, ["src", "dst"], 1000)
    assert total == 6000 and known["dst"] is None
    assert [tuple(r) for r in known["src"].collect()] == [("hub", 4)]
    for key in ("src", "dst"):
        table = rows.where("src <> 's33' and dst <> 'd33'").select(F.col(key).alias("_key")).distinct().withColumn("n", F.lit(1))
        for how in ("left_semi", "left_anti", "inner", "left"):
            found = lookup_join(rows, table, key, how, rows_per_task=1000, known=known)
            plain = rows.join(table, rows[key] == table["_key"], how).drop("_key")
            assert found.exceptAll(plain).count() == 0 == plain.exceptAll(found).count(), (key, how)
    # Without a hub no key is counted.
    plan = lookup_join(rows, rows.select(F.col("dst").alias("_key")), "dst", "inner", known=known)._jdf.queryExecution()
    assert "Aggregate" not in plan.executedPlan().toString()


@pytest.mark.parametrize(
    "url,ok",
    [
        ("http://h/", True),
        ("https://user:pw@h:8080/a", True),
        ("http://h:/a", True),
        ("http://[::1]:80/a", True),
        ("http:opaque", True),
        ("http://h:abc/", False),
        ("http://[::1/", False),
        ("http://::1]/", False),
        ("http://h h/", False),
        ("mailto:a@h", False),
    ],
)
def test_ports_and_brackets_of_urls(spark, url, ok):
    assert spark.sql("select 1").select(is_web_url(F.lit(url))).first()[0] is ok


@pytest.mark.parametrize(
    "href,url",
    [
        ("../up", "http://h.x/up"),
        ("./same", "http://h.x/d/same"),
        ("../../../far", "http://h.x/far"),
        ("a/./b/../c", "http://h.x/d/a/c"),
        ("..", "http://h.x/"),
        ("x/.", "http://h.x/d/x/"),
        (".hidden/..twice", "http://h.x/d/.hidden/..twice"),
        ("q?x=/../y", "http://h.x/d/q?x=/../y"),
        ("/a//b", "http://h.x/a//b"),
    ],
)
def test_dot_segments(spark, href, url):
    assert spark.sql("select 1").select(resolve_url(F.lit(href), F.lit("http://h.x/d/page"))).first()[0] == url


def test_hrefs_and_entities_of_pages(spark):
    html = (
        '<a data-href="/wrong" href="/right">x</a><!-- <a href="/c">c</a> --><script>"<a href=\'/s\'>"</script>'
        "<a title='href=\"/t\"' href=/plain>y</a><A\nclass=x HREF = '/up?a=1&amp;b=2'>z</A><abbr href='/no'></abbr>"
        "<p>it&#8217;s caf&eacute; &#x1F600; &amp;lt; &unknown; &#0; &hearts;</p>"
    )
    page = spark.createDataFrame([("http://h.x/", html)], "url string, html string")
    row = extract_pages(page).first()
    assert row.found_urls == [f"http://h.x/{p}" for p in ("right", "plain", "up?a=1&b=2")]
    assert row.content == "x y z it\u2019s caf\u00e9 \U0001f600 &lt; &unknown; &#0; \u2665"
