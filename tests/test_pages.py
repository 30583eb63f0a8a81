"""Title, text and links of pages that patterns over the whole page get wrong."""

import pytest
from pyspark.sql import functions as F

from webloom.functions.html import decode_entities, page_fields
from webloom.sources.pages import extract_pages

PAGES = [
    ("<title>T</title><p>a <b>b</b></p>", "T", "T a b", []),
    ("<!-- <title>Old</title> --><title>New</title>", "New", "New", []),
    ("<script>var t='<title>No</title>'</script><TITLE lang=en>Yes\n now</TITLE >x", "Yes now", "Yes now x", []),
    ("<title>first</title><title>second</title>", "first", "first second", []),
    ("<title>a <b>bold</b> &amp; b</title>", "a <b>bold</b> & b", "a <b>bold</b> & b", []),
    ('<p>x <img alt="x > y"> z</p>', "", "x z", []),
    ("<p title='it\"s > x'>in</p>", "", "in", []),
    ("<p data-x=a>b</p>", "", "b", []),
    ("<p don't care>text</p>it's <b>fine</b>", "", "text it's fine", []),
    ("1 < 2 and 3 > 2 <b>x</b>", "", "1 < 2 and 3 > 2 x", []),
    ("a<3 b", "", "a<3 b", []),
    ("<!DOCTYPE html><?xml v?>x<![CDATA[ y ]]>z", "", "x z", []),
    ("a<!-->b<!--->c<!-- d --!>e", "", "a b c e", []),
    ("a <!-- open <b>x</b>", "", "a", []),
    ("a <script>open <b>x</b>", "", "a", []),
    ("a <style>p{margin:0}</style>b<script src=x>if (a</b) f('</p>')</script>c", "", "a b c", []),
    ("<scripty>seen</scripty><styles>too</styles>", "", "seen too", []),
    ("x <a href='/open", "", "x", []),
    ("</p>a</>b</ c>d", "", "a b d", []),
    ("<textarea><a href='/no'>raw</a></textarea>", "", "<a href='/no'>raw</a>", []),
    ('<a href="/a">A</a><A\nHREF = /b>B</A><a class=x href=\'/c?x=1&amp;y=2\' id=y>C</a>', "", "A B C", ["/a", "/b", "/c?x=1&y=2"]),
    ('<a title="<a href=/no>" href="/yes">x</a>', "", "x", ["/yes"]),
    ('<a data-href="/no">x</a><abbr href="/no">y</abbr><a>z</a>', "", "x y z", []),
    ('<!-- <a href="/no">x</a> --><script>"<a href=/no>"</script><a/href=/yes>x</a>', "", "x", ["/yes"]),
    ('<a href="/a>b">x</a>', "", "x", ["/a>b"]),
    ('<a href="">x</a><a href=\' /s \'>y</a>', "", "x y", ["", " /s "]),
    ("&lt;b&gt; &copy; &hellip; &Aacute; &#65;&#x42; &nosuch; &amp;lt;", "", "<b> © … Á AB &nosuch; &lt;", []),
    ("", "", "", []),
    ("<" * 50, "", "<" * 50, []),
    (None, None, None, None),
]


def test_fields_of_pages(spark):
    table = spark.createDataFrame([(k, p[0]) for k, p in enumerate(PAGES)], "k int, html string")
    found = {r.k: r.f for r in table.select("k", page_fields(F.col("html")).alias("f")).collect()}
    for k, (html, title, content, hrefs) in enumerate(PAGES):
        got = found[k]
        assert (got and (got.title, got.content, got.hrefs)) == (None if html is None else (title, content, hrefs)), html


@pytest.mark.parametrize("page", ["<p " + "a='b' " * 3000 + ">end", "<!--" + "x" * 300_000 + "-->end", "<script>" + "<b" * 100_000 + "</script>end", "<p>" * 20_000 + "end"])
def test_long_tags_comments_and_scripts(spark, page):
    row = spark.createDataFrame([(page,)], "html string").select(page_fields(F.col("html")).alias("f")).first()
    assert row.f.content == "end"


def test_rare_and_frequent_references_decode_alike(spark):
    rows = spark.createDataFrame([("&amp;&Amp;&AMP;&nbsp;&rarr;&CounterClockwiseContourIntegral;&apos;",)], "t string")
    assert rows.select(decode_entities(F.col("t"))).first()[0] == "&&Amp;& →∳'"


def test_extracted_pages_keep_other_columns(spark):
    pages = spark.createDataFrame([(1, "HTTP://h.x/a#f", "<title>t</title><a href=b>x</a><a href='#y'>y</a>")], "page_id long, url string, html string")
    (row,) = extract_pages(pages).collect()
    assert (row.page_id, row.url, row.title, row.content, row.found_urls) == (1, "http://h.x/a", "t", "t x y", ["http://h.x/b", "http://h.x/a"])
