"""Small tables for the corpus operators."""

from __future__ import annotations

ODD_DOCS = [
    (5, "The quick brown fox jumps over the lazy dog\nshared line of text here\nend"),
    (2, None),
    (3, ""),
    (1, "shared line of text here\nthe quick brown fox"),
    (None, "a row without an id\nshared line of text here"),
    (7, "x" * 50_000 + " " + "word " * 20_000),
    (8, "Ünïcode ÄÖÜ straße 日本語 text İstanbul\tტექსტი \U0001f600\nline two é"),
    (9, "same text twice over and over"),
    (10, "same text twice over and over"),
    (11, "same text twice over and over"),
    (11, "same text twice over and over"),
    (12, " \t\r\n\x0b\x0c "),
]


def documents(spark, rows=None, **extra):
    """Documents with columns that operators might use for themselves."""
    rows = ODD_DOCS if rows is None else rows
    given = [(i, t, None, "key", 1, "ids", -1.0) for i, t in rows]
    return spark.createDataFrame(
        given, "doc_id long, text string, lang string, key string, shard int, ids string, score double"
    )


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
