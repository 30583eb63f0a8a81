"""What the Python workers of the index build are handed."""

import random

import pytest
from pyspark.sql import functions as F

from test_documents import T0, docs
from webloom.operators.postings import build_postings
from webloom.session import planning

LENGTHS = [0, 1, 127, 128, 129, 0, 256, 5000, 3, 0, 700, 0]


def texts():
    draw = random.Random(20)
    return {f"d{k:02}": " ".join(draw.choice(("the", "cats", "cat", "running", "dog", f"w{draw.randint(0, 60)}")) for _ in range(n)) for k, n in enumerate(LENGTHS)}


def table(spark, given):
    return docs(spark, [(k, f"u/{k}", None, text, T0, 0.1) for k, text in given.items()]).coalesce(1)


@pytest.mark.parametrize("english", [True, False])
def test_workers_are_handed_short_rows(spark, monkeypatch, english):
    """A batch is up to 10,000 rows, or 64 MB: rows without a bound fill it in larger tasks."""
    source, handed = table(spark, texts()), []
    kind = type(source)
    given = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, *args: handed.append(df) or given(df, *args))
    build_postings(source, english)
    assert len(handed) == (2 if english else 1)
    for df, column in zip(handed, ("words", "codes")):
        sizes = df.agg(F.max(F.size(column)).alias("most"), F.sum(F.size(column)).alias("all")).first()
        assert sizes["most"] <= 1000 and sizes["all"] == sum(LENGTHS)


@pytest.mark.parametrize("rows", [1, 3, 7, 10_000])
def test_documents_torn_between_batches_stay_whole(spark, rows):
    given = texts()
    want = {}
    for key, text in given.items():
        for place, word in enumerate(text.split()):
            want.setdefault((key, word), []).append(place)
    with planning(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": rows}):
        plain = build_postings(table(spark, given), english=False, partitions=1).collect()
        stems = build_postings(table(spark, given), partitions=2).collect()
    assert sorted(map(tuple, plain)) == sorted((k, w, len(p), p) for (k, w), p in want.items())
    stem = {"cats": "cat", "running": "run"}
    merged = {}
    for (key, word), places in want.items():
        if word != "the":
            merged.setdefault((key, stem.get(word, word)), []).extend(places)
    assert sorted(map(tuple, stems)) == sorted((k, w, len(p), sorted(p)) for (k, w), p in merged.items())
