import pytest

import __spark_entry__ as entry
from compare import compare, connect
from webloom.llm import queries as corpus

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(corpus.queries()) - set(corpus.oracle_sql())))
def test_query_returns_a_row_for_each_input(spark, name):
    df = entry.queries()[name](spark, SF_DIR)
    table = "pages" if name.startswith("op10") else "documents"
    rows = spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
    found = df.toArrow()
    key = "page_id" if table == "pages" else "doc_id"
    assert len(set(found.column(key).to_pylist())) == rows
    assert len(found) == rows or name.startswith("op4")


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, connect(SF_DIR), SF_DIR, entry.queries()[name], entry.oracle_sql()[name]) is None
