import pytest

import __spark_entry__ as entry
from compare import compare, connect
from webloom import queries as catalogue

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) & set(entry.oracle_sql())))
def test_query_equals_its_sql(spark, duck, name):
    assert compare(spark, duck, SF_DIR, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_entry(spark):
    hits = entry.entry(spark)
    assert hits.columns == ["link_id", "url", "title", "summary_html", "rank_pos"]
    assert hits.count() == 10
