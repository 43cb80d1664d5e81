import pytest

from tidemill.plans import catalogue, lifecycle, reading, training  # noqa: F401

from .oracle import differing


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, name):
    got = catalogue.QUERIES[name](spark, data).toPandas()
    assert len(got), "no rows"
    if name in catalogue.SQL:
        assert differing(got, data, catalogue.SQL[name]) == ""


def test_entry(spark):
    import __spark_entry__ as e

    got = e.entry(spark).toPandas()
    assert 0 < len(got) <= 10 and set(e.oracle_sql()) <= set(e.queries())
