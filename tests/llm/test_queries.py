import pytest

from tidemill.llm import queries

from ..oracle import differing


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    from tidemill.session import ship

    ship(spark)
    got = queries.QUERIES[name](spark, data).toPandas()
    if name != "p4_search":
        assert len(got)
    if name in queries.SQL:
        assert differing(got, data, queries.SQL[name]) == ""


def test_the_rest_doesnt_import_this_package():
    from pathlib import Path

    import tidemill

    root = Path(tidemill.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text()
