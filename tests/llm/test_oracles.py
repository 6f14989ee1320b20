import pytest

from gleaner.llm import queries
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    n, m, extra, missing = differences(spark, con, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)
    assert n == m and not extra and not missing, (n, m, extra, missing)


def test_no_operator_is_imported_from_outside():
    import pathlib
    import re

    root = pathlib.Path(queries.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"gleaner\.llm|from \.+llm|import llm", f.read_text()), f
