import pytest

from codeloam.llm.queries import QUERIES, SQL
from compare import DATA, same


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() == df.distinct().count() or not name.endswith("_found")
