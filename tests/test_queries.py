import pytest

import __spark_entry__ as entry
from codeloam.plans import code, commands, history, more, problems, reports, text
from compare import DATA, same

CORE = {k: f for m in (text, code, history, commands, more, reports, problems) for k, f in m.QUERIES.items()}
SQL = {k: s for m in (text, code, history, commands, more, reports, problems) for k, s in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    same(spark, CORE[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_runs(spark, name):
    assert CORE[name](spark, DATA).columns


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(CORE) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
