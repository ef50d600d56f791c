import pytest
from conftest import DATA

from quarrylane.llm.queries import QUERIES
from quarrylane.llm.sql import SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    assert QUERIES[name](spark, DATA).count() > 0
