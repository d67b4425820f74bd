"""Every registered query: its oracle on the smallest tables, and the shape of its plan."""

import pytest
from compare import connect, normal
from conftest import SMALL

from passages.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert normal(got, df.columns) == normal(result.fetchall(), names)
