"""Every registered query of the subpackage against its oracle, and against the rules of its plan."""

import pytest
from compare import connect, normal
from conftest import SMALL

from passages.llm.queries import ORACLES, QUERIES


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
    assert got
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert normal(got, df.columns) == normal(result.fetchall(), names)


@pytest.mark.parametrize("name", ["op4_decontamination", "op5_secrets", "op8_urls"])
def test_native(name, spark):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
