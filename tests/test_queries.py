"""Every registered query: equal to its SQL twin, and a plan without cross joins or Python."""

import pytest

from compare import difference, duck
from meterline import registry
from oracles import ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(registry.KEYS) == set(ORACLES)


@pytest.mark.parametrize("key", registry.KEYS)
def test_query(spark, sf_dir, con, key):
    df = registry.run(key, spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython"):
        assert bad not in plan, f"{bad} in the plan of {key}"
    assert difference(df, con, ORACLES[key]) is None
