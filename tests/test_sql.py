"""Every core query with SQL agrees with it on the smallest tables; the others run. The library stands without llm."""

import os
import subprocess
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import oracle  # noqa: E402

from querylens.plans import registry  # noqa: E402

D = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(D)


@there
@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, D)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if name != "literal_neighbours":  # its one table and column are constants, so its equi-join has no keys left
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name in registry.ORACLE:
        assert oracle.difference(df, registry.ORACLE[name], con) == ""
    else:
        df.collect()


@there
def test_scans_read_what_is_needed(spark):
    plan = registry.QUERIES["score_rollup"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<db_id:string,reasoning_type:string,valid:boolean,match:boolean,similarity:double>" in plan
    plan = registry.QUERIES["k6_hypothetical_rewrite"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_size), EqualTo(p_size,10)]" in plan and "p_name" not in plan


def test_core_does_not_import_llm():
    root = os.path.dirname(os.path.dirname(__file__))
    code = "import sys; sys.modules['querylens.llm'] = None; import __spark_entry__ as e; assert not any(n.startswith('querylens.llm.') for n in sys.modules); assert set(e.oracle_sql()) <= set(e.queries()) and 'p4_found' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env=os.environ | {"PYTHONPATH": root})
