"""Every llm query with SQL agrees with it on the smallest tables; the others run."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
import oracle  # noqa: E402

from querylens.llm import queries  # noqa: E402

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(D)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, D)
    if name in queries.ORACLE:
        assert oracle.difference(df, queries.ORACLE[name], con) == ""
    else:
        assert df.count() > 0
