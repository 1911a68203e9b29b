import os

import pytest

from docloom.plans.oracles import ORACLES
from docloom.plans.queries import QUERIES
from tests.oracle import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, SMALL, name, QUERIES[name], ORACLES[name]) is None


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SMALL).limit(5).collect()
