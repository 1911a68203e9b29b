import os

import pytest

from docloom.llm import queries as registered
from tests.oracle import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare(spark, SMALL, name, registered.queries()[name], registered.oracle_sql()[name]) is None
