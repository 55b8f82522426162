import os

import pytest

from nightledger.llm import queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, name):
    assert compare(spark, connect(SF), SF, queries.QUERIES[name], queries.ORACLES[name])
