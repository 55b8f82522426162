import os

import pytest

from nightledger.plans import analyses, calibrations, catalog, histories, measures, more, names, scalars, sky_groups  # noqa: F401
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base():
    return connect(SF)


@pytest.mark.skipif(not os.path.exists(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_oracle(spark, base, name):
    compare(spark, base, SF, catalog.QUERIES[name], catalog.ORACLES[name])
