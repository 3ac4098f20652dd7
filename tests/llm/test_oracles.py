import os

import pytest

from glossweave.llm.queries import ORACLES, QUERIES
from tests.oracle import DATA, compare


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.01"), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLES[name], "sf0.01") > 0
