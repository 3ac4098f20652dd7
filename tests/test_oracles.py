import os

import pytest

from glossweave.queries import ORACLES, QUERIES
from tests.oracle import DATA, compare

needs_tables = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.01"), reason="no tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLES[name], "sf0.01") > 0


@needs_tables
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0
