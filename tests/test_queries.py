"""Every registered query of the library: its SQL's rows, or at least some rows."""

import pytest

from cadenza.plans import registry
from tests.compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, name):
    compare(spark, SF, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
