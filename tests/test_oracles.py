"""Every query against its SQL on the smallest tables; the others must run."""

import pytest
from compare import compare

from corpusloom.plans import registry

SF = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    query = registry.queries()[name]
    if name in ORACLES:
        ours, theirs = compare(spark, SF, query, ORACLES[name])
        assert ours == theirs
    else:
        assert query(spark, SF).count() >= 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(registry.queries())


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
