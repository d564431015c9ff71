"""The queries that SQL can express against their SQL."""

import pytest
from compare import compare

from corpusloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    ours, theirs = compare(spark, "/root/testdata/sf0.01", queries.queries()[name], queries.oracle_sql()[name])
    assert ours == theirs
