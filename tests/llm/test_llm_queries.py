"""Every pN_ query runs on the smallest tables and equals its SQL where there is one."""

import pytest
from oracle import connect, same

from marlstone.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    if name in queries.ORACLE:
        same(spark, connect(sf), sf, queries.QUERIES[name], queries.ORACLE[name])
    else:
        assert queries.QUERIES[name](spark, sf).count() > 0
