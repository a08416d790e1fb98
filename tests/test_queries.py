"""Every core query runs on the smallest tables and equals its SQL."""

import pytest
from oracle import connect, same

from marlstone import registry

registry.load()

#: The given tables hold no book, no list of rules and too few files for an import between them; tests/test_operators.py has such texts.
NO_ROWS = {"tx7_book_sections", "tx8_rule_list", "j6_import_edges"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, sf, name):
    if name in registry.ORACLE:
        same(spark, con, sf, registry.QUERIES[name], registry.ORACLE[name])
    else:
        # Those without SQL are compared with literals or by brute force elsewhere; here each must give rows.
        assert (registry.QUERIES[name](spark, sf).count() > 0) is (name not in NO_ROWS)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
