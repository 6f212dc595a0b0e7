"""Every tenth query against its SQL, and the whole catalogue for its form; the driver compares all of them."""

import pytest
from oracle import same

from trailweave.plans import catalog

SQL = catalog.oracle_sql()
SOME = sorted(SQL)[::10]


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, sf, name):
    same(spark, sf, catalog.queries()[name], SQL[name])


def test_entry_has_rows(spark, sf):
    assert catalog.entry(spark, sf).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(catalog.queries())
