"""Every registered query against its SQL on the smallest tables."""

import pytest

from orelayer.plans.bindings import Source
from orelayer.plans.oracle import ORACLE
from orelayer.plans.queries import QUERIES, tenant_sources
from tests.compare import database, differences


@pytest.fixture(scope="module")
def duck(folder):
    return database(folder)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, folder, duck, name):
    got = QUERIES[name](spark, folder).toArrow()
    assert differences(got, duck.sql(ORACLE[name]).to_arrow_table()) == []


def test_entry_has_rows(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0


def test_tenants_share_the_copies_in_stock(spark, folder):
    source = Source(spark, folder)
    own = [tables["inventory"] for tables in tenant_sources(source).values()]
    assert len(own) == 2 and not any("lineitem" in file for df in own for file in df.inputFiles())
    assert all(sorted(df.collect()) == sorted(source.inventory().collect()) for df in own)
