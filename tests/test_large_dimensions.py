"""Queries give the same rows when every dimension counts as too large to broadcast."""

import pytest

from orelayer.functions import skew
from orelayer.plans.oracle import ORACLE
from orelayer.plans.queries import QUERIES
from tests.compare import database, differences


@pytest.mark.parametrize("name", ["fact_rental", "sl_rental_enriched", "store_metrics", "overdue_returns"])
def test_large_dimensions(spark, folder, monkeypatch, name):
    monkeypatch.setattr(skew, "SMALL", 0)
    got = QUERIES[name](spark, folder).toArrow()
    assert differences(got, database(folder).sql(ORACLE[name]).to_arrow_table()) == []
