"""Every registered query that has a SQL twin gives the twin's rows on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import DATA
from parity import assert_same

from tidewell.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, duck, name):
    assert_same(catalog.queries()[name](spark, DATA), duck.sql(catalog.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0
