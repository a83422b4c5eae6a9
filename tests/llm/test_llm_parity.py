"""The corpus queries give the rows of their SQL twins on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import DATA
from parity import assert_same

from tidewell.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, duck, name):
    assert_same(catalog.queries()[name](spark, DATA), duck.sql(catalog.oracle_sql()[name]))
