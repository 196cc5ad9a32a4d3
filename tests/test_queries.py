"""Every registered query of the library against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import pytest
from compare import DATA, compare

from docstrata.queries import ORACLES, QUERIES

SMALL = str(DATA / "sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert compare(spark, name, QUERIES[name], ORACLES.get(name), SMALL) == ""
