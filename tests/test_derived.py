"""Shapes of the derived rasters against their SQL."""

from __future__ import annotations

import duckdb
import pytest

from tessella.plans.oracles import _GRID
from tessella.sources.derived import grid_shape


@pytest.mark.parametrize("n", [2, 9, 25, 49, 199, 200, 2000, 20_000, 120_000, 1_200_000])
def test_grid_shape(n):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT range AS p_partkey, 1 AS p_size FROM range({n})")
    h, w = con.execute("WITH RECURSIVE " + _GRID + "SELECT coalesce(h, 0), w FROM dim").fetchone()
    assert grid_shape(n) == (h, w)
