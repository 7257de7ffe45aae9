"""Registered queries against their SQL on the small tables."""

from __future__ import annotations

import pytest

from compare import differences
from tessella.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, small, name):
    assert differences(QUERIES[name](spark, small), ORACLE_SQL[name], small) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).collect() is not None


def test_goldens_of_the_derived_raster(spark):
    sf = "/root/testdata/sf0.01"
    audit = QUERIES["raster_audit"](spark, sf).first()
    assert (audit.habitat_cells, audit.restorable_cells, audit.frontier_cells, audit.n_patches, audit.largest_patch, audit.n_components) == (428, 544, 197, 62, 24, 3)
    assert audit.iic == 0.0380347109
    assert QUERIES["greedy_first_action"](spark, sf).first().cell_id == 1238
    assert QUERIES["greedy_cost_first_action"](spark, sf).first().cell_id == 287


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
