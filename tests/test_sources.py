from __future__ import annotations

import numpy as np
import pytest

from tessella.functions.cells import parse_shape
from tessella.sources import npy, results


def test_npy_round_trip(spark, tmp_path):
    grid = np.random.default_rng(0).integers(0, 80, (13, 7)).astype(np.int16)
    np.save(tmp_path / "a.npy", grid)
    spark.dataSource.register(npy.NpySource)
    cells = spark.read.format("npy").option("path", str(tmp_path / "a.npy")).option("raster_id", "a").option("rows", 5).load()
    assert cells.rdd.getNumPartitions() == 3 and cells.count() == 91
    assert all(r.class_code == grid[r.y, r.x] and r.cell_id == r.y * 7 + r.x for r in cells.collect())
    again = npy.read_binary(spark, str(tmp_path))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, cells.collect()))
    cells.write.format("npy").option("path", str(tmp_path / "b.npy")).option("height", 13).option("width", 7).mode("append").save()
    assert (np.load(tmp_path / "b.npy") == grid).all()
    assert len(npy.row_table(cells).where("y = 0").first().classes) == 7
    with pytest.raises(ValueError):
        npy.header(b"nothing")


def test_upsert_of_an_older_results_file(spark, tmp_path):
    (tmp_path / "old.csv").write_text("resolution,cost_scenario,budget,timesteps,seeds,method,iic_gain\n48x96,1:2,45,0,,Bridge Planner,0.02\n48x96,1:2,45,50000,0.0,MaskablePPO,0.03\n")
    old = results.read_results(spark, str(tmp_path / "old.csv"))
    new = old.where("method = 'MaskablePPO'").withColumn("iic_gain", old.iic_gain * 2).withColumn("seeds", old.seeds)
    got = {r.method: r for r in results.upsert(old, new).collect()}
    assert len(got) == 2 and got["MaskablePPO"].iic_gain == 0.06 and got["MaskablePPO"].seeds == "0" and got["MaskablePPO"].rl_preset == "default"
    assert got["Bridge Planner"].rl_preset == "" and got["Bridge Planner"].land_scenario == "main" and got["Bridge Planner"].training_seconds == 0
    results.write_csv(results.upsert(old, new), str(tmp_path / "new.csv"))
    assert results.read_results(spark, str(tmp_path / "new.csv")).count() == 2


def test_names_and_shapes():
    assert results.output_name("main", True) == "results_multires.csv" and results.output_name("s2", False) == "results_s2_scenario.csv"
    assert parse_shape("32X64") == (32, 64)
    for bad in ("32", "0x4", "ax4", "1x2x3"):
        with pytest.raises(ValueError):
            parse_shape(bad)
