"""GeoTIFF, Office, learned planner and streams."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.catalogue import QUERIES
from tessella.model import COST_SCENARIOS
from tessella.operators import learning, planning, texts
from tessella.sources import geotiff, office
from tessella.streaming import monitor


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 3000, 60000])
def test_lzw(n):
    for high in (2, 7, 256):
        raw = np.random.default_rng(n).integers(0, high, n).astype(np.uint8).tobytes()
        assert geotiff.lzw_decode(geotiff.lzw_encode(raw)) == raw


def test_geotiff_round_trip(spark, tmp_path):
    grid = np.random.default_rng(0).choice([0, 5, 13, -9999], (150, 31)).astype(np.int16)
    (tmp_path / "r.tif").write_bytes(geotiff.write(grid, (100.0, -5.0, 131.0, 145.0), 32748, -9999))
    back, meta = geotiff.read((tmp_path / "r.tif").read_bytes())
    assert (back == grid).all() and meta == {"nodata": -9999.0, "crs": "EPSG:32748", "bounds": (100.0, -5.0, 131.0, 145.0)}
    cells, about = geotiff.read_cells(spark, str(tmp_path))
    got = np.zeros(grid.shape, int)
    for r in cells.collect():
        got[r.y, r.x] = r.class_code
    assert (got == np.where(grid == -9999, 0, grid)).all()
    assert about.first().bounds.top == 145.0 and about.first().raster_id == "r"
    with pytest.raises(ValueError):
        geotiff.read(b"II*_nothing_")


def test_docx(spark, tmp_path):
    xml = """<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>
    <w:p><w:pPr><w:numPr/></w:pPr><w:r><w:rPr><w:rFonts w:ascii="Arial"/><w:b/><w:sz w:val="24"/></w:rPr><w:t>Hello there [1, 2]</w:t></w:r><w:r><w:t> again</w:t></w:r></w:p><w:p/>
    <w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
    <w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="1440" w:right="1440" w:bottom="1440" w:left="1701" w:header="708" w:footer="708"/></w:sectPr></w:body></w:document>"""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", xml)
        z.writestr("word/comments.xml", "<x/>")
    (tmp_path / "a.docx").write_bytes(raw.getvalue())
    df = office.read_docx(spark, str(tmp_path)).cache()
    runs = df.where("kind = 'run' and trim(text) <> ''").withColumn("n", F.length("text"))
    assert [(r.font, r.weight) for r in texts.weighted_counts(runs, "font", "n").collect()] == [("Arial", 18), ("(style/default)", 6)]
    assert df.where("kind = 'row'").first().text == "a / b | c" and df.where("kind = 'section'").first().width_cm == 21.0
    assert {r.text: r["item"] for r in df.where("kind = 'marker'").collect()}["comments_part"] == 1
    para = df.where("kind = 'paragraph'").select(F.col("item").alias("doc_id"), "text")
    assert texts.citations(para).where("doc_id = 0").first().square == 1


def test_learned_policy(spark):
    rng = np.random.default_rng(3)
    g = np.array([5, 13, 21, 31])[rng.choice(4, (6, 8), p=[0.3, 0.3, 0.25, 0.15])]
    rows = [("g", int(y * 8 + x), y, x, int(g[y, x])) for y in range(6) for x in range(8)]
    cells = spark.createDataFrame(rows, "raster_id string, cell_id long, y int, x int, class_code int")
    config = spark.createDataFrame([("1:2", "learned", s, 6.0, 2.0, [13, 21], {13: 1.0, 21: 2.0}) for s in (0, 1)], "config string, method string, seed int, budget double, dispersal double, restorable array<int>, costs map<int,double>")
    log = learning.train_policies(cells, config, "s2-tuned", episodes=12, eval_every=4).cache()
    assert log.count() == 24 and log.where("iic is not null").count() == 6
    for m in learning.models(log).collect():
        grid = planning.Grid(g, COST_SCENARIOS["1:2"], 6.0, 2.0)
        assert learning.evaluate(grid, np.array(m.weights), True) == pytest.approx(m.best_iic) and grid.invalid == 0 and grid.iic > grid.first_iic
    assert learning.preset("s2-tuned")["rate"] == 0.1 and learning.preset("default")["rate"] == 0.3
    loose = list(learning.train(planning.Grid(g, COST_SCENARIOS["1:2"], 6.0, 2.0), 0, False, learning.preset("default") | {"episodes": 1}))
    assert len(loose) == 1


def test_streams(spark, tmp_path, small):
    events = spark.read.parquet(f"{small}/events.parquet").select("ts", F.col("user_id").alias("episode"), F.col("value").alias("reward"), (F.col("event_type") == "error").alias("invalid"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = monitor.episode_windows(stream).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    want = monitor.episode_windows(events)
    assert sorted(r[:4] for r in map(tuple, spark.table("windows").collect())) == sorted(r[:4] for r in map(tuple, want.collect()))
    keep = monitor.upserting(str(tmp_path / "table"), ["k"])
    keep(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), 0)
    for _ in range(2):  # a batch run again changes nothing
        keep(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "table/version=1")).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    last = monitor.upserting(str(tmp_path / "late"), ["k"], "n")
    last(spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 6, "c")], "k int, n int, v string"), 3)  # epochs needn't begin at 0
    for epoch in range(5, 9):
        last(spark.createDataFrame([(epoch, 0, "x")], "k int, n int, v string"), epoch)
    assert sorted(map(tuple, monitor.current(spark, str(tmp_path / "late")).collect())) == [(1, 7, "b"), *((e, 0, "x") for e in range(5, 9))]
    assert len(list((tmp_path / "late").iterdir())) <= 4


def test_release_deletes_intermediate_tables(spark):
    from tessella import session

    df = session.settled(spark.range(5))
    assert df.count() == 5 and session.release(spark) >= 1
    spark.catalog.clearCache()
    with pytest.raises(Exception, match="exist|found"):
        spark.read.parquet(df.inputFiles()[0])


def test_gap_distances_beyond_the_budget(spark):
    steps = [r.steps for r in QUERIES["gap_distances"](spark, "/root/testdata/sf0.01").where("steps > 0").collect()]
    assert (len(steps), sum(d <= 20 for d in steps), max(steps)) == (178, 123, 49)


def test_episodes_plan_the_whole_raster(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["episode_rollout"](spark, sf).collect()
    assert {round(r.iic_initial, 10) for r in rows} == {QUERIES["raster_audit"](spark, sf).first().iic}
    assert sum(r.method == "random" for r in rows) == 20 and max(r.cost for r in rows) == 20


def test_settings_are_crossed_in_one_task(spark, small):
    assert QUERIES["run_slugs"](spark, small).rdd.getNumPartitions() == 1
