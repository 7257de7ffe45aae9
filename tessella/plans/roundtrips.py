"""Queries of sources, sinks, streams and run settings: what is written to the shared folder is read back and compared."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import LAND_SCENARIOS, PROFILES, RESTORABLE
from ..operators import learning, planning, raster, reports, texts
from ..session import local_folder, shared_folder
from ..sources import geotiff, npy, office, results
from ..sources.derived import cells as derived_cells
from ..streaming import monitor
from .queries import BUDGET, COSTS, _cells, _facts, _table, query

CELLS = ["cell_id", "y", "x", "class_code"]


@query
def npy_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The raster written as one .npy file and read back in bands of rows."""
    c, h, w = derived_cells(spark, sf)
    path = local_folder(spark, "grid") + ".npy"
    spark.dataSource.register(npy.NpySource)
    c.select("raster_id", *CELLS).write.format("npy").option("path", path).option("height", h).option("width", w).mode("append").save()
    return spark.read.format("npy").option("path", path).option("raster_id", "part").load().select(*CELLS)


@query
def npy_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The compact form: a row per grid line."""
    return npy.row_table(_cells(spark, sf)).select("y", F.array_join(F.col("classes").cast("array<string>"), " ").alias("classes"))


def _tiff(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    folder = local_folder(spark, "tiff")

    def write(batches):
        import os

        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            for r in pdf.itertuples():
                grid = np.frombuffer(r.grid, np.int16).reshape(r.height, r.width)
                with open(f"{folder}/{r.raster_id}.tif", "wb") as f:
                    f.write(geotiff.write(np.where(grid == 0, -9999, grid), (100.0, -5.0, 100.0 + r.width, -5.0 + r.height), 32748, -9999))
                yield pd.DataFrame({"n": [1]})

    planning.packed_grids(_cells(spark, sf)).mapInPandas(write, "n int").agg(F.sum("n")).collect()
    return geotiff.read_cells(spark, folder)


@query
def geotiff_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The raster as an LZW GeoTIFF, its zeros as NoData, read back with NoData as class 0."""
    return _tiff(spark, sf)[0].select(*CELLS)


@query
def geotiff_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return _tiff(spark, sf)[1].select("raster_id", "height", "width", "nodata", "crs", "bounds.left", "bounds.bottom", "bounds.right", "bounds.top")


def _result_rows(spark: SparkSession, sf: str) -> DataFrame:
    f = _facts(spark, sf).groupBy("resolution", "method", "seed").agg(F.sum("cents").alias("cents"), F.sum("cost").alias("cost"))
    given = {"resolution": F.col("resolution"), "method": F.col("method"), "seeds": F.col("seed").cast("string"), "iic_gain": F.col("cents").cast("double"), "cost_used": F.col("cost").cast("double"), "land_scenario": F.lit("s2"), "budget": F.lit(BUDGET)}
    return results.evolve(f.select(*[v.alias(k) for k, v in given.items()]))


@query
def results_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The results table written as CSV under its routed name, and read back by column names."""
    path = f"{shared_folder(spark)}/{local_folder(spark, 'results').rsplit('/', 1)[-1]}/{results.output_name('s2', True)}"
    results.write_csv(_result_rows(spark, sf), path)
    return results.read_results(spark, path).select("resolution", "method", "seeds", "land_scenario", "rl_preset", "budget", "iic_gain", "cost_used")


@query
def output_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(land, wide, results.output_name(land, wide)) for land in LAND_SCENARIOS for wide in (False, True)]
    return spark.createDataFrame(rows, "land_scenario string, with_resolution boolean, file_name string")


@query
def console_report(spark: SparkSession, sf: str) -> DataFrame:
    """The class histogram as a fixed-width report, a row per line."""
    h = raster.histogram(_cells(spark, sf)).orderBy("class_code").select("class_code", "n_cells", "percent")
    lines = reports.console(h, digits=2).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


@query
def docx_fonts(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a Word file, its lines in two fonts by turns; the characters in each font, read back from the files."""
    folder = local_folder(spark, "docx")

    def write(batches):
        import os

        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            for r in pdf.itertuples():
                with open(f"{folder}/{r.doc_id}.docx", "wb") as f:
                    f.write(office.document([[(line, ("Arial", None, "Courier")[k % 3])] for k, line in enumerate((r.text or "").split("\n"))]))
            yield pd.DataFrame({"n": [len(pdf)]})

    _table(spark, sf, "documents").select("doc_id", "text").mapInPandas(write, "n int").agg(F.sum("n")).collect()
    runs = office.read_docx(spark, folder).where("kind = 'run'").withColumn("n", F.length("text"))
    return texts.weighted_counts(runs, "font", "n")


@query
def block_growth(spark: SparkSession, sf: str) -> DataFrame:
    """What each frontier cell would plant in blocks of two, with money for one cell of each class."""
    return planning.blocks(_cells(spark, sf), COSTS, 3.0, 2).drop("raster_id")


@query
def method_choices(spark: SparkSession, sf: str) -> DataFrame:
    """The methods that each command line runs, or its error."""
    rows = []
    for methods in (None, ["random"], ["naive", "bridge"]):
        for learned in (None, "ppo", "mask", "both"):
            for without in (False, True):
                for land, preset in (("main", "default"), ("main", "s2-tuned"), ("s2", "s2-tuned")):
                    try:
                        base, rl = planning.choose_methods(methods, learned, without, land, preset)
                        said = f"{' '.join(base)}|{' '.join(rl)}"
                    except ValueError:
                        said = "error"
                    rows.append((" ".join(methods or []), learned or "", without, land, preset, said))
    return spark.createDataFrame(rows, "methods string, learned string, without_learned boolean, land_scenario string, rl_preset string, runs string")


@query
def preset_values(spark: SparkSession, sf: str) -> DataFrame:
    """Training options by preset: a preset's values over the defaults, the merge done in the query."""
    base = F.create_map(*[F.lit(x) for k, v in learning.DEFAULTS.items() for x in (k, str(v))])
    own = spark.createDataFrame([(name, {k: str(v) for k, v in p.items()}) for name, p in learning.PRESETS.items()], "rl_preset string, own map<string,string>")
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys("own"), k)), "own")
    return own.select("rl_preset", F.explode(merged).alias("option", "value"))


@query
def model_store(spark: SparkSession, sf: str) -> DataFrame:
    """Policies trained on the raster (brought to 48 x 96 where it is larger), saved, loaded, and evaluated greedily."""
    c, h, w = derived_cells(spark, sf)
    size = (min(h, 48), min(w, 96))
    c = raster.resample(c, (h, w), size).select("raster_id", "cell_id", "y", "x", "class_code") if size != (h, w) else c
    dispersal, budget = (float(x) for x in PROFILES["48x96"])
    rows = [("1:2", "learned", s, budget, dispersal, list(RESTORABLE), {k: float(v) for k, v in COSTS.items()}) for s in (0, 1, 2)]
    configs = spark.createDataFrame(rows, "config string, method string, seed int, budget double, dispersal double, restorable array<int>, costs map<int,double>")
    path = f"{shared_folder(spark)}/{local_folder(spark, 'models').rsplit('/', 1)[-1]}"
    learning.save_models(learning.models(learning.train_policies(c, configs, "s2-tuned", episodes=20)), path)
    return learning.evaluate_models(c, learning.load_models(spark, path), budget, dispersal, {k: float(v) for k, v in COSTS.items()}, RESTORABLE).drop("raster_id")


def _event_steps(df: DataFrame) -> DataFrame:
    return df.select("ts", F.col("user_id").alias("episode"), F.round("value", 4).cast("decimal(18,4)").alias("reward"), (F.col("event_type") == "error").alias("invalid"))


@query
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The step log read as a stream, summed by episode and hour, and upserted batch by batch into a table."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{sf}/events.parquet")
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    schema = _table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema)
    stream = stream.parquet(f"{sf}/events.parquet") if whole else stream.option("pathGlobFilter", "events.parquet").parquet(sf)
    base = f"{shared_folder(spark)}/{local_folder(spark, 'stream').rsplit('/', 1)[-1]}"
    writer = monitor.episode_windows(_event_steps(stream), late="3650 days").writeStream.outputMode("update").trigger(availableNow=True)
    writer.foreachBatch(monitor.upserting(f"{base}/table", ["episode", "start"])).option("checkpointLocation", f"{base}/state").start().awaitTermination()
    return monitor.current(spark, f"{base}/table").select("episode", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n_steps", "n_invalid", F.col("reward").cast("double").alias("reward"))
