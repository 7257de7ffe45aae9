"""Rasters derived from the star-schema tables: part keys are cells, part sizes give classes in 2 x 2 clumps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTHS = {200: 20, 2000: 50, 20000: 200}


def grid_shape(n: int) -> tuple[int, int]:
    """Even height and width of the grid for n parts; what does not fill a row pair is left out."""
    w = WIDTHS.get(n, 2 * round(math.sqrt(n) / 2))  # halves to even, as in SQL
    return (n // w // 2 * 2 if w else 0), w


def class_of(size: F.Column) -> F.Column:
    limits = [(9, 5), (10, 76), (14, 13), (24, 21), (33, 31), (44, 40), (46, 33), (47, 35)]
    out = F.when(size <= limits[0][0], limits[0][1])
    for top, code in limits[1:]:
        out = out.when(size <= top, code)
    return out.otherwise(0)


def cells(spark: SparkSession, sf_dir: str, raster_id: str = "part") -> tuple[DataFrame, int, int]:
    """(cells, height, width)."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    h, w = grid_shape(part.count())
    y, x = F.expr(f"k div {w}"), F.col("k") % w
    grid = part.where(F.col("k") < h * w).select("k", y.cast("int").alias("y"), x.cast("int").alias("x"))
    coarse = (F.expr("y div 2") * (w // 2) + F.expr("x div 2")).alias("c")
    out = grid.select("*", coarse).join(part.select(F.col("k").alias("c"), "s"), "c")
    return out.select(F.lit(raster_id).alias("raster_id"), F.col("k").alias("cell_id"), "y", "x", class_of(F.col("s")).alias("class_code")), h, w
