"""Composite reports: raster audit, multi-resolution histogram, planning headroom, uniqueness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import safe_percent
from ..model import HABITAT, LOCKED, RESTORABLE
from ..session import settled
from . import graph, raster


def connectivity(cells: DataFrame, r: float) -> dict[str, DataFrame]:
    """Patches, areas, edges and IIC of habitat at dispersal distance r."""
    masked = raster.with_masks(cells)
    labelled = graph.label_patches(masked.where("habitat"))
    areas = settled(graph.patch_areas(labelled))
    edges = settled(graph.patch_edges(labelled, r))
    landscape = masked.groupBy("raster_id").agg(F.count_if(F.col("habitat") | F.col("restorable")).alias("landscape_area"))
    return {"masked": masked, "labelled": labelled, "areas": areas, "edges": edges, "iic": graph.iic(graph.hop_products(areas, edges), landscape)}


def raster_audit(cells: DataFrame, r: float, budget: int) -> DataFrame:
    """A row per raster: sizes, shares, patches, frontier, components, IIC, unknown codes, status and notes."""
    c = connectivity(cells, r)
    m = c["masked"]
    known = [*HABITAT, *RESTORABLE, *LOCKED]
    odd = F.when(~F.col("class_code").isin(*known), F.col("class_code"))
    base = m.groupBy("raster_id").agg(
        (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.count("*").alias("total_cells"), F.count_if("habitat").alias("habitat_cells"), F.count_if("restorable").alias("restorable_cells"),
        F.count(odd).alias("unknown_cells"), F.array_join(F.array_sort(F.collect_set(odd)), ";").alias("unknown_codes"),
    )
    patches = c["areas"].groupBy("raster_id").agg(F.count("*").alias("n_patches"), F.max("area").alias("largest_patch"))
    comps = graph.patch_components(c["areas"], c["edges"]).groupBy("raster_id").agg(F.countDistinct("component_id").alias("n_components"))
    front = raster.frontier(m).groupBy("raster_id").agg(F.count("*").alias("frontier_cells"))
    out = reduce(lambda a, b: a.join(b, "raster_id", "left"), [base, patches, comps, front, c["iic"]])
    zero = lambda n: F.coalesce(n, F.lit(0).cast("long")).alias(n)
    notes = F.array_compact(F.array(F.when(F.col("habitat_cells") == 0, "no_habitat"), F.when(F.col("restorable_cells") == 0, "no_restorable"), F.when(F.coalesce("frontier_cells", F.lit(0)) == 0, "empty_frontier"), F.when(F.col("unknown_cells") > 0, "unknown_class")))
    return out.select(
        "raster_id", "height", "width", "total_cells", "habitat_cells", (100.0 * F.col("habitat_cells") / F.col("total_cells")).alias("habitat_percent"), "restorable_cells",
        (100.0 * F.col("restorable_cells") / F.col("total_cells")).alias("restorable_percent"), zero("n_patches"), zero("largest_patch"), zero("frontier_cells"), zero("n_components"), F.lit(float(r)).alias("dispersal"), F.lit(budget).alias("budget"),
        F.round("iic", 10).alias("iic"), "unknown_codes", "unknown_cells", F.when(F.size(notes) == 0, "OK").otherwise("REVIEW").alias("status"), F.array_join(notes, ";").alias("notes"),
    )


def multires_histogram(cells: DataFrame, shape: tuple[int, int], targets: list[tuple[int, int]]) -> DataFrame:
    """Class histograms of the source and of each resampled grid."""
    own = raster.histogram(cells).withColumn("resolution", F.lit(f"{shape[0]}x{shape[1]}"))
    for t in targets:
        own = own.unionByName(raster.histogram(raster.resample(cells, shape, t)).withColumn("resolution", F.lit(f"{t[0]}x{t[1]}")))
    return own.select("resolution", "class_code", "class_name", "n_cells", "percent")


def not_unique(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows <> 1")


def headroom(gains: DataFrame, by: list[str], strict: bool = True) -> DataFrame:
    """gains(by..., method in naive/cost/bridge, gain), one row each, to the bridge planner's headroom over the greedy ones."""
    one = lambda m: F.max(F.when(F.col("method") == m, F.col("gain")))
    n = [F.count_if(F.col("method") == m) for m in ("naive", "cost", "bridge")]
    wide = gains.groupBy(*by).agg(one("naive").alias("gain_naive"), one("cost").alias("gain_cost"), one("bridge").alias("gain_bridge"), F.array(*n).alias("n"))
    if strict:
        wide = wide.withColumn("gain_naive", F.when(F.exists("n", lambda x: x != 1), F.raise_error("one result for each method is needed").cast("double")).otherwise(F.col("gain_naive")))
    best = F.greatest("gain_naive", "gain_cost")
    vs = {"naive": F.col("gain_naive"), "cost": F.col("gain_cost"), "best": best}
    cols = []
    for k, base in vs.items():
        cols += [(F.col("gain_bridge") - base).alias(f"vs_{k}_absolute"), safe_percent(F.col("gain_bridge") - base, base).alias(f"vs_{k}_percent")]
    return wide.select(*by, "gain_naive", "gain_cost", "gain_bridge", *cols, F.greatest(F.lit(0.0), safe_percent(F.col("gain_bridge") - best, best)).alias("positive_headroom_percent"))


def console(df: DataFrame, digits: int = 4, rows: int = 50) -> str:
    """A fixed-width table of the first rows, doubles rounded."""
    shown = df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).limit(rows).collect()
    table = [df.columns, *[["" if v is None else str(v) for v in r] for r in shown]]
    widths = [max(map(len, col)) for col in zip(*table, strict=True)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(line, widths, strict=True)).rstrip() for line in table)
