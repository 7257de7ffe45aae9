"""Masks, histograms, resampling and sliding windows on cells(raster_id, cell_id, y, x, class_code)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import cost_of, is_habitat, is_locked, is_restorable, target_index
from ..model import CLASS_NAMES, COST_SCENARIOS, HABITAT, LOCKED, RESTORABLE

NEIGHBOURS = ((-1, 0), (1, 0), (0, -1), (0, 1))


def with_masks(cells: DataFrame, restorable=RESTORABLE, costs=None) -> DataFrame:
    """cells + habitat, restorable, locked, cost."""
    code = F.col("class_code")
    return cells.select("*", is_habitat(code).alias("habitat"), is_restorable(code, restorable).alias("restorable"), is_locked(code, restorable).alias("locked"), cost_of(code, costs or COST_SCENARIOS["1:2"]).alias("cost"))


def class_name(code) -> F.Column:
    names = F.create_map(*[x for k, v in CLASS_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(names, code), F.lit("?"))


def histogram(cells: DataFrame) -> DataFrame:
    """(raster_id, class_code, class_name, n_cells, percent)."""
    n = cells.groupBy("raster_id", "class_code").agg(F.count("*").alias("n_cells"))
    share = 100.0 * F.col("n_cells") / F.sum("n_cells").over(W.partitionBy("raster_id"))
    return n.select("raster_id", "class_code", class_name(F.col("class_code")).alias("class_name"), "n_cells", share.alias("percent"))


def band_stats(cells: DataFrame, nodata: int = 0) -> DataFrame:
    """Side-car statistics of a band without its NoData cells."""
    v = F.when(F.col("class_code") != nodata, F.col("class_code"))
    return cells.groupBy("raster_id").agg(F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_dev"), (100.0 * F.count(v) / F.count("*")).alias("valid_percent"))


def mask_counts(cells: DataFrame) -> DataFrame:
    m = with_masks(cells)
    return m.groupBy("raster_id").agg(F.count("*").alias("total_cells"), F.count_if("habitat").alias("habitat_cells"), F.count_if("restorable").alias("restorable_cells"), F.count_if("locked").alias("locked_cells"), F.count_if(F.col("habitat") | F.col("restorable")).alias("landscape_area"), F.greatest(F.max("cost"), F.lit(1.0)).alias("max_cost"))


def cost_violations(cells: DataFrame, restorable, costs) -> DataFrame:
    """Restorable classes without a positive cost: no rows if the scenario is sound."""
    m = with_masks(cells, restorable, costs)
    return m.where("restorable and cost <= 0").groupBy("raster_id", "class_code").agg(F.count("*").alias("n_cells"))


def require_costs(cells: DataFrame, restorable, costs) -> DataFrame:
    """``cells`` with masks; a restorable cell without a positive cost stops the query and names its class."""
    m = with_masks(cells, restorable, costs)
    bad = F.raise_error(F.concat(F.lit("restorable class without a positive cost: "), F.col("class_code").cast("string")))
    return m.withColumn("cost", F.when(F.col("restorable") & (F.col("cost") <= 0), bad.cast("double")).otherwise(F.col("cost")))


def unknown_codes(cells: DataFrame) -> DataFrame:
    known = [*HABITAT, *RESTORABLE, *LOCKED]
    return cells.where(~F.col("class_code").isin(*known)).groupBy("raster_id", "class_code").agg(F.count("*").alias("n_cells"))


def frontier(masked: DataFrame) -> DataFrame:
    """Restorable cells beside habitat: (raster_id, cell_id, y, x, cost)."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in NEIGHBOURS])).alias("s")
    beside = masked.where("habitat").select("raster_id", "y", "x", steps).select("raster_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    return masked.where("restorable").join(beside, ["raster_id", "y", "x"], "left_semi").select("raster_id", "cell_id", "y", "x", "cost")


def action_mask(masked: DataFrame, remaining: float) -> DataFrame:
    return frontier(masked).where(F.col("cost") <= remaining)


def observation_planes(masked: DataFrame, remaining: float, budget: float) -> DataFrame:
    """(raster_id, cell_id, habitat, open_frontier, cost_share, budget_share), each in [0, 1]."""
    open_ = frontier(masked).select("raster_id", "cell_id", F.lit(1.0).alias("open_frontier"))
    top = masked.groupBy("raster_id").agg(F.greatest(F.max("cost"), F.lit(1.0)).alias("max_cost"))
    out = masked.join(open_, ["raster_id", "cell_id"], "left").join(top, "raster_id")
    return out.select("raster_id", "cell_id", F.col("habitat").cast("double").alias("habitat"), F.coalesce("open_frontier", F.lit(0.0)).alias("open_frontier"), (F.col("cost") / F.col("max_cost")).alias("cost_share"), F.lit(remaining / max(budget, 1.0)).alias("budget_share"))


def observation_tensor(planes: DataFrame) -> DataFrame:
    """One array of 4 planes per raster, cells in order."""
    rows = F.sort_array(F.collect_list(F.struct("cell_id", "habitat", "open_frontier", "cost_share", "budget_share")))
    part = lambda c: F.transform(rows, lambda r: r[c].cast("float"))
    return planes.groupBy("raster_id").agg(F.concat(*[part(c) for c in ("habitat", "open_frontier", "cost_share", "budget_share")]).alias("observation"))


def resample(cells: DataFrame, shape: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Majority class of each block, ties to the least code; for targets no larger than the source: one aggregation."""
    (h, w), (th, tw) = shape, target
    if th > h or tw > w:
        raise ValueError("target larger than the source; use resample_any")
    ty, tx = target_index(F.col("y"), th, h).alias("ty"), target_index(F.col("x"), tw, w).alias("tx")
    out = cells.groupBy("raster_id", ty, tx).agg(F.mode("class_code", True).alias("class_code"))
    return out.select("raster_id", (F.col("ty").cast("long") * tw + F.col("tx")).alias("cell_id"), F.col("ty").alias("y"), F.col("tx").alias("x"), "class_code")


def resample_any(cells: DataFrame, shape: tuple[int, int], target: tuple[int, int], at_least_one: bool = True) -> DataFrame:
    """Majority blocks for any target. Blocks take a row and a column at least, or, without that, may be empty (class 0)."""
    (h, w), (th, tw) = shape, target
    spark = cells.sparkSession

    def axis(n: int, t: int, name: str) -> DataFrame:
        i = F.col("id").cast("int")
        lo = F.floor(F.col("id") * n / F.lit(t)).cast("int")
        hi = F.floor((F.col("id") + 1) * n / F.lit(t)).cast("int") - 1
        hi = F.greatest(lo, hi) if at_least_one else hi
        return spark.range(t).select(i.alias("t" + name), F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))).alias(name))

    hit = cells.join(axis(h, th, "y"), "y").join(axis(w, tw, "x"), "x")  # equi-joins; an axis has a row per block row
    out = hit.groupBy("raster_id", "ty", "tx").agg(F.mode("class_code", True).alias("class_code"))
    if not at_least_one:
        grid = cells.select("raster_id").distinct().select("raster_id", F.explode(F.sequence(F.lit(0), F.lit(th - 1))).alias("ty")).select("raster_id", "ty", F.explode(F.sequence(F.lit(0), F.lit(tw - 1))).alias("tx"))
        out = grid.join(out, ["raster_id", "ty", "tx"], "left").withColumn("class_code", F.coalesce("class_code", F.lit(0)))
    return out.select("raster_id", (F.col("ty").cast("long") * tw + F.col("tx")).alias("cell_id"), F.col("ty").alias("y"), F.col("tx").alias("x"), "class_code")


def windows(cells: DataFrame, shape: tuple[int, int], size: tuple[int, int], fraction: float = 0.5) -> DataFrame:
    """Cells of every full sliding window as a raster of its own: raster_id 'id@y0,x0', y and x inside it."""
    (h, w), (nh, nw) = shape, size
    sy, sx = max(1, int(nh * fraction)), max(1, int(nw * fraction))

    def starts(i: str, n: int, size: int, step: int) -> F.Column:
        last = max(n - size, 0) // step  # number of the last full window
        lo = F.greatest(F.lit(0), F.ceil((F.col(i) - size + 1) / F.lit(step))).cast("int")
        hi = F.least(F.lit(last), F.floor(F.col(i) / F.lit(step))).cast("int")
        return F.explode(F.when(hi >= lo, F.transform(F.sequence(lo, hi), lambda k: k * step)).otherwise(F.array().cast("array<int>")))

    if nh > h or nw > w:
        return cells.where(F.lit(False)).select("raster_id", "cell_id", "y", "x", "class_code", F.lit(0).alias("y0"), F.lit(0).alias("x0"))
    out = cells.withColumn("y0", starts("y", h, nh, sy)).withColumn("x0", starts("x", w, nw, sx))
    y, x = F.col("y") - F.col("y0"), F.col("x") - F.col("x0")
    return out.select(F.concat("raster_id", F.lit("@"), "y0", F.lit(","), "x0").alias("raster_id"), (y.cast("long") * nw + x).alias("cell_id"), y.alias("y"), x.alias("x"), "class_code", "y0", "x0")
