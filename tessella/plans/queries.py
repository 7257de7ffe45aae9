"""The registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import parse_shape, passes, run_slug, without_nodata
from ..model import BUDGETS, COST_SCENARIOS, EVALUATIONS, LAND_SCENARIOS, RESTORABLE
from ..operators import graph, planning, raster, reports, steps, structure, texts
from ..sources.derived import cells as derived_cells
from ..sources.results import evolve, upsert

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
R = 5.0
BUDGET = 20
SHARE = 0.08
COSTS = COST_SCENARIOS["1:2"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _cells(spark, sf):
    return derived_cells(spark, sf)[0]


def _masked(spark, sf):
    return raster.with_masks(_cells(spark, sf))


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- cells ---------------------------------------------------------------------------------------------------------


@query
def class_histogram(spark, sf):
    return raster.histogram(_cells(spark, sf)).select("class_code", "class_name", "n_cells", F.round("percent", 6).alias("percent"))


@query
def band_stats(spark, sf):
    s = raster.band_stats(_cells(spark, sf))
    return s.select("minimum", "maximum", *[F.round(c, 6).alias(c) for c in ("mean", "std_dev", "valid_percent")])


@query
def mask_counts(spark, sf):
    return raster.mask_counts(_cells(spark, sf)).drop("raster_id")


@query
def cost_map(spark, sf):
    return _masked(spark, sf).select("cell_id", "cost")


@query
def cost_violations(spark, sf):
    return raster.cost_violations(_cells(spark, sf), LAND_SCENARIOS["s2"][0], COSTS).drop("raster_id")


@query
def unknown_codes(spark, sf):
    return raster.unknown_codes(_cells(spark, sf)).drop("raster_id")


@query
def nodata_normalise(spark, sf):
    return _table(spark, sf, "part").select(F.col("p_partkey").alias("cell_id"), without_nodata(F.col("p_size"), 47).alias("class_code"))


@query
def cell_index_roundtrip(spark, sf):
    c, _, w = derived_cells(spark, sf)
    return c.select("cell_id", F.expr(f"cast(cell_id div {w} as int)").alias("row"), (F.col("cell_id") % w).cast("int").alias("col"), (F.col("y").cast("long") * w + F.col("x")).alias("back"))


@query
def majority_resample(spark, sf):
    c, h, w = derived_cells(spark, sf)
    return raster.resample(c, (h, w), (h * 2 // 5, w * 2 // 5)).select("y", "x", "class_code")


@query
def majority_resample_up(spark, sf):
    c, h, w = derived_cells(spark, sf)
    return raster.resample_any(c, (h, w), (h * 3 // 2, w * 3 // 2)).select("y", "x", "class_code")


@query
def majority_resample_sparse(spark, sf):
    c, h, w = derived_cells(spark, sf)
    return raster.resample_any(c, (h, w), (h * 3 // 2, w * 3 // 2), at_least_one=False).select("y", "x", "class_code")


@query
def resample_histogram(spark, sf):
    c, h, w = derived_cells(spark, sf)
    half, fifth = parse_shape(f"{h // 2}X{w // 2}"), parse_shape(f"{h // 5}x{w // 5}")
    out = reports.multires_histogram(c, (h, w), [half, fifth])
    return out.select("resolution", "class_code", "class_name", "n_cells", F.round("percent", 6).alias("percent"))


@query
def frontier_initial(spark, sf):
    return raster.frontier(_masked(spark, sf)).select("cell_id")


@query
def action_mask(spark, sf):
    return raster.action_mask(_masked(spark, sf), 1.0).select("cell_id")


@query
def observation_planes(spark, sf):
    p = raster.observation_planes(_masked(spark, sf), 15.0, float(BUDGET))
    return p.drop("raster_id")


@query
def mask_sets(spark, sf):
    """Union, intersection and complement of id sets."""
    m, front = _masked(spark, sf), frontier_initial(spark, sf)
    habitat, rest = m.where("habitat").select("cell_id"), m.where("restorable").select("cell_id")
    parts = {"landscape": habitat.union(rest), "frontier": rest.intersect(front), "interior": rest.exceptAll(front), "locked": m.select("cell_id").exceptAll(habitat.union(rest))}
    out = None
    for name, p in parts.items():
        p = p.select(F.lit(name).alias("part"), "cell_id")
        out = p if out is None else out.unionAll(p)
    return out


# --- patches -------------------------------------------------------------------------------------------------------


@query
def distance_pairs(spark, sf):
    return graph.distance_pairs(_masked(spark, sf).where("habitat"), 3.0).drop("raster_id")


def _patches(spark, sf):
    masked = _masked(spark, sf)
    return masked, graph.label_patches(masked.where("habitat"))


@query
def patch_labels(spark, sf):
    return _patches(spark, sf)[1].select("cell_id", "patch_id")


@query
def patch_areas(spark, sf):
    return graph.patch_areas(_patches(spark, sf)[1]).drop("raster_id")


@query
def patch_stats(spark, sf):
    return graph.patch_areas(_patches(spark, sf)[1]).agg(F.count("*").alias("n_patches"), F.coalesce(F.max("area"), F.lit(0)).alias("largest_patch"))


@query
def patch_edges(spark, sf):
    return graph.patch_edges(_patches(spark, sf)[1], R).drop("raster_id")


@query
def components(spark, sf):
    _, lab = _patches(spark, sf)
    return graph.patch_components(graph.patch_areas(lab), graph.patch_edges(lab, R)).drop("raster_id")


@query
def component_cells(spark, sf):
    _, lab = _patches(spark, sf)
    comp = graph.patch_components(graph.patch_areas(lab), graph.patch_edges(lab, R))
    return lab.join(comp, ["raster_id", "patch_id"]).select("cell_id", "component_id")


@query
def component_count(spark, sf):
    _, lab = _patches(spark, sf)
    return graph.patch_components(graph.patch_areas(lab), graph.patch_edges(lab, R)).agg(F.countDistinct("component_id").alias("n_components"))


@query
def hop_distances(spark, sf):
    _, lab = _patches(spark, sf)
    return graph.hop_distances(graph.patch_areas(lab), graph.patch_edges(lab, R)).drop("raster_id")


@query
def iic(spark, sf):
    return reports.connectivity(_cells(spark, sf), R)["iic"].select(F.round("iic", 10).alias("iic"))


@query
def iic_by_dispersal(spark, sf):
    masked, lab = _patches(spark, sf)
    areas = graph.patch_areas(lab)
    land = masked.groupBy("raster_id").agg(F.count_if(F.col("habitat") | F.col("restorable")).alias("landscape_area"))
    out = None
    for r in (2.0, 3.0, 5.0):
        one = graph.iic(graph.hop_products(areas, graph.patch_edges(lab, r)), land).select(F.lit(r).alias("dispersal"), F.round("iic", 10).alias("iic"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def largest_patch(spark, sf):
    return graph.largest_patch(graph.patch_areas(_patches(spark, sf)[1])).drop("raster_id")


@query
def bait_frontier(spark, sf):
    masked, lab = _patches(spark, sf)
    return graph.bait_frontier(masked, lab, graph.patch_areas(lab)).select("cell_id")


@query
def gap_distances(spark, sf):
    """Every two patches of 8 % of the largest at least; -1 where no open cells lead from one to the other."""
    return structure.gap_table(_cells(spark, sf), SHARE).drop("raster_id")


@query
def raster_audit(spark, sf):
    return reports.raster_audit(_cells(spark, sf), R, BUDGET)


# --- windows -------------------------------------------------------------------------------------------------------


def _windows(spark, sf):
    c, h, w = derived_cells(spark, sf)
    size = (h * 2 // 5, w * 2 // 5)
    return raster.windows(c, (h, w), size), size


@query
def window_scan(spark, sf):
    win, _ = _windows(spark, sf)
    m = raster.with_masks(win)
    return m.groupBy("y0", "x0").agg(F.count("*").alias("n_cells"), F.count_if("habitat").alias("habitat_cells"), F.count_if("restorable").alias("restorable_cells"), F.count_if(F.col("class_code").isin(31, 40, 33, 0)).alias("locked_cells"))


def _structures(spark, sf):
    win, size = _windows(spark, sf)
    half = raster.resample(win.drop("y0", "x0"), size, (max(1, size[0] // 2), max(1, size[1] // 2)))
    return structure.window_structure(half, BUDGET, SHARE)


def _rounded_structure(df):
    return df.withColumns({c: F.round(c, 9).alias(c) for c in ("frac_habitat", "frac_restorable", "frac_locked", "score")})


@query
def window_structure(spark, sf):
    return _rounded_structure(_structures(spark, sf))


@query
def window_topk(spark, sf):
    return _rounded_structure(structure.top_windows(_structures(spark, sf), 5))


# --- scenarios -----------------------------------------------------------------------------------------------------


def _each(values) -> F.Column:
    """A row per value: cross products of settings stay in one task, where joins would multiply the partitions."""
    return F.explode(F.array(*map(F.lit, values)))


@query
def scenario_grid(spark, sf):
    return spark.range(1, numPartitions=1).select(_each(COST_SCENARIOS).alias("cost_scenario")).select("cost_scenario", _each(BUDGETS).alias("budget"))


@query
def scenario_cost_merge(spark, sf):
    rows = [(k, l, v, e[1]) for k, v in COST_SCENARIOS.items() for l, e in LAND_SCENARIOS.items()]
    df = spark.createDataFrame(rows, "cost_scenario string, land_scenario string, base map<int,int>, extra map<int,int>")
    merged = F.map_zip_with("base", "extra", lambda k, a, b: F.coalesce(b, a))
    return df.select("cost_scenario", "land_scenario", F.explode(merged).alias("class_code", "cost"))


@query
def run_slugs(spark, sf):
    grid = scenario_grid(spark, sf).select("*", _each(LAND_SCENARIOS).alias("land_scenario")).select("*", _each(("default", "s2-tuned")).alias("rl_preset"))
    slug = run_slug(F.lit("maskableppo"), F.col("land_scenario"), F.col("rl_preset"), F.col("cost_scenario"), F.col("budget"), F.lit(50000), F.lit(0))
    return grid.select("cost_scenario", "budget", "land_scenario", "rl_preset", slug.alias("run_name"))


# --- result tables -------------------------------------------------------------------------------------------------


def _facts(spark, sf):
    """One episode per order: gains in cents and cost as integers."""
    o, li = _table(spark, sf, "orders"), _table(spark, sf, "lineitem")
    per = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.sum(F.col("l_quantity").cast("long")).alias("cost"), F.count("*").alias("steps"), F.count_if(F.col("l_returnflag") == "R").alias("invalid"))
    method = F.element_at(F.array(F.lit("naive"), F.lit("cost"), F.lit("bridge")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.join(per, "o_orderkey").select("o_orderkey", F.col("o_orderpriority").alias("resolution"), method.alias("method"), (F.col("o_custkey") % 5).cast("int").alias("seed"), "cents", "cost", "steps", "invalid")


def _episodes(spark, sf):
    f = _facts(spark, sf)
    return f.select("resolution", "method", "seed", F.lit(0.0).alias("iic_initial"), F.col("cents").cast("double").alias("iic_final"), F.col("cost").cast("double").alias("cost"), F.col("steps").alias("n_planted"), F.col("steps").alias("n_patches"), F.col("steps").alias("largest_patch"), "invalid", "steps")


def _rounded(df, keys):
    return df.select(*keys, *[F.round(c, 4).alias(c) for c in df.columns if c not in keys])


@query
def episode_summary(spark, sf):
    return _rounded(planning.summarise(_episodes(spark, sf), ["resolution", "method"]), ["resolution", "method"])


@query
def seed_summary(spark, sf):
    return _rounded(planning.summarise_seeds(_episodes(spark, sf), ["resolution", "method"]), ["resolution", "method"])


@query
def results_upsert(spark, sf):
    f = _facts(spark, sf).select("resolution", "method", "seed", "o_orderkey", "cents")
    return upsert(f.where("o_orderkey % 2 = 0"), f.where("o_orderkey % 2 = 1 and seed < 3"), ["resolution", "method", "seed"], "o_orderkey")


@query
def results_schema_evolution(spark, sf):
    f = _facts(spark, sf)
    method = F.when(F.col("method") == "bridge", "MaskablePPO").otherwise(F.col("method"))
    old = f.select("resolution", F.concat(F.col("seed").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".0").otherwise("")).alias("seeds"), method.alias("method"), F.col("cents").cast("double").alias("iic_gain"), F.lit(20).alias("budget"))
    return evolve(old).groupBy("resolution", "land_scenario", "rl_preset", "budget", "timesteps", "seeds", "method").agg(F.count("*").alias("n_rows"), F.sum(F.col("iic_gain").cast("long")).alias("gain"))


@query
def results_uniqueness(spark, sf):
    return reports.not_unique(_facts(spark, sf), ["resolution", "method", "seed"])


@query
def planning_headroom(spark, sf):
    g = _facts(spark, sf).groupBy("resolution", "seed", "method").agg((F.sum("cents") / F.sum("cost")).alias("gain"))
    return _rounded(reports.headroom(g, ["resolution", "seed"], strict=False), ["resolution", "seed"])


# --- planning ------------------------------------------------------------------------------------------------------


def _gains(spark, sf, r=2.0):
    return planning.candidate_gains(_cells(spark, sf), COSTS, float(BUDGET), r)


@query
def candidate_gains(spark, sf):
    return _gains(spark, sf).select("cell_id", F.round("gain", 10).alias("gain"), "cost")


@query
def greedy_first_action(spark, sf):
    return planning.first_action(_gains(spark, sf), "gain").select("cell_id", F.round("gain", 10).alias("gain"))


@query
def greedy_cost_first_action(spark, sf):
    return planning.first_action(_gains(spark, sf), "ratio").select("cell_id", F.round("ratio", 10).alias("ratio"))


def _grids(spark, sf, run, schema):
    import numpy as np

    def go(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                g = planning.Grid(np.frombuffer(r.grid, np.int16).reshape(r.height, r.width), COSTS, BUDGET, 2.0)
                yield run(g)

    return planning.packed_grids(_cells(spark, sf)).mapInPandas(go, schema)


@query
def bridge_route(spark, sf):
    import pandas as pd

    return _grids(spark, sf, lambda g: pd.DataFrame({"cell_id": planning.bridge_candidates(g)}, dtype="int64"), "cell_id long")


@query
def bridge_first_action(spark, sf):
    import pandas as pd

    return _grids(spark, sf, lambda g: pd.DataFrame({"cell_id": [planning.policy_bridge(g)]}), "cell_id long")


def _configs(spark, methods, seeds, budget, dispersal):
    rows = [("1:2", m, s, budget, dispersal, list(RESTORABLE), {k: float(v) for k, v in COSTS.items()}) for m in methods for s in (seeds if m == "random" else (0,))]
    return spark.createDataFrame(rows, "config string, method string, seed int, budget double, dispersal double, restorable array<int>, costs map<int,double>")


def _all_policies(spark, sf):
    return planning.episodes(_cells(spark, sf), _configs(spark, ["random", "naive", "cost", "bridge"], range(EVALUATIONS), float(BUDGET), R))


@query
def episode_rollout(spark, sf):
    """Every policy's episodes; plant_order: cell ids in the order of planting."""
    order = F.array_join(F.col("plant_order").cast("array<string>"), " ").alias("plant_order")
    return _all_policies(spark, sf).withColumns({"iic_initial": F.round("iic_initial", 10), "iic_final": F.round("iic_final", 10), "plant_order": order})


@query
def random_rollout(spark, sf):
    """The random policy's episodes step by step; plant_order: cell ids in the order of planting."""
    e = planning.episodes(_cells(spark, sf), _configs(spark, ["random"], range(EVALUATIONS), float(BUDGET), R))
    return e.select("seed", "cost", "n_planted", "steps", "invalid", "n_patches", "largest_patch", F.round("iic_final", 10).alias("iic_final"), F.array_join(F.col("plant_order").cast("array<string>"), " ").alias("plant_order"))


@query
def greedy_rollout(spark, sf):
    """The greedy policies' episodes step by step."""
    e = planning.episodes(_cells(spark, sf), _configs(spark, ["naive", "cost"], (0,), float(BUDGET), R))
    return e.select("method", "cost", "n_planted", "steps", "n_patches", "largest_patch", F.round("iic_final", 10).alias("iic_final"), F.array_join(F.col("plant_order").cast("array<string>"), " ").alias("plant_order"))


@query
def scenario_random(spark, sf):
    """Rows of the results table for the random policy, in every cost scenario and budget."""
    s = planning.run_scenarios(_cells(spark, sf), ["random"], COST_SCENARIOS, list(BUDGETS), R)
    fine = [F.round(c, 10).alias(c) for c in ("iic_initial", "iic_final", "iic_gain", "std_iic_gain")] + [F.round(c, 6).alias(c) for c in ("cost_used", "cells_planted", "n_patches", "largest_patch")]
    return s.select("cost_scenario", "budget", "method", *fine, "invalid_action_rate")


@query
def policy_comparison(spark, sf):
    means = planning.summarise(_all_policies(spark, sf), ["config", "method"])
    return means.select("config", "method", *[F.round(c, 10).alias(c) for c in means.columns[2:]])


@query
def candidate_check(spark, sf):
    win, size = _windows(spark, sf)
    """Random and greedy episodes on the five best windows, five random ones each, with the whole budget."""
    top = structure.top_windows(_structures(spark, sf), 5).select("raster_id", "score")
    half = raster.resample(win.drop("y0", "x0"), size, (max(1, size[0] // 2), max(1, size[1] // 2)))
    s = planning.summarise(planning.episodes(half.join(F.broadcast(top), "raster_id", "left_semi"), _configs(spark, ["random", "naive"], range(5), float(BUDGET), R)), ["raster_id", "method"])
    wide = s.groupBy("raster_id").agg(F.max(F.when(F.col("method") == "random", F.col("iic_gain"))).alias("gain_random"), F.max(F.when(F.col("method") == "naive", F.col("iic_gain"))).alias("gain_greedy"))
    wide = wide.withColumn("gap", F.col("gain_greedy") - F.col("gain_random"))
    fine = [F.round("score", 9).alias("score"), *[F.round(c, 10).alias(c) for c in ("gain_random", "gain_greedy", "gap")]]
    return wide.join(top, "raster_id").select("raster_id", *fine, passes(F.col("gap"), F.col("gain_greedy")).alias("passed"))


@query
def bridge_routes_frames(spark, sf):
    """The cheapest bridge by frames, on the graph of dispersal 2 (at 5 the derived rasters have no way between components)."""
    masked, lab = _patches(spark, sf)
    comp = graph.patch_components(graph.patch_areas(lab), graph.patch_edges(lab, 2.0))
    state = graph.cheapest_routes(masked, lab.join(comp, ["raster_id", "patch_id"]).select("raster_id", "cell_id", "component_id"))
    return graph.cheapest_bridge(state).select("cost", "a", "b")


@query
def scenario_results(spark, sf):
    rows = planning.run_scenarios(_cells(spark, sf), ["random", "naive", "cost", "bridge"], COST_SCENARIOS, list(BUDGETS), R)
    return rows.select(*[F.round(c, 10).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


@query
def result_attributes(spark, sf):
    method = F.when(F.col("method") == "bridge", "MaskablePPO").otherwise(F.col("method"))
    rows = _facts(spark, sf).select(method.alias("method"), "cents").groupBy("method").agg(F.sum("cents").alias("gain"))
    return planning.attributes(rows, "48x96", "s2", "s2-tuned", F.lit("1:2"), F.lit(45), 50000, [0, 1, 2])


# --- step logs -----------------------------------------------------------------------------------------------------


def _steps(spark, sf):
    from pyspark.sql import Window as W

    e = _table(spark, sf, "events")
    nth = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("episode"), nth.cast("long").alias("step"), F.col("event_type").alias("action"), (F.col("event_type") == "error").alias("invalid"), F.round(F.col("value"), 4).alias("iic"), (F.col("event_id") % 3 + 1).cast("double").alias("cost"))


@query
def step_rewards(spark, sf):
    s = steps.rewards(_steps(spark, sf))
    s = steps.rewards(s.withColumnRenamed("reward", "plain"), per_cost=True, scale=100.0).withColumnRenamed("reward", "per_cost")
    s = steps.rewards(s, at_end=True, penalties=False)
    return s.select("episode", "step", F.round("plain", 4).alias("plain"), F.round("per_cost", 4).alias("per_cost"), F.round("reward", 4).alias("at_end"))


@query
def step_totals(spark, sf):
    return steps.totals(_steps(spark, sf))


@query
def truncation_runs(spark, sf):
    return steps.invalid_runs(_steps(spark, sf))


@query
def trailing_reward(spark, sf):
    return steps.trailing_mean(_steps(spark, sf), "iic").select("episode", "step", F.round("trailing", 6).alias("trailing"))


@query
def best_checkpoint(spark, sf):
    return steps.best_checkpoints(_steps(spark, sf)).select("episode", "step", "iic")


@query
def training_progress(spark, sf):
    s = _steps(spark, sf).withColumn("seconds", F.col("step") * 0.5 + F.col("cost"))
    p = steps.progress(s, 40, 8)
    return p.select("episode", "step", F.round("share", 6).alias("share"), F.round("steps_per_second", 6).alias("steps_per_second"), F.round("seconds_left", 4).alias("seconds_left"))


# --- texts ---------------------------------------------------------------------------------------------------------


@query
def doc_word_counts(spark, sf):
    return texts.word_counts(_table(spark, sf, "documents"))


@query
def doc_citations(spark, sf):
    return texts.citations(_table(spark, sf, "documents"))


@query
def doc_markers(spark, sf):
    return texts.markers(_table(spark, sf, "documents"), texts.TEMPLATE_MARKERS + ["the", "license"])


@query
def xml_markers(spark, sf):
    return texts.markers(_table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), [*texts.XML_MARKERS, "<p"]).withColumnRenamed("doc_id", "page_id")


@query
def doc_paragraphs(spark, sf):
    return texts.paragraphs(_table(spark, sf, "documents"), 2, 6)


@query
def weighted_value_counts(spark, sf):
    return texts.weighted_counts(_table(spark, sf, "documents"), "source", "n_chars")


@query
def doc_table_preview(spark, sf):
    return texts.table_preview(_table(spark, sf, "conversations"), ["role", "text"], "turn", "conv_id")
