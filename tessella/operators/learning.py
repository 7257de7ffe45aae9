"""A learned planner: linear softmax policies trained by masked or penalised policy gradient, and a store for them.

A policy scores each cell by a few features of its place; training is a sequence, so each (raster, configuration, seed)
is one task, and many run side by side. It stands in for deep policies and claims none of their results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .planning import Grid, on_every_raster, packed_grids, patch_graph

FEATURES = ("bias", "cost", "habitat_neighbours", "patches_joined", "open_neighbours")
# Presets of a training run; a preset overrides the defaults.
DEFAULTS = {"rate": 0.3, "episodes": 60, "entropy": 0.01, "eval_every": 10, "select_best": False, "reward_per_cost": False}
PRESETS = {"default": {}, "s2-tuned": {"rate": 0.1, "entropy": 0.003, "select_best": True, "reward_per_cost": True}}
LOG = "raster_id string, config string, seed int, step long, reward double, iic double, best_iic double, weights array<double>"


def preset(name: str) -> dict:
    return DEFAULTS | PRESETS[name]


def features(g: Grid, cells: np.ndarray) -> np.ndarray:
    """[cells, FEATURES] of the state."""
    h, w = g.shape
    _, _, image = patch_graph(g.habitat, 1.0)
    y, x = np.divmod(cells, w)
    near, near_open, patches = np.zeros(len(cells)), np.zeros(len(cells)), []
    for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)):
        ok = (y + dy >= 0) & (y + dy < h) & (x + dx >= 0) & (x + dx < w)
        at = np.where(ok, (y + dy) * w + x + dx, 0)
        patches.append(np.where(ok, image[at], -1))
        near += ok & (image[at] >= 0)
        near_open += ok & (g.restorable & ~g.planted).ravel()[at]
    p = np.sort(np.stack(patches), axis=0)
    joined = ((p[1:] != p[:-1]) & (p[1:] >= 0)).sum(axis=0) + (p[0] >= 0)
    return np.stack((np.ones(len(cells)), g.cost.ravel()[cells] / max(g.cost.max(), 1.0), near / 4, joined / 4, near_open / 4), axis=1)


def choose(g: Grid, weights: np.ndarray, masked: bool, rng=None) -> tuple[int, np.ndarray, np.ndarray]:
    """(cell, its features, expected features); greedy without rng."""
    cells = g.valid() if masked else np.arange(g.cost.size)
    if not len(cells):
        return 0, np.zeros(len(FEATURES)), np.zeros(len(FEATURES))
    f = features(g, cells)
    z = f @ weights
    p = np.exp(z - z.max())
    p /= p.sum()
    k = int(z.argmax()) if rng is None else int(rng.choice(len(cells), p=p))
    return int(cells[k]), f[k], p @ f


def evaluate(g: Grid, weights: np.ndarray, masked: bool) -> float:
    g.reset()
    while True:
        g.step(choose(g, weights, masked)[0])
        if g.over():
            return g.iic


def train(g: Grid, seed: int, masked: bool, options: dict):
    """Yields (step, episode reward, evaluated IIC or None, best so far, weights)."""
    rng, weights = np.random.default_rng(seed), np.zeros(len(FEATURES))
    best, kept, step, base = -np.inf, weights.copy(), 0, 0.0
    for n in range(1, options["episodes"] + 1):
        g.reset()
        total, push = 0.0, np.zeros(len(FEATURES))
        while True:
            cell, f, mean = choose(g, weights, masked, rng)
            total += g.step(cell, options["reward_per_cost"], penalties=not masked)
            push += f - mean
            step += 1
            if g.over():
                break
        weights = weights + options["rate"] * 100 * (total - base) * push / max(1, g.steps) - options["entropy"] * weights
        base += 0.1 * (total - base)
        iic = None
        if n % options["eval_every"] == 0 or n == options["episodes"]:
            iic = evaluate(g, weights, masked)
            if iic > best:
                best, kept = iic, weights.copy()
        yield step, total, iic, best if np.isfinite(best) else None, (kept if options["select_best"] else weights).copy()


def train_policies(cells: DataFrame, configs: DataFrame, preset_name: str = "default", masked: bool = True, **overrides) -> DataFrame:
    """Training logs, a row per episode; the last row of a run holds its weights. configs as for ``planning.episodes``."""
    options = preset(preset_name) | overrides
    runs = on_every_raster(packed_grids(cells), configs)

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                g = Grid(np.frombuffer(r.grid, np.int16).reshape(r.height, r.width), dict(r.costs), r.budget, r.dispersal, tuple(r.restorable))
                log = [(r.raster_id, r.config, r.seed, *row[:-1], row[-1].tolist()) for row in train(g, r.seed, masked, options)]
                yield pd.DataFrame(log, columns=["raster_id", "config", "seed", "step", "reward", "iic", "best_iic", "weights"])

    tasks = max(1, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return runs.repartition(tasks, "raster_id", "config", "seed").mapInPandas(run, LOG)


def models(log: DataFrame) -> DataFrame:
    """The store: (raster_id, config, seed, weights, iic) of each run's last step."""
    return log.groupBy("raster_id", "config", "seed").agg(F.max_by("weights", "step").alias("weights"), F.max("best_iic").alias("best_iic"), F.max("step").alias("steps"))


def save_models(store: DataFrame, path: str) -> None:
    """Write the store of :func:`models`, one file for each configuration and seed's partition."""
    store.write.mode("overwrite").partitionBy("config", "seed").parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("raster_id", F.col("config").cast("string").alias("config"), F.col("seed").cast("int").alias("seed"), "weights", "best_iic", "steps")


def evaluate_models(cells: DataFrame, store: DataFrame, budget: float, dispersal: float, costs: dict[int, float], restorable, masked: bool = True, evaluations: int = 20, first_seed: int = 1000) -> DataFrame:
    """(raster_id, config, seed, evaluation seed, iic): greedy episodes of stored models. They don't depend on the seed, so one is run for all."""
    runs = packed_grids(cells).join(store.select("raster_id", "config", "seed", "weights"), "raster_id")

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                g = Grid(np.frombuffer(r.grid, np.int16).reshape(r.height, r.width), costs, budget, dispersal, tuple(restorable))
                yield pd.DataFrame({"raster_id": [r.raster_id], "config": [r.config], "seed": [r.seed], "iic": [evaluate(g, np.asarray(r.weights), masked)]})

    got = runs.mapInPandas(run, "raster_id string, config string, seed int, iic double")
    return got.withColumn("evaluation", F.explode(F.sequence(F.lit(first_seed), F.lit(first_seed + evaluations - 1))))
