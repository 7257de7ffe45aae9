"""Step logs: rewards, runs of repeated invalid actions, trailing means, best checkpoints.

steps(episode, step, ...) rows; windows are per episode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import INVALID_PENALTY, REPEAT_LIMIT

def by_step():
    return W.partitionBy("episode").orderBy("step")


def rewards(steps: DataFrame, per_cost: bool = False, at_end: bool = False, penalties: bool = True, scale: float = 1.0) -> DataFrame:
    """steps(episode, step, iic, cost, invalid) + reward: gain of the step, or the whole gain on the last step only."""
    gain = F.col("iic") - F.lag("iic", 1, 0.0).over(by_step())
    if per_cost:
        gain = gain / F.greatest(F.col("cost"), F.lit(1e-9))
    if at_end:
        last = F.lead("step").over(by_step()).isNull()
        gain = F.when(last, F.col("iic")).otherwise(0.0)
    out = F.when(F.col("invalid"), -INVALID_PENALTY if penalties else 0.0).otherwise(gain)
    return steps.withColumn("reward", out * scale)


def invalid_runs(steps: DataFrame, limit: int = REPEAT_LIMIT) -> DataFrame:
    """steps(episode, step, action, invalid) to runs of one invalid action: (episode, first_step, length, truncated)."""
    prior = F.lag(F.struct("invalid", "action")).over(by_step())
    new = ~F.coalesce(F.col("invalid") & prior["invalid"] & (F.col("action") == prior["action"]), F.lit(False))
    run = F.sum(new.cast("int")).over(by_step())
    runs = steps.withColumn("run", run).where("invalid").groupBy("episode", "run").agg(F.min("step").alias("first_step"), F.count("*").alias("length"))
    return runs.select("episode", "first_step", "length", (F.col("length") >= limit).alias("truncated"))


def trailing_mean(steps: DataFrame, value: str = "reward", rows: int = 20) -> DataFrame:
    return steps.withColumn("trailing", F.avg(value).over(by_step().rowsBetween(1 - rows, 0)))


def best_checkpoints(steps: DataFrame, value: str = "iic") -> DataFrame:
    """Rows that beat all before them."""
    top = F.max(value).over(by_step().rowsBetween(W.unboundedPreceding, -1))
    return steps.withColumn("_top", top).where(F.col("_top").isNull() | (F.col(value) > F.col("_top"))).drop("_top")


def progress(steps: DataFrame, total: int, every: int = 256) -> DataFrame:
    """steps(episode, step, seconds) + share done, steps per second and seconds left, at every ``every``-th step."""
    speed = F.try_divide(F.col("step").cast("double"), F.col("seconds"))
    out = steps.where((F.col("step") % every == 0) | (F.col("step") >= total))
    return out.select("*", F.least(F.col("step") / F.lit(total), F.lit(1.0)).alias("share"), speed.alias("steps_per_second"), F.try_divide(F.greatest(F.lit(total) - F.col("step"), F.lit(0)), speed).alias("seconds_left"))


def totals(steps: DataFrame) -> DataFrame:
    """(episode, n_steps, n_planted, n_invalid, cost_used): counters of a whole episode."""
    ok = ~F.col("invalid")
    return steps.groupBy("episode").agg(F.count("*").alias("n_steps"), F.count_if(ok).alias("n_planted"), F.count_if("invalid").alias("n_invalid"), F.coalesce(F.sum(F.when(ok, F.col("cost"))), F.lit(0.0)).alias("cost_used"))
