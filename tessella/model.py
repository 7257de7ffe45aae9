"""Domain constants, dimensions and schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the domain: class codes, roles, costs, budgets and limits.
CLASS_NAMES = {0: "nodata", 5: "mangrove", 13: "other_non_forest", 21: "other_agriculture", 31: "pond", 33: "water", 35: "unclassified", 40: "rice_field", 76: "peat_swamp"}
HABITAT = (5, 76)
RESTORABLE = (13, 21)
LOCKED = (31, 40, 33, 0)
LAND_SCENARIOS = {"main": ((13, 21), {}), "s2": ((13, 21, 31, 40), {31: 3, 40: 3})}
COST_SCENARIOS = {"1:1": {13: 1, 21: 1}, "1:2": {13: 1, 21: 2}, "1:3": {13: 1, 21: 3}}
BUDGETS = (10, 20, 30)
PROFILES = {"32x64": (5.0, 20), "48x96": (7.5, 45), "64x128": (10.0, 80)}  # dispersal, budget
INVALID_PENALTY = 0.05
REPEAT_LIMIT = 3
MIN_STEPS = 300
STEPS_PER_BUDGET = 30
EVALUATIONS = 20
METHODS = {"random": "Random Valid Action", "naive": "Greedy Naive", "cost": "Greedy Cost", "bridge": "Bridge Planner"}
LEARNED = ("PPO", "MaskablePPO")

CELLS = "raster_id string, cell_id long, y int, x int, class_code int"
RESULTS = (
    "resolution string, land_scenario string, rl_preset string, cost_scenario string, budget int, timesteps int, seeds string, method string, "
    "iic_initial double, iic_final double, iic_gain double, std_iic_gain double, cost_used double, iic_per_unit double, cells_planted double, "
    "n_patches double, largest_patch double, invalid_action_rate double, training_seconds double"
)
RESULT_KEY = ["resolution", "land_scenario", "rl_preset", "cost_scenario", "budget", "timesteps", "seeds", "method"]


def class_dim(spark: SparkSession) -> DataFrame:
    """(class_code, class_name, role): a row per known code."""
    role = {**dict.fromkeys(HABITAT, "habitat"), **dict.fromkeys(RESTORABLE, "restorable"), **dict.fromkeys(LOCKED, "locked")}
    return spark.createDataFrame([(c, n, role.get(c, "unknown")) for c, n in CLASS_NAMES.items()], "class_code int, class_name string, role string")


def limit_of_steps(budget: float) -> int:
    return max(MIN_STEPS, int(budget) * STEPS_PER_BUDGET)
