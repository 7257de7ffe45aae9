"""Column functions on cells and results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import HABITAT, RESTORABLE


def is_habitat(code: Column) -> Column:
    return code.isin(*HABITAT)


def is_restorable(code: Column, codes=RESTORABLE) -> Column:
    return code.isin(*codes)


def is_locked(code: Column, codes=RESTORABLE) -> Column:
    """Neither habitat nor restorable."""
    return ~(is_habitat(code) | is_restorable(code, codes))


def cost_of(code: Column, costs: dict[int, float]) -> Column:
    """Cost of a class, 0 if it has none."""
    out = F.lit(None).cast("double")
    for k, v in costs.items():
        out = F.when(code == k, float(v)).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def cell_id(y: Column, x: Column, width: int) -> Column:
    return (y.cast("long") * width + x).cast("long")


def target_index(i: Column, target: int, source: int) -> Column:
    """Row (or column) of the coarse grid that source index i falls into, for target <= source."""
    return F.floor(((i + 1) * target - 1) / F.lit(source)).cast("int")


def safe_percent(part: Column, base: Column) -> Column:
    """100 part / base, NULL where base is 0."""
    return 100.0 * F.try_divide(part, base)


def without_nodata(band: Column, nodata: float | None) -> Column:
    """Class codes with NoData as 0; a NaN marker matches nothing."""
    if nodata is None or nodata != nodata:
        return band.cast("int")
    return F.when(band == nodata, 0).otherwise(band.cast("int"))


def parse_shape(text: str) -> tuple[int, int]:
    """'HxW' in either case, both positive."""
    parts = text.lower().split("x")
    if len(parts) != 2 or not all(p.strip().isdigit() for p in parts) or min(map(int, parts)) <= 0:
        raise ValueError(f"expected HxW with positive sizes: {text!r}")
    return int(parts[0]), int(parts[1])


def structural_score(gap: Column, prize: Column, largest: Column, bait: Column, budget: float) -> Column:
    """0.4 closeness of the gap to half the budget + 0.4 normalised prize + 0.2 bait, each within [0, 1]."""
    close = F.greatest(1.0 - F.abs(gap - budget / 2.0) / budget, F.lit(0.0))
    return 0.4 * close + 0.4 * F.least(prize / (largest * largest + 1e-9), F.lit(1.0)) + 0.2 * F.least(bait / 20.0, F.lit(1.0))


def passes(gap: Column, greedy: Column) -> Column:
    return gap < 0.3 * F.greatest(greedy, F.lit(1e-9))


def run_slug(method: Column, land: Column, preset: Column, cost: Column, budget: Column, steps: Column, seed: Column) -> Column:
    return F.concat(
        method, F.when(land == "main", "").otherwise(F.concat(F.lit("_land_"), land)), F.when(preset == "default", "").otherwise(F.concat(F.lit("_preset_"), preset)),
        F.lit("_cost_"), F.replace(cost, F.lit(":"), F.lit("-")), F.lit("_budget"), budget.cast("string"), F.lit("_steps"), steps.cast("string"), F.lit("_seed"), seed.cast("string"),
    )
