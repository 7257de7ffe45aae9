"""The experiment results table: CSV in and out, schema evolution, keyed upsert, output routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import LEARNED, RESULT_KEY, RESULTS


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A results CSV of any age: its columns are read by name and brought to the current schema."""
    raw = spark.read.option("header", True).csv(path)
    return evolve(raw)


def evolve(old: DataFrame) -> DataFrame:
    """Back-fill what an older table lacks: land scenario 'main', preset 'default' for learned methods, else '' or 0."""
    schema = T._parse_datatype_string(RESULTS)
    cols = []
    for f in schema.fields:
        if f.name in old.columns:
            c = F.col(f.name).cast("double").cast("int") if f.dataType == T.IntegerType() else F.col(f.name).cast(f.dataType)
            if f.name == "seeds":  # "0.0" and "0" are one spelling
                c = F.coalesce(F.regexp_replace(F.col("seeds").cast("string"), r"\.0$", ""), F.lit(""))
            elif f.name == "rl_preset":
                c = F.coalesce(c, F.lit(""))
        elif f.name == "seeds":
            c = F.lit("")
        elif f.name == "land_scenario":
            c = F.lit("main")
        elif f.name == "rl_preset":
            c = F.when(F.col("method").isin(*LEARNED), "default").otherwise("")
        else:
            c = F.lit(0).cast(f.dataType)
        cols.append(c.alias(f.name))
    return old.select(cols)


def upsert(old: DataFrame, new: DataFrame, key: list[str] = RESULT_KEY, order: str | None = None) -> DataFrame:
    """Rows of both, the last one of each key: ``new`` beats ``old``, and inside either the greater ``order``.

    Rows that are still tied are told apart by a hash of their values, so that every run keeps the same one.
    """
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    rank = [F.col("_batch").desc(), *([F.col(order).desc()] if order else []), F.xxhash64(*both.columns)]
    last = F.row_number().over(W.partitionBy(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]).orderBy(*rank))
    return both.withColumn("_last", last).where("_last = 1").drop("_last", "_batch")


def output_name(land_scenario: str, with_resolution: bool) -> str:
    scope = "multires" if with_resolution else "scenario"
    return f"results_{scope}.csv" if land_scenario == "main" else f"results_{land_scenario}_{scope}.csv"


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """UTF-8 CSV with a header and a fixed column order."""
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).csv(path)
