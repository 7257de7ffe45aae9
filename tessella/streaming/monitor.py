"""The step log as a stream: per-episode counts in event-time windows, and results upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.results import upsert


def episode_windows(steps: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """steps(ts, episode, reward, invalid), batch or stream, to sums per episode and window; later rows are dropped."""
    per = steps.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "episode")
    return per.agg(F.count("*").alias("n_steps"), F.count_if("invalid").alias("n_invalid"), F.sum("reward").alias("reward")).select("episode", F.col("window.start").alias("start"), "n_steps", "n_invalid", "reward")


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    whole = [f.getPath() for f in fs.listStatus(at) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))] if fs.exists(at) else []
    return sorted(int(p.getName().removeprefix("version=")) for p in whole if p.getName().startswith("version="))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`upserting` has made."""
    return spark.read.parquet(f"{path}/version={_versions(spark, path)[-1]}")


def upserting(path: str, key: list[str], order: str | None = None, keep: int = 2):
    """A foreachBatch function that keeps the last row of each key in a table of versions under ``path``.

    Inside a batch the row with the greatest ``order`` is the last; rows tied in that are told apart by their values, alike
    in every run. Version n is written whole before it is current by being the greatest, and builds on the greatest one
    before it, so a batch that is run again, as after a lost driver, only writes its own version anew. Of older versions
    ``keep`` stay.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, path) if v < epoch]
        old = spark.read.parquet(f"{path}/version={before[-1]}") if before else batch.limit(0)
        upsert(old, batch, key, order).write.mode("overwrite").parquet(f"{path}/version={epoch}")
        for v in before[: -keep or None]:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}")
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    return write
