"""Tables that cut lineage and outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may leave it unset, and gets a temporary folder."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="tessella-")
    return _local[app]


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once and read again."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder as a path for files that Python opens itself; the folder has to be mounted."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    scheme, _, rest = path.partition("://")
    if rest and scheme != "file":
        raise ValueError("this needs a mounted spark.checkpoint.dir")
    _made.append(path)
    return "/" + rest.lstrip("/") if rest else path.removeprefix("file:")


def release(spark: SparkSession) -> int:
    """Delete the tables made so far; results that still read them have to be written before. Returns their number."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_made)
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
