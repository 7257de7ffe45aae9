"""The .npy grid format as a Spark data source: reading in bands of rows, writing one raster.

    spark.dataSource.register(NpySource)
    spark.read.format("npy").option("path", ...).option("raster_id", "r1").load()

Format 1.0 and 2.0 headers, C order, integer and float grids. Values become SMALLINT class codes. Paths are opened by
the Python process, so they have to be visible to driver and executors; for other stores use :func:`read_binary`.
"""

from __future__ import annotations

import ast
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "raster_id string, cell_id long, y int, x int, class_code int"


def header(raw: bytes) -> tuple[tuple[int, int], np.dtype, int]:
    """(shape, dtype, offset of the data) of a 2-D grid."""
    if raw[:6] != b"\x93NUMPY":
        raise ValueError("not an .npy file")
    wide = raw[6] >= 2
    size, start = (struct.unpack_from("<I", raw, 8)[0], 12) if wide else (struct.unpack_from("<H", raw, 8)[0], 10)
    info = ast.literal_eval(raw[start : start + size].decode())
    if info["fortran_order"] or len(info["shape"]) != 2:
        raise ValueError("a 2-D grid in C order is needed")
    return info["shape"], np.dtype(info["descr"]), start + size


class _Band(InputPartition):
    def __init__(self, y0: int, y1: int):
        self.y0, self.y1 = y0, y1


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.raster_id, self.rows = options["path"], options.get("raster_id", options["path"]), int(options.get("rows", 256))

    def _header(self):
        with open(self.path, "rb") as f:
            return header(f.read(4096))

    def partitions(self):
        (h, _), _, _ = self._header()
        return [_Band(y, min(h, y + self.rows)) for y in range(0, h, self.rows)] or [_Band(0, 0)]

    def read(self, partition):
        (_, w), kind, start = self._header()
        with open(self.path, "rb") as f:
            f.seek(start + partition.y0 * w * kind.itemsize)
            n = (partition.y1 - partition.y0) * w
            band = np.frombuffer(f.read(n * kind.itemsize), kind, n).reshape(-1, w) if n else np.zeros((0, max(w, 1)))
        for y in range(0, len(band), max(1, 65536 // max(w, 1))):  # Arrow batches of some 65,536 cells
            own = band[y : y + max(1, 65536 // max(w, 1))]
            cell = (partition.y0 + y) * w + np.arange(own.size)
            columns = [pa.array([self.raster_id] * own.size, pa.string()), pa.array(cell, pa.int64()), pa.array((cell // max(w, 1)).astype(np.int32)), pa.array((cell % max(w, 1)).astype(np.int32)), pa.array(own.ravel().astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["raster_id", "cell_id", "y", "x", "class_code"])


class _Message(WriterCommitMessage):
    def __init__(self, cells):
        self.cells = cells


class _Writer(DataSourceWriter):
    """Each task writes its cells beside the target; the driver's commit lays them into one grid."""

    def __init__(self, options):
        self.path, self.shape = options["path"], (int(options["height"]), int(options["width"]))

    def write(self, iterator):
        import uuid

        part = f"{self.path}.{uuid.uuid4().hex}.part"
        rows = [(r.cell_id, r.class_code) for r in iterator]
        with open(part, "wb") as f:
            np.save(f, np.array(rows, np.int64).reshape(-1, 2))
        return _Message(part)

    def commit(self, messages):
        import os

        grid = np.lib.format.open_memmap(self.path, "w+", np.int16, self.shape)
        for m in messages:
            if m is not None:
                got = np.load(m.cells)
                grid.reshape(-1)[got[:, 0]] = got[:, 1]
                os.remove(m.cells)
        grid.flush()

    def abort(self, messages):
        import os

        for m in messages:
            if m is not None and os.path.exists(m.cells):
                os.remove(m.cells)


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all .npy files under ``path`` (any store that Spark reads); a task holds one file at a time."""

    def run(batches):
        import pandas as pd

        for b in batches:
            for name, raw in zip(b["path"], b["content"], strict=True):
                (h, w), kind, start = header(raw)
                grid = np.frombuffer(raw, kind, h * w, start)
                i = np.arange(h * w)
                yield pd.DataFrame({"raster_id": name.rsplit("/", 1)[-1].removesuffix(".npy"), "cell_id": i, "y": (i // max(w, 1)).astype(np.int32), "x": (i % max(w, 1)).astype(np.int32), "class_code": grid.astype(np.int32)})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def row_table(cells: DataFrame) -> DataFrame:
    """A raster as one row per grid line (raster_id, y, classes): the compact form to keep in Parquet."""
    line = F.sort_array(F.collect_list(F.struct("x", "class_code")))
    return cells.groupBy("raster_id", "y").agg(F.transform(line, lambda c: c["class_code"]).alias("classes"))
