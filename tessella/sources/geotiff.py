"""Single-band GeoTIFF: a reader for grids of any store that Spark reads, and a writer of int16 LZW files.

Classic TIFF, either byte order, strips or tiles, one sample a pixel; compression none, LZW or Deflate, predictor 1 or
2; the affine from pixel scale and tie point, the CRS as EPSG code, and the NoData text tag.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODE = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
META = "raster_id string, height int, width int, nodata double, crs string, bounds struct<left:double,bottom:double,right:double,top:double>, source string"


def lzw_decode(raw: bytes) -> bytes:
    out, bits, n, width, at = bytearray(), 0, 0, 9, 0
    table: list[bytes] = []
    last = b""
    while True:
        while n < width and at < len(raw):
            bits, n, at = (bits << 8 | raw[at]) & 0xFFFFFFFF, n + 8, at + 1
        if n < width:
            return bytes(out)
        code = bits >> (n - width) & ((1 << width) - 1)
        n -= width
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = max(9, (len(table) + 1).bit_length()) if len(table) < 4095 else 12


def lzw_encode(raw: bytes) -> bytes:
    out, bits, n, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            out.append(bits >> (n - 8) & 255)
            n -= 8
        bits &= (1 << n) - 1

    put(256)
    table = {bytes([i]): i for i in range(256)}
    free, word = 258, b""
    for i in range(len(raw)):
        more = word + raw[i : i + 1]
        if more in table:
            word = more
            continue
        put(table[word])
        table[more] = free
        free, word = free + 1, raw[i : i + 1]
        if free == 4095:
            put(256)
            table = {bytes([i]): i for i in range(256)}
            free, width = 258, 9
        elif free + 1 > (1 << width):
            width += 1
    if word:
        put(table[word])
        free += 1
        if free + 1 > (1 << width) and width < 12:
            width += 1
    put(257)
    if n:
        out.append(bits << (8 - n) & 255)
    return bytes(out)


def read(raw: bytes) -> tuple[np.ndarray, dict]:
    """(grid, meta with nodata, crs, bounds) of a file's only band."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("not a classic TIFF file")
    start = struct.unpack_from(order + "I", raw, 4)[0]
    tags = {}
    for k in range(struct.unpack_from(order + "H", raw, start)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", raw, start + 2 + 12 * k)
        size = _SIZE.get(kind, 1) * n
        at = start + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", raw, start + 10 + 12 * k)[0]
        tags[tag] = raw[at : at + n] if kind in (2, 7) else struct.unpack_from(f"{order}{n}{_CODE[kind]}", raw, at) if kind in _CODE else ()
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    if one(277, 1) != 1:
        raise ValueError("exactly one band is needed")
    w, h = one(256), one(257)
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[one(339, 1)] + str(one(258, 8) // 8))
    tiled = 324 in tags
    bh, bw = (one(323), one(322)) if tiled else (one(278, h), w)
    offsets, counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    unpack = {1: bytes, 5: lzw_decode, 8: zlib.decompress, 32946: zlib.decompress}[one(259, 1)]
    out, across = np.zeros((h, w), kind), -(-w // bw)
    for k, (o, n) in enumerate(zip(offsets, counts, strict=True)):
        y, x = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, h - y)
        block = np.frombuffer(unpack(raw[o : o + n]), kind, rows * bw).reshape(rows, bw)
        if one(317, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=kind)
        out[y : y + bh, x : x + bw] = block[: h - y, : w - x]
    meta = {"nodata": float(tags[42113].rstrip(b"\0 ")) if 42113 in tags else None, "crs": None, "bounds": None}
    if 33550 in tags and 33922 in tags:
        (sx, sy), tie = tags[33550][:2], tags[33922]
        left, top = tie[3] - tie[0] * sx, tie[4] + tie[1] * sy
        meta["bounds"] = (left, top - h * sy, left + w * sx, top)
    keys = tags.get(34735, ())
    for k in range(4, len(keys) - 3, 4):
        if keys[k] in (2048, 3072) and keys[k + 1] == 0:
            meta["crs"] = f"EPSG:{keys[k + 3]}"
    return out, meta


def write(grid: np.ndarray, bounds=None, epsg: int | None = None, nodata: float | None = None, rows: int = 64) -> bytes:
    """An int16 LZW file."""
    grid = np.ascontiguousarray(grid, "<i2")
    h, w = grid.shape
    strips = [lzw_encode(grid[y : y + rows].tobytes()) for y in range(0, h, rows)]
    tags: list[tuple[int, int, object]] = [(256, 4, [w]), (257, 4, [h]), (258, 3, [16]), (259, 3, [5]), (262, 3, [1]), (273, 4, None), (277, 3, [1]), (278, 4, [rows]), (279, 4, [len(s) for s in strips]), (339, 3, [2])]
    if bounds:
        left, bottom, right, top = bounds
        tags += [(33550, 12, [(right - left) / w, (top - bottom) / h, 0.0]), (33922, 12, [0.0, 0.0, 0.0, left, top, 0.0])]
    if epsg:
        tags.append((34735, 3, [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg]))
    if nodata is not None:
        tags.append((42113, 2, f"{nodata:g}\0".encode()))
    at = 8 + sum(map(len, strips))
    at += at % 2
    starts = np.cumsum([8, *map(len, strips)])[:-1].tolist()
    entries, extra = b"", b""
    extra_at = at + 2 + 12 * len(tags) + 4
    for tag, kind, value in tags:
        value = starts if value is None else value
        body = value if kind == 2 else struct.pack(f"<{len(value)}{_CODE[kind]}", *value)
        if len(body) > 4:
            place, extra = struct.pack("<I", extra_at + len(extra)), extra + body + b"\0" * (len(body) % 2)
        else:
            place = body.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, kind, len(value)) + place
    head = b"II" + struct.pack("<HI", 42, at) + b"".join(strips)
    return head.ljust(at, b"\0") + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra


def read_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells, metadata) of all .tif files under ``path``; NoData becomes class 0. A task holds one file at a time."""
    import pandas as pd

    def name(p: str) -> str:
        return p.rsplit("/", 1)[-1].rsplit(".", 1)[0]

    def cells(batches):
        for b in batches:
            for p, raw in zip(b["path"], b["content"], strict=True):
                grid, meta = read(raw)
                v = grid if meta["nodata"] is None else np.where(grid == meta["nodata"], 0, grid)
                i, w = np.arange(v.size), max(1, v.shape[1])
                yield pd.DataFrame({"raster_id": name(p), "cell_id": i, "y": (i // w).astype(np.int32), "x": (i % w).astype(np.int32), "class_code": v.ravel().astype(np.int32)})

    def metas(batches):
        for b in batches:
            rows = []
            for p, raw in zip(b["path"], b["content"], strict=True):
                grid, meta = read(raw)
                bounds = dict(zip(("left", "bottom", "right", "top"), meta["bounds"], strict=True)) if meta["bounds"] else None
                rows.append({"raster_id": name(p), "height": grid.shape[0], "width": grid.shape[1], "nodata": meta["nodata"], "crs": meta["crs"], "bounds": bounds, "source": p})
            yield pd.DataFrame(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(path).select("path", "content")
    return files.mapInPandas(cells, "raster_id string, cell_id long, y int, x int, class_code int"), files.mapInPandas(metas, META)
