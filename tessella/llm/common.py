"""Helpers shared by the corpus operators.

* shared tables: intermediate results go to the folder named by ``spark.checkpoint.dir`` so that they outlive a lost
  executor; a local master may do without that setting (tests on one machine), any other may not;
* packed chunks: a few MB of whole texts as one compressed row, so that later passes move few, large rows;
* bucket messages: what a chunk says about its names, one row per (chunk, bucket), and the replies to it;
* connected components on an edge table.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = np.int64(2**63 - 1)  # stands for a null id inside kernels; sorts after every real id
_own_dir: dict[str, str] = {}
_made: list[tuple[str, str]] = []

PACKED = "chunk long, ids binary, id_null binary, lens binary, blob binary"
MESSAGE = "bucket int, chunk long, kind int, p1 binary, p2 binary, p3 binary"
REPLY = "chunk long, kind int, bucket int, reply binary"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local master may leave it unset, and gets a temporary one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="tessella-")
    return _own_dir[app]


def shared_table(df: DataFrame, name: str, bucket: tuple[int, str] | None = None, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and return it as a table.

    With ``bucket`` (n, column) it is dealt out once, to a file for each of n buckets, and joins on that column need no
    further exchange of it.
    """
    spark, tag = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{tag}"
    _made.append((tag if bucket else "", path))
    if bucket:
        df.repartition(*bucket).write.format("parquet").bucketBy(*bucket).option("path", path).saveAsTable(tag)
        return spark.table(tag)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def own_tables():
    """A list that holds, at the end, the tables made meanwhile; :func:`release` of all others leaves them alone."""
    at, own = len(_made), []
    try:
        yield own
    finally:
        own += _made[at:]
        del _made[at:]


def release(spark: SparkSession, tables: list[tuple[str, str]] | None = None) -> int:
    """Delete intermediate tables, by default all made so far; results that still read them have to be written before.

    Shuffle files of queries that are no longer referred to go too, by a collection on the driver.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    tables = _made if tables is None else tables
    n = len(tables)
    while tables:
        tag, path = tables.pop()
        if tag:
            spark.sql(f"DROP TABLE IF EXISTS {tag}")
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    gc.collect()
    jvm.System.gc()
    return n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bound Arrow batches by bytes, as texts can be long; a session that bounds them already is left alone."""
    if not spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def tidy(kernel):
    """The kernel of an Arrow map whose worker hands unused memory back to the system when the task ends."""

    @wraps(kernel)
    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return run


def plain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Only the id (long), the text (string) and ``keep``, so that other columns, whatever their names, can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)


def text_arrays(batch: pa.RecordBatch, at: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts joined, start offsets of n + 1, null mask) of a string column, without Python objects."""
    col = batch.column(at)
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        null = np.asarray(col.is_null().to_numpy(zero_copy_only=False))
        col = col.fill_null(b"")
    else:
        null = np.zeros(len(col), bool)
    col = pa.concat_arrays([col])
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64, len(col) + 1 + col.offset)[col.offset :] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0], null


def id_arrays(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    null = np.asarray(col.is_null().to_numpy(zero_copy_only=False))
    return np.where(null, NO_ID, np.asarray(col.fill_null(0).to_numpy(zero_copy_only=False), np.int64)), null


def ids_out(ids: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=np.asarray(null, bool))


def pack(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """docs(doc_id, text) as packed chunks. A chunk holds whole documents; a longer document is a chunk of its own.

    Further columns of ``docs`` go along, row by row, as an Arrow stream in the column ``rest``.
    """
    more = docs.columns[2:]

    def run(batches):
        from pyspark import TaskContext

        base, seq = np.int64(TaskContext.get().partitionId()) << 32, 0
        held, size, rest = [], 0, []

        def flush():
            nonlocal seq, held, size, rest
            ids, null, lens, data = (np.concatenate(x) for x in zip(*held, strict=True))
            row = [[int(base + seq)], [ids.tobytes()], [null.astype(np.uint8).tobytes()], [lens.astype(np.int64).tobytes()], [zstandard.ZstdCompressor(level=3).compress(data.tobytes())]]
            names = ["chunk", "ids", "id_null", "lens", "blob"]
            if more:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest[0].schema) as out:
                    for x in rest:
                        out.write_batch(x)
                row.append([sink.getvalue().to_pybytes()])
                names.append("rest")
            seq, held, size, rest = seq + 1, [], 0, []
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *(pa.array(x, pa.binary()) for x in row[1:])], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            data, offs, _ = text_arrays(b)
            ids, null = id_arrays(b.column(0))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(offs, offs[at] + chunk_bytes - size, side="right")) - 1)
                held.append((ids[at:to], null[at:to], np.diff(offs[at : to + 1]), data[offs[at] : offs[to]]))
                if more:
                    rest.append(b.select(more).slice(at, to - at))
                size += int(offs[to] - offs[at])
                at = to
                if size >= chunk_bytes or at < b.num_rows:
                    yield flush()
        if held:
            yield flush()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(run), PACKED + ", rest binary" * bool(more))


def chunk_size(n: int, least: int = 1 << 20) -> int:
    """Bytes of a chunk for n buckets: at least 2 KB for each, so that what a chunk says to a bucket stays worth a row."""
    return max(least, 2048 * n)


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, null mask of ids, offsets of n + 1, bytes) of a packed chunk."""
    lens = np.frombuffer(row["lens"], np.int64)
    offs = np.concatenate((np.zeros(1, np.int64), np.cumsum(lens)))
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=max(1, int(offs[-1]))), np.uint8)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["id_null"], np.uint8).astype(bool), offs, data


def chunk_rows(batches, columns: list[str]):
    """Rows of Arrow batches as dicts, one at a time."""
    for b in batches:
        cols = [b.column(i) for i in range(b.num_columns)]
        for i in range(b.num_rows):
            yield {n: c[i].as_py() for n, c in zip(columns, cols, strict=True)}


def joined(batches, rows: int):
    """Arrow batches put together to at least ``rows`` rows, but for the last."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held, size = [*held, b], size + b.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


MESSAGE_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("p1", pa.binary()), ("p2", pa.binary()), ("p3", pa.binary())])
REPLY_ARROW = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("reply", pa.binary())])


def split_by_bucket(bucket: np.ndarray, n: int):
    """(bucket, indices) of each bucket that has entries; indices keep their order."""
    order = np.argsort(bucket.astype(np.uint16) if n < 65536 else bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(ends)):
        yield int(k), order[ends[k] : ends[k + 1]]


def answered(messages: DataFrame, reducers: dict, n: int, keep: tuple[int, ...] = ()) -> DataFrame:
    """Deal bucket messages out and let ``reducers[kind](rows)`` give the reply (bytes) to each row of a task.

    Messages of the kinds in ``keep`` go through as they are, as replies of bucket -1.
    """

    def run(batches):
        rows = []
        for r in chunk_rows(batches, ["bucket", "chunk", "kind", "p1", "p2", "p3"]):
            if r["kind"] in keep:
                yield to_batch([(r["chunk"], r["kind"], -1, r["p1"])], REPLY_ARROW)
            else:
                rows.append(r)
        for kind, reducer in reducers.items():
            own = sorted((r for r in rows if r["kind"] == kind), key=lambda r: (r["chunk"], r["bucket"]))
            if own:
                out = [(r["chunk"], kind, r["bucket"], reply) for r, reply in zip(own, reducer(own), strict=True)]
                yield to_batch(out, REPLY_ARROW)

    return messages.repartitionById(n, F.col("bucket")).mapInArrow(tidy(run), REPLY)


def with_replies(packed: DataFrame, replies: DataFrame) -> DataFrame:
    """packed + ``replies``: array of (kind, bucket, reply); chunks without a reply have null there."""
    got = replies.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "reply")).alias("replies"))
    return packed.hint("merge").join(got, "chunk", "left")


def reply_map(row: dict) -> dict[tuple[int, int], bytes]:
    return {(x["kind"], x["bucket"]): x["reply"] for x in row["replies"] or ()}


def name_messages(names: np.ndarray, several: np.ndarray, chunk: int, kind: int, n: int):
    """Messages of a chunk's distinct 47-bit names, with a bit for those that it has in several places itself."""
    said = (names << np.uint64(1) | several).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    for k, i in split_by_bucket((names % np.uint64(n)).astype(np.int64), n):
        yield k, chunk, kind, said[i].tobytes(), b"", b""


def bits_of(got: dict, kind: int, names: np.ndarray, n: int) -> np.ndarray:
    """The bits that were replied about ``names``."""
    out = np.zeros(len(names), bool)
    for k, i in split_by_bucket((names % np.uint64(n)).astype(np.int64), n):
        out[i] = np.unpackbits(np.frombuffer(got[kind, k], np.uint8), count=len(i)).astype(bool)
    return out


def shared_names(rows: list[dict]) -> list[bytes]:
    """Replies to :func:`name_messages`: a bit for each name that occurs in several places."""
    sizes = [len(r["p1"]) // 6 for r in rows]
    said = np.zeros((sum(sizes), 8), np.uint8)
    said[:, :6] = np.frombuffer(b"".join(r["p1"] for r in rows), np.uint8).reshape(-1, 6)
    said = said.view("<u8")[:, 0]
    name, several = said >> np.uint64(1), (said & np.uint64(1)).astype(bool)
    order = np.argsort(name, kind="stable")
    start = np.flatnonzero(np.concatenate(([True], np.diff(name[order]) != 0)))
    size = np.diff(np.append(start, len(name)))
    both = (size > 1) | np.logical_or.reduceat(several[order], start)
    out = np.empty(len(name), bool)
    out[order] = np.repeat(both, size)
    return [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_draw = np.random.default_rng(21)
_BYTE = _draw.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[32] = 0  # the space behind a word adds nothing to its hash
_PLACE = _draw.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)


class Words:
    """The words of texts: ``bytes`` holds every word followed by one space, word i at at[i] with length[i] bytes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        raw, edge = data.tobytes(), offs.tolist()
        split = [raw[i:j].split() for i, j in zip(edge[:-1], edge[1:], strict=True)]
        n = np.array([len(w) for w in split], np.int64)
        self.bytes = np.frombuffer(b"".join([x for w in split if w for x in (b" ".join(w), b" ")]), np.uint8)
        self.doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        end = np.flatnonzero(self.bytes == 32)
        self.at = np.concatenate((np.zeros(1, np.int64), end[:-1] + 1)) if len(end) else end
        self.length = end - self.at
        if not len(end):
            self.hash = np.zeros(0, np.uint64)
            return
        place = np.arange(len(self.bytes), dtype=np.int32) - np.repeat(self.at.astype(np.int32), self.length + 1)
        place &= 4095
        self.hash = mix(np.add.reduceat(_BYTE[self.bytes] * _PLACE[place], self.at) + self.length.astype(np.uint64))


def local_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) of the edges (u, v), by min-label hooking and pointer jumping."""
    nodes, flat = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (up := label[label]).tolist() != label.tolist() if len(label) < 64 else not np.array_equal(up := label[label], label):
            label = up
    return nodes, nodes[label]


def connected_components(edges: DataFrame, most_rounds: int = 60, most_local: int = 1 << 21) -> DataFrame:
    """edges(u, v: long) to (node, component): the smallest node that each node reaches. Nodes without an edge don't appear.

    Each task first reduces its edges to a star forest. Forests of at most ``most_local`` edges together (counted; 16
    bytes each) are merged in one task; of larger ones large-star and small-star rounds alternate until nothing changes,
    each round written to the shared folder, and joins with a hot node are split by AQE. The result is the same.
    """

    def forest(batches):
        got = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
        if got:
            nodes, root = local_components(*(np.concatenate(x).astype(np.int64) for x in zip(*got, strict=True)))
            keep = nodes != root
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], names=["u", "v"])

    e = shared_table(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").mapInArrow(tidy(forest), "u long, v long").distinct(), "edges")
    if e.count() <= most_local:
        e = shared_table(e.coalesce(1).mapInArrow(tidy(forest), "u long, v long"), "components")
        return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        top = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(top, "u").select(F.col("v").alias("a"), "m", "u")
        small = small.where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        e = shared_table(small.distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
