"""Balanced shards from global byte-size prefix sums, equal texts together.

A group is the documents of one text. A group of more than 1/128 of a shard, of which there are fewer than 128 per shard,
is placed whole, the largest first, each into the shard that has least; one that is larger than a shard fills shards of
its own, document by document, and its rest is placed like the others. All other documents are range-partitioned in the
order (hash of the text, id). Per-partition totals, a table of one row per partition, are summed into offsets, and with
a running sum inside each partition every document gets its place in the corpus, counted in bytes. That order is cut
where each shard has what it needs to be level with the rest; a cut inside a group moves to the group's nearer end. So
equal texts share a shard unless they hold more than a shard's bytes, at any size, and shards differ by about 1/128.

Defined cases: null text: no bytes, size 1, CRC 0, of one group with empty texts; very long texts: one over a shard's
bytes is a shard of its own; ties: groups of one size by hash, shards of one size by number, a cut as near to either end
goes to the first; repeated rows: each has its own slot; null doc_id: first in its group; fewer documents than shards:
some shards stay empty; empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, plain, shared_table, tidy

KEY = ["h", "text_crc32", "size"]  # of a group
ORDER = [*KEY, "doc_id", "u"]


def place_groups(groups: list[tuple[int, int]], shards: int, total: int) -> tuple[list[tuple[int, int, int, int, int]], list[int], list[int]]:
    """groups (size of a document, documents) to parts (group, first, end, shard, first slot), bytes and rows per shard."""
    items = []
    for g, (size, rows) in enumerate(groups):
        each, at = max(1, total // shards // size), 0
        while rows - at > each:
            items.append((each * size, g, at, at + each))
            at += each
        items.append(((rows - at) * size, g, at, rows))
    bytes_, rows_, parts = [0] * shards, [0] * shards, []
    for size, g, a, b in sorted(items, key=lambda x: (-x[0], x[1:])):
        k = bytes_.index(min(bytes_))
        parts.append((g, a, b, k, rows_[k]))
        bytes_[k] += size
        rows_[k] += b - a
    return parts, bytes_, rows_


def level_targets(bytes_: list[int], rest: int) -> list[int]:
    """Places in the other documents' order, which has ``rest`` bytes, where the shards end: as level as can be."""
    low = sorted(bytes_)
    n = next(n for n in range(len(low), 0, -1) if n * low[n - 1] - sum(low[:n]) <= rest)
    level = (rest + sum(low[:n])) / n
    need = np.cumsum([max(0.0, level - b) for b in bytes_])
    return [int(x) for x in need[:-1]]


def byte_shards(docs: DataFrame, shards: int = 8, fine: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    slim = plain(docs, id_col, text_col).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("u"))
    slim = shared_table(slim, "sizes")
    total = slim.agg(F.sum("size")).first()[0] or 0
    large = slim.groupBy(*KEY).agg(F.count("*").alias("rows")).where(F.col("rows") * F.col("size") * (shards * fine) > total)
    large = sorted(tuple(r) for r in large.collect())  # fewer than shards * fine rows
    parts, bytes_, rows_ = place_groups([(size, rows) for _, _, size, rows in large], shards, total)
    names = spark.createDataFrame([(h, crc, size, g) for g, (h, crc, size, _) in enumerate(large)], "h long, text_crc32 long, size long, g int")

    def run(batches):
        from pyspark import TaskContext

        pid, at, small, rows = TaskContext.get().partitionId(), 0, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            size = np.asarray(b.column("size"))
            own = np.asarray(b.column("g").is_null().to_numpy(zero_copy_only=False)).astype(np.int64)
            places = at + np.cumsum(size * own) - size * own, small + np.cumsum(own) - own, rows + np.arange(len(size))
            at, small, rows = at + int((size * own).sum()), small + int(own.sum()), rows + len(size)
            cols = [b.column(c) for c in ("doc_id", "size", "text_crc32", "h", "g")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(size), pid, np.int32)), *map(pa.array, places)], names=["doc_id", "size", "text_crc32", "h", "g", "pid", "at", "small", "nth"])

    ranged = slim.join(F.broadcast(names), KEY, "left").repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER)
    ranged = shared_table(ranged.select(*ORDER, "g").mapInArrow(tidy(run), "doc_id long, size long, text_crc32 long, h long, g int, pid int, at long, small long, nth long"), "ranges")
    before = W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    totals = ranged.groupBy("pid").agg(F.sum(F.when(F.col("g").isNull(), F.col("size")).otherwise(0)).alias("bytes"), F.count_if(F.col("g").isNull()).alias("some"), F.count("*").alias("all"))
    base = totals.select("pid", count("bytes").alias("at0"), count("some").alias("small0"), count("all").alias("nth0"))
    placed = ranged.join(F.broadcast(base), "pid")  # a row per partition
    placed = placed.select("doc_id", "size", "text_crc32", "h", "g", (F.col("at") + F.col("at0")).alias("at"), (F.col("small") + F.col("small0")).alias("small"), (F.col("nth") + F.col("nth0")).alias("nth"))

    rest = placed.where("g is null")
    targets = level_targets(bytes_, total - sum(bytes_))
    inside = lambda t: (F.col("at") < t) & (F.col("at") + F.col("size") > t)
    hit = F.lit(False)
    for t in targets:
        hit = hit | inside(t)
    groups = rest.join(F.broadcast(rest.where(hit | F.col("at").isin(targets)).select(*KEY).distinct()), KEY, "left_semi")  # a group for each cut
    ends = [(r.a, r.b) for r in groups.groupBy(*KEY).agg(F.min("at").alias("a"), F.max(F.col("at") + F.col("size")).alias("b")).collect()]
    cuts = []
    for t in targets:
        a, b = next(((a, b) for a, b in ends if a <= t < b), (t, t))
        cuts.append(a if t - a <= b - t else b)
    shard = sum((F.when(F.col("at") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    out = rest.withColumn("shard", shard)
    first = out.groupBy("shard").agg(F.min("small").alias("first"))  # a row per shard
    rows_before = F.element_at(F.array(*[F.lit(r).cast("long") for r in rows_]), F.col("shard") + 1)
    out = out.join(F.broadcast(first), "shard").withColumn("slot", rows_before + F.col("small") - F.col("first"))
    begin = placed.where("g is not null").groupBy("g").agg(F.min("nth").alias("begin"))
    where = spark.createDataFrame(parts, "g int, a long, b long, shard int, base long")
    whole = placed.where("g is not null").join(F.broadcast(begin), "g").withColumn("rank", F.col("nth") - F.col("begin"))
    whole = whole.join(F.broadcast(where), "g").where("rank >= a and rank < b").withColumn("slot", F.col("base") + F.col("rank") - F.col("a"))
    columns = ["doc_id", "size", "text_crc32", "shard", "slot"]
    out = out.select(*columns).unionAll(whole.select(*columns))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
