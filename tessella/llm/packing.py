"""Hierarchical residual best-fit packing of token pieces into sequences.

Texts are tokenised whole, the end id is appended, and only documents above the capacity are cut, into full pieces with
the shorter piece first. Full pieces are sequences already. Of the rest each task packs its own share best-fit
decreasing; bins at 99 % or more are emitted, and the others go up a tree of ever fewer tasks as items of their own
size, to be packed best-fit again. After a best-fit task no two of its bins fit together, so at most one is half empty
or less; hence above it no more than one bin per task below can ever find a partner, and a task hands up at most that
many bins of one fill. Nothing that could be merged stays behind and no task gets an unbounded share.

Defined cases: null or empty text: the end id alone; very long texts: tokenised whole, one at a time; ties of fill or
size: the lowest number first; repeated rows: packed one by one; null doc_id: kept; empty table:
no rows; other columns are ignored. Texts that contain a special token's string are encoded by the tokenizers library
as it does by default; others by the same vocabulary's rank file, whose ids are the same and come several times faster.
"""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_arrays, ids_out, plain, shared_table, small_batches, text_arrays, tidy

_encoders: dict = {}


def encoder(path: str):
    """text -> ids by the vocabulary at ``path`` (a tokenizers JSON file; a .tiktoken file beside it is used if there)."""
    if path not in _encoders:
        import json

        import tokenizers

        slow = tokenizers.Tokenizer.from_file(path)
        special = [x["content"] for x in json.loads(slow.to_str())["added_tokens"]]
        whole = lambda text: slow.encode(text, add_special_tokens=False).ids
        ranks = Path(path).with_suffix(".tiktoken")
        if ranks.exists():
            import base64

            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.open("rb"))}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
            _encoders[path] = lambda text: whole(text) if any(s in text for s in special) else fast(text)
        else:
            _encoders[path] = whole
    return _encoders[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every piece of every document."""

    def run(batches):
        encode = encoder(path)
        for b in batches:
            data, offs, _ = text_arrays(b)
            raw, at = data.tobytes(), offs.tolist()
            ids, null = id_arrays(b.column(0))
            cols = [[], [], [], [], []]
            tokens = []
            for row, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
                own = np.array([*encode(raw[i:j].decode()), end_id], "<u4")
                start = 0
                for piece in range(-(-len(own) // capacity)):
                    stop = start + ((len(own) - 1) % capacity + 1 if piece == 0 else capacity)
                    for c, x in zip(cols, (row, piece, start, stop - start, zlib.crc32(own[start:stop].tobytes())), strict=True):
                        c.append(x)
                    if with_ids:
                        tokens.append(own[start:stop].astype(np.int32))
                    start = stop
            rows = np.array(cols[0], np.int64)
            out = [ids_out(ids[rows], null[rows]), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(tokens, pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)

    small_batches(docs.sparkSession)
    return plain(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin of each item, its offset there). The fullest bin that an item fits is a bit search."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = mask >> s
        if fits:
            space = s + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                mask ^= 1 << space
        else:
            b, space, count = count, capacity, count + 1
        bins[i], offsets[i] = b, capacity - space
        if space > s:
            if not by_space[space - s]:
                mask |= 1 << (space - s)
            by_space[space - s].append(b)
    return bins, offsets


def _round(items: DataFrame, tasks: int, level: int, capacity: int, most_up: int) -> DataFrame:
    """items(item, size) to (item, bin, at, fill, up)."""

    def run(batches):
        from pyspark import TaskContext

        got = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
        if not got:
            return
        item, size = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(item)
        item, size = item[order], size[order]
        bins, at = best_fit(size, capacity)
        fill = np.bincount(bins, weights=size).astype(np.int64)
        by = np.argsort(fill, kind="stable")
        start = np.searchsorted(fill[by], fill[by], side="left")
        nth = np.empty(len(fill), np.int64)
        nth[by] = np.arange(len(fill)) - start
        up = (fill < 0.99 * capacity) & (nth < most_up)
        base = (level << 58) | (TaskContext.get().partitionId() << 32)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(bins + base), pa.array(at), pa.array(fill[bins]), pa.array(up[bins])], names=["item", "bin", "at", "fill", "up"])

    dealt = items.repartitionById(tasks, F.pmod(F.xxhash64("item", F.lit(level)), F.lit(tasks)).cast("int"))
    return shared_table(dealt.mapInArrow(tidy(run), "item long, bin long, at long, fill long, up boolean"), "bins")


def pack(pieces: DataFrame, capacity: int = 2048, rows_per_task: int = 50_000, fan_in: int = 8) -> DataFrame:
    """pieces(length, ...) with sequence_id and offset; ``pieces`` is written once, as tokens are costly."""
    pieces = shared_table(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    part = pieces.where(F.col("length") < capacity)
    most = tasks = max(1, -(-part.count() // rows_per_task))
    level = 1
    chain = [_round(part.select(F.col("uid").alias("item"), F.col("length").alias("size")), tasks, level, capacity, most)]
    while tasks > 1:
        tasks, level = -(-tasks // fan_in), level + 1
        rest = chain[-1].where("up").groupBy("bin").agg(F.first("fill").alias("size")).withColumnRenamed("bin", "item")
        chain.append(_round(rest, tasks, level, capacity, most))
    at = chain[0].select(F.col("item").alias("uid"), "bin", "at")
    for c in chain[1:]:
        above = c.select(F.col("item").alias("bin"), F.col("bin").alias("higher"), F.col("at").alias("more"))
        at = at.join(above, "bin", "left").select("uid", F.coalesce("higher", "bin").alias("bin"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at"))
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.join(at, "uid").withColumn("sequence_id", F.col("bin")).withColumn("offset", F.col("at")).drop("bin", "at")
    return full.unionByName(rest).drop("uid")
