"""Embedding near-duplicates: an exact metric range join on the unit sphere.

cos(u, v) >= c is a chord of at most r = sqrt(2 - 2c). A bounded number of pivots (refined on a bounded sample), always
several, splits the sphere into cells by nearest pivot. If u lies in the cell of p and v, whose own pivot is h, is within
r of u, the triangle inequality against the hyperplane between p and h gives (d(v,p)^2 - d(v,h)^2) / (2 d(p,h)) <= r;
such v are replicated to p's cell, or u to h's: of two cells the lower is joined if their numbers add to an even one,
else the higher, so each pair of vectors meets once and cells have equal shares. Cells join independently, crowded ones
in blocks of separate tasks. Inside a task vectors are sorted by their distance to the pivot, and blocks whose distances
lie more than r apart are passed over. Similarities are computed in double precision; pairs within 1e-12 of the
threshold are computed again term by term.

Equal vectors (by 96 bits of hash) are collapsed to one class with a multiplicity first. A task returns counts and a
spanning forest of the links found, never pairs.

Defined cases: null, empty or zero vectors and those with null or non-finite components link with nothing: n_links 0,
component_id their own id; vectors of different lengths never link; ties: a pair just at the threshold links, and a
vector as near to two pivots is the first one's; repeated rows are vectors of their own; a null vec_id links but is a
component_id only of components without other ids; empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, local_components, partitions, shared_table, tidy


def matrix(col: pa.Array, n: int) -> np.ndarray:
    return np.asarray(pa.concat_arrays([col]).flatten(), np.float64).reshape(n, -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit vectors: rows of the sample moved to the mean direction of what is nearest to them."""
    p = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(rounds):
        near = (sample @ p.T).argmax(axis=1)
        total = np.zeros_like(p)
        np.add.at(total, near, sample)
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        p = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), p)
    return p


def cells_of(x: np.ndarray, p: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, mask of every cell that a vector has to be in)."""
    d2 = np.maximum(2 - 2 * (x @ p.T), 0)
    home = d2.argmin(axis=1)
    gap = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))[home]
    mask = d2 - d2[np.arange(len(x)), home][:, None] <= 2 * r * gap + 1e-9
    mask[np.arange(len(x)), home] = True
    return home, mask


def sent_to(home: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The cells of ``mask`` that a vector is sent to: its own, and those that are joined with its own one."""
    cell = np.arange(mask.shape[1])
    even = (home[:, None] + cell) % 2 == 0
    return mask & ((cell == home[:, None]) | np.where(even, cell < home[:, None], cell > home[:, None]))


def block_pairs(a: np.ndarray, b: np.ndarray, r: float, side: int = 1024):
    """Starts of the blocks of two sorted lists of distances to a pivot that the triangle inequality doesn't rule out."""
    for i in range(0, len(a), side):
        for j in range(0, len(b), side):
            if b[j] - a[min(i + side, len(a)) - 1] <= r + 1e-9 and a[i] - b[min(j + side, len(b)) - 1] <= r + 1e-9:
                yield i, j


def _block_links(x, uid, mult, y, vid, vmult, away, pivot, c):
    """Counts for x's rows and y's (those ``away`` from their cell), and a forest of links between them.

    Single precision only sorts out what is far below the threshold; its error stays well under the margin.
    """
    far = [np.sqrt(np.maximum(2 - 2 * (z @ pivot), 0)) for z in (x, y)]
    i, j = (np.argsort(d, kind="stable") for d in far)
    x, uid, mult, y, vid, vmult, away = x[i], uid[i], mult[i], y[j], vid[j], vmult[j], away[j]
    count, other, edges = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    x4, y4, margin = x.astype(np.float32), y.astype(np.float32).T.copy(), np.float32(c - 1e-4 - 1e-7 * x.shape[1])
    for a, b in block_pairs(far[0][i], far[1][j], math.sqrt(max(0.0, 2 - 2 * c))):
        at = np.flatnonzero(x4[a : a + 1024] @ y4[:, b : b + 1024] >= margin)
        p, q = np.divmod(at, min(1024, len(y) - b))
        for k in range(0, len(at), 65536):
            m, n = a + p[k : k + 65536], b + q[k : k + 65536]
            s = np.einsum("ij,ij->i", x[m], y[n])
            ok = s >= c
            for near in np.flatnonzero(np.abs(s - c) < 1e-12):
                ok[near] = math.fsum((x[m[near]] * y[n[near]]).tolist()) >= c
            ok &= uid[m] != vid[n]
            m, n = m[ok], n[ok]
            np.add.at(count, m, vmult[n])
            np.add.at(other, n, mult[m])
            nodes, root = local_components(uid[m], vid[n])
            edges.append((nodes[nodes != root], root[nodes != root]))
    u, v = (np.concatenate(e) for e in zip(*edges, strict=True))
    nodes, root = local_components(u, v)
    return np.concatenate((uid, vid[away])), np.concatenate((count, other[away])), nodes[nodes != root], root[nodes != root]


def near_duplicates(vecs: DataFrame, threshold: float = 0.95, rows_per_pivot: int = 4096, least_pivots: int = 4, most_pivots: int = 512, sample_rows: int = 4096, block_rows: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; pivots are fitted on at most ``sample_rows`` vectors."""
    spark = vecs.sparkSession
    rows = vecs.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("e"))
    fine = F.coalesce((F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("fine", fine)
    name = F.struct(F.xxhash64("e").alias("a"), F.hash("e").alias("b")).alias("name")
    slim = rows.select("vec_id", F.when(F.col("fine"), name).alias("name"))  # vectors are shuffled once, below
    classes = rows.where("fine").groupBy(name).agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"), F.first("e").alias("e"))
    classes = shared_table(classes.select(F.monotonically_increasing_id().alias("uid"), "name", "e", "least", "mult", F.size("e").alias("dim")), "vectors")
    dims = {d: n for d, n in classes.groupBy("dim").count().collect()}
    r = math.sqrt(max(0.0, 2 - 2 * threshold))
    pivots = {}
    for d, n in dims.items():  # vectors of one length are a space of their own
        sample = classes.where(F.col("dim") == d).orderBy(F.xxhash64("uid"), "uid").limit(sample_rows).select("e").toArrow()
        pivots[d] = choose_pivots(unit(matrix(sample.column(0).combine_chunks(), len(sample))), min(most_pivots, max(least_pivots, -(-n // rows_per_pivot)), len(sample)))

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            dim = np.asarray(b.column(2))
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                part = b.take(pa.array(at))
                home, mask = cells_of(unit(matrix(part.column(1), len(at))), pivots[int(d)], r)
                i, cell = np.nonzero(sent_to(home, mask))
                got = part.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), got.column(2), got.column(3), pa.array(cell, pa.int32()), pa.array(home[i] == cell)], names=["uid", "e", "dim", "mult", "cell", "own"])

    kind = dict(classes.dtypes)["e"]
    placed = classes.select("uid", "e", "dim", "mult").repartition(partitions(spark), "uid").mapInArrow(tidy(place), f"uid long, e {kind}, dim int, mult long, cell int, own boolean")
    placed = shared_table(placed, "cells")
    sizes = placed.groupBy("dim", "cell").agg(F.sum(F.col("own").cast("int")).alias("homes"), F.count("*").alias("everyone"))  # at most most_pivots rows for a length
    cut = sizes.select("dim", "cell", F.ceil(F.col("homes") / block_rows).cast("int").alias("ni"), F.ceil(F.col("everyone") / block_rows).cast("int").alias("nj")).where("ni > 0")
    placed = placed.join(F.broadcast(cut), ["dim", "cell"])
    draw = lambda salt, n: F.pmod(F.xxhash64("uid", F.lit(salt)), F.col(n)).cast("int")
    left = placed.where("own").withColumn("bj", F.explode(F.sequence(F.lit(0), F.col("nj") - 1))).select("dim", "cell", draw(1, "ni").alias("bi"), "bj", F.lit(0).alias("side"), "uid", "mult", "e")
    right = placed.withColumn("bi", F.explode(F.sequence(F.lit(0), F.col("ni") - 1))).select("dim", "cell", "bi", draw(2, "nj").alias("bj"), F.when(F.col("own"), 1).otherwise(2).alias("side"), "uid", "mult", "e")

    def run(batches):
        held, key = [], None

        def joined():
            cols = [pa.concat_arrays([h.column(i) for h in held]) for i in range(4, 8)]
            side, uid, mult = (np.asarray(c) for c in cols[:3])
            x = unit(matrix(cols[3], len(uid)))
            a, b = side == 0, side > 0
            node, count, u, v = _block_links(x[a], uid[a], mult[a], x[b], uid[b], mult[b], side[b] == 2, pivots[key[0]][key[1]], threshold)
            names, counted = ["u", "v", "n"], count > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[counted]), pa.nulls(int(counted.sum()), pa.int64()), pa.array(count[counted])], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([np.asarray(b.column(i)) for i in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if key is not None and tuple(k[i]) != key:
                    yield from joined()
                    held = []
                key = tuple(k[i])
                held.append(b.slice(i, j - i))
        if held:
            yield from joined()

    dealt = left.unionAll(right).repartition(partitions(spark), "dim", "cell", "bi", "bj").sortWithinPartitions("dim", "cell", "bi", "bj")
    found = shared_table(dealt.mapInArrow(tidy(run), "u long, v long, n long"), "links")
    counts = found.where("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    comp = connected_components(found.where("v is not null").select("u", "v"))
    known = classes.drop("e").join(counts, classes.uid == counts.u, "left").join(comp, classes.uid == comp.node, "left").select("uid", "name", "least", "mult", "n", F.coalesce("component", "uid").alias("root"))
    known = known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("name", "component_id", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    fits = slim.where("name is not null").join(known, "name").select("vec_id", "n_links", "component_id")
    alone = slim.where("name is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return fits.unionAll(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
