"""Patches, patch graphs, hop distances and cheapest bridges, as DataFrame iterations and bounded kernels."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled
from .raster import NEIGHBOURS

TILE = 256  # side of the tiles that are labelled locally: a bounded group


def _least_reached(batches):
    """Components of all edges of one task: nodes are (raster_id, id)."""
    parts = [p for p in batches if len(p)]
    if parts:
        e = pd.concat(parts)
        ends = pd.concat([e[["ru", "iu"]].set_axis(["raster_id", "id"], axis=1), e[["rv", "iv"]].set_axis(["raster_id", "id"], axis=1)])
        nodes = ends.drop_duplicates().sort_values(["raster_id", "id"], ignore_index=True)
        number = pd.MultiIndex.from_frame(nodes).get_indexer(pd.MultiIndex.from_frame(ends))
        label = merge_labels(len(nodes), number[: len(e)], number[len(e) :])
        yield nodes.assign(root=nodes["id"].to_numpy()[label])


def components(edges: DataFrame, most_rounds: int = 60, most_local: int = 200_000) -> DataFrame:
    """edges(u, v), nodes struct(raster_id, id), to (node, component): the least node that each reaches.

    Up to ``most_local`` edges (counted) are merged in one task. Beyond, large-star and small-star rounds alternate
    until the edge table is a forest of stars; each round is written once.
    """
    e = settled(edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct())
    name = e.schema["u"].dataType.fields[1].name
    if e.count() <= most_local:
        flat = e.select(F.col("u.raster_id").alias("ru"), F.col(f"u.{name}").alias("iu"), F.col("v.raster_id").alias("rv"), F.col(f"v.{name}").alias("iv"))
        out = flat.coalesce(1).mapInPandas(_least_reached, "raster_id string, id long, root long")
        node = lambda c: F.struct(F.col("raster_id"), F.col(c).alias(name))
        return out.select(node("id").alias("node"), node("root").alias("component"))
    seen = None
    for _ in range(most_rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        e = settled(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def merge_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n nodes over the edges (a, b)."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        if not (la != lb).any():
            return label
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label = up


def grid_links(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of 4-neighbours among cells sorted by (y, x)."""
    wide = np.int64(x.max() + 2) if len(x) else np.int64(1)
    key = y.astype(np.int64) * wide + x
    out = []
    for step in (1, wide):
        at = np.minimum(np.searchsorted(key, key + step), max(len(key) - 1, 0))
        i = np.flatnonzero(key[at] == key + step) if len(key) else at
        out.append((i, at[i]))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def _label_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["y", "x"])
    y, x, cell = (pdf[c].to_numpy() for c in ("y", "x", "cell_id"))
    a, b = grid_links(y, x)
    label = merge_labels(len(y), a, b)
    inner = np.bincount(np.concatenate((a, b)), minlength=len(y)) == 4
    least = np.full(len(y), np.iinfo(np.int64).max)
    np.minimum.at(least, label, cell)
    return pd.DataFrame({"raster_id": pdf["raster_id"], "cell_id": cell, "y": y, "x": x, "part": least[label], "rim": ~inner})


def label_patches(habitat: DataFrame, tile: int = TILE) -> DataFrame:
    """habitat(raster_id, cell_id, y, x) to (raster_id, cell_id, y, x, patch_id, rim): 4-connected patches.

    Tiles are labelled on their own; parts that touch across a tile border are joined by a component search over
    border pairs only. rim: the cell may have a non-habitat neighbour.
    """
    keys = [F.expr(f"y div {tile}").alias("ty"), F.expr(f"x div {tile}").alias("tx")]
    local = habitat.select("raster_id", "cell_id", "y", "x").groupBy("raster_id", *keys).applyInPandas(_label_tile, "raster_id string, cell_id long, y int, x int, part long, rim boolean")
    local = settled(local)
    here = local.select("raster_id", "y", "x", F.struct("raster_id", "part").alias("u"))
    pairs = None
    for axis in ("y", "x"):
        far = here.where(F.col(axis) % tile == 0).withColumn(axis, F.col(axis) - 1).withColumnRenamed("u", "v")
        got = here.where(F.col(axis) % tile == tile - 1).join(far, ["raster_id", "y", "x"]).select("u", "v")
        pairs = got if pairs is None else pairs.unionAll(got)
    joined = components(pairs.distinct())
    joined = joined.select(F.col("node.raster_id").alias("raster_id"), F.col("node.part").alias("part"), F.col("component.part").alias("whole"))
    out = local.join(joined, ["raster_id", "part"], "left")
    return settled(out.select("raster_id", "cell_id", "y", "x", F.coalesce("whole", "part").alias("patch_id"), "rim"))


def half_stencil(r: float) -> list[tuple[int, int]]:
    """One of each pair of opposite lattice steps with length at most r."""
    k = int(r)
    return [(dy, dx) for dy in range(0, k + 1) for dx in range(-k, k + 1) if (dy > 0 or dx > 0) and dy * dy + dx * dx <= r * r]


def cell_pairs(cells: DataFrame, r: float, keep: list[str]) -> DataFrame:
    """Pairs of cells at most r apart: an equi-join on the places that a fixed stencil reaches, no theta join.

    The exploded side counts by the size of its input and would be broadcast, so the join is held to a shuffle.
    """
    steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in half_stencil(r)])
    near = cells.select("raster_id", *[F.col(c).alias("a_" + c) for c in keep], "y", "x", F.explode(steps).alias("s"))
    near = near.select("raster_id", *["a_" + c for c in keep], (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    return near.hint("merge").join(cells.select("raster_id", "y", "x", *[F.col(c).alias("b_" + c) for c in keep]), ["raster_id", "y", "x"]).drop("y", "x")


def distance_pairs(habitat: DataFrame, r: float) -> DataFrame:
    """(raster_id, lo, hi): habitat cells at most r apart."""
    p = cell_pairs(habitat, r, ["cell_id"])
    return p.select("raster_id", F.least("a_cell_id", "b_cell_id").alias("lo"), F.greatest("a_cell_id", "b_cell_id").alias("hi"))


def patch_edges(labelled: DataFrame, r: float) -> DataFrame:
    """(raster_id, lo, hi): patches with cells at most r apart. Only rim cells can be the nearest of two patches."""
    p = cell_pairs(labelled.where("rim"), r, ["patch_id"]).where("a_patch_id <> b_patch_id")
    return p.select("raster_id", F.least("a_patch_id", "b_patch_id").alias("lo"), F.greatest("a_patch_id", "b_patch_id").alias("hi")).distinct()


def patch_areas(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("raster_id", "patch_id").agg(F.count("*").alias("area"))


def patch_components(areas: DataFrame, edges: DataFrame) -> DataFrame:
    """(raster_id, patch_id, component_id) of every patch."""
    node = lambda c: F.struct(F.col("raster_id"), F.col(c).alias("id"))
    comp = components(edges.select(node("lo").alias("u"), node("hi").alias("v")))
    comp = comp.select(F.col("node.raster_id").alias("raster_id"), F.col("node.id").alias("patch_id"), F.col("component.id").alias("component_id"))
    return areas.select("raster_id", "patch_id").join(comp, ["raster_id", "patch_id"], "left").select("raster_id", "patch_id", F.coalesce("component_id", "patch_id").alias("component_id"))


def hop_distances_frames(areas: DataFrame, edges: DataFrame) -> DataFrame:
    """(raster_id, src, dst, hop) of reachable pairs, by level-synchronous search: graphs of any size, a round per level."""
    both = settled(edges.select("raster_id", F.col("lo").alias("a"), F.col("hi").alias("b")).unionAll(edges.select("raster_id", F.col("hi").alias("a"), F.col("lo").alias("b"))))
    seen = front = settled(areas.select("raster_id", F.col("patch_id").alias("src"), F.col("patch_id").alias("dst"), F.lit(0).alias("hop")))
    level = 0
    while not front.isEmpty():
        level += 1
        step = front.join(both, (front.raster_id == both.raster_id) & (front.dst == both.a)).select(front.raster_id, "src", F.col("b").alias("dst"), F.lit(level).alias("hop")).distinct()
        front = settled(step.join(seen.select("raster_id", "src", "dst"), ["raster_id", "src", "dst"], "left_anti"))
        seen = seen.unionAll(front)
    return seen


def _both_ways(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the edges in both directions, sorted by their end."""
    u, v = np.concatenate((a, b)), np.concatenate((b, a))
    order = np.argsort(v, kind="stable")
    return u[order], v[order]


def _words(marks: np.ndarray) -> np.ndarray:
    """Boolean rows as bits in 64-bit words."""
    bits = np.packbits(marks, axis=1)
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)


def levels(u: np.ndarray, v: np.ndarray, start: np.ndarray):
    """(nodes, bits of the sources that reach them now, hop), a level at a time; start: words of hop 0.

    Sources are bits, so a level costs one OR over the edges that leave the nodes of the last one.
    """
    reach = start.copy()
    at = np.flatnonzero(reach.any(axis=1))
    bits, place, hop = reach[at], np.full(len(reach), -1), 0
    while len(at):
        yield at, bits, hop
        place[at] = np.arange(len(at))
        edge = np.flatnonzero(place[u] >= 0)
        if not len(edge):
            return
        to = v[edge]
        heads = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        grown = np.bitwise_or.reduceat(bits[place[u[edge]]], heads, axis=0)
        place[at] = -1
        to = to[heads]
        grown &= ~reach[to]
        hit = grown.any(axis=1)
        at, bits, hop = to[hit], grown[hit], hop + 1
        reach[at] |= bits


def spread(n: int, a: np.ndarray, b: np.ndarray, start: np.ndarray):
    """(source index, node index, hop) arrays of all that the sources reach, a level at a time for all of them.

    start [n, sources]: the nodes of hop 0.
    """
    for at, bits, hop in levels(*_both_ways(a, b), _words(start)):
        node, src = np.nonzero(np.unpackbits(bits.view(np.uint8), axis=1, count=start.shape[1]))
        yield src, at[node], hop


def neighbourhoods(n: int, u: np.ndarray, v: np.ndarray, most: int = 256):
    """(nodes, words of hop 0) of blocks of at most ``most`` nodes that lie close together, each node in one block.

    Searches from nodes side by side pass a place at nearly the same level, so few levels touch it.
    """
    first = np.searchsorted(v, np.arange(n + 1))
    left, block, seeds = np.ones(n, bool), [], list(range(n))[::-1]
    while seeds:
        queue = [seeds.pop()]
        if not left[queue[0]]:
            continue
        left[queue[0]] = False
        for k, node in enumerate(queue):
            if len(block) == most:
                left[queue[k:]] = True
                seeds += queue[k:]
                break
            block.append(node)
            near = u[first[node] : first[node + 1]]
            near = np.unique(near[left[near]])
            left[near] = False
            queue += near.tolist()
        if len(block) == most or not seeds:
            yield _block(n, block)
            block = []
    if block:
        yield _block(n, block)


def _block(n: int, own: list[int]) -> tuple[np.ndarray, np.ndarray]:
    start = np.zeros((n, len(own)), bool)
    start[own, np.arange(len(own))] = True
    return np.array(own, np.int64), _words(start)


def weights_of(bits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row of bits, the sum of the (whole) sizes of its sources: a count of bits for each digit of the sizes."""
    total = np.zeros(len(bits))
    for digit in range(int(sizes.max(initial=0)).bit_length()):
        mask = _words(((sizes >> digit) & 1).astype(bool)[None, :])[0]
        for k in np.flatnonzero(mask):
            total += np.bitwise_count(bits[:, k] & mask[k]) * float(1 << digit)
    return total


def hop_areas(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """For each hop, from 0 on, the size that each node has at that hop. Repeated edges don't matter.

    Searched from a block of sources at a time, so memory follows the graph and not its square.
    """
    n, out = len(sizes), [sizes.astype(np.float64)]  # sums stay below 2^53, so they are exact
    sizes = sizes.astype(np.int64)
    u, v = _both_ways(a, b)
    for own, start in neighbourhoods(n, u, v):
        for at, bits, hop in levels(u, v, start):
            if hop == len(out):
                out.append(np.zeros(n))
            if hop:
                out[hop][at] += weights_of(bits, sizes[own])
    return out


FAR = 16383  # more than any hop


def hop_matrix(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hops between all n nodes, FAR where there is no way."""
    out = np.full((n, n), FAR, np.int16)
    u, v = _both_ways(a, b)
    for own, start in neighbourhoods(n, u, v):
        for at, bits, hop in levels(u, v, start):
            node, src = np.nonzero(np.unpackbits(bits.view(np.uint8), axis=1, count=len(own)))
            out[own[src], at[node]] = hop
    return out


class Ways:
    """Hops from any nodes of a sparse graph, by elimination: a node taken out leaves ways among those it was linked to.

    Nodes of few links go first, so on graphs that lie in a plane few ways are added. Then a node's hops follow from those of
    the nodes that it led to when it was taken out: a few row operations a node, however long the ways are. Nodes are
    renumbered by :attr:`place` so that neighbours lie close together and each leads to later ones only.
    """

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray):
        near: list[dict[int, int]] = [{} for _ in range(n)]
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if i != j:
                near[i][j] = near[j][i] = 1
        heap, gone, order = [(len(x), v) for v, x in enumerate(near)], [False] * n, []
        heapify(heap)
        while heap:
            links, v = heappop(heap)
            ups = near[v]
            if gone[v] or links != len(ups):
                continue
            gone[v] = True
            order.append(v)
            for u, w in ups.items():
                own = near[u]
                del own[v]
                for x, wx in ups.items():
                    if x != u and own.get(x, FAR) > w + wx:
                        own[x] = w + wx
                heappush(heap, (len(own), u))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        below: list[list[int]] = [[] for _ in range(n)]
        roots = []
        for v in order:
            (below[min(near[v], key=rank.__getitem__)] if near[v] else roots).append(v)
        self.n, self.place, at, todo = n, np.empty(n, np.int64), n, roots
        while todo:  # each node before those below it, from the end on
            v = todo.pop()
            at -= 1
            self.place[v] = at
            todo += below[v]
        self._ups: list = [None] * n
        for v, x in enumerate(near):
            self._ups[self.place[v]] = self.place[list(x)].astype(np.int64) if x else np.zeros(0, np.int64), np.array(list(x.values()), np.int16)[:, None]

    def hops(self, sources: np.ndarray) -> np.ndarray:
        """[n, sources] hops, FAR where there is no way; all by their places."""
        out = np.full((self.n, len(sources)), FAR, np.int16)
        out[sources, np.arange(len(sources))] = 0
        leads = np.zeros(self.n, bool)
        leads[sources] = True
        for v in range(int(sources.min(initial=self.n)), self.n):
            if leads[v]:
                ups, w = self._ups[v]
                out[ups] = np.minimum(out[ups], out[v] + w)
                leads[ups] = True
        for v in range(self.n - 1, -1, -1):
            ups, w = self._ups[v]
            if len(ups):
                np.minimum(out[v], (out[ups] + w).min(axis=0), out=out[v])
        return out


def sums_between(hops: np.ndarray, rows: np.ndarray, columns: np.ndarray, width: int, held: int = 1 << 19) -> np.ndarray:
    """Sum of the products of the rows' and columns' sizes at each hop; hops of ``width`` or more count as no way."""
    out = np.zeros(width + 1)
    order, step = np.argsort(rows, kind="stable"), max(1, held // max(1, len(columns)))
    cuts = np.flatnonzero(np.diff(rows[order], prepend=-1, append=-1))
    for lo, hi in zip(cuts, cuts[1:]):  # rows of one size
        for k in range(lo, hi, step):
            own = np.minimum(hops[order[k : min(hi, k + step)]], width)
            out += rows[order[lo]] * np.bincount(own.ravel(), np.tile(columns, len(own)), width + 1)
    return out[:width]


def hop_sums(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> list[int]:
    """Sum of size products of all ordered node pairs at each hop, from 0 on."""
    return [int(sizes @ x) for x in hop_areas(a, b, sizes)]


def _searches(areas: DataFrame, edges: DataFrame, block: int) -> DataFrame:
    """(raster_id, nodes, sizes, a, b, part, own): a raster's patch graph for each share of its patches, numbered, as sources.

    Blocks of sources lie close together; the edges a and b are numbers of patches too.
    """
    tasks = max(1, int(areas.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    nodes = F.sort_array(F.collect_list(F.struct("patch_id", F.col("area").cast("long").alias("area"))))
    nodes = areas.groupBy("raster_id").agg(nodes.alias("n")).select("raster_id", F.col("n.patch_id").alias("nodes"), F.col("n.area").alias("sizes"))
    links = edges.groupBy("raster_id").agg(F.collect_list(F.struct("lo", "hi")).alias("e")).select("raster_id", F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi"))
    none = F.array().cast("array<bigint>")

    def deal(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                nodes = np.asarray(r.nodes, np.int64)
                a, b = (np.searchsorted(nodes, np.asarray(x, np.int64)) for x in (r.lo, r.hi))
                blocks = [own for own, _ in neighbourhoods(len(nodes), *_both_ways(a, b), block)]
                parts = min(4 * tasks, len(blocks))
                for k in range(parts):
                    own = np.concatenate(blocks[len(blocks) * k // parts : len(blocks) * (k + 1) // parts])
                    yield pd.DataFrame({"raster_id": [r.raster_id], "nodes": [nodes], "sizes": [r.sizes], "a": [a], "b": [b], "part": [k], "own": [own]})

    out = nodes.join(links, "raster_id", "left").select("raster_id", "nodes", "sizes", F.coalesce("lo", none).alias("lo"), F.coalesce("hi", none).alias("hi"))
    dealt = out.mapInPandas(deal, "raster_id string, nodes array<long>, sizes array<long>, a array<long>, b array<long>, part int, own array<long>")
    return dealt.repartition(tasks, "raster_id", "part")


def _searched(areas: DataFrame, edges: DataFrame, block: int, found, schema: str) -> DataFrame:
    """Record batches of found(raster, nodes, sizes, blocks), blocks: (source numbers, levels) of every block of a share."""

    def run(batches):
        for batch in batches:
            for r in (batch.slice(k, 1) for k in range(batch.num_rows)):
                nodes, sizes, a, b, own = (r[c][0].values.to_numpy() for c in ("nodes", "sizes", "a", "b", "own"))
                u, v = _both_ways(a, b)
                parts = (own[k : k + block] for k in range(0, len(own), block))
                yield from found(r["raster_id"][0], nodes, sizes, ((x, levels(u, v, _block(len(nodes), x)[1])) for x in parts))

    return _searches(areas, edges, block).mapInArrow(run, schema)


MOST_ROWS = 1 << 18  # rows of a batch that a search gives on, give or take a level


def _pairs_found(raster, nodes: np.ndarray, sizes: np.ndarray, blocks):
    """Batches (raster_id, src, dst, hop)."""
    import pyarrow as pa

    held: list[tuple] = []

    def batch():
        src, dst, hop = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.repeat(raster, len(src)), pa.array(nodes[src]), pa.array(nodes[dst]), pa.array(hop)], ["raster_id", "src", "dst", "hop"])

    n = 0
    for own, steps in blocks:
        for at, bits, hop in steps:
            node, src = np.nonzero(np.unpackbits(bits.view(np.uint8), axis=1, count=len(own)))
            held.append((own[src], at[node], np.full(len(src), hop, np.int32)))
            n += len(src)
            if n >= MOST_ROWS:
                yield batch()
                n = 0
    if held:
        yield batch()


def _products_found(raster, nodes: np.ndarray, sizes: np.ndarray, blocks):
    """A batch (raster_id, hop, s), the pairs only counted by their sizes and never listed."""
    import pyarrow as pa

    sums: dict[int, int] = {}
    for own, steps in blocks:
        for at, bits, hop in steps:
            sums[hop] = sums.get(hop, 0) + int(sizes[at] @ weights_of(bits, sizes[own]).astype(np.int64))
    yield pa.RecordBatch.from_arrays([pa.repeat(raster, len(sums)), pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.int64())], ["raster_id", "hop", "s"])


def hop_distances(areas: DataFrame, edges: DataFrame, most_edges: int = 200_000, block: int = 256) -> DataFrame:
    """(raster_id, src, dst, hop) of reachable pairs.

    Where all patch graphs have at most ``most_edges`` edges together, tasks hold the graph of a raster and search from
    shares of its patches; larger ones are searched by :func:`hop_distances_frames`, with the same result.
    """
    edges, areas = settled(edges), settled(areas)
    if edges.count() > most_edges or areas.count() > most_edges:
        return hop_distances_frames(areas, edges)
    return _searched(areas, edges, block, _pairs_found, "raster_id string, src long, dst long, hop int")


def hop_products(areas: DataFrame, edges: DataFrame, most_edges: int = 200_000, block: int = 256) -> DataFrame:
    """(raster_id, hop, s): area products of all ordered pairs of patches, summed per hop where the pairs are found."""
    edges, areas = settled(edges), settled(areas)
    if edges.count() > most_edges or areas.count() > most_edges:
        size = lambda c: areas.select("raster_id", F.col("patch_id").alias(c), F.col("area").alias(f"{c}_area"))
        parts = hop_distances_frames(areas, edges).join(size("src"), ["raster_id", "src"]).join(size("dst"), ["raster_id", "dst"]).select("raster_id", "hop", (F.col("src_area") * F.col("dst_area")).alias("s"))
    else:
        parts = _searched(areas, edges, block, _products_found, "raster_id string, hop int, s long")
    return parts.groupBy("raster_id", "hop").agg(F.sum("s").alias("s"))


def iic(products: DataFrame, landscape: DataFrame) -> DataFrame:
    """products of :func:`hop_products` and landscape(raster_id, landscape_area) to (raster_id, iic).

    The sums are of integers and the few of a raster are folded in order of the hop, so the result is the same under any
    partitioning. Rasters without habitat have 0.
    """
    fold = F.aggregate(F.sort_array(F.collect_list(F.struct("hop", "s"))), F.lit(0.0), lambda t, x: t + x["s"] / (1 + x["hop"]))
    total = products.groupBy("raster_id").agg(fold.alias("total"))
    out = landscape.join(total, "raster_id", "left")
    area = F.col("landscape_area").cast("double")
    return out.select("raster_id", F.coalesce(F.try_divide(F.col("total"), area * area), F.lit(0.0)).alias("iic"))


def gap_distances(masked: DataFrame, labelled: DataFrame, most_steps: int | None = None) -> DataFrame:
    """(raster_id, lo, hi, steps): least number of moves between two patches over habitat and restorable cells.

    A search from all patches at once; a state is (patch, cell), and a patch's search goes on through other patches.
    ``most_steps`` bounds it, e.g. by the budget.
    """
    open_ = masked.where("habitat or restorable").select("raster_id", "y", "x")
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in NEIGHBOURS])).alias("s")
    seen = front = settled(labelled.select("raster_id", F.col("patch_id").alias("src"), "y", "x", F.lit(0).alias("d")))
    d = 0
    while not front.isEmpty() and (most_steps is None or d < most_steps):
        d += 1
        moved = front.select("raster_id", "src", "y", "x", steps).select("raster_id", "src", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).distinct()
        front = settled(moved.join(open_, ["raster_id", "y", "x"], "left_semi").join(seen.select("raster_id", "src", "y", "x"), ["raster_id", "src", "y", "x"], "left_anti").select("raster_id", "src", "y", "x", F.lit(d).alias("d")))
        seen = seen.unionAll(front)
    hit = seen.join(labelled.select("raster_id", "y", "x", F.col("patch_id").alias("dst")), ["raster_id", "y", "x"]).where("src < dst")
    return hit.groupBy("raster_id", F.col("src").alias("lo"), F.col("dst").alias("hi")).agg(F.min("d").alias("steps"))


def cheapest_routes(masked: DataFrame, owners: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """Multi-source cheapest distances for rasters of any size: (raster_id, cell_id, y, x, owner, dist, pred).

    owners(raster_id, cell_id, component_id): the habitat cells, sources of cost 0. A restorable cell takes the least
    (distance, cell) among its neighbours, their distance plus its own cost; rounds go on until nothing changes.
    """
    place = masked.select("raster_id", "cell_id", "y", "x")
    sources = owners.join(place, ["raster_id", "cell_id"]).select("raster_id", "cell_id", "y", "x", F.col("component_id").alias("owner"), F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("pred"))
    free = settled(masked.where("restorable").select("raster_id", "cell_id", "y", "x", "cost").join(owners.select("raster_id", "cell_id"), ["raster_id", "cell_id"], "left_anti"))
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in NEIGHBOURS])).alias("s")
    sources = state = settled(sources)
    seen = None
    for _ in range(most_rounds):
        offer = state.select("raster_id", "y", "x", F.struct("dist", "cell_id", "owner").alias("via"), steps)
        offer = offer.select("raster_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "via").groupBy("raster_id", "y", "x").agg(F.min("via").alias("via"))
        reached = free.join(offer, ["raster_id", "y", "x"]).select("raster_id", "cell_id", "y", "x", F.col("via.owner").alias("owner"), (F.col("via.dist") + F.col("cost")).alias("dist"), F.col("via.cell_id").alias("pred"))
        state = settled(sources.unionByName(reached))
        now = state.agg(F.count("*"), F.sum(F.xxhash64("raster_id", "cell_id", "owner", "dist", "pred").cast("decimal(38,0)"))).first()
        if now == seen:
            return state
        seen = now
    raise RuntimeError("routes did not settle")


def cheapest_bridge(state: DataFrame) -> DataFrame:
    """(raster_id, cost, a, b) of the least sum of distances over neighbours with different owners."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 1), (1, 0))])).alias("s")
    near = state.select("raster_id", "y", "x", F.struct("owner", "dist", "cell_id").alias("p"), steps)
    near = near.select("raster_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "p")
    pair = near.join(state, ["raster_id", "y", "x"]).where("p.owner <> owner")
    best = F.min(F.struct((F.col("p.dist") + F.col("dist")).alias("cost"), F.least("p.cell_id", "cell_id").alias("a"), F.greatest("p.cell_id", "cell_id").alias("b")))
    return pair.groupBy("raster_id").agg(best.alias("m")).select("raster_id", "m.cost", "m.a", "m.b")


def bridge_cells(state: DataFrame, bridge: DataFrame) -> DataFrame:
    """Cells to plant on the bridge: both ends followed back by predecessor, a round per cell of the route."""
    at = settled(bridge.select("raster_id", F.explode(F.array("a", "b")).alias("cell_id")))
    out = None
    while not at.isEmpty():
        here = settled(at.join(state, ["raster_id", "cell_id"]).where("pred is not null").select("raster_id", "cell_id", "pred"))
        out = here if out is None else out.unionAll(here)
        at = settled(here.select("raster_id", F.col("pred").alias("cell_id")).distinct())
    return out.select("raster_id", "cell_id").distinct()


def largest_patch(areas: DataFrame) -> DataFrame:
    """(raster_id, patch_id, area) of the largest patch, the least id on ties."""
    best = F.max_by(F.struct("patch_id", "area"), F.struct("area", -F.col("patch_id")))
    return areas.groupBy("raster_id").agg(best.alias("b")).select("raster_id", "b.patch_id", "b.area")


def bait_frontier(masked: DataFrame, labelled: DataFrame, areas: DataFrame) -> DataFrame:
    """Restorable cells beside the largest patch."""
    top = largest_patch(areas).select("raster_id", "patch_id")
    own = labelled.join(top, ["raster_id", "patch_id"]).select("raster_id", "y", "x", F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in NEIGHBOURS])).alias("s"))
    own = own.select("raster_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    return masked.where("restorable").join(own, ["raster_id", "y", "x"], "left_semi").select("raster_id", "cell_id", "y", "x")


def gap_steps(open_: np.ndarray, image: np.ndarray, ids: np.ndarray, most: int | None = None, block: int = 256):
    """(i, j, steps), i < j: least moves between patches over open cells of one grid; image: patch number or -1."""
    y, x = np.nonzero(open_)
    a, b = grid_links(y, x)
    label = image[y, x]
    for k in range(0, len(ids), block):
        own = ids[k : k + block]
        best: dict[tuple[int, int], int] = {}
        for src, node, hop in spread(len(y), a, b, label[:, None] == own[None, :]):
            if most is not None and hop > most:
                break
            hit = label[node] > own[src]
            for pair in set(zip(own[src[hit]].tolist(), label[node[hit]].tolist(), strict=True)):
                best.setdefault(pair, hop)
        yield from ((i, j, d) for (i, j), d in best.items())
