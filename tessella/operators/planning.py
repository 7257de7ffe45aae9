"""Budgeted restoration: the state of one grid, counterfactual gains, policies, episodes and their summaries.

Grids, configurations, seeds and candidates run in parallel; the steps of one episode are a sequence and stay in one
task, which holds one grid.
"""

from __future__ import annotations

from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EVALUATIONS, HABITAT, INVALID_PENALTY, LAND_SCENARIOS, LEARNED, METHODS, REPEAT_LIMIT, RESTORABLE, RESULTS, limit_of_steps
from ..session import settled
from .graph import FAR, Ways, grid_links, half_stencil, hop_areas, hop_matrix, hop_sums, merge_labels, sums_between
from .raster import NEIGHBOURS


MOST_MATRIX = 8192  # patches up to which hops between all of them are held in a matrix; the results are the same beyond

SHARES = np.append(1 / (1.0 + np.arange(FAR)), 0)  # what a pair counts at each hop; none: nothing

DETOURS = 8  # hops that a bound tells apart; more count as no way at all


def patches_of(habitat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(patch number of each habitat cell in scan order, cell ids)."""
    y, x = np.nonzero(habitat)
    a, b = grid_links(y, x)
    label = merge_labels(len(y), a, b)
    return np.unique(label, return_inverse=True)[1], y * habitat.shape[1] + x


def patch_graph(habitat: np.ndarray, r: float):
    """(areas, edge array [E, 2], patch number of each cell or -1)."""
    label, cell = patches_of(habitat)
    h, w = habitat.shape
    image = np.full(habitat.size, -1)
    image[cell] = label
    grid = image.reshape(h, w)
    pairs = []
    for dy, dx in half_stencil(r):
        if dy >= h or abs(dx) >= w:
            continue
        a = grid[: h - dy, max(0, -dx) : w - max(0, dx)]
        b = grid[dy:, max(0, dx) : w - max(0, -dx)]
        hit = (a >= 0) & (b >= 0) & (a != b)
        if hit.any():
            pairs.append(np.stack((np.minimum(a[hit], b[hit]), np.maximum(a[hit], b[hit])), axis=1))
    sizes = np.bincount(label)
    if not pairs:
        return sizes, np.zeros((0, 2), np.int64), image
    key = np.concatenate(pairs) @ np.array([len(sizes), 1])
    if len(sizes) <= 4096:
        linked = np.zeros(len(sizes) ** 2, bool)
        linked[key] = True
        key = np.flatnonzero(linked)
    else:
        key = np.unique(key)
    return sizes, np.stack(np.divmod(key, len(sizes)), axis=1), image


def fold(sums: list[int], area: float) -> float:
    """IIC from the sums of area products per hop, nearest first."""
    total = 0.0
    for hop, s in enumerate(sums):
        total += s / (1 + hop)
    return total / (area * area) if area else 0.0


def iic_of(habitat: np.ndarray, area: float, r: float) -> float:
    """Integral Index of Connectivity of a habitat mask."""
    sizes, edges, _ = patch_graph(habitat, r)
    return fold(hop_sums(edges[:, 0], edges[:, 1], sizes), area) if len(sizes) else 0.0


def areas_per_hop(hops: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each hop, the size that each node has at that hop, from the hops between all nodes."""
    n, top = len(sizes), 1 + int(hops.max(where=hops < FAR, initial=0))
    out = np.zeros((top, n))
    for k in range(0, n, 256):
        own = np.minimum(hops[k : k + 256], top).astype(np.int64)
        own += np.arange(len(own))[:, None] * (top + 1)
        got = np.bincount(own.ravel(), np.tile(sizes, len(own)), len(own) * (top + 1))
        out[:, k : k + len(own)] = got.reshape(len(own), top + 1)[:, :top].T
    return out


class Grid:
    """The state of an episode."""

    def __init__(self, classes: np.ndarray, costs: dict[int, float], budget: float, r: float, restorable=RESTORABLE, block: int = 1, like: Grid | None = None):
        """like: a grid of the same cells, distance and restorable classes, whose patch graph is taken over."""
        self.shape = classes.shape
        self.start = np.isin(classes, HABITAT)
        self.restorable = np.isin(classes, restorable)
        self.cost = np.zeros(classes.shape)
        for code, c in costs.items():
            self.cost[classes == code] = c
        if (bad := self.restorable & (self.cost <= 0)).any():
            raise ValueError(f"restorable classes without a positive cost: {np.unique(classes[bad]).tolist()}")
        self.budget, self.r, self.block = float(budget), float(r), block
        self.area = float((self.start | self.restorable).sum())
        self._reach = np.array(half_stencil(max(self.r, 1.0))).T
        self._reach = np.concatenate((self._reach, -self._reach), axis=1)
        if self.r < 1:  # cells side by side are one patch at any distance
            raise ValueError("dispersal distance has to be 1 or more")
        self._first, self._seen, self._first_around = patch_graph(self.start, self.r) if like is None else like._first, {}, None
        self.plain = False  # without a graph of the state: its IIC is worked out elsewhere
        self.reset()

    @cached_property
    def first_iic(self) -> float:
        """IIC of the start, when it is asked for."""
        if self._first_around is not None:
            return fold(self._first_around[1].tolist(), self.area)
        sizes, edges, _ = self._first
        if len(sizes) > MOST_MATRIX:
            return fold(state_sums(self, [])[()].tolist(), self.area)
        return fold(hop_sums(edges[:, 0], edges[:, 1], sizes), self.area)

    @property
    def iic(self) -> float:
        """IIC of the state, worked out when it is asked for: an episode of random steps needs the last one only."""
        if self._iic is None:
            sizes, edges, _ = self._known
            if not self.order:
                self._iic = self.first_iic
            elif len(self._first[0]) > MOST_MATRIX and self._around is None:
                self._iic = fold(state_sums(self, [tuple(self.order)])[tuple(self.order)].tolist(), self.area)
            else:
                if self._hops is not None:
                    self._look_around()
                self._iic = fold(hop_sums(edges[:, 0], edges[:, 1], sizes) if self._around is None else self._around[1].tolist(), self.area)
        return self._iic

    def share(self, other: Grid) -> None:
        """Start as another grid of the same cells, distance and restorable classes, and keep what either finds for both."""
        if other is not self and other._first_around is None and 0 < len(other._first[0]) <= MOST_MATRIX:
            other._first_around = self._hops_of(other._first)  # from the second on it is worth its time
        self._first, self._seen, self._first_around, self.first_iic = other._first, other._seen, other._first_around, other.first_iic
        self.reset()

    def reset(self) -> None:
        self.habitat, self.planted = self.start.copy(), np.zeros(self.shape, bool)
        self._known, self._around = self._first, self._first_around
        self._hops = None if self._around is None else self._whole(self._around)
        self.frontier = self._open()
        self.remaining, self.used, self.order, self.refused = self.budget, 0.0, [], []
        self._iic, self.invalid, self.steps = None, 0, 0

    def _open(self) -> np.ndarray:
        """Restorable cells beside habitat that are not planted."""
        return self._beside(self.habitat) & self.restorable & ~self.planted

    @staticmethod
    def _beside(mask: np.ndarray) -> np.ndarray:
        out = np.zeros_like(mask)
        out[1:] |= mask[:-1]
        out[:-1] |= mask[1:]
        out[:, 1:] |= mask[:, :-1]
        out[:, :-1] |= mask[:, 1:]
        return out

    def valid(self) -> np.ndarray:
        """Ids of the cells that can be planted now."""
        return np.flatnonzero(self.frontier & (self.cost <= self.remaining))

    def _ring(self, cells: np.ndarray) -> np.ndarray:
        """Cells beside ``cells``, in their order, each once."""
        h, w = self.shape
        y, x = (np.add.outer(at, step).ravel() for at, step in zip(np.divmod(cells, w), np.array(NEIGHBOURS).T, strict=True))
        inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
        return np.array(list(dict.fromkeys((y * w + x)[inside].tolist())), np.int64)

    def _affordable(self, cells: np.ndarray, money: float, most: int) -> np.ndarray:
        """The cells that are bought in order: one that the rest of the money doesn't cover is passed over."""
        price = self.cost.ravel()
        while not (fits := np.cumsum(price[cells]) <= money).all():
            cells = np.delete(cells, fits.argmin())
        return cells[:most]

    def grow(self, cell: int) -> list[int]:
        """The block planted from a valid cell: rings of open cells around what is bought, nearest ring first, until the

        block is full, the money is spent or nothing is left to reach. [] from any other cell.
        """
        price = self.cost.ravel()
        if not (0 <= cell < price.size and self.frontier.ravel()[cell] and price[cell] <= self.remaining):
            return []
        if self.block == 1:
            return [int(cell)]
        shut, restorable, planted = {cell}, self.restorable.ravel(), self.planted.ravel()
        block, ring = np.zeros(0, np.int64), np.array([cell])
        while len(ring) and len(block) < self.block:
            bought = self._affordable(ring, self.remaining - price[block].sum(), self.block - len(block))
            block = np.append(block, bought)
            ring = self._ring(bought)
            ring = np.array([c for c in ring[restorable[ring] & ~planted[ring]].tolist() if c not in shut], np.int64)
            shut.update(ring.tolist())
        return block.tolist()

    def gain(self, cell: int) -> tuple[float, float]:
        """(gain of planting from the cell, rounded so that ties are ties; its cost)."""
        block = self.grow(cell)
        cost = max(float(self.cost.ravel()[block].sum()), 1e-9)
        if len(block) == 1:
            return round(self._iic_with(block[0]) - self.iic, 12), cost
        trial = self.habitat.copy()
        trial.ravel()[block] = True
        return round(iic_of(trial, self.area, self.r) - self.iic, 12), cost

    def _iic_with(self, cell: int) -> float:
        """IIC with one more cell. What it joins and reaches decides, so cells alike in that are computed once.

        States with the same cells planted share what they found, whatever their budgets and costs.
        """
        self._look_around()
        beside, near = self._touched(cell)
        key = beside.tobytes() + b"|" + near.tobytes()
        found = self._seen.setdefault(frozenset(self.order), {})
        if key not in found:
            near_by = self._part(near)
            found[key] = self._with_cell(cell) if near_by is None else fold(self._sums_with(beside, near, *near_by).tolist(), self.area)
        return found[key]

    @staticmethod
    def _hops_of(known, hops: np.ndarray | None = None) -> tuple:
        """(areas per hop, area products per hop, component of each patch, what :meth:`_part` holds) of a patch graph."""
        sizes, edges, _ = known
        label, parts = merge_labels(len(sizes), edges[:, 0], edges[:, 1]), {}
        if len(sizes) <= MOST_MATRIX:
            hops = hop_matrix(len(sizes), edges[:, 0], edges[:, 1]) if hops is None else hops
            areas, parts = areas_per_hop(hops, sizes), {"of": (), "hops": hops}
        else:
            areas = np.array(hop_areas(edges[:, 0], edges[:, 1], sizes))
        return areas, areas @ sizes, label, parts

    @staticmethod
    def _whole(around: tuple) -> np.ndarray | None:
        """The hops between all patches, if they are held."""
        return around[3]["hops"] if around[3].get("of") == () else None

    def _look_around(self) -> None:
        if self._around is None:
            self._around = self._hops_of(self._known, self._hops)
            self._hops = self._whole(self._around)
            if not self.order:
                self._first_around = self._around

    def _hops_with(self, beside: np.ndarray, near: np.ndarray) -> np.ndarray | None:
        """The hops between all patches after a cell, if they are known before it; its patch is the first."""
        old = self._hops
        if old is None or not len(beside):
            return None
        to = np.minimum(old[near].min(axis=0) + 1, old[beside].min(axis=0))
        stays = np.setdiff1d(np.arange(len(old)), beside, assume_unique=True)
        to = np.minimum(to[stays], FAR)
        out = np.zeros((1 + len(stays), 1 + len(stays)), np.int16)
        out[0, 1:] = out[1:, 0] = to
        for k in range(0, len(stays), 512):
            own = slice(k, k + 512)
            out[1:][own, 1:] = np.minimum(old[stays[own]][:, stays], to[own, None] + np.minimum(to, FAR))
        return out

    def _kinds(self, cells: np.ndarray) -> dict[bytes, tuple[np.ndarray, np.ndarray, list[int]]]:
        """Cells by what they join and reach: (patches beside, patches near, numbers of the cells)."""
        image, (h, w) = self._known[2], self.shape
        y, x = np.divmod(cells, w)
        v, u = y[:, None] + self._reach[0], x[:, None] + self._reach[1]
        near = np.where((v >= 0) & (v < h) & (u >= 0) & (u < w), image[np.clip(v, 0, h - 1) * w + np.clip(u, 0, w - 1)], -1)
        side = np.abs(self._reach).sum(axis=0) == 1
        sets = []
        for of in (near[:, side], near):
            of = np.sort(of, axis=1)
            of[:, 1:][of[:, 1:] == of[:, :-1]] = -1
            sets.append(np.sort(of, axis=1))
        out: dict[bytes, tuple] = {}
        for k, key in enumerate(np.concatenate(sets, axis=1)):
            key = key.tobytes()
            if key not in out:
                out[key] = (*(of[k][of[k] >= 0] for of in sets), [])
            out[key][2].append(k)
        return out

    @staticmethod
    def _detours(rows: np.ndarray, near: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(by how much two patches come closer at most, for those nearest to p and to q; the nearest of each patch; its way).

        The old way is no longer than the two patches' ways to p and q and the one from p to q; FAR where there was none.
        """
        ways = rows + step
        by = ways.argmin(axis=0)
        between = rows[:, near].astype(np.int64)
        return np.where(between < FAR, between - step - step.T, FAR), by, ways[by, np.arange(rows.shape[1])]

    def _most(self, beside: np.ndarray, near: np.ndarray, alone: np.ndarray, before: float, fine: bool = False, dist=None, sizes: np.ndarray | None = None) -> float:
        """No less than the IIC sum with a cell, in a time that follows the patches and not their pairs.

        All is exact but the pairs that come closer, which are bounded by the ways through the patches near the cell;
        ``fine``: through those of either end. dist: the rows of hops that are asked for, of patches of ``sizes``.
        """
        if dist is None:
            dist, sizes = self._around[3]["hops"], self._known[0]
        whole, sizes = 1.0 + sizes[beside].sum(), sizes.astype(np.float64)
        inner = dist[np.ix_(beside, beside)]
        total = before - 2 * sizes[beside] @ alone[beside] + sizes[beside] @ np.where(inner < FAR, 1 / (1.0 + inner), 0) @ sizes[beside]
        step = (~np.isin(near, beside)).astype(dist.dtype)[:, None]
        rows = dist[near]
        sizes[beside] = 0
        total += whole * whole + 2 * whole * (sizes @ SHARES[np.minimum((rows + step).min(axis=0, initial=FAR), FAR)])
        if not (rows[:, near] - step - step.T > 0).any():
            return total
        longer, by, to = self._detours(rows, near, step)
        closer = np.flatnonzero((to + step < rows).any(axis=0) & (sizes > 0))
        if not len(closer) or not (longer > 0).any():
            return total
        m, wide = len(near), int(to[closer].max()) + 1
        sum_ = 1.0 + np.add.outer(np.arange(wide), np.arange(wide))
        at, size = by[closer] * wide + to[closer], sizes[closer]
        if fine:  # a hop at a time, for pairs of which both ends come so much closer
            saved = rows[:, closer].astype(np.int64)
            saved = np.where(saved < FAR, saved - step - to[closer], FAR)
            for k in range(1, DETOURS + 1):
                q, i = np.nonzero(saved >= k)
                if not len(q):
                    break
                weight = np.bincount(q * (m * wide) + at[i], size[i], m * m * wide).reshape(m, m, wide)
                less = 1 / (sum_ + k - 1) - (1 / (sum_ + k) if k < DETOURS else 0)
                total += ((weight.reshape(m * m, wide) @ less).reshape(m, m, wide) * weight.transpose(1, 0, 2)).sum()
            return total
        weight = np.bincount(at, size, m * wide).reshape(m, wide)
        for c in np.unique(longer[longer > 0]):
            less = 1 / sum_ - (1 / (sum_ + c) if c < FAR else 0)
            total += ((weight @ less @ weight.T) * (longer == c)).sum()
        return total

    def best(self, cells: np.ndarray, per_cost: bool) -> int:
        """The cell of the greatest gain, or gain per cost, the least on ties. Cells that can't reach the best are not worked out."""
        score = lambda gain, cost: round(gain / cost, 12) if per_cost else gain
        if self.block == 1 and len(self._known[0]) > MOST_MATRIX:
            return self._best_of_many(cells, per_cost)
        if self.block > 1 or not len(self._known[0]):
            return _best([score(*self.gain(c)) for c in cells.tolist()], cells)
        self._look_around()
        areas, sums = self._around[:2]
        share = 1 / (1.0 + np.arange(len(areas)))
        alone, before = share @ areas, float(share @ sums)
        found = self._seen.setdefault(frozenset(self.order), {})
        kinds = list(self._kinds(cells).items())
        price = np.maximum(self.cost.ravel()[cells], 1e-9)

        def most(k: int, fine: bool) -> float:
            """A bound of the scores of a kind, more than rounding takes above them."""
            key, (beside, near, own) = kinds[k]
            key = (b"fine" if fine else b"most") + key
            if key not in found:
                found[key] = (self._most(beside, near, alone, before, fine) - before) / (self.area * self.area) + 1e-11
            return found[key] / price[own].min() + 1e-11 if per_cost else found[key]

        todo = [(-most(k, False), k, False) for k in range(len(kinds))]
        heapify(todo)
        top, at = -np.inf, -1
        while todo and -todo[0][0] >= top:
            _, k, fine = heappop(todo)
            if not fine:
                heappush(todo, (-most(k, True), k, True))
                continue
            for cell in cells[kinds[k][1][2]].tolist():
                now = score(*self.gain(cell))
                if now > top or now == top and cell < at:
                    top, at = now, cell
        return at

    def _best_of_many(self, cells: np.ndarray, per_cost: bool, block: int = 512, first: int = 8) -> int:
        """:meth:`best` without a matrix of hops: bounds from the rows of a block of patches at a time, then the IIC of the states

        with the cells of the greatest bounds, together, until no other bound reaches the best.
        """
        sizes, edges, image = self._known
        ways, order, price = Ways(len(sizes), edges[:, 0], edges[:, 1]), tuple(self.order), np.maximum(self.cost.ravel()[cells], 1e-9)
        by = np.empty(len(sizes), np.int64)
        by[ways.place] = sizes
        kinds = [(np.sort(ways.place[beside]), np.sort(ways.place[near]), own) for beside, near, own in self._kinds(cells).values()]
        kinds.sort(key=lambda x: x[1][0])
        bounds, alone, at = np.zeros(len(kinds)), np.zeros(len(sizes)), 0
        while at < len(kinds):
            end, ids = at, set()
            while end < len(kinds) and (not ids or len(ids | set(kinds[end][1].tolist())) <= block):
                ids |= set(kinds[end][1].tolist())
                end += 1
            ids = np.array(sorted(ids))
            rows = _Rows(ids, np.ascontiguousarray(ways.hops(ids).T))
            alone[ids] = [SHARES[row] @ by for row in rows.hops]
            for k in range(at, end):
                beside, near, own = kinds[k]
                bounds[k] = self._most(beside, near, alone, 0.0, False, rows, by) / (self.area * self.area) + 1e-11
                if per_cost:
                    bounds[k] /= price[own].min()
            bounds[at:end] += 1e-11
            at = end
            del rows
        todo, top, best = np.argsort(-bounds, kind="stable"), -np.inf, -1
        while len(todo) and bounds[todo[0]] >= top:
            now, todo, first = todo[:first], todo[first:], min(64, 2 * first)
            now = now[bounds[now] >= top]
            sums = state_sums(self, [order, *((*order, int(cells[kinds[k][2][0]])) for k in now)])
            self._iic = fold(sums[order].tolist(), self.area)
            for k in now:
                gain = round(fold(sums[(*order, int(cells[kinds[k][2][0]]))].tolist(), self.area) - self.iic, 12)
                for c in kinds[k][2]:
                    score = round(gain / price[c], 12) if per_cost else gain
                    if score > top or score == top and cells[c] < best:
                        top, best = score, int(cells[c])
        return best

    def _part(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(nodes, hops between them) of the components that a cell reaches; None if they have over MOST_MATRIX patches."""
        sizes, edges, _ = self._known
        label, parts = self._around[2:]
        if len(sizes) <= MOST_MATRIX:
            key, nodes = (), np.arange(len(sizes))
        else:
            if not parts:
                order = np.argsort(label, kind="stable")
                parts["nodes"] = order, np.searchsorted(label[order], np.arange(len(sizes) + 1))
                by = np.argsort(label[edges[:, 0]], kind="stable")
                parts["edges"] = by, np.searchsorted(label[edges[by, 0]], np.arange(len(sizes) + 1))
            key = tuple(np.unique(label[near]).tolist())
            own, at = parts["nodes"]
            nodes = np.sort(np.concatenate([own[at[c] : at[c + 1]] for c in key]))
            if len(nodes) > MOST_MATRIX:
                return None
            by, at = parts["edges"]
            edges = edges[np.concatenate([by[at[c] : at[c + 1]] for c in key])]
        if parts.get("of") != key:  # only the last matrix is held
            parts["of"], parts["hops"] = key, hop_matrix(len(nodes), *(np.searchsorted(nodes, edges[:, k]) for k in (0, 1)))
        return nodes, parts["hops"]

    def _sums_with(self, beside: np.ndarray, near: np.ndarray, nodes: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """Area products per hop once a cell has made one patch of those beside it, linked to those near it.

        New ways lead through that patch, so two others are as far apart as before or as their ways to it together. They
        come closer only if each of them comes closer to some patch that the cell reaches.
        """
        areas, before, *_ = self._around
        sizes = self._known[0][nodes].astype(np.float64)  # sums stay below 2^53, so they are exact
        own, near = areas[:, beside], np.searchsorted(nodes, near)
        beside = np.searchsorted(nodes, beside)
        to = np.minimum(dist[near].min(axis=0) + 1, dist[beside].min(axis=0))
        other = np.setdiff1d(np.flatnonzero(to < FAR), beside, assume_unique=True)
        sums = np.zeros(max(len(areas), 2 * int(to[other].max(initial=0)) + 1))
        sums[: len(areas)] = before - 2 * own @ sizes[beside]
        inside = dist[np.ix_(beside, beside)]
        sums += np.bincount(inside[inside < FAR], np.outer(sizes[beside], sizes[beside])[inside < FAR], len(sums))
        step = (~np.isin(near, beside)).astype(dist.dtype)
        closer = other[(to[other] + step[:, None] < dist[np.ix_(near, other)]).any(axis=0)]
        longer, by = self._detours(dist[near], near, step[:, None])[:2]
        by = by[closer]
        for p in np.unique(by):  # patches nearest to p and to q, where the way from p to q gets shorter; each pair once
            mine, theirs = closer[by == p], closer[(longer[p] > 0)[by] & (by > p)]
            was, now = dist[np.ix_(mine, theirs)], to[mine][:, None] + to[theirs]
            i, j = np.nonzero(now < was)
            product, was, now = 2 * sizes[mine[i]] * sizes[theirs[j]], was[i, j], now[i, j]
            sums += np.bincount(now, product, len(sums))
            sums -= np.bincount(was[was < FAR], product[was < FAR], len(sums))
        whole = 1 + sizes[beside].sum()
        sums += 2 * whole * np.bincount(to[other], sizes[other], len(sums))
        sums[0] += whole * whole
        return sums

    def _touched(self, cell: int) -> tuple[np.ndarray, np.ndarray]:
        """(patches beside a cell, patches within reach of it)."""
        image, (h, w) = self._known[2], self.shape
        y, x = divmod(cell, w)
        v, u = y + self._reach[0], x + self._reach[1]
        ok = (v >= 0) & (v < h) & (u >= 0) & (u < w)
        near = image[v[ok] * w + u[ok]]
        beside = near[(np.abs(v[ok] - y) + np.abs(u[ok] - x) == 1) & (near >= 0)]
        return np.unique(beside), np.unique(near[near >= 0])

    def _graph_with(self, cell: int):
        """(sizes, edges, new number of each patch) with one more cell: its neighbour patches and itself become patch 0,

        linked to what they were linked to and to what the cell reaches.
        """
        sizes, edges, _ = self._known
        beside, near = self._touched(cell)
        stays = np.ones(len(sizes), np.int64)
        stays[beside] = 0
        number = np.cumsum(stays) * stays
        grown = np.bincount(number, weights=sizes, minlength=1)
        grown[0] = 1 + sizes[stays == 0].sum()
        lo, hi, far = number[edges[:, 0]], number[edges[:, 1]], number[near]
        keep, far = lo != hi, far[far > 0]
        return grown, np.stack((np.concatenate((lo[keep], np.zeros_like(far))), np.concatenate((hi[keep], far))), axis=1), number

    def _with_cell(self, cell: int) -> float:
        sizes, edges, _ = self._graph_with(cell)
        return fold(hop_sums(edges[:, 0], edges[:, 1], sizes), self.area)

    def _plant(self, cell: int) -> None:
        self.habitat.ravel()[cell] = True
        if self.plain:
            return
        hops = self._hops_with(*self._touched(cell))
        sizes, edges, number = self._graph_with(cell)
        image = np.where(self._known[2] >= 0, number[self._known[2]], -1) if len(number) else self._known[2].copy()
        image[cell] = 0
        key = np.unique(np.sort(edges, axis=1) @ np.array([len(sizes), 1]))
        self._known, self._around = (sizes, np.stack(np.divmod(key, len(sizes)), axis=1), image), None
        self._hops = hops  # areas are added up when they are asked for

    def links(self, order: list[int] | tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Links (from, to, cost) that cells planted in order bring to the first graph, and the sizes of all nodes.

        Planted cells are nodes after the first patches, in their order; 0: side by side, so one patch, 1: within reach.
        A link leads from the later cell.
        """
        n, planted = len(self._first[0]), {c: k for k, c in enumerate(order)}
        image, (h, w) = self._first[2], self.shape
        out: list[tuple[int, int, int]] = []
        for k, cell in enumerate(order):
            best: dict[int, int] = {}
            y, x = divmod(cell, w)
            for dy, dx in self._reach.T.tolist():
                if 0 <= y + dy < h and 0 <= x + dx < w:
                    at = (y + dy) * w + x + dx
                    to = int(image[at])
                    if to < 0:
                        to = n + planted[at] if planted.get(at, k) < k else -1
                    if to >= 0:
                        best[to] = min(best.get(to, 1), int(abs(dy) + abs(dx) != 1))
            out += [(n + k, to, cost) for to, cost in best.items()]
        a, b, cost = np.array(out, np.int64).reshape(-1, 3).T
        return a, b, cost, np.concatenate((self._first[0], np.ones(len(order), np.int64)))

    def sizes(self) -> np.ndarray:
        """Areas of the patches."""
        a, b, cost, sizes = self.links(self.order)
        label = merge_labels(len(sizes), a[cost == 0], b[cost == 0])
        areas = np.bincount(label, sizes, len(sizes)).astype(np.int64)
        return areas[areas > 0]

    def _settle(self, block: list[int]) -> float:
        """Plant a block; its cost."""
        cost = float(self.cost.ravel()[block].sum())
        for cell in block:
            self._plant(cell)
        self.planted.ravel()[block] = True
        frontier, ring = self.frontier.ravel(), self._ring(np.array(block))
        frontier[ring] |= self.restorable.ravel()[ring]
        frontier[self.order + block] = False
        self._iic = None
        self.order += block
        self.used, self.remaining = self.used + cost, self.remaining - cost
        return cost

    def act(self, cell: int) -> float | None:
        """Plant from a cell and give the cost, or note a refusal."""
        self.steps += 1
        if block := self.grow(cell):
            self.refused = []
            return self._settle(block)
        self.invalid += 1
        self.refused = [c for c in self.refused if c == cell] + [cell]  # the run of one cell
        return None

    def step(self, cell: int, reward_per_cost: bool = False, penalties: bool = False) -> float:
        """:meth:`act`, and the reward."""
        before = self.iic
        if (cost := self.act(cell)) is None:
            return -INVALID_PENALTY if penalties else 0.0
        gain = self.iic - before
        return gain / max(cost, 1e-9) if reward_per_cost else gain

    def over(self) -> bool:
        """Nothing more can be bought, one cell was refused too often, or the steps are used up."""
        return self.remaining <= 0 or not len(self.valid()) or len(self.refused) >= REPEAT_LIMIT or self.steps >= limit_of_steps(self.budget)


class _Rows:
    """Rows of a matrix of hops, asked for by the numbers of all rows."""

    def __init__(self, ids: np.ndarray, hops: np.ndarray):
        self.ids, self.hops, self.dtype = ids, hops, hops.dtype

    def __getitem__(self, at):
        if isinstance(at, tuple):
            return self.hops[np.searchsorted(self.ids, at[0]), at[1]]
        return self.hops[np.searchsorted(self.ids, at)]


def _best(scores: list[float], cells) -> int:
    return int(cells[int(np.argmax(scores))])  # the first, so the least cell, on ties


def draw(seed: int, step: int, cell: np.ndarray) -> np.ndarray:
    """A fixed hash of (seed, step, cell) that SQL can compute too."""
    return (cell * 7919 + step * 104729 + seed * 15485863 + 12345) % 1000003


def policy_random(g: Grid, seed: int) -> int:
    cells = g.valid()
    return int(cells[draw(seed, g.steps, cells).argmin()]) if len(cells) else 0  # the first, so the least cell, on ties


def policy_naive(g: Grid, seed: int = 0) -> int:
    cells = g.valid()
    return g.best(cells, False) if len(cells) else 0


def policy_cost(g: Grid, seed: int = 0) -> int:
    cells = g.valid()
    return g.best(cells, True) if len(cells) else 0


def bridge_candidates(g: Grid) -> list[int]:
    """Plantable cells on the cheapest route between two connectivity components; none if it costs too much.

    All habitat cells are sources of cost 0. A restorable cell is settled from its cheapest neighbour (least cell on
    ties); two settled neighbours of different components close a route.
    """
    sizes, edges, image = patch_graph(g.habitat, g.r)
    label = merge_labels(len(sizes), edges[:, 0], edges[:, 1])
    if len(np.unique(label)) < 2:
        return []
    h, w = g.shape
    owner = np.where(image >= 0, label[np.maximum(image, 0)], -1)
    dist = np.where(image >= 0, 0.0, np.inf)
    pred = np.full(h * w, -1)
    free = (g.restorable & ~g.planted).ravel() & (image < 0)
    cost = g.cost.ravel()
    y, x = np.divmod(np.arange(h * w), w)
    beside = []
    for dy, dx in NEIGHBOURS:
        ok = (y + dy >= 0) & (y + dy < h) & (x + dx >= 0) & (x + dx < w)
        beside.append((ok, np.where(ok, np.arange(h * w) + dy * w + dx, 0)))
    while True:  # to the fixpoint: dist(v) = cost(v) + least (dist(u), u) over neighbours
        near, who = np.full(h * w, np.inf), np.full(h * w, h * w)
        for ok, u in beside:
            d = np.where(ok, dist[u], np.inf)
            less = (d < near) | ((d == near) & (u < who) & np.isfinite(d))
            near, who = np.where(less, d, near), np.where(less, u, who)
        settled = free & np.isfinite(near)
        new = np.where(settled, near + cost, dist)
        source = np.where(settled, who, 0)
        new_owner = np.where(settled, owner[source], owner)
        if np.array_equal(new, dist) and np.array_equal(new_owner, owner):
            pred = np.where(settled, source, -1)
            break
        dist, owner = new, new_owner
    best = (np.inf, -1, -1)
    for ok, u in beside:
        hit = np.flatnonzero(ok & (owner >= 0) & (owner[u] >= 0) & (owner != owner[u]))
        if len(hit):
            total = dist[hit] + dist[u[hit]]
            k = np.lexsort((u[hit], hit, total))[0]
            best = min(best, (float(total[k]), int(hit[k]), int(u[hit[k]])))
    if best[1] < 0 or best[0] > g.remaining:
        return []
    route = set()
    for c in best[1:]:
        while c >= 0:
            if image[c] < 0:
                route.add(c)
            c = int(pred[c])
    return sorted(route & set(g.valid().tolist()))


def policy_bridge(g: Grid, seed: int = 0) -> int:
    cells = bridge_candidates(g)
    return _best([round(a / b, 12) for a, b in map(g.gain, cells)], cells) if cells else policy_cost(g)


POLICIES = {"random": policy_random, "naive": policy_naive, "cost": policy_cost, "bridge": policy_bridge}


def run_episode(g: Grid, method: str, seed: int) -> dict:
    g.reset()
    while True:
        g.act(POLICIES[method](g, seed))
        if g.over():
            break
    sizes = g.sizes()
    return {"iic_initial": None if g.plain else g.first_iic, "iic_final": None if g.plain else g.iic, "invalid": g.invalid, "steps": max(g.steps, 1), "cost": g.used, "n_planted": len(g.order), "n_patches": len(sizes), "largest_patch": int(sizes.max(initial=0)), "plant_order": g.order}


def state_sums(g: Grid, orders: list[tuple[int, ...]], share: int = 0, shares: int = 1, block: int = 512) -> dict[tuple[int, ...], np.ndarray]:
    """Area products per hop of the start and of the states after ``orders``, as far as they come from a share of the patches.

    The shares' sums add up to those of all ordered pairs. Hops of the start are worked out for a block of patches at a
    time; a planted cell is a node, and two others are then as far apart as before or as their ways to it together, so only
    pairs that come closer are counted anew. States that begin alike share what their beginnings change.
    """
    sizes, edges, _ = g._first
    n = len(sizes)
    ways = Ways(n, edges[:, 0], edges[:, 1])
    by = np.empty(n, np.int64)
    by[ways.place] = sizes
    cells: dict[tuple, _Hub] = {}
    for order in dict.fromkeys(orders):
        a, b, cost, _ = g.links(order)
        b = np.where(b < n, ways.place[np.minimum(b, n - 1)], b)
        for k in range(len(order)):
            if order[: k + 1] not in cells:
                own = a == n + k
                cells[order[: k + 1]] = _Hub([cells[order[: i + 1]] for i in range(k)], b[own], cost[own])
    hubs = list(cells.values())
    held: dict[int, np.ndarray] = {}
    for k, hub in enumerate(hubs):  # in the order of their states, so neighbours are worked out together
        if any(p not in held for p in hub.patches(n).tolist()):
            ahead = dict.fromkeys(p for x in hubs[k:] for p in x.patches(n).tolist())
            some = np.array(list(ahead)[: max(block, len(hub.ends))])
            held = dict(zip(some.tolist(), np.ascontiguousarray(ways.hops(some).T), strict=True))
        hub.reach(n, held)
    del held
    top = 1 + max([0, *(2 * int(x.to.max(where=x.to < FAR, initial=0)) for x in hubs)])
    first, total = np.zeros(0), {}
    changed = {id(x): np.zeros(top + 1) for x in hubs}
    if share == 0:
        for x in hubs:
            changed[id(x)] += x.own_sums(n, by, top)
    width = 1
    for k in range(share * block, n, shares * block):  # blocks in turn, as planted cells may lie together
        own = np.arange(k, min(k + block, n))
        hops = ways.hops(own)
        width = max(width, 1 + int(hops.max(where=hops < FAR, initial=0)))
        got = sums_between(hops, by, by[own], width)
        got[: len(first)] += first
        first = got
        for x in hubs:
            changed[id(x)] += x.closer(own, hops, by, top)
        del hops  # before the next are made
    total[()] = first
    for order in dict.fromkeys(orders):
        now = np.zeros(max(len(first), top + 1))
        now[: len(first)] = first
        for k in range(len(order)):
            now[: top + 1] += changed[id(cells[order[: k + 1]])]
        total[order] = now
    return total


class _Hub:
    """A planted cell as a node of size 1 after the patches: its links to patches (by their places) and earlier cells."""

    def __init__(self, before: list[_Hub], ends: np.ndarray, cost: np.ndarray):
        self.before, self.ends, self.cost = before, ends, cost

    def patches(self, n: int) -> np.ndarray:
        return self.ends[self.ends < n]

    def reach(self, n: int, rows: dict[int, np.ndarray]) -> None:
        """to: hops to the patches and earlier cells; is_near: those that come closer to one of its ends.

        sides: the patches that a pair that comes closer is of, nearest to one end and closer to another.
        """
        k = len(self.before)
        self.to = np.full(n + k + 1, FAR, np.int16)
        self.to[n + k] = 0
        now = []
        for end, cost in zip(self.ends.tolist(), self.cost.astype(np.int16).tolist(), strict=True):
            row = np.full(n + k, FAR, np.int16)
            if end < n:
                row[:n] = rows[end]
            for x in self.before:
                if end < len(x.to) and x.to[end] < FAR:
                    np.minimum(row[: len(x.to)], x.to + x.to[end], out=row[: len(x.to)])
            now.append(row)
            self.to[: n + k] = np.minimum(self.to[: n + k], row + cost)
        self.to = np.minimum(self.to, FAR)
        ends = self.cost.astype(np.int16)[:, None]
        now = np.array(now, np.int16).reshape(-1, n + k)
        closer = self.to[: n + k] + ends < now
        self.is_near = closer.any(axis=0)
        by = (now + ends)[:, :n].argmin(axis=0) if len(now) else np.zeros(n, np.int64)
        sides = {(i, j): np.flatnonzero((by == i) & closer[j, :n]).astype(np.int32) for i in range(len(now)) for j in range(len(now)) if i != j}
        self.sides = {key: x for key, x in sides.items() if len(x)}

    def own_sums(self, n: int, sizes: np.ndarray, top: int) -> np.ndarray:
        """What its own pairs bring, and those of earlier cells that come closer to something."""
        k, out = len(self.before), np.zeros(top + 1)
        whole = np.concatenate((sizes, np.ones(k)))
        reached = self.to[: n + k] < FAR
        out += 2 * np.bincount(self.to[: n + k][reached], whole[reached], top + 1)
        out[0] += 1
        for i in np.flatnonzero(self.is_near[n:]).tolist():
            was = np.full(n + k, FAR, np.int16)
            for x in self.before:
                if n + i < len(x.to) and x.to[n + i] < FAR:
                    np.minimum(was[: len(x.to)], x.to + x.to[n + i], out=was[: len(x.to)])
            was[n + i] = 0
            now = self.to[n + i] + self.to[: n + k]
            less = np.flatnonzero(now < was)
            size = np.where(less < n, 2.0, 1.0) * whole[less]  # a pair of cells is met from both
            out += np.bincount(now[less], size, top + 1)
            gone = was[less] < FAR
            out -= np.bincount(was[less][gone], size[gone], top + 1)
        return out

    def closer(self, own: np.ndarray, hops: np.ndarray, sizes: np.ndarray, top: int, most: int = 1 << 20) -> np.ndarray:
        """What pairs of patches that come closer through it bring, of those that ``own`` stands for; hops: of the start."""
        out = np.zeros(top + 1)
        for (one, other), whole in self.sides.items():
            if one > other:  # the same pairs, from both: once each, counted twice
                continue
            others = self.sides.get((other, one), whole[:0])
            lo, hi = np.searchsorted(others, (own[0], own[-1] + 1))
            columns = others[lo:hi]
            if not len(columns):
                continue
            for k in range(0, len(whole), step := max(1, most // len(columns))):
                rows = whole[k : k + step]
                was = hops[np.ix_(rows, columns - own[0])]
                for x in self.before:
                    i, j = np.flatnonzero(x.is_near[rows]), np.flatnonzero(x.is_near[columns])
                    if len(i) and len(j):
                        was[np.ix_(i, j)] = np.minimum(was[np.ix_(i, j)], x.to[rows[i], None] + x.to[columns[j]])
                now = self.to[rows, None] + self.to[columns]
                less = np.flatnonzero(now < was)
                if len(less):
                    size, was, now = 2 * np.outer(sizes[rows], sizes[columns]).ravel()[less], was.ravel()[less], now.ravel()[less]
                    out += np.bincount(now, size, top + 1)
                    gone = was < FAR
                    out -= np.bincount(was[gone], size[gone], top + 1)
        return out


EPISODE = "raster_id string, config string, method string, seed int, iic_initial double, iic_final double, invalid int, steps int, cost double, n_planted int, n_patches int, largest_patch int, plant_order array<long>"
_CONFIG = "config string, method string, seed int, budget double, dispersal double, restorable array<int>, costs map<int,double>"


def grid_of(pdf: pd.DataFrame) -> np.ndarray:
    out = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), np.int64)
    out[pdf["y"], pdf["x"]] = pdf["class_code"]
    return out


def packed_grids(cells: DataFrame) -> DataFrame:
    """(raster_id, grid): a raster as one row of bytes; a planner task holds one raster."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = grid_of(pdf).astype(np.int16)
        return pd.DataFrame({"raster_id": [pdf["raster_id"].iloc[0]], "height": [g.shape[0]], "width": [g.shape[1]], "grid": [g.tobytes()]})

    return cells.select("raster_id", "y", "x", "class_code").groupBy("raster_id").applyInPandas(run, "raster_id string, height int, width int, grid binary")


def on_every_raster(grids: DataFrame, configs: DataFrame, dealt: DataFrame | None = None, most: int = 100_000) -> DataFrame:
    """Every configuration on every raster, as asked for: configurations are counted, and shipped to the rasters, in the rows of ``dealt``."""
    if configs.count() > most:
        raise ValueError(f"more than {most} configurations; run them in parts")
    return grids.crossJoin(F.broadcast(configs if dealt is None else dealt))


def episodes(cells: DataFrame, configs: DataFrame, most: int = MOST_MATRIX) -> DataFrame:
    """configs(config, method, seed, budget, dispersal, restorable, costs) on every raster, dealt over tasks by episodes that begin alike.

    Random episodes of rasters with more than ``most`` patches are run first, as they don't ask for the IIC, and the IIC of
    their ends is worked out together, by shares of the patches.
    """
    tasks = max(1, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    few = 4 * max(1, cells.sparkSession.sparkContext.defaultParallelism)
    alike = F.when(F.col("method") == "random", F.pmod(F.xxhash64("config", "seed"), F.lit(few)).cast("string")).otherwise(F.to_json("costs"))  # greedy episodes of other budgets begin alike
    dealt = configs.groupBy("method", alike.alias("alike")).agg(F.collect_list(F.struct("config", "seed", "budget", "dispersal", "restorable", "costs")).alias("own"))
    runs = on_every_raster(packed_grids(cells), configs, dealt)  # a raster goes to a task once

    def run(batches):
        known: dict[tuple, Grid] = {}
        for pdf in batches:
            for row, r in ((row, r) for row in pdf.itertuples() for r in row.own):
                grid, key = np.frombuffer(row.grid, np.int16).reshape(row.height, row.width), (row.raster_id, r["dispersal"], tuple(r["restorable"]))
                g = Grid(grid, dict(r["costs"]), r["budget"], r["dispersal"], tuple(r["restorable"]), like=known.get(key))
                g.plain = row.method == "random" and len(g._first[0]) > most
                first = known.setdefault(key, g)
                if not g.plain:
                    g.share(first)
                e = run_episode(g, row.method, r["seed"])
                yield pd.DataFrame([{"raster_id": row.raster_id, "config": r["config"], "method": row.method, "seed": r["seed"], **e}])

    # written once: whether any IIC is open decides on what follows
    done = settled(runs.repartition(tasks, "raster_id", "method", "alike").mapInPandas(run, EPISODE))
    open_ = done.where("iic_final is null")
    return done if open_.isEmpty() else _with_iic(cells, configs, done, open_)


def _with_iic(cells: DataFrame, configs: DataFrame, done: DataFrame, open_: DataFrame) -> DataFrame:
    """The episodes ``done`` with the IIC of those in ``open_``, whose rasters have many patches."""
    key = ["raster_id", "config", "method", "seed"]
    shares = max(1, cells.sparkSession.sparkContext.defaultParallelism)
    asked = open_.join(configs.select("config", "method", "seed", "dispersal", "restorable"), ["config", "method", "seed"])
    asked = asked.groupBy("raster_id", "dispersal", "restorable").agg(F.collect_list(F.struct("config", "method", "seed", "plant_order")).alias("runs"))
    asked = asked.join(packed_grids(cells), "raster_id").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                g = Grid(np.frombuffer(r.grid, np.int16).reshape(r.height, r.width), {c: 1.0 for c in r.restorable}, 0, r.dispersal, tuple(r.restorable))
                orders = [tuple(x["plant_order"]) for x in r.runs]
                sums = state_sums(g, orders, int(r.share), shares)
                for x, order in zip(r.runs, orders, strict=True):
                    for name, own in (("iic_initial", sums[()]), ("iic_final", sums[order])):
                        yield pd.DataFrame({"raster_id": r.raster_id, "config": x["config"], "method": x["method"], "seed": x["seed"], "name": name, "hop": np.arange(len(own)), "s": own.astype(np.int64), "area": g.area})

    parts = asked.repartition(shares).mapInPandas(run, "raster_id string, config string, method string, seed int, name string, hop int, s long, area double")
    total = parts.groupBy(*key, "name", "hop").agg(F.sum("s").alias("s"), F.first("area").alias("area"))
    folded = F.aggregate(F.sort_array(F.collect_list(F.struct("hop", "s"))), F.lit(0.0), lambda t, x: t + x["s"] / (1 + x["hop"]))
    iic = total.groupBy(*key, "name").agg(F.try_divide(folded, F.first("area") * F.first("area")).alias("iic"))
    iic = iic.groupBy(*key).agg(*[F.max(F.when(F.col("name") == c, F.col("iic"))).alias(f"own_{c}") for c in ("iic_initial", "iic_final")])
    return done.join(iic, key, "left").withColumns({c: F.coalesce(f"own_{c}", c) for c in ("iic_initial", "iic_final")}).select(*done.columns)


def candidate_gains(cells: DataFrame, costs: dict[int, float], budget: float, r: float, restorable=RESTORABLE, per_task: int = 16) -> DataFrame:
    """(raster_id, cell_id, gain, cost, ratio) of planting each valid cell first, candidates dealt over tasks."""
    from .raster import action_mask, with_masks

    grids = packed_grids(cells)
    todo = action_mask(with_masks(cells, restorable, costs), budget).withColumn("salt", F.expr(f"cell_id % {per_task}"))
    todo = todo.groupBy("raster_id", "salt").agg(F.collect_list("cell_id").alias("ids")).join(grids, "raster_id")

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                g = Grid(np.frombuffer(row.grid, np.int16).reshape(row.height, row.width), costs, budget, r, restorable)
                got = [(row.raster_id, c, *g.gain(int(c))) for c in row.ids]
                out = pd.DataFrame(got, columns=["raster_id", "cell_id", "gain", "cost"])
                yield out.assign(ratio=(out["gain"] / out["cost"]).round(12))

    return todo.repartition(per_task, "raster_id", "salt").mapInPandas(run, "raster_id string, cell_id long, gain double, cost double, ratio double")


def blocks(cells: DataFrame, costs: dict[int, float], budget: float, block: int, restorable=RESTORABLE, per_task: int = 16) -> DataFrame:
    """(raster_id, cell_id, nth, planted): the cells that each valid cell's block would plant, in order."""
    from .raster import action_mask, with_masks

    todo = action_mask(with_masks(cells, restorable, costs), budget).withColumn("salt", F.expr(f"cell_id % {per_task}"))
    todo = todo.groupBy("raster_id", "salt").agg(F.collect_list("cell_id").alias("ids")).join(packed_grids(cells), "raster_id")

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                g = Grid(np.frombuffer(row.grid, np.int16).reshape(row.height, row.width), costs, budget, 1.0, restorable, block)
                got = [(row.raster_id, c, k, p) for c in row.ids for k, p in enumerate(g.grow(int(c)))]
                yield pd.DataFrame(got, columns=["raster_id", "cell_id", "nth", "planted"])

    return todo.repartition(per_task, "raster_id", "salt").mapInPandas(run, "raster_id string, cell_id long, nth int, planted long")


def first_action(gains: DataFrame, score: str) -> DataFrame:
    """Best cell by ``score``, the least id on ties."""
    best = F.max_by(F.struct("cell_id", score), F.struct(F.col(score), -F.col("cell_id")))
    return gains.groupBy("raster_id").agg(best.alias("b")).select("raster_id", "b.cell_id", F.col(f"b.{score}").alias(score))


def summarise(eps: DataFrame, keys: list[str]) -> DataFrame:
    """Episode records to one row per key: means, sample deviation of the gain, mean of per-episode ratios."""
    gain = F.col("iic_final") - F.col("iic_initial")
    return eps.groupBy(*keys).agg(
        F.avg("iic_initial").alias("iic_initial"), F.avg("iic_final").alias("iic_final"), F.avg(gain).alias("iic_gain"), F.stddev_samp(gain).alias("std_iic_gain"), F.avg("cost").alias("cost_used"),
        F.avg(F.try_divide(gain, F.col("cost"))).alias("iic_per_unit"), F.avg("n_planted").alias("cells_planted"), F.avg("n_patches").alias("n_patches"), F.avg("largest_patch").alias("largest_patch"),
        F.avg(F.col("invalid") / F.col("steps")).alias("invalid_action_rate"),
    )


def summarise_seeds(eps: DataFrame, keys: list[str], seed: str = "seed") -> DataFrame:
    """Mean of the seeds' means and the deviation between seeds."""
    per = summarise(eps, [*keys, seed])
    means = [F.avg(c).alias(c) for c in per.columns if c not in (*keys, seed, "std_iic_gain")]
    return per.groupBy(*keys).agg(*means, F.stddev_samp("iic_gain").alias("std_iic_gain"))


def attributes(rows: DataFrame, resolution: str, land: str, preset: str, cost: F.Column, budget: F.Column, timesteps: int, seeds: list[int]) -> DataFrame:
    """Summary rows (method, measures) with the columns of a results table: preset, steps and seeds are of learned methods only."""
    learned = F.col("method").isin(*LEARNED)
    return rows.withColumns({
        "resolution": F.lit(resolution), "land_scenario": F.lit(land), "cost_scenario": cost, "budget": budget.cast("int"),
        "rl_preset": F.when(learned, preset).otherwise(""), "timesteps": F.when(learned, timesteps).otherwise(0), "seeds": F.when(learned, "-".join(map(str, seeds))).otherwise(""),
    })


def run_scenarios(cells: DataFrame, methods: list[str], costs: dict[str, dict], budgets: list[float], r: float, resolution: str = "default", land: str = "main", evaluations: int = EVALUATIONS) -> DataFrame:
    """Rows of the results table for every cost scenario, budget and method; only the random policy is run more than once."""
    codes, extra = LAND_SCENARIOS[land]
    rows = [(f"{name}|{b:g}", m, seed, float(b), float(r), list(codes), {k: float(v) for k, v in (cost | extra).items()}) for name, cost in costs.items() for b in budgets for m in methods for seed in range(evaluations if m == "random" else 1)]
    configs = cells.sparkSession.createDataFrame(rows, _CONFIG)
    parts = F.split("config", r"\|")
    label = F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv])
    out = summarise(episodes(cells, configs), ["config", "method"]).withColumn("method", label[F.col("method")]).withColumn("training_seconds", F.lit(0.0))
    out = attributes(out, resolution, land, "default", parts[0], parts[1], 0, [])
    return out.select(*[c.split()[0] for c in RESULTS.split(", ")])


def choose_methods(methods: list[str] | None, learned: str | None, without_learned: bool, land: str = "main", preset: str = "default") -> tuple[list[str], list[str]]:
    """(baselines, learned methods) that a command line asks for."""
    if without_learned and learned:
        raise ValueError("learned methods are both asked for and excluded")
    if preset == "s2-tuned" and land != "s2":
        raise ValueError("preset s2-tuned is for land scenario s2 only")
    known = {"ppo": ["ppo"], "mask": ["mask"], "both": ["ppo", "mask"]}
    if without_learned:
        rl = []
    elif learned:
        rl = known[learned]
    else:
        rl = [] if methods is not None else ["ppo", "mask"]
    base = methods if methods is not None else ([] if learned else ["random", "naive", "cost"])
    return base, rl
