"""Graph, connectivity, window and planning operators against brute force on small random grids."""

from __future__ import annotations

from collections import Counter, deque
from heapq import heappop, heappush

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.model import COST_SCENARIOS, HABITAT, RESTORABLE
from tessella.operators import graph, planning, raster, reports, structure

COSTS = COST_SCENARIOS["1:2"]
CODES = np.array([5, 76, 13, 21, 31, 0])
grids = st.tuples(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**32 - 1)).map(lambda a: CODES[np.random.default_rng(a[2]).choice(6, (a[0], a[1]), p=[0.3, 0.05, 0.25, 0.2, 0.1, 0.1])])


def frame(spark, *many):
    rows = [(f"g{k}", int(y * g.shape[1] + x), int(y), int(x), int(g[y, x])) for k, g in enumerate(many) for y in range(g.shape[0]) for x in range(g.shape[1])]
    return spark.createDataFrame(rows, "raster_id string, cell_id long, y int, x int, class_code int")


def brute_patches(habitat):
    h, w = habitat.shape
    name = {}
    for y, x in zip(*np.nonzero(habitat), strict=True):
        if (y, x) in name:
            continue
        queue, name[y, x] = deque([(y, x)]), int(y * w + x)
        while queue:
            a, b = queue.popleft()
            for v, u in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= v < h and 0 <= u < w and habitat[v, u] and (v, u) not in name:
                    name[v, u] = name[y, x]
                    queue.append((v, u))
    return name


def brute_graph(habitat, r):
    name = brute_patches(habitat)
    edges = {tuple(sorted((p, q))) for a, p in name.items() for b, q in name.items() if p != q and (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= r * r}
    hops = {}
    for s in set(name.values()):
        queue, seen = deque([(s, 0)]), {s}
        while queue:
            n, d = queue.popleft()
            hops[s, n] = d
            for e in edges:
                for x, y in (e, e[::-1]):
                    if x == n and y not in seen:
                        seen.add(y)
                        queue.append((y, d + 1))
    return name, edges, hops


def brute_iic(habitat, area, r):
    name, _, hops = brute_graph(habitat, r)
    size = Counter(name.values())
    return sum(size[a] * size[b] / (1 + d) for (a, b), d in hops.items()) / area**2 if area else 0.0


@settings(max_examples=60, deadline=None)
@given(grids, st.sampled_from([1.0, 2.0, 2.5, 3.0]))
def test_iic_of_a_grid(g, r):
    habitat = np.isin(g, HABITAT)
    area = float((habitat | np.isin(g, RESTORABLE)).sum())
    got = planning.iic_of(habitat, area, r)
    assert got == pytest.approx(brute_iic(habitat, area, r))
    assert 0 <= got <= 1 + 1e-12
    for turned in (habitat[::-1], habitat[:, ::-1], habitat.T):
        assert planning.iic_of(turned, area, r) == pytest.approx(got)
    assert planning.iic_of(habitat, area, r + 1) >= got - 1e-12


@settings(max_examples=60, deadline=None)
@given(grids)
def test_bridge_route_costs_as_little_as_a_heap_search(g):
    state = planning.Grid(g, COSTS, 50, 1.5)
    got = planning.bridge_candidates(state)
    name, edges, _ = brute_graph(state.habitat, 1.5)
    ids = sorted(set(name.values()))
    label = dict(zip(ids, ids, strict=True))
    for a, b in sorted(edges) * len(ids):
        label[a] = label[b] = min(label[a], label[b])
    free, heap, dist, owner = np.isin(g, RESTORABLE), [], {}, {}
    for c, p in name.items():
        heappush(heap, (0.0, c[0] * g.shape[1] + c[1], label[p]))
    best = np.inf
    while heap:
        d, c, o = heappop(heap)
        if c in dist:
            continue
        dist[c], owner[c] = d, o
        y, x = divmod(c, g.shape[1])
        for v, u in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            n = v * g.shape[1] + u
            if 0 <= v < g.shape[0] and 0 <= u < g.shape[1]:
                if n in dist and owner[n] != o:
                    best = min(best, d + dist[n])
                elif n not in dist and free[v, u]:
                    heappush(heap, (d + COSTS[int(g[v, u])], n, o))
    if len(set(label.values())) < 2 or best > 50:
        assert got == []
    elif got:
        assert set(got) <= set(state.valid().tolist())


def test_frames_agree_with_brute_force(spark):
    rng = np.random.default_rng(1)
    many = [CODES[rng.choice(6, (7, 9), p=[0.35, 0.05, 0.25, 0.15, 0.1, 0.1])] for _ in range(6)] + [np.full((3, 3), 31), np.full((4, 2), 5)]
    cells = frame(spark, *many)
    masked = raster.with_masks(cells)
    labelled = graph.label_patches(masked.where("habitat"), tile=3)  # borders cross patches
    areas, edges = graph.patch_areas(labelled), graph.patch_edges(labelled, 2.0)
    kernel = sorted(map(tuple, graph.hop_distances(areas, edges).select("raster_id", "src", "dst", "hop").collect()))
    assert kernel == sorted(map(tuple, graph.hop_distances_frames(areas, edges).select("raster_id", "src", "dst", "hop").collect()))
    land = masked.groupBy("raster_id").agg(F.count_if(F.col("habitat") | F.col("restorable")).alias("landscape_area"))
    assert sorted(map(tuple, graph.hop_products(areas, edges).collect())) == sorted(map(tuple, graph.hop_products(areas, edges, most_edges=0).collect()))
    score = {r.raster_id: r.iic for r in graph.iic(graph.hop_products(areas, edges), land).collect()}
    names = {(r.raster_id, r.y, r.x): r.patch_id for r in labelled.collect()}
    comps = {(r.raster_id, r.patch_id): r.component_id for r in graph.patch_components(areas, edges).collect()}
    pairs = {(r.raster_id, r.lo, r.hi) for r in edges.collect()}
    for k, g in enumerate(many):
        habitat = np.isin(g, HABITAT)
        name, want, hops = brute_graph(habitat, 2.0)
        assert {c: p for (i, *c), p in ((k_, v) for k_, v in names.items()) if i == f"g{k}" for c in [tuple(c)]} == name
        assert {(a, b) for i, a, b in pairs if i == f"g{k}"} == want
        assert {p: c for (i, p), c in comps.items() if i == f"g{k}"} == {p: min(b for (a, b) in hops if a == p) for p in set(name.values())}
        assert score[f"g{k}"] == pytest.approx(brute_iic(habitat, float((habitat | np.isin(g, RESTORABLE)).sum()), 2.0))


def test_components_by_rounds_and_in_one_task(spark):
    rng = np.random.default_rng(3)
    pairs = [(f"r{k}", int(a), int(b)) for k in range(3) for a, b in rng.integers(0, 60, (45, 2))]
    edges = spark.createDataFrame(pairs, "raster_id string, a long, b long")
    edges = edges.select(F.struct("raster_id", F.col("a").alias("id")).alias("u"), F.struct("raster_id", F.col("b").alias("id")).alias("v"))
    one = {tuple(r.node): tuple(r.component) for r in graph.components(edges).collect()}
    assert one == {tuple(r.node): tuple(r.component) for r in graph.components(edges, most_local=0).collect()}
    for k, a, b in pairs:
        assert a == b or one[k, a] == one[k, b] <= (k, min(a, b))


def test_bridge_by_frames_agrees_with_the_kernel(spark):
    rng = np.random.default_rng(14)
    many = [CODES[rng.choice(6, (6, 8), p=[0.25, 0.05, 0.3, 0.25, 0.1, 0.05])] for _ in range(6)]
    masked = raster.with_masks(frame(spark, *many))
    lab = graph.label_patches(masked.where("habitat"))
    comp = graph.patch_components(graph.patch_areas(lab), graph.patch_edges(lab, 1.5))
    state = graph.cheapest_routes(masked, lab.join(comp, ["raster_id", "patch_id"]).select("raster_id", "cell_id", "component_id"))
    bridge = graph.cheapest_bridge(state)
    route = {}
    for r in graph.bridge_cells(state, bridge).collect():
        route.setdefault(r.raster_id, set()).add(r.cell_id)
    cost = {r.raster_id: r.cost for r in bridge.collect()}
    for k, g in enumerate(many):
        grid = planning.Grid(g, COSTS, 50, 1.5)
        own = sum(grid.cost.ravel()[c] for c in route.get(f"g{k}", ()))
        assert own == cost.get(f"g{k}", 0.0)
        assert set(planning.bridge_candidates(grid)) == route.get(f"g{k}", set()) & set(grid.valid().tolist())


def test_scenario_rows_fit_the_results_table(spark):
    from tessella.model import RESULT_KEY
    from tessella.sources.results import upsert

    g = CODES[np.random.default_rng(4).choice(6, (4, 5))]
    rows = planning.run_scenarios(frame(spark, g), ["random", "naive"], {"1:2": COSTS}, [2, 3], 1.5, evaluations=2).cache()
    assert rows.count() == 4 and upsert(rows, rows, RESULT_KEY).count() == 4
    assert "Random Valid Action" in reports.console(rows)


def test_gaps_by_frames_and_by_grid(spark):
    rng = np.random.default_rng(6)
    cells = frame(spark, *[CODES[rng.choice(6, (6, 7))] for _ in range(3)])
    masked = raster.with_masks(cells)
    frames = graph.gap_distances(masked, graph.label_patches(masked.where("habitat")))
    assert sorted(map(tuple, frames.collect())) == sorted(map(tuple, structure.gap_table(cells).where("steps > 0").collect()))


def test_resample_identity_and_blocks(spark):
    rng = np.random.default_rng(2)
    g = CODES[rng.choice(6, (12, 10))]
    cells = frame(spark, g)
    same = {(r.y, r.x): r.class_code for r in raster.resample(cells, (12, 10), (12, 10)).collect()}
    assert same == {(y, x): int(g[y, x]) for y in range(12) for x in range(10)}
    for th, tw in ((5, 3), (7, 10), (1, 1)):
        got = {(r.y, r.x): r.class_code for r in raster.resample(cells, (12, 10), (th, tw)).collect()}
        for i in range(th):
            for j in range(tw):
                v, n = np.unique(g[i * 12 // th : (i + 1) * 12 // th, j * 10 // tw : (j + 1) * 10 // tw], return_counts=True)
                assert got[i, j] == v[n.argmax()]


def test_windows_cover_full_ones_only(spark):
    g = np.arange(7 * 9).reshape(7, 9)
    got = raster.windows(frame(spark, g), (7, 9), (4, 4)).collect()
    want = {(y0, x0) for y0 in range(0, 4, 2) for x0 in range(0, 6, 2)}
    assert {(r.y0, r.x0) for r in got} == want and len(got) == 16 * len(want)
    assert all(r.class_code == g[r.y0 + r.y, r.x0 + r.x] for r in got)
    assert raster.windows(frame(spark, g), (7, 9), (8, 4)).count() == 0


def test_structure_guards(spark):
    structure_of = lambda g: structure.window_structure(frame(spark, g)).first()
    assert structure_of(np.full((5, 5), 31))["score"] == -1
    g = np.full((5, 12), 13)
    g[:, :3], g[:, 8:] = 5, 5
    s = structure_of(g)
    assert (s["n_patches"], s["gap"], s["prize"], s["bait"], s["n_valid_pairs"]) == (2, 6, 300.0, 5, 1)
    assert s["score"] == pytest.approx(0.4 * (1 - 4 / 20) + 0.4 * 0.75 + 0.2 * 0.25)


def test_episode_rules():
    g = np.array([[5, 13, 21, 5], [31, 13, 21, 0]])
    s = planning.Grid(g, COSTS, 3, 1.0)
    assert s.valid().tolist() == [1, 2]
    for name in planning.POLICIES:
        e = planning.run_episode(s, name, 1)
        assert e["cost"] <= 3 and e["iic_final"] >= e["iic_initial"] and e["invalid"] == 0 and len(set(e["plant_order"])) == e["n_planted"]
    s.reset()
    for _ in range(3):
        assert s.step(0, penalties=True) == -0.05
    assert s.over() and s.invalid == 3
    blocked = planning.Grid(np.full((2, 2), 31), COSTS, 3, 1.0)
    assert planning.run_episode(blocked, "naive", 0)["invalid"] == 1
    with pytest.raises(ValueError, match="positive cost"):
        planning.Grid(np.array([[31]]), COSTS, 3, 1.0, (31,))


@settings(max_examples=25, deadline=None)
@given(grids, st.sampled_from([1.0, 2.5]))
def test_steps_keep_the_graph_of_the_whole_grid(g, r):
    s = planning.Grid(g, COSTS, 12, r)
    while True:
        s.step(planning.policy_random(s, 3))
        assert s.iic == planning.iic_of(s.habitat, s.area, r)
        if s.over():
            break


def test_blocks_grow_within_the_budget():
    s = planning.Grid(np.array([[5, 13, 13, 13, 13]]), COSTS, 3, 1.0, block=4)
    assert s.grow(1) == [1, 2, 3] and s.grow(2) == []


def test_gains_match_full_recomputation(spark):
    rng = np.random.default_rng(12)
    g = CODES[rng.choice(6, (6, 8), p=[0.3, 0.05, 0.25, 0.2, 0.1, 0.1])]
    got = {r.cell_id: r.gain for r in planning.candidate_gains(frame(spark, g), COSTS, 5.0, 2.0).collect()}
    habitat = np.isin(g, HABITAT)
    area = float((habitat | np.isin(g, RESTORABLE)).sum())
    before = brute_iic(habitat, area, 2.0)
    assert got
    for c, v in got.items():
        after = habitat.copy()
        after.ravel()[c] = True
        assert v == pytest.approx(brute_iic(after, area, 2.0) - before, abs=1e-9)


def test_headroom_of_published_gains(spark):
    rows = [("48x96", "naive", 0.0226611943560617), ("48x96", "cost", 0.0296645142265775), ("48x96", "bridge", 0.029993768424592)]
    h = reports.headroom(spark.createDataFrame(rows, "resolution string, method string, gain double"), ["resolution"]).first()
    assert h.vs_naive_percent == pytest.approx(32.35740338006012) and h.vs_cost_percent == pytest.approx(1.1099261410440056) and h.positive_headroom_percent == pytest.approx(1.1099261410440056)
    with pytest.raises(Exception, match="one result for each method"):
        reports.headroom(spark.createDataFrame(rows[:2], "resolution string, method string, gain double"), ["resolution"]).collect()


def test_method_selection():
    assert planning.choose_methods(None, None, False) == (["random", "naive", "cost"], ["ppo", "mask"])
    assert planning.choose_methods(["bridge"], None, False) == (["bridge"], [])
    assert planning.choose_methods(None, "mask", False) == ([], ["mask"])
    assert planning.choose_methods(None, None, True) == (["random", "naive", "cost"], [])
    with pytest.raises(ValueError):
        planning.choose_methods(None, "ppo", True)
    with pytest.raises(ValueError):
        planning.choose_methods(None, None, False, "main", "s2-tuned")


def test_pairs_of_cells_are_not_broadcast(spark):
    cells = frame(spark, np.full((3, 3), 5)).withColumn("patch_id", F.col("cell_id"))
    plan = graph.cell_pairs(cells, 5.0, ["patch_id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_gains_of_a_component_are_those_of_the_whole_graph(monkeypatch):
    grid = CODES[np.random.default_rng(5).choice(6, (30, 30), p=[0.15, 0.05, 0.25, 0.2, 0.2, 0.15])]
    whole = planning.Grid(grid, COSTS, 20, 2.0)
    gains = [whole.gain(c) for c in whole.valid().tolist()]
    monkeypatch.setattr(planning, "MOST_MATRIX", len(whole._known[0]) - 1)
    monkeypatch.setattr(planning.Grid, "_with_cell", None)
    parts = planning.Grid(grid, COSTS, 20, 2.0)
    assert [parts.gain(c) for c in parts.valid().tolist()] == gains
    for c in whole.valid()[::7].tolist():
        trial = whole.habitat.copy()
        trial.ravel()[c] = True
        assert whole.gain(c)[0] == pytest.approx(planning.iic_of(trial, whole.area, 2.0) - whole.iic, abs=1e-11)


def test_random_episodes_work_out_no_gains(monkeypatch):
    calls = []
    monkeypatch.setattr(planning, "hop_sums", lambda *a: calls.append(1) or graph.hop_sums(*a))
    grid = CODES[np.random.default_rng(6).choice(6, (20, 20), p=[0.2, 0.05, 0.25, 0.2, 0.2, 0.1])]
    assert planning.run_episode(planning.Grid(grid, COSTS, 20, 5.0), "random", 1)["n_planted"] > 5
    assert len(calls) == 2  # the first and the last state


def test_episodes_that_share_a_start_are_those_alone(monkeypatch):
    grid = CODES[np.random.default_rng(7).choice(6, (14, 14), p=[0.2, 0.05, 0.25, 0.2, 0.2, 0.1])]
    alone = [planning.run_episode(planning.Grid(grid, COSTS, b, 3.0), "cost", 0) for b in (6, 9)]
    first = planning.Grid(grid, COSTS, 6, 3.0)
    one = planning.run_episode(first, "cost", 0)
    calls = len(first._seen)
    second = planning.Grid(grid, COSTS, 9, 3.0)
    second.share(first)
    assert [one, planning.run_episode(second, "cost", 0)] == alone
    assert calls and second._seen is first._seen


def test_searches_are_dealt_by_blocks(spark):
    """A way of 700 patches: every patch is the source of one share, and all pairs are found and counted."""
    n, block = 700, 256
    areas = spark.createDataFrame([("g", 10 * k, 1 + k % 3) for k in range(n)], "raster_id string, patch_id long, area long")
    edges = spark.createDataFrame([("g", 10 * k, 10 * (k + 1)) for k in range(n - 1)], "raster_id string, lo long, hi long")
    size = np.array([1 + k % 3 for k in range(n)])
    want = {h: int((size[h:] @ size[: n - h]) * (2 if h else 1)) for h in range(n)}
    shares = graph._searches(areas, edges, block).collect()
    assert sorted(i for r in shares for i in r.own) == list(range(n)) and len(shares) == -(-n // block)
    assert {r.hop: r.s for r in graph.hop_products(areas, edges, block=block).collect()} == want
    assert graph.hop_distances(areas, edges, block=block).where("abs(src - dst) = 10 * hop").count() == n * n


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([2.0, 5.0]), st.booleans())
def test_best_cell_is_that_of_all_gains(seed, r, per_cost):
    """Cells are ruled out by a bound only: the choice is that of scoring every cell, before and after a cell is planted."""
    g = planning.Grid(CODES[np.random.default_rng(seed).choice(6, (18, 18), p=[0.12, 0.03, 0.3, 0.25, 0.2, 0.1])], COSTS, 20, r)
    for _ in range(2):
        if not len(cells := g.valid()):
            return
        scores = [round(a / b, 12) if per_cost else a for a, b in map(g.gain, cells.tolist())]
        assert g.best(cells, per_cost) == planning._best(scores, cells)
        g.act(int(cells[0]))
        assert g.iic == pytest.approx(planning.iic_of(g.habitat, g.area, r), rel=1e-13)


def test_few_cells_are_worked_out(monkeypatch):
    g = planning.Grid(CODES[np.random.default_rng(3).choice(6, (60, 60), p=[0.12, 0.03, 0.3, 0.25, 0.2, 0.1])], COSTS, 20, 3.0)
    calls, own = [], planning.Grid._sums_with
    monkeypatch.setattr(planning.Grid, "_sums_with", lambda *a: calls.append(1) or own(*a))
    assert planning.policy_naive(g) in g.valid()
    assert 0 < len(calls) < len(g.valid()) / 4


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_hops_by_elimination(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    a, b = rng.integers(0, n, (2, int(rng.integers(0, 2 * n))))
    ways = graph.Ways(n, a, b)
    got = ways.hops(ways.place)
    assert np.array_equal(got[ways.place], graph.hop_matrix(n, a, b))
    sizes = rng.integers(1, 5, n)
    by = np.empty(n, np.int64)
    by[ways.place] = sizes
    sums = graph.hop_sums(a, b, sizes)
    assert graph.sums_between(ways.hops(np.arange(n)), by, by, len(sums), held=50).tolist() == sums


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1.0, 2.0, 3.0, 5.0]))
def test_sums_of_states_by_shares(seed, r):
    rng = np.random.default_rng(seed)
    g = planning.Grid(rng.choice([5, 13, 21, 31], rng.integers(5, 24, 2), p=[0.15, 0.2, 0.2, 0.45]), COSTS, 12, r)
    if not len(g._first[0]):
        return
    ends = {}
    for k in range(4):
        for g.budget in (6.0, 12.0):
            e = planning.run_episode(g, "random", k)
            ends[tuple(e["plant_order"])] = g.iic
            assert sorted(g.sizes()) == sorted(np.bincount(planning.patches_of(g.habitat)[0]))
            assert np.array_equal(g.frontier, g._open())
    ends[()] = g.first_iic
    parts = [planning.state_sums(g, list(ends), k, 3, block=7) for k in range(3)]
    for order, iic in ends.items():
        sums = [sum(int(p[order][h]) for p in parts if h < len(p[order])) for h in range(max(len(p[order]) for p in parts))]
        assert abs(planning.fold(sums, g.area) - iic) < 1e-15


def test_random_episodes_of_many_patches(spark):
    rng = np.random.default_rng(5)
    c = frame(spark, *(rng.choice([5, 13, 21, 31], (18, 20), p=[0.15, 0.2, 0.2, 0.45]) for _ in range(2)))
    rows = [(f"1:2|{b:g}", m, s, b, 3.0, list(RESTORABLE), {k: float(v) for k, v in COSTS.items()}) for b in (4.0, 8.0) for m, s in (("random", 0), ("random", 1), ("naive", 0))]
    configs = spark.createDataFrame(rows, planning._CONFIG)
    held, shared = (sorted(planning.episodes(c, configs, **own).collect(), key=str) for own in ({}, {"most": 0}))
    assert len(held) == 12 and held == shared


@pytest.mark.parametrize("method", ["naive", "cost", "bridge"])
def test_greedy_episodes_of_many_patches(monkeypatch, method):
    """Without a matrix of hops, and without an IIC for each of the cells."""
    for seed in range(6):
        rng = np.random.default_rng(seed)
        c = rng.choice([5, 13, 21, 31], rng.integers(5, 22, 2), p=[0.15, 0.25, 0.2, 0.4])
        got = []
        for most in (planning.MOST_MATRIX, 0):
            with monkeypatch.context() as m:
                m.setattr(planning, "MOST_MATRIX", most)
                if not most and method != "bridge":
                    m.setattr(planning.Grid, "gain", None)
                e = planning.run_episode(planning.Grid(c, COSTS, 8, [2.0, 3.0, 5.0][seed % 3]), method, 0)
                got.append({k: round(v, 13) if k.startswith("iic") else v for k, v in e.items()})
        assert got[0] == got[1]
