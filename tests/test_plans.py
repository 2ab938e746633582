"""Plans over all nodes against the way that gathers a surface, and what must be refused."""

from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from runoff.operators import analytics, grouped
from runoff.operators.kernels import COLUMN, SCALAR, FlowKernelEroder, create_flow_kernel
from runoff.plans.graph import DiffusionADIEroder, FlowGraph, FlowSnapshot, MSTSinkResolver, MultiFlowRouter, PFloodSinkResolver, SingleFlowRouter, SPLEroder
from runoff.plans import graph as plans
from runoff.plans import iterate, sheets
from runoff.plans.iterate import ancestors, sum_downstream
from runoff.schema import FlowDirection, FlowGraphTraversalDir, MSTMethod, MSTRouteMethod, NodeStatus, RasterConnect
from runoff.sources.grids import HealpixGrid, ProfileBoundaryStatus, ProfileGrid, RasterBoundaryStatus, RasterGrid, TriMesh
from runoff.sources.surfaces import synthetic

C, F_, L = NodeStatus.CORE, NodeStatus.FIXED_VALUE, NodeStatus.LOOPED
BOTTOM = RasterBoundaryStatus(C, C, C, F_)


def surfaces(spark, *zs):
    return spark.createDataFrame([(g, i, float(v)) for g, z in enumerate(zs) for i, v in enumerate(np.ravel(z))], "grid_id long, idx long, z double")


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy(*names[:2]).collect()]


@pytest.mark.parametrize("z", [[0, 1, 2, float("nan"), 0], [0, 1, 2, None, 0], [0, 1, 2, 3], [0, 1, 2, 3, 4, 5]])
def test_bad_elevations_are_refused(spark, z):
    graph = FlowGraph(ProfileGrid(spark, 5, 1.0, ProfileBoundaryStatus.of(F_)), [SingleFlowRouter()])
    frame = spark.createDataFrame([(0, i, v if v is None else float(v)) for i, v in enumerate(z)], "grid_id long, idx long, z double")
    with pytest.raises(ValueError):
        graph.update_routes(frame)
    with pytest.raises(ValueError):
        graph.update_routes(surfaces(spark, [0, 1, 2, 3, 4]).unionByName(surfaces(spark, [0])))


def test_masked_nodes_need_no_number(spark):
    graph = FlowGraph(ProfileGrid(spark, 5, 1.0, ProfileBoundaryStatus.of(F_)), [SingleFlowRouter()])
    graph.set_mask(spark.createDataFrame([(0, 3), (0, 3)], "grid_id long, idx long"))
    graph.update_routes(surfaces(spark, [0, 1, 2, float("nan"), 0]))
    assert rows(graph.flow, "src", "rec") == [(0, 0), (1, 0), (2, 1), (3, 3), (4, 4)]


@pytest.mark.parametrize("recs", [[1, 2, 0, 3], [0, 9, 1, 2]])
def test_circles_and_lost_nodes_end(spark, recs):
    flow = spark.createDataFrame([(0, i, r) for i, r in enumerate(recs)], "grid_id long, src long, rec long")
    with pytest.raises(ValueError):
        ancestors(flow)
    if 9 not in recs:
        with pytest.raises(ValueError):
            sum_downstream(flow, spark.range(4).selectExpr("0L as grid_id", "id as idx", "1.0D as v"), "v")


@pytest.fixture(params=[(7, 1 << 17), (7, 3)], ids=["gathered", "rounds"])
def small_blocks(request, monkeypatch):
    """Blocks of few nodes; what is left between them is gathered, or solved by rounds."""
    for name, value in zip(("BLOCK", "GATHERED"), request.param, strict=True):
        monkeypatch.setattr(iterate, name, value)


def test_paths_by_blocks(spark, small_blocks):
    rng = np.random.default_rng(3)
    recs = [[0] + [int(rng.integers(max(0, i - 5), i)) for i in range(1, 90)], [int(rng.integers(0, i + 1)) for i in range(90)]]
    flow = spark.createDataFrame([(g, i, r) for g, rec in enumerate(recs) for i, r in enumerate(rec)], "grid_id long, src long, rec long")
    own = spark.createDataFrame([(g, i, float(i % 7)) for g in (0, 1) for i in range(90)], "grid_id long, idx long, v double")
    depth, root, total = [], [], []
    for g, rec in enumerate(recs):
        sums = [float(i % 7) for i in range(90)]
        for i in range(89, -1, -1):
            if rec[i] != i:
                sums[rec[i]] += sums[i]
        d, r = [0] * 90, list(range(90))
        for i in range(90):
            if rec[i] != i:
                d[i], r[i] = d[rec[i]] + 1, r[rec[i]]
        depth += [(g, i, x) for i, x in enumerate(d)]
        root += [(g, i, x) for i, x in enumerate(r)]
        total += [(g, i, x) for i, x in enumerate(sums)]
    given = flow.where("src = rec").select("grid_id", F.col("src").alias("idx"), (F.col("src") % 2 == 0).alias("even"))
    found = ancestors(flow, given)
    assert rows(found, "grid_id", "idx", "depth") == depth and rows(found, "grid_id", "idx", "root") == root
    assert [r[2] for r in rows(found, "grid_id", "idx", "even")] == [x % 2 == 0 for _, _, x in root]
    assert rows(sum_downstream(flow, own, "v"), "grid_id", "idx", "v") == total


@pytest.mark.parametrize("recs", [[1, 2, 0, 3], [0, 9, 1, 2], [0, 8, 1, 2, 3, 4, 5, 6, 7]])
def test_circles_across_blocks_end(spark, small_blocks, recs):
    flow = spark.createDataFrame([(0, i, r) for i, r in enumerate(recs)], "grid_id long, src long, rec long")
    with pytest.raises(ValueError):
        ancestors(flow)
    with pytest.raises(ValueError):
        sum_downstream(flow, spark.range(len(recs)).selectExpr("0L as grid_id", "id as idx", "1.0D as v"), "v")


def test_long_paths_take_few_rounds(spark, monkeypatch):
    """Not one round for each doubling of the path's length."""
    made = []
    plain = iterate.durable
    monkeypatch.setattr(iterate, "durable", lambda df: made.append(1) or plain(df))
    flow = spark.range(3000).selectExpr("0L as grid_id", "id as src", "greatest(id - 1, 0L) as rec")
    assert ancestors(flow).agg(F.sum("depth")).first()[0] == 2999 * 1500 and len(made) <= 4
    made.clear()
    total = sum_downstream(flow, flow.select("grid_id", F.col("src").alias("idx"), F.lit(1.0).alias("v")), "v")
    assert total.agg(F.max("v")).first()[0] == 3000 and len(made) <= 4


def test_forest_by_blocks(spark, small_blocks):
    """As Kruskal's, with equal passes and surfaces that fall apart."""
    rng = np.random.default_rng(7)
    pairs = sorted({(g, min(a, b), max(a, b)) for g in (0, 1) for a, b in rng.integers(0, 60, (150 - 90 * g, 2)).tolist() if abs(a - b) < 20 and a != b})
    edges = [(g, a, b, float(rng.integers(0, 9))) for g, a, b in pairs]
    tree, names = analytics.spanning_forest(spark.createDataFrame(edges, "grid_id long, b0 long, b1 long, pass_elev double"))
    wanted, parts = [], 0
    for g in (0, 1):
        here = [e for e in edges if e[0] == g]
        b0, b1, elev = (np.array([e[k] for e in here]) for k in (1, 2, 3))
        kept = grouped.spanning_tree(b0, b1, elev, 60)
        wanted += [here[k][:3] for k in kept]
        parts += len(set(b0.tolist()) | set(b1.tolist())) - len(kept)
    assert sorted(tuple(r) for r in tree.select("grid_id", "b0", "b1").collect()) == sorted(wanted)
    assert names.select("grid_id", "b").distinct().count() == names.count() and names.select("grid_id", "c").distinct().count() == parts
    ends = tree.join(names, (names.grid_id == tree.grid_id) & (names.b == tree.b0)).select(tree.grid_id, "b1", "c")
    assert ends.join(names.select("grid_id", F.col("b").alias("b1"), F.col("c").alias("d")), ["grid_id", "b1"]).where("c <> d").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_orientation_by_blocks(spark, small_blocks, monkeypatch, seed):
    """Trees across blocks lead to their roots, a tree without a way out is left out, and the tour finds the same."""
    rng = np.random.default_rng(seed)
    edges, wanted = [], []
    for g in (0, 1):
        up = {int(i): int(rng.integers(max(0, i - 9), i)) for i in range(1, 60) if i not in (20, 40)}
        roots = {0: 60, 20: 61}  # 40 and what hangs on it have none
        number = {**{i: int(x) for i, x in enumerate(rng.permutation(60) if seed == 2 else range(60))}, 60: 60, 61: 61}
        top = lambda i: i if i not in up else top(up[i])
        for i, j in [*up.items(), *roots.items()]:
            a, b = number[i], number[j]
            edges.append((g, min(a, b), max(a, b), 1000 * g + a, 1000 * g + b, float(a), float(b), 1.0, 1.0) if a < b else (g, b, a, 1000 * g + b, 1000 * g + a, float(b), float(a), 1.0, 1.0))
            if top(i) != 40:
                wanted.append((g, a, b, 1000 * g + a, 1000 * g + b, float(a), float(b)))
    tree = spark.createDataFrame(edges, "grid_id long, b0 long, b1 long, p0 long, p1 long, z0 double, z1 double, pass_elev double, pass_len double")
    outer = spark.createDataFrame([(g, b) for g in (0, 1) for b in (60, 61)], "grid_id long, b long")
    names = analytics.spanning_forest(tree.unionByName(spark.createDataFrame([(g, 60, 61, 0.0) for g in (0, 1)], "grid_id long, b0 long, b1 long, pass_elev double"), allowMissingColumns=True))[1]
    columns = ("grid_id", "up", "down", "inside", "outside", "z_in", "z_out")
    assert rows(analytics.orient(tree, names, outer), *columns) == sorted(wanted)
    assert rows(analytics._toured(tree, names, outer), *columns) == sorted(wanted)
    if iterate.GATHERED > 100:  # blocks gather what is left, so nothing is toured
        monkeypatch.setattr(analytics, "_toured", None)
        assert analytics.orient(tree, names, outer).count() == len(wanted)


def test_filling_waits_until_read(spark, monkeypatch):
    made = []
    monkeypatch.setattr(plans, "fill", lambda surface, flow, plain=plans.fill: made.append(1) or plain(surface, flow))
    graph = FlowGraph(ProfileGrid(spark, 6, 1.0, ProfileBoundaryStatus(F_, C)), [SingleFlowRouter(), MSTSinkResolver(MSTMethod.BORUVKA)])
    graph.route(surfaces(spark, [0, 3, 1, 2, 1, 5]))
    assert [r[1] for r in rows(graph.flow, "src", "rec")] == [0, 0, 1, 2, 3, 4] and not made
    assert [r[1] for r in rows(graph.state.surface, "idx", "z")][:2] == [0, 3] and graph.state.surface.where("z > 3").count() == 4 and len(made) == 1


def test_sums_over_several_receivers_by_blocks(spark, small_blocks):
    """Ways down that leave blocks and come back."""
    rng = np.random.default_rng(12)
    edges = []
    for i in range(1, 80):
        to = sorted({int(x) for x in rng.integers(max(0, i - 12), i, 3)})
        edges += [(0, (i * 37) % 80, s, (t * 37) % 80, 1.0 / len(to)) for s, t in enumerate(to)]
    flow = spark.createDataFrame([*edges, (0, 0, 0, 0, 0.0)], "grid_id long, src long, slot int, rec long, weight double")
    own = spark.range(80).selectExpr("0L as grid_id", "id as idx", "cast(id % 5 as double) as acc")
    src, rec, weight = (np.array([e[k] for e in edges]) for k in (1, 3, 4))
    wanted = grouped.accumulate_np(80, src, rec, weight, np.arange(80) % 5)
    found = rows(iterate.sum_by_levels(flow, own, "acc"), "grid_id", "idx", "acc")
    assert len(found) == 80 and np.allclose([r[2] for r in found], wanted)
    circle = spark.createDataFrame([(0, 1, 0, 2, 0.5), (0, 2, 0, 1, 1.0), (0, 1, 1, 0, 0.5), (0, 0, 0, 0, 0.0)], "grid_id long, src long, slot int, rec long, weight double")
    with pytest.raises(ValueError):
        iterate.sum_by_levels(circle, own.where("idx < 3"), "acc")


@pytest.mark.parametrize(("direction", "threads"), [*[(d, 1) for d in FlowGraphTraversalDir], (FlowGraphTraversalDir.BREADTH_UPSTREAM, 2)])
def test_kernels_by_basins(spark, monkeypatch, direction, threads):
    """No task takes the whole surface, and what a kernel writes is the same."""
    z = np.random.default_rng(14).random((12, 9))
    graph = FlowGraph(RasterGrid(spark, (12, 9), (1.0, 2.0), BOTTOM), [SingleFlowRouter()])
    graph.update_routes(surfaces(spark, z))

    def mix(node):
        node.a = 0.5 * node.a + node.receivers.b[0] + node.donors.b.sum() + node.receivers.distance[0]
        node.b = node.a / 3 + node.b

    def push(node):
        mix(node)
        if node.receivers.distance[0] > 0:
            node.receivers.b = node.receivers.b + 0.25 * node.b

    def outcome():
        kernel, data = create_flow_kernel(graph, mix if threads > 1 else push, {"a": (COLUMN, 1.0), "b": COLUMN}, apply_dir=direction, outputs=["a", "b"], n_threads=threads)
        data.bind(b=z)
        return rows(graph.apply_kernel(kernel, data), "grid_id", "idx", "a", "b")

    whole = outcome()
    monkeypatch.setattr(iterate, "BLOCK", 10)
    sizes, plain = [], grouped.per_grid
    monkeypatch.setattr(grouped, "per_grid", lambda *a: sizes.append(1) or plain(*a))
    assert outcome() == whole and not sizes


def test_flooding_goes_on_from_filled_routes(spark, monkeypatch):
    """A long way over many blocks takes no round for each of them."""
    rng = np.random.default_rng(15)
    z = rng.integers(0, 40, (60, 5)) + 2 * np.arange(60)[::-1, None]
    grid = RasterGrid(spark, (60, 5), (1.0, 1.0), BOTTOM)
    graph = FlowGraph(grid, [PFloodSinkResolver(), SingleFlowRouter()])
    whole = rows(graph.update_routes(surfaces(spark, z)), "grid_id", "idx", "z")
    monkeypatch.setattr(grouped, "LOCAL_NODES", 15)
    made, applied = [], type(grid).linked
    monkeypatch.setattr(type(grid), "linked", lambda self, df: made.append(1) or applied(self, df))
    assert rows(graph.update_routes(surfaces(spark, z)), "grid_id", "idx", "z") == whole and len(made) < 10


@pytest.mark.parametrize(("route", "case"), [(MSTRouteMethod.CARVE, "masked"), (MSTRouteMethod.BASIC, "ties")])
def test_resolved_by_plans_as_in_a_task(spark, route, case):
    rng = np.random.default_rng(4)
    zs = [rng.integers(0, 12, (14, 11)) if case == "ties" else rng.random((14, 11)) for _ in range(3)]
    if case == "masked":
        zs[1][5, 3:9] = 0.0
    bounds = RasterBoundaryStatus(C, C, F_, C) if case != "masked" else RasterBoundaryStatus(L, L, F_, C)
    out = []
    for method in MSTMethod:
        graph = FlowGraph(RasterGrid(spark, (14, 11), (1.5, 2.0), bounds, grids=3), [SingleFlowRouter(), MSTSinkResolver(method, route)])
        if case == "masked":  # a ring of masked nodes cuts an inner basin off
            ring = [(r, c) for r in range(6, 11) for c in range(4, 9) if r in (6, 10) or c in (4, 8)]
            graph.set_mask([r * 11 + c for r, c in ring])
        z = graph.update_routes(surfaces(spark, *zs))
        out.append((rows(z, "grid_id", "idx", "z"), rows(graph.flow, "grid_id", "src", "rec", "distance")))
        left = graph.pits().count()
        assert left == 0 if case != "masked" else left > 0
    assert out[0] == out[1]


def test_basin_graph(spark):
    rng = np.random.default_rng(9)
    z = rng.random((9, 13))
    graph = FlowGraph(RasterGrid(spark, (9, 13), (1.0, 1.0), BOTTOM), [SingleFlowRouter()])
    graph.update_routes(surfaces(spark, z))
    basins = graph.basin_graph()
    n, n_outer = basins.basins_count().first()["n"], basins.outlets().where("outer").count()
    assert basins.tree().count() == n - 1 and basins.tree().where("p0 is null").count() == n_outer - 1
    edges = [(r["pass_elev"], r["b0"], r["b1"]) for r in basins.edges().collect()]
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    weight = 0.0
    for e, a, b in sorted(edges):
        if top(a) != top(b):
            parent[top(a)] = top(b)
            weight += max(e, 0.0)
    assert sum(max(r["pass_elev"], 0.0) for r in basins.tree().collect()) == pytest.approx(weight)
    down = {r["up"]: r["down"] for r in basins.oriented().collect()}
    outer = {r["basin"] for r in basins.outlets().where("outer").collect()}
    assert set(down) == set(range(n)) - outer
    for b in down:
        steps = 0
        while b in down:
            b, steps = down[b], steps + 1
            assert steps <= n
        assert b in outer


@pytest.mark.parametrize(("connect", "bounds"), list(zip(RasterConnect, [RasterBoundaryStatus(L, L, L, L), BOTTOM, RasterBoundaryStatus(L, L, F_, C)], strict=True)))
def test_around_as_by_joins(spark, connect, bounds):
    rng = np.random.default_rng(2)
    grid = RasterGrid(spark, (4, 2), (1.0, 2.5), bounds, connect=connect, grids=2)
    frame = surfaces(spark, rng.random((4, 2)), rng.random((4, 2))).withColumn("odd", F.col("idx") % 3 == 1)
    from runoff.sources.grids import Grid

    plain = lambda df: sorted((r["grid_id"], r["idx"], r["z"], r["odd"], [tuple(x) for x in r["near"]]) for r in df.collect())
    assert plain(grid.around(frame, ["z"], ["odd"], ~F.col("odd"))) == plain(Grid.around(grid, frame, ["z"], ["odd"], ~F.col("odd")))
    counted = {(r["grid_id"], r["idx"]): r["n"] for r in grid.neighbors_count().collect()}
    assert counted == {(r["grid_id"], r["idx"]): r["n"] for r in Grid.neighbors_count(grid).collect()}


def test_routes_take_one_exchange(spark):
    grid = RasterGrid(spark, (20, 20), (1.0, 1.0), BOTTOM)
    from runoff.operators.routing import multi_flow, single_flow

    frame = surfaces(spark, np.random.default_rng(1).random((20, 20))).selectExpr("*", "false as masked", "idx >= 380 as is_base")
    for plan in (single_flow(grid, frame), multi_flow(grid, frame)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_order_and_donors(spark):
    graph = FlowGraph(ProfileGrid(spark, 8, 1.0, ProfileBoundaryStatus.of(F_)), [SingleFlowRouter()])
    graph.update_routes(surfaces(spark, [0, 0.2, 0.1, 0.2, 0.4, 0.6, 0.3, 0]))
    assert [r["idx"] for r in graph.bfs_order().orderBy("place").collect()] == [0, 2, 7, 1, 3, 6, 4, 5]
    assert [r["donors"] for r in graph.donors().orderBy("idx").collect()] == [[1], [], [3], [4], [], [], [5], [6]]
    graph.set_base_levels([2])
    graph.update_routes(surfaces(spark, [0, 0.2, 0.1, 0.2, 0.4, 0.6, 0.3, 0]))
    assert [r["idx"] for r in graph.base_levels().collect()] == [2] and rows(graph.pits(), "grid_id", "idx") == [(0, 0), (0, 7)]
    multi = FlowGraph(graph.grid, [PFloodSinkResolver(), MultiFlowRouter()])
    multi.update_routes(surfaces(spark, [0, 0.2, 0.1, 0.2, 0.4, 0.6, 0.3, 0]))
    assert all(len(r["receivers"]) == len(r["weights"]) for r in multi.receivers().collect())
    assert grouped.LOCAL_NODES >= 1 << 10


def test_large_surfaces_as_in_a_task(spark, monkeypatch):
    """Flooding, erosion and diffusion of surfaces too large for a task."""
    rng = np.random.default_rng(8)
    z = rng.random((13, 9)) * 50
    grid = RasterGrid(spark, (13, 9), (2.0, 3.0), BOTTOM)
    k = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(rng.random(117))], "grid_id long, idx long, k double")

    def outcome():
        flooded = FlowGraph(grid, [PFloodSinkResolver(), SingleFlowRouter()])
        flooded.set_mask([40, 41, 42])
        filled = rows(flooded.update_routes(surfaces(spark, z)), "grid_id", "idx", "z")
        plain = FlowGraph(grid, [SingleFlowRouter()])
        plain.update_routes(surfaces(spark, z))
        eroded = rows(SPLEroder(plain, k, 0.4, 1.0).erode(surfaces(spark, z), plain.accumulate(1.0), 10.0), "grid_id", "idx", "erosion")
        return filled, rows(DiffusionADIEroder(grid, k).erode(surfaces(spark, z), 0.5), "grid_id", "idx", "erosion"), eroded

    small = outcome()
    monkeypatch.setattr(grouped, "LOCAL_NODES", 30)
    large = outcome()
    assert small[:2] == large[:2] and [r[:2] for r in small[2]] == [r[:2] for r in large[2]]
    assert np.allclose([r[2] for r in small[2]], [r[2] for r in large[2]], atol=1e-9) and max(r[2] for r in large[2]) > 1


@pytest.mark.parametrize(("router", "exponent"), [(SingleFlowRouter, 2.0), (MultiFlowRouter, 1.0)])
def test_stream_power_by_blocks(spark, monkeypatch, router, exponent):
    """Laws that don't compose, on surfaces too large for a task; the ways down wind through many blocks."""
    rng = np.random.default_rng(5)
    z = rng.random((9, 7)) * 40
    grid = RasterGrid(spark, (9, 7), (2.0, 3.0), BOTTOM, grids=2)
    graph = FlowGraph(grid, [PFloodSinkResolver(), router()])
    filled = graph.update_routes(surfaces(spark, z, z[:, ::-1]))
    area = graph.accumulate(1.0)

    def outcome(k):
        eroder = SPLEroder(graph, k, 0.4, exponent, tolerance=1e-9)
        done = rows(eroder.erode(filled, area, 5.0), "grid_id", "idx", "erosion", "limited")
        assert eroder.n_corr == sum(r[3] for r in done)
        return done

    k = rng.random((9, 7)) * 0.2
    small = outcome(k)
    monkeypatch.setattr(grouped, "LOCAL_NODES", 11)
    assert outcome(k) == small and max(r[2] for r in small) > 1


def test_coefficients(spark):
    grid = RasterGrid(spark, (3, 4), (1.0, 1.0), BOTTOM)
    graph = FlowGraph(grid, [SingleFlowRouter()])
    table = grid.nodes.select("grid_id", "idx", F.lit(0.5).alias("k"))
    for eroder in (DiffusionADIEroder(grid, 0.5), SPLEroder(graph, 0.5, 0.5, 1.0)):
        assert eroder.k_coef == 0.5
        eroder.k_coef = np.full((3, 4), 0.25)
        assert eroder.k_coef.count() == 12
        eroder.k_coef = table
        for bad in (np.ones(11), table.where("idx > 0"), table.unionByName(table), table.withColumn("k", F.when(F.col("idx") > 0, 1.0))):
            with pytest.raises(ValueError):
                eroder.k_coef = bad
        with pytest.raises(TypeError):
            eroder.k_coef = "much"
    assert SPLEroder(graph, 0.5, 0.5, 1.0).n_corr == 0


def test_depth_first_by_plans(spark):
    rng = np.random.default_rng(6)
    graph = FlowGraph(RasterGrid(spark, (12, 10), (1.0, 1.0), BOTTOM, grids=2), [SingleFlowRouter()])
    graph.set_mask([33, 34])
    graph.update_routes(surfaces(spark, rng.random((12, 10)), rng.integers(0, 4, (12, 10))))
    for g in (0, 1):
        rec = np.array([r[1] for r in rows(graph.flow.where(f"grid_id = {g}"), "src", "rec")])
        found = [r["idx"] for r in graph.dfs_order().where(f"grid_id = {g}").orderBy("place").collect()]
        assert found == grouped.depth_order(120, np.arange(120), rec)


def test_records_of_neighbors(spark):
    grid = RasterGrid(spark, (3, 4), (1.0, 2.0), BOTTOM, connect=RasterConnect.ROOK)
    found = rows(grid.neighbors_records().where("src = 5"), "slot", "dst", "distance", "status", "row", "col")
    assert found == [(0, 1, 1.0, 0, 0, 1), (1, 4, 2.0, 0, 1, 0), (2, 6, 2.0, 0, 1, 2), (3, 9, 1.0, 1, 2, 1)]


def test_kernels(spark):
    grid = ProfileGrid(spark, 8, 1.0, ProfileBoundaryStatus.of(F_))
    graph = FlowGraph(grid, [SingleFlowRouter()])
    graph.update_routes(surfaces(spark, [0, 0.2, 0.1, 0.2, 0.4, 0.6, 0.3, 0]))

    def depth(node):
        node.d = node.receivers.d[0] + node.step if node.receivers.distance[0] > 0 else 0.0

    found = []
    for threads in (1, 2):
        kernel, data = create_flow_kernel(graph, depth, {"d": COLUMN, "step": SCALAR}, apply_dir=FlowGraphTraversalDir.BREADTH_UPSTREAM, outputs=["d"], n_threads=threads)
        with pytest.raises(ValueError):
            graph.apply_kernel(kernel, data)
        data.bind(d=np.full(8, 7.0), step=2.0)
        found.append(rows(graph.apply_kernel(kernel, data), "grid_id", "idx", "d"))
        assert rows(data.d, "grid_id", "idx", "value") == found[-1]
    assert found[0] == found[1] and [d for *_, d in found[0]] == [0, 2, 0, 2, 4, 4, 2, 0]
    assert data.var_names == ("d", "step") and data.grid_var_names == ("d",) and len(data) == 2 and data["step"] == 2.0 and data.missing is None
    with pytest.raises(ValueError):
        data.bind(d=np.zeros(7))
    with pytest.raises(KeyError):
        data.bind(other=1.0)
    with pytest.raises(TypeError):
        create_flow_kernel(graph, lambda node, more: None, {"d": COLUMN}, outputs=["d"])
    with pytest.raises(ValueError):
        create_flow_kernel(graph, depth, {"d": COLUMN}, outputs=["d"], n_threads=2)


@pytest.mark.parametrize(("threads", "output"), [(1, "a"), (2, "b")])
def test_kernels_write_outputs_only(spark, threads, output):
    graph = FlowGraph(ProfileGrid(spark, 3, 1.0, ProfileBoundaryStatus.of(F_)), [SingleFlowRouter()])
    graph.update_routes(surfaces(spark, [0, 1, 2]))

    def push(node):
        node.receivers.b = 9.0

    kernel, data = create_flow_kernel(graph, push, {"a": (COLUMN, 1.0), "b": (COLUMN, 2.0)}, apply_dir=FlowGraphTraversalDir.ANY, outputs=[output], n_threads=threads)
    with pytest.raises(Exception, match="no output"):
        graph.apply_kernel(kernel, data)


def test_depth_order():
    src, rec = np.arange(8), np.array([0, 0, 2, 2, 3, 6, 7, 7])
    assert grouped.depth_order(8, src, rec) == [0, 1, 2, 3, 4, 7, 6, 5]
    many = grouped.depth_order(4, np.array([0, 1, 2, 3, 3]), np.array([0, 0, 0, 1, 2]))
    assert sorted(many) == [0, 1, 2, 3] and many[0] == 0 and many[-1] == 3


def test_single_nodes(spark):
    grid = RasterGrid.from_length(spark, (3, 4), (2.0, 6.0), BOTTOM)
    assert grid.spacing == (1.0, 2.0) and grid.node_status(11) == F_ and grid.node_area(0) == 2.0
    assert grid.neighbors_indices(0) == [1, 4, 5] and grid.neighbors_distances(0) == pytest.approx([2.0, 1.0, 5**0.5])
    assert [(n.row, n.col, n.status) for n in grid.raster_neighbors(2, 3)] == [(1, 2, C), (1, 3, C), (2, 2, F_)]
    assert ProfileGrid.from_length(spark, 5, 8.0, ProfileBoundaryStatus.of(C)).spacing == 2.0
    for call in (lambda: grid.node_status(12), lambda: grid.neighbors_of(-1), lambda: grid.ravel_idx(3, 0), lambda: grid.unravel_idx(12)):
        with pytest.raises(IndexError):
            call()


def test_status_tables(spark):
    table = spark.createDataFrame([(0, int(NodeStatus.GHOST)), (5, int(F_))], "idx long, status int")
    sphere = HealpixGrid(spark, 2, table)
    plain = HealpixGrid(spark, 2, {0: NodeStatus.GHOST, 5: F_})
    assert rows(sphere.nodes, "grid_id", "idx", "status") == rows(plain.nodes, "grid_id", "idx", "status")
    assert sphere.edges.count() == plain.edges.count()
    with pytest.raises(ValueError):
        HealpixGrid(spark, 2, table.unionByName(table))
    points = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 1.0, 0.0), (0, 2, 0.0, 1.0)], "grid_id long, idx long, x double, y double")
    triangles = spark.createDataFrame([(0, 0, 1, 2)], "grid_id long, t0 long, t1 long, t2 long")
    with pytest.raises(ValueError):
        TriMesh(points, triangles, spark.createDataFrame([(0, 0, 1), (0, 0, 1), (0, 1, 0)], "grid_id long, idx long, status int"))


def test_snapshots_own_operators_and_eroders(spark):
    class Lift:
        name, elevation_updated, graph_updated = "Lift", True, False
        in_flowdir = out_flowdir = FlowDirection.UNDEFINED

        def apply(self, state):
            return replace(state, surface=state.surface.withColumn("z", F.col("z") + 1))

    graph = FlowGraph(ProfileGrid(spark, 4, 1.0, ProfileBoundaryStatus(F_, C)), [FlowSnapshot("raw", save_graph=False, save_elevation=True), Lift(), SingleFlowRouter()])
    z = surfaces(spark, [0, 1, 2, 3])
    assert [r[2] for r in rows(graph.update_routes(z), "grid_id", "idx", "z")] == [1, 2, 3, 4]
    assert graph.elevation_snapshot_keys() == ["raw"] and [r[2] for r in rows(graph.elevation_snapshot("raw"), "grid_id", "idx", "z")] == [0, 1, 2, 3]

    class Slope(FlowKernelEroder):
        param_spec = staticmethod(lambda: ["k"])
        input_spec = staticmethod(lambda: ["h"])
        kernel_apply_dir = staticmethod(lambda: FlowGraphTraversalDir.ANY)

        @staticmethod
        def eroder_kernel(node):
            node.erosion = node.k * (node.h - node.receivers.h[0])

    heights = z.withColumnRenamed("z", "value")
    assert [r[2] for r in rows(Slope(graph).erode(k=0.5, h=heights), "grid_id", "idx", "erosion")] == [0, 0.5, 0.5, 0.5]
    with pytest.raises(KeyError):
        Slope(graph).erode(k=0.5)
    with pytest.raises(ValueError):
        Slope(graph).erode(k=0.5, h=heights, more=1)
    cone = {r["idx"]: r["z"] for r in synthetic(RasterGrid(spark, (3, 3), (1.0, 1.0), BOTTOM), "cone").collect()}
    assert cone[4] == pytest.approx(2**0.5) and cone[0] == pytest.approx(0)


@pytest.mark.parametrize("bounds", [BOTTOM, RasterBoundaryStatus(L, L, F_, C), RasterBoundaryStatus(L, L, L, L)], ids=["open", "sides", "all"])
@pytest.mark.parametrize("connect", [RasterConnect.QUEEN, RasterConnect.ROOK], ids=["queen", "rook"])
def test_routes_and_passes_by_blocks(spark, monkeypatch, bounds, connect):
    z = surfaces(spark, np.random.default_rng(5).integers(0, 5, 99), np.random.default_rng(6).integers(0, 40, 99))

    def made():
        graph = FlowGraph(RasterGrid(spark, (11, 9), (1.0, 2.0), bounds, connect=connect, grids=2), [SingleFlowRouter()])
        graph.set_mask(F.col("idx") % 13 == 4)
        graph.set_base_levels(F.col("idx") % 31 == 2)
        graph.update_routes(z)
        return sorted(map(tuple, graph.flow.collect())), sorted(map(tuple, graph.basin_edges().where("p0 is not null").collect()))

    whole = made()
    monkeypatch.setattr(grouped, "LOCAL_NODES", 50)
    monkeypatch.setattr(iterate, "BLOCK", 16)
    monkeypatch.setattr(RasterGrid, "around", None)  # each node's neighbours side by side
    assert made() == whole and len(whole[1]) > 10


def test_filling_beside_masked_nodes_without_a_number(spark):
    graph = FlowGraph(ProfileGrid(spark, 7, 1.0, ProfileBoundaryStatus.of(F_)), [SingleFlowRouter(), MSTSinkResolver(MSTMethod.BORUVKA)])
    graph.set_mask([4])
    z = [0.0, 3.0, 1.0, 5.0, None, 4.0, 0.0]
    filled = graph.update_routes(spark.createDataFrame([(0, i, v) for i, v in enumerate(z)], "grid_id long, idx long, z double"))
    assert [r[1] for r in rows(filled, "idx", "z")] == [0.0, 3.0, np.nextafter(3.0, 4.0), 5.0, None, 4.0, 0.0]


@pytest.mark.parametrize("gathered", [1 << 17, 3], ids=["gathered", "rounds"])
@pytest.mark.parametrize("bounds", [BOTTOM, RasterBoundaryStatus(L, L, F_, C), RasterBoundaryStatus(L, L, L, L)], ids=["open", "sides", "all"])
def test_sinks_on_sheets(spark, monkeypatch, bounds, gathered):
    """Blocks that exchange borders only give the routes and elevations of a task; masked nodes need no number."""
    z = surfaces(spark, np.random.default_rng(8).integers(0, 6, 99), np.random.default_rng(9).integers(0, 40, 99))
    z = z.withColumn("z", F.when(F.col("idx") % 13 != 4, F.col("z")))
    mask = spark.range(99).where("id % 13 = 4").selectExpr("explode(array(0L, 1L)) as grid_id", "id as idx")

    def made(where, route):
        graph = FlowGraph(RasterGrid(spark, (11, 9), (1.0, 2.0), bounds, grids=2), [SingleFlowRouter(), MSTSinkResolver(route_method=route)])
        graph.set_mask(where)
        graph.set_base_levels(F.col("idx") % 31 == 2)
        filled = graph.update_routes(z)
        return sorted(map(tuple, graph.flow.collect())), rows(filled, "grid_id", "idx", "z")

    whole = [made(mask, route) for route in MSTRouteMethod]
    monkeypatch.setattr(grouped, "LOCAL_NODES", 50)
    monkeypatch.setattr(iterate, "BLOCK", 16)
    monkeypatch.setattr(iterate, "GATHERED", gathered)
    monkeypatch.setattr(analytics, "labelled", None)  # basins by sheets
    assert [made(mask, route) for route in MSTRouteMethod] == whole
    if gathered > 3:
        assert made(F.col("idx") % 13 == 4, MSTRouteMethod.BASIC) == whole[list(MSTRouteMethod).index(MSTRouteMethod.BASIC)]


def test_sheets_take_each_node_once(spark, monkeypatch):
    grid = RasterGrid(spark, (6, 5), (1.0, 1.0), BOTTOM)
    good = surfaces(spark, np.arange(30) % 7)
    extra = lambda g, i, v: good.unionByName(spark.createDataFrame([(g, i, v)], "grid_id long, idx long, z double"))
    cases = [good.where("idx <> 17"), extra(0, 9, 1.0), extra(0, 30, 1.0), extra(1, 3, 1.0), extra(None, 3, 1.0), extra(0, -1, 1.0), good.where("idx < 0")]
    cases += [good.withColumn("z", F.when(F.col("idx") != 8, F.col("z"))), good.withColumn("z", F.when(F.col("idx") != 8, F.col("z")).otherwise(float("nan")))]

    def refused(df):
        with pytest.raises(ValueError) as found:
            FlowGraph(grid, [SingleFlowRouter()]).update_routes(df)
        return str(found.value)

    whole = [refused(df) for df in cases]
    monkeypatch.setattr(grouped, "LOCAL_NODES", 10)
    monkeypatch.setattr(iterate, "BLOCK", 8)
    assert [refused(df) for df in cases] == whole


def test_changed_surfaces_leave_their_sheets(spark, monkeypatch):
    """Passes are those of the surface as it is, also where an operator changed it after routing."""
    class Flat:
        name, elevation_updated, graph_updated = "Flat", True, False
        in_flowdir = out_flowdir = FlowDirection.UNDEFINED

        def apply(self, state):
            return replace(state, surface=state.surface.withColumn("z", F.when(F.col("idx") == 12, 0.5).otherwise(F.col("z"))))

    def made():
        graph = FlowGraph(ProfileGrid(spark, 30, 1.0, ProfileBoundaryStatus.of(F_)), [SingleFlowRouter(), Flat(), MSTSinkResolver(route_method=MSTRouteMethod.BASIC)])
        return rows(graph.update_routes(surfaces(spark, [0, *np.random.default_rng(4).integers(1, 9, 28), 0])), "grid_id", "idx", "z"), sorted(map(tuple, graph.flow.collect()))

    whole = made()
    monkeypatch.setattr(grouped, "LOCAL_NODES", 10)
    monkeypatch.setattr(iterate, "BLOCK", 8)
    assert made() == whole


def test_sheets_are_small():
    """Checkpoints hold on to many rows as they are written: 54,000,000 nodes filled a heap of 10 GB with plain arrays."""
    ids = np.arange(5 * 65536, 6 * 65536)
    row = SimpleNamespace(ids=sheets._kept(np.diff(ids, prepend=0)), rec=sheets._kept(np.maximum(ids - 50, 0) - ids), z=sheets._kept(np.zeros(0)))
    assert len(row.ids) + len(row.rec) < 2 * ids.nbytes // 10 and np.array_equal(sheets._ids(row), ids) and np.array_equal(sheets._rec(row, ids), ids - 50)
    assert len(sheets._array(row, "z", float)) == 0
