"""Known outcomes on small surfaces, and invariants."""

import math

import numpy as np
import pytest

from runoff.functions.ordinals import from_ordinal, ordinal
from runoff.operators import grouped
from runoff.operators.analytics import boruvka
from runoff.plans.graph import DiffusionADIEroder, FlowGraph, FlowSnapshot, MSTSinkResolver, MultiFlowRouter, PFloodSinkResolver, SingleFlowRouter, SPLEroder
from runoff.plans.iterate import ancestors
from runoff.schema import MSTRouteMethod, NodeStatus, RasterConnect
from runoff.sources.grids import HealpixGrid, healpix_lonlat, healpix_neighbors, ProfileBoundaryStatus, ProfileGrid, RasterBoundaryStatus, RasterGrid, TriMesh
from runoff.streaming.steps import simulate

C, F_, G, L = NodeStatus.CORE, NodeStatus.FIXED_VALUE, NodeStatus.FIXED_GRADIENT, NodeStatus.LOOPED
BOTTOM = RasterBoundaryStatus(C, C, C, F_)


def surface(spark, z):
    return spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(np.ravel(z))], "grid_id long, idx long, z double")


def column(df, name):
    return [r[name] for r in df.orderBy("idx" if "idx" in df.columns else "src").collect()]


def test_profile(spark):
    grid = ProfileGrid(spark, 8, 1.0, ProfileBoundaryStatus.of(F_))
    graph = FlowGraph(grid, [SingleFlowRouter()])
    z = surface(spark, [0, 0.2, 0.1, 0.2, 0.4, 0.6, 0.3, 0])
    graph.update_routes(z)
    assert column(graph.flow, "rec") == [0, 0, 2, 2, 3, 6, 7, 7]
    assert column(graph.flow, "distance") == [0, 1, 0, 1, 1, 1, 1, 0]
    assert column(graph.donors_count(), "n") == [1, 0, 2, 1, 0, 0, 1, 1]
    assert column(graph.bfs_levels(), "level") == [0, 1, 0, 1, 2, 2, 1, 0]
    graph.set_mask([3])
    graph.update_routes(z)
    assert column(graph.flow, "rec") == [0, 0, 2, 3, 4, 6, 7, 7]


def test_accumulate_and_basins(spark):
    z = [[0.6] * 4, [0.4] * 4, [0.2] * 4, [0.1, 0, 0.1, 0.1]]
    graph = FlowGraph(RasterGrid(spark, (4, 4), (1.0, 1.0), BOTTOM), [SingleFlowRouter()])
    graph.update_routes(surface(spark, z))
    assert column(graph.flow, "rec") == [4, 5, 6, 7, 8, 9, 10, 11, 13, 13, 13, 15, 12, 13, 14, 15]
    assert column(graph.accumulate(1.0), "acc") == [1] * 4 + [2] * 4 + [3] * 4 + [1, 10, 1, 4]
    assert column(graph.basins(), "basin") == [1, 1, 1, 3] * 3 + [0, 1, 2, 3]


@pytest.mark.parametrize(
    ("connect", "expected"),
    [(RasterConnect.QUEEN, [4, 5, 6, 7, 8, 8, 10, 11, 13, 13, 13, 15]), (RasterConnect.ROOK, list(range(4, 16))), (RasterConnect.BISHOP, [5, 4, 5, 6, 9, 8, 9, 10, 13, 12, 13, 14])],
)
def test_connectivity(spark, connect, expected):
    z = [[0.60, 0.60, 0.61, 0.61], [0.40, 0.40, 0.41, 0.41], [0.05, 0.20, 0.21, 0.21], [0.02, 0, 0.11, 0.11]]
    graph = FlowGraph(RasterGrid(spark, (4, 4), (1.1, 1.2), BOTTOM, connect=connect), [SingleFlowRouter()])
    graph.update_routes(surface(spark, z))
    assert column(graph.flow, "rec") == [*expected, 12, 13, 14, 15]


def test_multi_flow(spark):
    s = math.sqrt(2)
    grid = RasterGrid(spark, (3, 3), (1.0, 1.0), RasterBoundaryStatus.of(F_))
    graph = FlowGraph(grid, [MultiFlowRouter(2.0)])
    graph.update_routes(surface(spark, [0, s, 0, s, 2 * s, s, 0, s, 0]))
    centre = graph.flow.where("src = 4").orderBy("slot").collect()
    assert [r["rec"] for r in centre] == [0, 1, 2, 3, 5, 6, 7, 8]
    assert np.allclose([r["weight"] * 12 for r in centre], [2, 1, 2, 1, 1, 2, 1, 2])
    assert column(graph.accumulate(1.0), "acc") == pytest.approx([1 + w / 12 for w in (2, 1, 2, 1)] + [1] + [1 + w / 12 for w in (1, 2, 1, 2)])


def test_status_precedence_and_errors(spark):
    grid = RasterGrid(spark, (3, 3), (1.0, 1.0), RasterBoundaryStatus(L, L, F_, F_), {4: G})
    assert column(grid.nodes, "status") == [1, 1, 1, 3, 2, 3, 1, 1, 1]
    with pytest.raises(ValueError):
        RasterBoundaryStatus(L, C, C, C)
    with pytest.raises(IndexError):
        ProfileGrid(spark, 4, 1.0, ProfileBoundaryStatus.of(C), {9: F_})
    with pytest.raises(ValueError):
        FlowGraph(grid, [FlowSnapshot("early"), SingleFlowRouter()])
    with pytest.raises(ValueError):
        FlowGraph(grid, [MultiFlowRouter(), MSTSinkResolver()])
    with pytest.raises(TypeError):
        FlowGraph(grid, ["router"])


def pit_surface():
    return [[1] * 5, [0.7, 0.7, 0.7, 0.1, 0.7], [0.5, 0.5, 0.15, 0.5, 0.5], [0.2, 0.19, 0.2, 0.2, 0.2], [0] * 5]


@pytest.mark.parametrize("route", list(MSTRouteMethod))
def test_tree_resolver(spark, route):
    graph = FlowGraph(RasterGrid(spark, (5, 5), (1.0, 1.0), BOTTOM), [SingleFlowRouter(), FlowSnapshot("before"), MSTSinkResolver(route_method=route)])
    z = column(graph.update_routes(surface(spark, pit_surface())), "z")
    rec, distance = column(graph.flow, "rec"), column(graph.flow, "distance")
    assert column(graph.graph_snapshot("before"), "rec")[8] == 8
    if route == MSTRouteMethod.CARVE:
        assert (rec[8], rec[12]) == (12, 16)
        assert distance[8] == distance[12] == math.sqrt(2)
    else:
        assert rec[8] == 16 and distance[8] == np.finfo(float).max and rec[12] == 8
    if route == MSTRouteMethod.CARVE:
        assert [i for i, (a, b) in enumerate(zip(np.ravel(pit_surface()), z, strict=True)) if a != b] == [8, 12]


def test_basin_edges(spark):
    z = np.array(pit_surface(), float)
    z[1, 3], z[2, 2] = 0.2, 0.1
    graph = FlowGraph(RasterGrid(spark, (5, 5), (1.0, 1.0), BOTTOM), [SingleFlowRouter()])
    graph.update_routes(surface(spark, z))
    edges = graph.basin_edges()
    found = {frozenset((r["p0"], r["p1"])): r["pass_elev"] for r in edges.where("p0 is not null").collect()}
    assert {frozenset((12, 16)): 0.19, frozenset((12, 17)): 0.2, frozenset((12, 18)): 0.2}.items() <= found.items()
    tree = boruvka(edges)
    assert tree.where("p0 is not null").count() == 1 and tree.count() == 5


def test_flood(spark):
    rng = np.random.default_rng(0)
    z = rng.random((12, 12))
    grid = RasterGrid(spark, (12, 12), (1.0, 1.0), RasterBoundaryStatus.of(F_))
    graph = FlowGraph(grid, [PFloodSinkResolver(), SingleFlowRouter()])
    filled = np.array(column(graph.update_routes(surface(spark, z)), "z")).reshape(12, 12)
    assert (filled >= z).all() and (filled[0] == z[0]).all()
    assert graph.pits().count() == 0
    assert sum(r["acc"] for r in graph.accumulate(1.0).join(graph.outlets(), ["grid_id", "idx"]).collect()) == 144


def test_ordinals():
    x = np.array([-1.5, -0.0, 0.0, 5e-324, 1.0])
    assert (from_ordinal(ordinal(x)) == x).all()
    assert (from_ordinal(ordinal(x) + 1) == np.nextafter(x, np.inf)).all()


@pytest.mark.parametrize("n", [1.0, 2.0, 4.0])
def test_stream_power_steady_state(n):
    x = np.arange(101) * 300.0
    area, k, uplift, m = 6.69 * np.maximum(x, 300.0) ** 1.67, 1e-3, 1e-3, 0.5
    import pandas as pd

    flow = pd.DataFrame({"src": np.arange(101), "rec": np.maximum(np.arange(101) - 1, 0), "distance": np.r_[0, np.full(100, 300.0)], "weight": 1.0})
    z = np.zeros(101)
    for _ in range(400):
        z[1:] += uplift * 1e5
        z, limited = grouped.stream_power(z, area, np.full(101, k), flow, 1e5, m, n, 1e-6, n == 1)
    slope = np.diff(z) / 300
    assert np.allclose(slope, (uplift / k) ** (1 / n) * area[1:] ** (-m / n), rtol=1e-4) and not limited.any()


def test_diffusion(spark):
    rows, cols, dy, dx, k, dt, t0 = 101, 51, 0.4, 0.8, 1e-3, 1e3, 2e3
    y, x = np.meshgrid((np.arange(rows) - 50) * dy, (np.arange(cols) - 25) * dx, indexing="ij")
    gauss = lambda t: np.exp(-(x**2 + y**2) / (4 * k * t)) / (4 * math.pi * k * t)
    new = grouped.diffuse(gauss(t0), k, dt, dy, dx)
    spread = np.sqrt(((new - gauss(t0 + dt)) ** 2).sum()) / np.sqrt((gauss(t0 + dt) ** 2).sum())
    assert spread < 0.05
    grid = RasterGrid(spark, (rows, cols), (dy, dx), BOTTOM)
    e = np.array(column(DiffusionADIEroder(grid, k).erode(surface(spark, gauss(t0)), dt), "erosion")).reshape(rows, cols)
    assert np.allclose(gauss(t0) - e, new)


def test_spl_small(spark):
    grid = RasterGrid(spark, (2, 2), (300.0, 300.0), RasterBoundaryStatus(C, C, F_, C))
    graph = FlowGraph(grid, [SingleFlowRouter()])
    z = surface(spark, [0, 0, 1, 1])
    graph.update_routes(z)
    a = 9e4
    assert column(graph.accumulate(1.0), "acc") == [2 * a, 2 * a, a, a]
    e = column(SPLEroder(graph, 1e-3, 0.5, 1.0).erode(z, graph.accumulate(1.0), 1.0), "erosion")
    assert e[:2] == [0, 0] and e[2] == pytest.approx(1e-3 * math.sqrt(a) / 300, rel=2e-3)


def test_mesh(spark):
    points = spark.createDataFrame([(0, i, *p) for i, p in enumerate([(0.0, 0.5), (0.5, 0.0), (0.0, -0.5), (-0.5, 0.0), (0.0, 0.0)])], "grid_id long, idx long, x double, y double")
    triangles = spark.createDataFrame([(0, 2, 4, 3), (0, 4, 2, 1), (0, 4, 0, 3), (0, 0, 4, 1)], "grid_id long, t0 long, t1 long, t2 long")
    mesh = TriMesh(points, triangles)
    assert column(mesh.nodes, "status") == [1, 1, 1, 1, 0]
    assert [(r["dst"], r["distance"]) for r in mesh.neighbors_of(3).collect()] == [(0, math.sqrt(0.5)), (2, math.sqrt(0.5)), (4, 0.5)]
    assert sum(column(mesh.nodes, "area")) == pytest.approx(0.5)


def test_sphere(spark):
    grid = HealpixGrid(spark, 32)
    first = grid.nodes.where("idx = 0").first()
    assert grid.nodes.count() == 12288 and first["area"] == pytest.approx(41509152987.45021)
    assert (first["lon"], first["lat"]) == pytest.approx((0.7853981633974483, 1.5452801164374776))
    assert (first["x"], first["z3"]) == pytest.approx((114937.4753788243, 6368926.106770833))


def test_sphere_neighbors(spark):
    near = HealpixGrid(spark, 32).neighbors_of(0).collect()
    assert [r["dst"] for r in near] == [11, 3, 2, 1, 6, 5, 13]
    assert [r["distance"] for r in near] == pytest.approx([0.04752047, 0.03608146, 0.05102688, 0.03608146, 0.04752047, 0.02914453, 0.0510435], abs=1e-7)
    assert HealpixGrid(spark, 32).neighbors_of(1984).count() == 6
    assert HealpixGrid(spark, 32, {1: NodeStatus.GHOST}).neighbors_of(0).count() == 6
    with pytest.raises(ValueError):
        HealpixGrid(spark, 4, {1: L})


@pytest.mark.parametrize("nside", [1, 2, 3, 8, 13])
def test_sphere_neighbors_are_mutual_and_near(nside):
    pixels = np.arange(12 * nside * nside)
    near = healpix_neighbors(pixels, nside)
    pairs = {(i, int(j)) for i in pixels for j in near[i] if j >= 0}
    assert all((j, i) in pairs for i, j in pairs)
    assert ((near < 0).sum(1) <= 2).all() and (near < 0).sum() == 24
    lon, lat = healpix_lonlat(pixels, nside)
    xyz = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1)
    if nside >= 8:  # the four that share a side are among the nearest
        for i in pixels:
            sides = near[i][[0, 2, 4, 6]]
            chord = np.sqrt(((xyz[sides] - xyz[i]) ** 2).sum(1))
            assert (chord < 2.5 / nside).all() and len(set(sides)) == 4


def test_multi_flow_on_sphere_keeps_all_area(spark):
    grid = HealpixGrid(spark, 4, {0: F_, 100: F_})
    graph = FlowGraph(grid, [PFloodSinkResolver(), MultiFlowRouter(1.0)])
    z = np.random.default_rng(5).random(192)
    graph.update_routes(surface(spark, z))
    reached = graph.accumulate(1.0).where("idx in (0, 100)").collect()
    assert sum(r["acc"] for r in reached) == pytest.approx(4 * math.pi * grid.radius**2)


def test_estimates_stay_small_in_loops(spark):
    flow = spark.range(300).selectExpr("0L as grid_id", "id as src", "greatest(id - 1, 0) as rec")
    found = ancestors(flow)
    assert found.agg({"depth": "max"}).first()[0] == 299
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= 2**63


def test_simulate(spark):
    grid = RasterGrid(spark, (12, 10), (100.0, 100.0), BOTTOM)
    graph = FlowGraph(grid, [SingleFlowRouter(), MSTSinkResolver()])
    z0 = np.random.default_rng(2).random(120)
    z = column(simulate(graph, surface(spark, z0), 2, 1e4, 1e-3, SPLEroder(graph, 1e-5, 0.5, 1.0), DiffusionADIEroder(grid, 1e-2)), "z")
    assert np.allclose(z[-10:], z0[-10:]) and np.isfinite(z).all() and max(z) > max(z0)
