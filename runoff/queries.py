"""Queries over surfaces made from the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runoff.functions.ordinals import ordinal_column
from runoff.operators import analytics
from runoff.operators.kernels import COLUMN, SCALAR, FlowKernelEroder, create_flow_kernel
from runoff.plans.graph import DiffusionADIEroder, FlowGraph, FlowSnapshot, MSTSinkResolver, MultiFlowRouter, PFloodSinkResolver, SingleFlowRouter, SPLEroder
from runoff.plans.iterate import dense_index, durable
from runoff.schema import NODE, FlowDirection, FlowGraphTraversalDir, MSTMethod, MSTRouteMethod, NodeStatus, RasterConnect
from runoff.sources.grids import HealpixGrid, ProfileBoundaryStatus, ProfileGrid, RasterBoundaryStatus, RasterGrid, TriMesh, mesh_edges
from runoff.sources.surfaces import COLS, orders_raster, synthetic

_CORE, _FIXED, _GRADIENT, _LOOPED = NodeStatus.CORE, NodeStatus.FIXED_VALUE, NodeStatus.FIXED_GRADIENT, NodeStatus.LOOPED
_ALL_LOOPED = RasterBoundaryStatus.of(_LOOPED)
_SIDES_LOOPED = RasterBoundaryStatus(_LOOPED, _LOOPED, _FIXED, _CORE)


def _routed(spark: SparkSession, sf_dir: str, *operators, mask=None, bounds=None) -> FlowGraph:
    grid, dem = orders_raster(spark, sf_dir, bounds=bounds, once=True)
    graph = FlowGraph(grid, operators or [SingleFlowRouter()])
    if mask is not None:
        graph.set_mask(mask)
    graph.route(dem)
    return graph


def grid_neighbors(spark, sf_dir, connect=RasterConnect.QUEEN, bounds=None) -> DataFrame:
    grid, _ = orders_raster(spark, sf_dir, connect, bounds)
    return grid.edges.drop("grid_id")


def nodes_by_status(spark, sf_dir) -> DataFrame:
    grid, _ = orders_raster(spark, sf_dir, bounds=RasterBoundaryStatus(_FIXED, _GRADIENT, _GRADIENT, _CORE))
    return grid.nodes.where("status > 0").select("idx", F.col("status").cast("int").alias("status"))


def neighbor_count(spark, sf_dir) -> DataFrame:
    return orders_raster(spark, sf_dir)[0].neighbors_count().drop("grid_id")


def node_codes(spark, sf_dir) -> DataFrame:
    return orders_raster(spark, sf_dir)[0].nodes_codes().drop("grid_id")


def d8_receivers(spark, sf_dir, mask=None, bounds=None) -> DataFrame:
    return _routed(spark, sf_dir, mask=mask, bounds=bounds).flow.select(F.col("src").alias("idx"), "rec", "distance")


def mfd_weights(spark, sf_dir, p) -> DataFrame:
    return _routed(spark, sf_dir, MultiFlowRouter(p)).flow.select(F.col("src").alias("idx"), "rec", F.round("weight", 9).alias("weight"))


def donors_count(spark, sf_dir) -> DataFrame:
    return _routed(spark, sf_dir).donors_count(include_pit_self=False).drop("grid_id")


def accumulate_uniform(spark, sf_dir) -> DataFrame:
    return _routed(spark, sf_dir).accumulate(1.0).drop("grid_id")


def accumulate_variable(spark, sf_dir) -> DataFrame:
    graph = _routed(spark, sf_dir)
    return graph.accumulate(graph.state.surface.select(*NODE, F.col("z").alias("value"))).drop("grid_id")


def accumulate_multi(spark, sf_dir) -> DataFrame:
    """Flow to all lower neighbours, the whole raster."""
    return _routed(spark, sf_dir, MultiFlowRouter(1.0)).accumulate(1.0).select("idx", F.round("acc", 6).alias("acc"))


def basins(spark, sf_dir) -> DataFrame:
    return _routed(spark, sf_dir, mask=F.col("idx") % 7 == 3).basins().select("idx", "basin")


def outlets(spark, sf_dir) -> DataFrame:
    return _routed(spark, sf_dir).outlets().drop("grid_id")


def pits(spark, sf_dir) -> DataFrame:
    return _routed(spark, sf_dir).pits().drop("grid_id")


def bfs_levels(spark, sf_dir) -> DataFrame:
    return _routed(spark, sf_dir).bfs_levels().drop("grid_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten outlets that drain the largest area."""
    graph = _routed(spark, sf_dir)
    sizes = graph.basins().groupBy("outlet").agg(F.count(F.lit(1)).alias("n_nodes"))
    return sizes.orderBy(F.desc("n_nodes"), "outlet").limit(10)


def basin_graph_edges(spark, sf_dir) -> DataFrame:
    return _routed(spark, sf_dir).basin_edges().where("p0 is not null").drop("grid_id")


def mst_total_weight(spark, sf_dir) -> DataFrame:
    tree = analytics.boruvka(_routed(spark, sf_dir).basin_edges())
    return tree.where("p0 is not null").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("pass_elev").alias("total"))


def _resolved(spark, sf_dir, route=MSTRouteMethod.CARVE) -> FlowGraph:
    return _routed(spark, sf_dir, SingleFlowRouter(), MSTSinkResolver(MSTMethod.BORUVKA, route))


def mst_receivers(spark, sf_dir, route) -> DataFrame:
    return _resolved(spark, sf_dir, route).flow.select(F.col("src").alias("idx"), "rec", "distance")


def mst_fill(spark, sf_dir) -> DataFrame:
    """Filled elevations, as the whole number below and the steps of a double above it."""
    filled = _resolved(spark, sf_dir).state.surface.select("idx", F.floor("z").cast("double").alias("level"), "z")
    return filled.withColumn("a", ordinal_column(F.col("z"))).withColumn("b", ordinal_column(F.col("level"))).select("idx", "level", (F.col("a") - F.col("b")).alias("steps"))


def basin_parents(spark, sf_dir) -> DataFrame:
    """The basin that each inner basin drains to over its lowest pass, and the nodes of the pass."""
    return _routed(spark, sf_dir).basin_graph().oriented().select("up", "down", "inside", "outside")


def ensemble_profiles(spark, sf_dir) -> DataFrame:
    """A profile for each nation, its customers by key with their balance as elevation: area that reaches each node."""
    rows = dense_index(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").cast("long").alias("grid_id"), "c_custkey", "c_acctbal"), "c_custkey", within="grid_id")
    rows = durable(rows.select(*NODE, F.floor("c_acctbal").cast("double").alias("z")))
    size = rows.groupBy("grid_id").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    kept = rows.where(F.col("idx") < size)  # surfaces of an ensemble are of one size
    grid = ProfileGrid(spark, size, 2.0, ProfileBoundaryStatus(_FIXED, _CORE), ids=kept.select(*NODE))
    graph = FlowGraph(grid, [SingleFlowRouter()])
    graph.update_routes(kept)
    return graph.flow.select("grid_id", F.col("src").alias("idx"), "rec").join(graph.accumulate(1.0), NODE)


def sphere_areas(spark, sf_dir) -> DataFrame:
    """Pixels of a sphere, their area and the sine of their latitude; the pixels number as many as regions ask for."""
    nside = spark.read.parquet(f"{sf_dir}/region.parquet").count()
    grid = HealpixGrid(spark, nside, radius=1.0, strict=True)
    return grid.nodes.select("idx", F.round("area", 12).alias("area"), F.round(F.sin("lat"), 9).alias("z"))


def resolved_outlets(spark, sf_dir, *operators) -> DataFrame:
    """After sinks are resolved, only base levels are outlets, and all area reaches them."""
    graph = _routed(spark, sf_dir, *operators)
    reached = graph.accumulate(1.0).join(graph.outlets(), NODE)
    return reached.agg(F.count(F.lit(1)).alias("n_outlets"), F.sum("acc").alias("area"))


def pflood_profile(spark, sf_dir) -> DataFrame:
    """A profile of parts by key, z their size, flooded from its left end; steps counted in ordinals above the start."""
    ranked = dense_index(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size"), "p_partkey")
    size = ranked.count()
    z = durable(ranked.select(F.lit(0).cast("long").alias("grid_id"), "idx", F.col("p_size").cast("double").alias("z")))
    grid = ProfileGrid(spark, size, 1.0, ProfileBoundaryStatus(_FIXED, _CORE))
    graph = FlowGraph(grid, [PFloodSinkResolver(), SingleFlowRouter()])
    filled = graph.update_routes(z)
    return filled.select("idx", F.round("z", 6).alias("z"))


def _lattice(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    grid, dem = orders_raster(spark, sf_dir)
    nodes = grid.nodes.select(*NODE, "row", "col")
    points = nodes.select(*NODE, F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    cells = nodes.where((F.col("row") < grid.shape[0] - 1) & (F.col("col") < COLS - 1))
    i = F.col("idx")
    halves = F.array(F.struct(i.alias("t0"), (i + 1).alias("t1"), (i + COLS).alias("t2")), F.struct((i + 1).alias("t0"), (i + COLS + 1).alias("t1"), (i + COLS).alias("t2")))
    return points, cells.select("grid_id", F.explode(halves).alias("t")).select("grid_id", "t.*")


def trimesh_edges(spark, sf_dir) -> DataFrame:
    return mesh_edges(_lattice(spark, sf_dir)[1]).drop("grid_id")


def trimesh_areas(spark, sf_dir) -> DataFrame:
    mesh = TriMesh(*_lattice(spark, sf_dir))
    return mesh.nodes.select("idx", F.col("status").cast("int").alias("status"), F.round("area", 6).alias("area"))


def mesh_receivers(spark, sf_dir) -> DataFrame:
    """Routes over a mesh whose statuses come from a table: its lower side is the base."""
    points, triangles = _lattice(spark, sf_dir)
    mesh = TriMesh(points, triangles, points.select(*NODE, (F.col("y") == 0).cast("int").alias("status")))
    graph = FlowGraph(mesh, [SingleFlowRouter()])
    graph.update_routes(orders_raster(spark, sf_dir)[1])
    return graph.flow.select(F.col("src").alias("idx"), "rec", "distance")


def kernel_accumulate(spark, sf_dir, apply_dir=FlowGraphTraversalDir.BREADTH_DOWNSTREAM) -> DataFrame:
    graph = _routed(spark, sf_dir)

    def push(node):
        if node.receivers.count and node.receivers.distance[0] > 0:
            node.receivers.acc = node.receivers.acc + node.acc * node.receivers.weight

    kernel, data = create_flow_kernel(graph, push, {"acc": COLUMN}, apply_dir=apply_dir, outputs=["acc"])
    data.bind(acc=graph.grid.nodes.select(*NODE, F.col("area").alias("value")))
    return graph.apply_kernel(kernel, data).drop("grid_id")


def kernel_lengths(spark, sf_dir, apply_dir, n_threads=1) -> DataFrame:
    """Twice the length of the way to the outlet, from the outlets up."""
    graph = _routed(spark, sf_dir)

    def extend(node):
        node.d = node.receivers.d[0] + node.factor * node.receivers.distance[0] if node.receivers.distance[0] > 0 else 0.0

    kernel, data = create_flow_kernel(graph, extend, {"d": (COLUMN, 0.0), "factor": (SCALAR, 2.0)}, apply_dir=apply_dir, outputs=["d"], n_threads=n_threads)
    return graph.apply_kernel(kernel, data).select("idx", F.round("d", 6).alias("d"))


class _Relaxing(FlowKernelEroder):
    """Takes a share of the step to the receiver off each node."""

    param_spec = staticmethod(lambda: ["share"])
    input_spec = staticmethod(lambda: ["z"])
    kernel_apply_dir = staticmethod(lambda: FlowGraphTraversalDir.ANY)

    @staticmethod
    def eroder_kernel(node):
        node.erosion = node.share * (node.z - node.receivers.z[0])


def kernel_erosion(spark, sf_dir) -> DataFrame:
    graph = _routed(spark, sf_dir)
    return _Relaxing(graph).erode(share=0.25, z=graph.state.surface.select(*NODE, F.col("z").alias("value"))).drop("grid_id")


class _Terraces:
    """An operator of one's own: elevations in steps of 64."""

    name, elevation_updated, graph_updated = "Terraces", True, False
    in_flowdir = out_flowdir = FlowDirection.UNDEFINED

    def apply(self, state):
        return replace(state, surface=state.surface.withColumn("z", 64.0 * F.floor(F.col("z") / 64)))


def own_operator(spark, sf_dir) -> DataFrame:
    graph = _routed(spark, sf_dir, _Terraces(), SingleFlowRouter())
    return graph.flow.select(F.col("src").alias("idx"), "rec").join(graph.state.surface.select("idx", "z"), "idx")


def elevation_snapshot(spark, sf_dir) -> DataFrame:
    """Elevations before sinks are resolved, and which of them filling raises."""
    graph = _routed(spark, sf_dir, FlowSnapshot("raw", save_graph=False, save_elevation=True), SingleFlowRouter(), MSTSinkResolver())
    now = graph.state.surface.select(*NODE, F.col("z").alias("filled"))
    return graph.elevation_snapshot("raw").join(now, NODE).select("idx", "z", (F.col("filled") > F.col("z")).alias("raised"))


def _spaced(spark, sf_dir) -> RasterGrid:
    """A raster by its lengths, with statuses of single nodes."""
    rows = orders_raster(spark, sf_dir)[0].shape[0]
    bounds = RasterBoundaryStatus(_FIXED, _GRADIENT, _GRADIENT, _CORE)
    return RasterGrid.from_length(spark, (rows, COLS), (2.0 * (rows - 1), 3.0 * (COLS - 1)), bounds, {COLS + 1: NodeStatus.GHOST, 2 * COLS + 7: _FIXED, 3: _CORE})


def spaced_nodes(spark, sf_dir) -> DataFrame:
    grid = _spaced(spark, sf_dir)
    found = grid.nodes_indices().join(grid.nodes_status(), NODE).join(grid.nodes_areas(), NODE)
    return found.select("idx", F.col("status").cast("int").alias("status"), "area")


def neighbor_records(spark, sf_dir) -> DataFrame:
    return _spaced(spark, sf_dir).neighbors_records().drop("grid_id").withColumn("status", F.col("status").cast("int"))


def profile_edges(spark, sf_dir) -> DataFrame:
    """A ring as long as two and a half times the number of parts."""
    size = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    return ProfileGrid.from_length(spark, size, 2.5 * (size - 1), ProfileBoundaryStatus.of(_LOOPED)).edges.drop("grid_id")


def own_base_levels(spark, sf_dir) -> DataFrame:
    """Receivers and pits where every 97th node is a base level and row 0 isn't."""
    grid, dem = orders_raster(spark, sf_dir)
    graph = FlowGraph(grid, [SingleFlowRouter()])
    graph.set_base_levels(F.col("idx") % 97 == 5)
    graph.update_routes(dem)
    pit = graph.pits().withColumn("pit", F.lit(True))
    found = graph.flow.select("grid_id", F.col("src").alias("idx"), "rec").join(pit, NODE, "left")
    return found.select("idx", "rec", F.coalesce("pit", F.lit(False)).alias("pit"))


def donor_lists(spark, sf_dir) -> DataFrame:
    return _routed(spark, sf_dir).donors().select("idx", F.array_join("donors", ",").alias("donors"))


def receiver_lists(spark, sf_dir) -> DataFrame:
    found = _routed(spark, sf_dir, MultiFlowRouter(1.0)).receivers()
    total = F.aggregate("distances", F.lit(0.0), lambda a, x: a + x)
    return found.select("idx", F.array_join("receivers", ",").alias("receivers"), F.size("weights").cast("long").alias("n"), F.round(total, 6).alias("length"))


def traversal(spark, sf_dir, order) -> DataFrame:
    return getattr(_routed(spark, sf_dir), order)().select("idx", "place")


def synthetic_surfaces(spark, sf_dir) -> DataFrame:
    """The surfaces without noise, on a raster with as many rows as there are nations."""
    grid = RasterGrid(spark, (spark.read.parquet(f"{sf_dir}/nation.parquet").count(), 40), (1.0, 1.0), RasterBoundaryStatus.of(_FIXED))
    found = [synthetic(grid, kind).select("idx", F.lit(kind).alias("kind"), (F.round("z", 9) + 0).alias("z")) for kind in ("cone", "cone_inv", "gauss")]
    return found[0].unionByName(found[1]).unionByName(found[2])


def spl_newton_step(spark, sf_dir) -> DataFrame:
    """Slope exponent 2; Newton steps and the closed form differ by up to 1e-9."""
    graph = _routed(spark, sf_dir, SingleFlowRouter(), MSTSinkResolver())
    e = SPLEroder(graph, 1e-3, 0.5, 2.0, tolerance=1e-9).erode(graph.state.surface, graph.accumulate(1.0), 1.0)
    return e.select("idx", (F.round("erosion", 3) + 0).alias("erosion"))


def diffusion_varied_step(spark, sf_dir) -> DataFrame:
    """A coefficient of its own for each node."""
    grid, dem = orders_raster(spark, sf_dir)
    k = dem.select(*NODE, (0.05 * (1 + F.col("idx") % 3)).alias("k"))
    return DiffusionADIEroder(grid, k).erode(dem, 1.0).select("idx", (F.round("erosion", 3) + 0).alias("erosion"))


def snapshot_before_after(spark, sf_dir) -> DataFrame:
    graph = _routed(spark, sf_dir, SingleFlowRouter(), FlowSnapshot("before"), MSTSinkResolver())
    before = graph.graph_snapshot("before").select("src", F.col("rec").alias("r0"))
    return before.join(graph.flow, "src").where("src = r0").select(F.col("src").alias("idx"), F.col("r0").alias("rec_before"))


def spl_step(spark, sf_dir) -> DataFrame:
    graph = _resolved(spark, sf_dir)
    e = SPLEroder(graph, 1e-3, 0.5, 1.0).erode(graph.state.surface, graph.accumulate(1.0), 1.0)
    return e.select("idx", F.round("erosion", 6).alias("erosion"))


def diffusion_step(spark, sf_dir) -> DataFrame:
    grid, dem = orders_raster(spark, sf_dir)
    return DiffusionADIEroder(grid, 0.1).erode(dem, 1.0).select("idx", F.round("erosion", 6).alias("erosion"))


QUERIES = {
    "grid_neighbors_queen": grid_neighbors,
    "grid_neighbors_rook": partial(grid_neighbors, connect=RasterConnect.ROOK),
    "grid_neighbors_bishop": partial(grid_neighbors, connect=RasterConnect.BISHOP),
    "grid_neighbors_looped": partial(grid_neighbors, bounds=_ALL_LOOPED),
    "nodes_by_status": nodes_by_status,
    "neighbor_count": neighbor_count,
    "node_codes": node_codes,
    "d8_receivers": d8_receivers,
    "d8_masked": lambda spark, sf_dir: d8_receivers(spark, sf_dir, mask=F.col("idx") % 7 == 3),
    "d8_looped": partial(d8_receivers, bounds=_SIDES_LOOPED),
    "mfd_weights_p1": partial(mfd_weights, p=1.0),
    "mfd_weights_p2": partial(mfd_weights, p=2.0),
    "donors_count": donors_count,
    "accumulate_uniform": accumulate_uniform,
    "accumulate_variable": accumulate_variable,
    "accumulate_multi": accumulate_multi,
    "basins": basins,
    "outlets": outlets,
    "pits": pits,
    "bfs_levels": bfs_levels,
    "basin_size_topk": flagship,
    "basin_graph_edges": basin_graph_edges,
    "mst_total_weight": mst_total_weight,
    "mst_carve_receivers": partial(mst_receivers, route=MSTRouteMethod.CARVE),
    "mst_basic_receivers": partial(mst_receivers, route=MSTRouteMethod.BASIC),
    "mst_fill": mst_fill,
    "basin_parents": basin_parents,
    "ensemble_profiles": ensemble_profiles,
    "sphere_areas": sphere_areas,
    "mst_carve_outlets": lambda spark, sf_dir: resolved_outlets(spark, sf_dir, SingleFlowRouter(), MSTSinkResolver()),
    "mst_basic_outlets": lambda spark, sf_dir: resolved_outlets(spark, sf_dir, SingleFlowRouter(), MSTSinkResolver(route_method=MSTRouteMethod.BASIC)),
    "pflood_outlets": lambda spark, sf_dir: resolved_outlets(spark, sf_dir, PFloodSinkResolver(), SingleFlowRouter()),
    "pflood_profile": pflood_profile,
    "trimesh_edges": trimesh_edges,
    "trimesh_areas": trimesh_areas,
    "kernel_accumulate": kernel_accumulate,
    "snapshot_before_after": snapshot_before_after,
    "spl_step": spl_step,
    "diffusion_step": diffusion_step,
    "mesh_receivers": mesh_receivers,
    "kernel_accumulate_depth": partial(kernel_accumulate, apply_dir=FlowGraphTraversalDir.DEPTH_DOWNSTREAM),
    "kernel_lengths_depth": partial(kernel_lengths, apply_dir=FlowGraphTraversalDir.DEPTH_UPSTREAM),
    "kernel_lengths_levels": partial(kernel_lengths, apply_dir=FlowGraphTraversalDir.BREADTH_UPSTREAM, n_threads=2),
    "kernel_erosion": kernel_erosion,
    "own_operator": own_operator,
    "elevation_snapshot": elevation_snapshot,
    "spaced_nodes": spaced_nodes,
    "neighbor_records": neighbor_records,
    "profile_edges": profile_edges,
    "own_base_levels": own_base_levels,
    "donor_lists": donor_lists,
    "receiver_lists": receiver_lists,
    "bfs_order": partial(traversal, order="bfs_order"),
    "dfs_order": partial(traversal, order="dfs_order"),
    "synthetic_surfaces": synthetic_surfaces,
    "spl_newton_step": spl_newton_step,
    "diffusion_varied_step": diffusion_varied_step,
}

_DEM = """dem AS (SELECT idx, idx // 50 AS r, idx % 50 AS c, CAST(CAST(floor(o_totalprice) AS BIGINT) % 1024 + 128 * (idx // 50) AS DOUBLE) AS z, n // 50 AS nr
        FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_totalprice, count(*) OVER () AS n FROM orders) WHERE idx < n // 50 * 50)"""


def _offsets(connect: RasterConnect) -> str:
    return "o(slot, dr, dc) AS (VALUES " + ", ".join(f"({s}, {r}, {c})" for s, (r, c) in enumerate(connect.value)) + ")"


def _edges(wrap_rows: bool = False, wrap_cols: bool = False) -> str:
    r, c = "(r + dr + nr) % nr" if wrap_rows else "r + dr", "(c + dc + 50) % 50" if wrap_cols else "c + dc"
    return f"""e AS (SELECT idx AS src, slot, nr2 * 50 + nc2 AS dst, sqrt(CAST(dr * dr + dc * dc AS DOUBLE)) AS distance
        FROM (SELECT idx, nr, slot, dr, dc, {r} AS nr2, {c} AS nc2 FROM dem, o) WHERE nr2 BETWEEN 0 AND nr - 1 AND nc2 BETWEEN 0 AND 49)"""


def _d8(mask: str = "false", wrap_cols: bool = False, base: str = "a.r = 0") -> str:
    return f"""WITH RECURSIVE {_DEM}, {_offsets(RasterConnect.QUEEN)}, {_edges(False, wrap_cols)},
        s AS (SELECT e.src, e.slot, e.dst, e.distance, (a.z - b.z) / e.distance AS slope FROM e JOIN dem a ON a.idx = e.src JOIN dem b ON b.idx = e.dst
              WHERE NOT ({base}) AND NOT (a.idx % 7 = 3 AND {mask}) AND NOT (b.idx % 7 = 3 AND {mask}) AND a.z > b.z),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY slope DESC, slot) AS k FROM s) WHERE k = 1),
        flow AS (SELECT idx, coalesce(dst, idx) AS rec, coalesce(distance, 0.0) AS distance, z, r FROM dem LEFT JOIN best ON src = idx),
        path AS (SELECT idx, rec AS spot, 1 AS n FROM flow WHERE rec <> idx UNION ALL SELECT path.idx, flow.rec, n + 1 FROM path JOIN flow ON flow.idx = path.spot WHERE flow.rec <> path.spot),
        root AS (SELECT idx, CASE WHEN n IS NULL THEN idx ELSE spot END AS root, coalesce(n, 0) AS depth
                 FROM flow LEFT JOIN (SELECT idx AS i, arg_max(spot, n) AS spot, max(n) AS n FROM path GROUP BY i) ON i = idx)"""


def _mfd(p: str) -> str:
    return f"""WITH RECURSIVE {_DEM}, {_offsets(RasterConnect.QUEEN)}, {_edges()},
        s AS (SELECT e.src, e.slot, e.dst, e.distance, (a.z - b.z) / e.distance AS slope FROM e JOIN dem a ON a.idx = e.src JOIN dem b ON b.idx = e.dst WHERE a.r > 0 AND a.z > b.z),
        w AS (SELECT src AS idx, slot, dst AS rec, distance, ({p}) / sum({p}) OVER (PARTITION BY src) AS weight FROM s)"""


_PASSES = """, b AS (SELECT flow.idx, z, root, dense_rank() OVER (ORDER BY root) - 1 AS basin, root < 50 AS outer_ FROM flow JOIN root ON root.idx = flow.idx),
        p AS (SELECT x.basin AS b0, y.basin AS b1, greatest(x.z, y.z) AS pe, e.* FROM e JOIN b x ON x.idx = e.src JOIN b y ON y.idx = e.dst WHERE NOT x.outer_ AND x.basin <> y.basin AND (y.basin > x.basin OR y.outer_)),
        q AS (SELECT *, row_number() OVER (PARTITION BY b0, b1 ORDER BY pe, src, slot) AS k FROM p)"""
#: Kruskal's tree, an edge at a time in the order of passes, with a list of the basins' labels.
_KRUSKAL = """, edges AS (SELECT *, row_number() OVER (ORDER BY pe, b0, b1) AS i FROM (
            SELECT b0, b1, src AS p0, dst AS p1, pe, distance FROM q WHERE k = 1
            UNION ALL SELECT first, basin, NULL, NULL, '-infinity'::DOUBLE, 0.0 FROM (SELECT DISTINCT basin, min(basin) OVER () AS first FROM b WHERE outer_) WHERE basin <> first)),
        kruskal AS (SELECT 0::BIGINT AS i, (SELECT list(x ORDER BY x) FROM (SELECT DISTINCT basin AS x FROM b)) AS lab, false AS taken
            UNION ALL SELECT n.i, CASE WHEN lab[b0 + 1] = lab[b1 + 1] THEN lab ELSE list_transform(lab, lambda x: CASE WHEN x = lab[b1 + 1] THEN lab[b0 + 1] ELSE x END) END, lab[b0 + 1] <> lab[b1 + 1]
            FROM kruskal s JOIN edges n ON n.i = s.i + 1),
        tree AS (SELECT e.* FROM edges e JOIN kruskal USING (i) WHERE taken),
        sides AS (SELECT b0 AS up, b1 AS down, p0 AS inside, p1 AS outside, distance AS len FROM tree WHERE p0 IS NOT NULL UNION ALL SELECT b1, b0, p1, p0, distance FROM tree WHERE p0 IS NOT NULL),
        hang AS (SELECT DISTINCT basin AS up, NULL::BIGINT AS down, NULL::BIGINT AS inside, NULL::BIGINT AS outside, NULL::DOUBLE AS len, true AS outer_ FROM b WHERE outer_
            UNION SELECT s.up, s.down, s.inside, s.outside, s.len, false FROM hang JOIN sides s ON s.down = hang.up WHERE s.up NOT IN (SELECT basin FROM b WHERE outer_) AND (hang.down IS NULL OR s.up <> hang.down))"""
_CARVED = _KRUSKAL + """,
        turn AS (SELECT inside AS idx, outside AS rec, len AS distance, inside AS last FROM hang WHERE NOT outer_
            UNION ALL SELECT f.rec, f.idx, f.distance, f.rec FROM turn JOIN flow f ON f.idx = turn.last WHERE f.rec <> f.idx),
        flow2 AS (SELECT f.idx, coalesce(t.rec, f.rec) AS rec, coalesce(t.distance, f.distance) AS distance, f.z FROM flow f LEFT JOIN turn t ON t.idx = f.idx),
        path2 AS (SELECT idx, idx AS spot, 0 AS n FROM flow2 UNION ALL SELECT p.idx, f.rec, n + 1 FROM path2 p JOIN flow2 f ON f.idx = p.spot WHERE f.rec <> f.idx),
        high AS (SELECT p.idx, arg_max(f.z, (f.z, p.n)) AS level, arg_max(p.n, (f.z, p.n)) AS steps FROM path2 p JOIN flow2 f ON f.idx = p.spot GROUP BY p.idx),
        area2 AS (SELECT spot AS idx, count(*)::DOUBLE AS acc FROM path2 GROUP BY spot)"""
#: The implicit step along the routes, from the outlets up: K = 1e-3, m = 0.5, n = 1, dt = 1.
_ERODED = _CARVED + """,
        filled AS (SELECT idx, level + steps * CASE WHEN level > 0 THEN pow(2.0, floor(log2(level)) - 52) ELSE 0.0 END AS z FROM high),
        eroded AS (SELECT idx, filled.z, filled.z AS new FROM filled JOIN flow2 USING (idx) WHERE flow2.rec = idx
            UNION ALL SELECT f.idx, y.z, CASE WHEN y.z <= e.new THEN y.z WHEN e.z > y.z THEN y.z ELSE (y.z + 1e-3 * sqrt(acc) / f.distance * e.new) / (1 + 1e-3 * sqrt(acc) / f.distance) END
            FROM eroded e JOIN flow2 f ON f.rec = e.idx AND f.idx <> f.rec JOIN filled y ON y.idx = f.idx JOIN area2 a ON a.idx = f.idx)"""
#: Half a step of diffusion, implicit along c: forward and backward sweeps, a column at a time; a is 0.5 * K * dt.
_HALF = """,
        {0}_rhs AS (SELECT r, c, z, z + a * (lag(z) OVER w - 2 * z + lead(z) OVER w) AS rhs, c > 0 AND lead(c) OVER v IS NOT NULL AND lag(z) OVER w IS NOT NULL AND lead(z) OVER w IS NOT NULL AS inner_, a
            FROM {1}, (SELECT 0.5 * 0.1 AS a) WINDOW w AS (PARTITION BY c ORDER BY r), v AS (PARTITION BY r ORDER BY c)),
        {0}_fwd AS (SELECT r, 0::BIGINT AS c, 0.0::DOUBLE AS cp, z AS dp FROM {1} WHERE c = 0
            UNION ALL SELECT g.r, g.c, CASE WHEN inner_ THEN -a / (1 + 2 * a + a * f.cp) ELSE 0.0 END, CASE WHEN inner_ THEN (g.rhs + a * f.dp) / (1 + 2 * a + a * f.cp) ELSE g.z END
            FROM {0}_fwd f JOIN {0}_rhs g ON g.r = f.r AND g.c = f.c + 1),
        {0}_bwd AS (SELECT r, c, dp AS x FROM {0}_fwd WHERE c = (SELECT max(c) FROM {1})
            UNION ALL SELECT f.r, f.c, f.dp - f.cp * b.x FROM {0}_bwd b JOIN {0}_fwd f ON f.r = b.r AND f.c = b.c - 1),
        {0} AS (SELECT b.r, b.c, CASE WHEN g.inner_ THEN b.x ELSE g.z END AS z FROM {0}_bwd b JOIN {0}_rhs g ON g.r = b.r AND g.c = b.c)"""
#: As _ERODED for a slope exponent of 2, whose equation has a closed form.
_ERODED_SQUARE = _ERODED.replace(
    "(y.z + 1e-3 * sqrt(acc) / f.distance * e.new) / (1 + 1e-3 * sqrt(acc) / f.distance)",
    "e.new + (sqrt(1 + 4e-3 * sqrt(acc) / f.distance ** 2 * (y.z - e.new)) - 1) / (2e-3 * sqrt(acc) / f.distance ** 2)",
)
#: As _HALF, for a coefficient k of each node: conductances to the nodes before and after along r (pr, qr) and along c (pc, qc).
_HALF_VARIED = """,
        {0}_face AS (SELECT *, 0.25 * (lag(k) OVER w + k) AS pr, 0.25 * (k + lead(k) OVER w) AS qr, 0.25 * (lag(k) OVER v + k) AS pc, 0.25 * (k + lead(k) OVER v) AS qc, lag(z) OVER w AS z0, lead(z) OVER w AS z1
            FROM {1} WINDOW w AS (PARTITION BY c ORDER BY r), v AS (PARTITION BY r ORDER BY c)),
        {0}_rhs AS (SELECT r, c, z, k, pc, qc, z + pr * (z0 - z) + qr * (z1 - z) AS rhs, pr + qr + pc + qc IS NOT NULL AS inner_ FROM {0}_face),
        {0}_fwd AS (SELECT r, 0::BIGINT AS c, 0.0::DOUBLE AS cp, z AS dp FROM {1} WHERE c = 0
            UNION ALL SELECT g.r, g.c, CASE WHEN inner_ THEN -qc / (1 + pc + qc + pc * f.cp) ELSE 0.0 END, CASE WHEN inner_ THEN (g.rhs + pc * f.dp) / (1 + pc + qc + pc * f.cp) ELSE g.z END
            FROM {0}_fwd f JOIN {0}_rhs g ON g.r = f.r AND g.c = f.c + 1),
        {0}_bwd AS (SELECT r, c, dp AS x FROM {0}_fwd WHERE c = (SELECT max(c) FROM {1})
            UNION ALL SELECT f.r, f.c, f.dp - f.cp * b.x FROM {0}_bwd b JOIN {0}_fwd f ON f.r = b.r AND f.c = b.c - 1),
        {0} AS (SELECT b.r, b.c, g.k, CASE WHEN g.inner_ THEN b.x ELSE g.z END AS z FROM {0}_bwd b JOIN {0}_rhs g ON g.r = b.r AND g.c = b.c)"""
_SPACED = """spaced AS (SELECT idx, r, c, CASE WHEN idx = 51 THEN 4 WHEN idx = 107 THEN 1 WHEN idx = 3 THEN 0 WHEN c = 0 THEN 1 WHEN c = 49 OR r = 0 THEN 2 ELSE 0 END AS status FROM dem)"""
_LENGTHS = " SELECT root.idx, round(coalesce(d, 0.0), 6) AS d FROM root LEFT JOIN (SELECT p.idx, sum(2.0 * f.distance) AS d FROM (SELECT idx, idx AS spot FROM root UNION ALL SELECT idx, spot FROM path) p JOIN flow f ON f.idx = p.spot GROUP BY p.idx) t ON t.idx = root.idx"
_NEIGHBORS = "SELECT src, slot, dst, distance FROM e"
_TRIANGLES = """, t AS (SELECT idx AS t0, idx + 1 AS t1, idx + 50 AS t2 FROM dem WHERE r < nr - 1 AND c < 49 UNION ALL SELECT idx + 1, idx + 51, idx + 50 FROM dem WHERE r < nr - 1 AND c < 49),
        h AS (SELECT least(t0, t1) AS a, greatest(t0, t1) AS b FROM t UNION ALL SELECT least(t1, t2), greatest(t1, t2) FROM t UNION ALL SELECT least(t2, t0), greatest(t2, t0) FROM t),
        u AS (SELECT a, b, count(*) AS uses FROM h GROUP BY a, b)"""

ORACLE_SQL = {
    "grid_neighbors_queen": f"WITH {_DEM}, {_offsets(RasterConnect.QUEEN)}, {_edges()} {_NEIGHBORS}",
    "grid_neighbors_rook": f"WITH {_DEM}, {_offsets(RasterConnect.ROOK)}, {_edges()} {_NEIGHBORS}",
    "grid_neighbors_bishop": f"WITH {_DEM}, {_offsets(RasterConnect.BISHOP)}, {_edges()} {_NEIGHBORS}",
    "grid_neighbors_looped": f"WITH {_DEM}, {_offsets(RasterConnect.QUEEN)}, {_edges(True, True)} {_NEIGHBORS}",
    "nodes_by_status": f"WITH {_DEM} SELECT idx, CASE WHEN c = 0 THEN 1 ELSE 2 END AS status FROM dem WHERE c = 0 OR c = 49 OR r = 0",
    "neighbor_count": f"WITH {_DEM} SELECT idx, CAST((CASE WHEN r IN (0, nr - 1) THEN 2 ELSE 3 END) * (CASE WHEN c IN (0, 49) THEN 2 ELSE 3 END) - 1 AS BIGINT) AS n FROM dem",
    "node_codes": f"WITH {_DEM} SELECT idx, CAST(3 * (CASE WHEN r = 0 THEN 0 WHEN r = nr - 1 THEN 2 ELSE 1 END) + (CASE WHEN c = 0 THEN 0 WHEN c = 49 THEN 2 ELSE 1 END) AS INTEGER) AS code FROM dem",
    "d8_receivers": f"{_d8()} SELECT idx, rec, distance FROM flow",
    "d8_masked": f"{_d8('true')} SELECT idx, rec, distance FROM flow",
    "d8_looped": f"{_d8('false', True)} SELECT idx, rec, distance FROM flow",
    "mfd_weights_p1": f"{_mfd('slope')} SELECT idx, rec, round(weight, 9) AS weight FROM w UNION ALL SELECT idx, idx, 0.0 FROM dem WHERE idx NOT IN (SELECT idx FROM w)",
    "mfd_weights_p2": f"{_mfd('slope * slope')} SELECT idx, rec, round(weight, 9) AS weight FROM w UNION ALL SELECT idx, idx, 0.0 FROM dem WHERE idx NOT IN (SELECT idx FROM w)",
    "donors_count": f"{_d8()} SELECT f.idx, count(d.idx) AS n FROM flow f LEFT JOIN flow d ON d.rec = f.idx AND d.idx <> f.idx GROUP BY f.idx",
    "accumulate_uniform": f"{_d8()} SELECT idx, 1.0 + coalesce(k, 0)::DOUBLE AS acc FROM flow LEFT JOIN (SELECT spot, count(*) AS k FROM path GROUP BY spot) ON spot = idx",
    "accumulate_variable": f"{_d8()} SELECT idx, z + coalesce(k, 0.0) AS acc FROM flow LEFT JOIN (SELECT spot, sum(f2.z) AS k FROM path JOIN flow f2 ON f2.idx = path.idx GROUP BY spot) ON spot = flow.idx",
    "accumulate_multi": f"""{_mfd('slope')}, walk AS (
        SELECT idx AS spot, 1.0::DOUBLE AS part, 0 AS n FROM dem
        UNION ALL SELECT w.rec, sum(part * weight), n + 1 FROM walk JOIN w ON w.idx = walk.spot GROUP BY w.rec, n)
        SELECT spot AS idx, round(sum(part), 6) AS acc FROM walk GROUP BY spot""",
    "basins": f"{_d8('true')} SELECT root.idx, CASE WHEN root.idx % 7 <> 3 THEN basin END AS basin FROM root LEFT JOIN (SELECT idx AS o, row_number() OVER (ORDER BY idx) - 1 AS basin FROM flow WHERE rec = idx AND idx % 7 <> 3) ON o = root",
    "outlets": f"{_d8()} SELECT idx FROM flow WHERE rec = idx",
    "pits": f"{_d8()} SELECT idx FROM flow WHERE rec = idx AND r > 0",
    "bfs_levels": f"{_d8()} SELECT idx, CAST(depth AS BIGINT) AS level FROM root",
    "basin_size_topk": f"{_d8()} SELECT root AS outlet, count(*) AS n_nodes FROM root GROUP BY root ORDER BY n_nodes DESC, outlet LIMIT 10",
    "basin_graph_edges": f"{_d8()}{_PASSES} SELECT b0, b1, src AS p0, dst AS p1, pe AS pass_elev, distance AS pass_len FROM q WHERE k = 1",
    "mst_total_weight": f"{_d8()}{_PASSES}{_KRUSKAL} SELECT count(*) AS n_edges, sum(pe) AS total FROM tree WHERE p0 IS NOT NULL",
    "basin_parents": f"{_d8()}{_PASSES}{_KRUSKAL} SELECT up, down, inside, outside FROM hang WHERE NOT outer_",
    "mst_carve_receivers": f"{_d8()}{_PASSES}{_CARVED} SELECT idx, rec, distance FROM flow2",
    "mst_basic_receivers": f"""{_d8()}{_PASSES}{_KRUSKAL},
        led AS (SELECT h.inside, h.outside, h.len, r.root AS pit, x.z < y.z AS over FROM hang h JOIN root r ON r.idx = h.inside JOIN flow x ON x.idx = h.inside JOIN flow y ON y.idx = h.outside WHERE NOT h.outer_),
        new AS (SELECT pit AS idx, CASE WHEN over THEN outside ELSE inside END AS rec, 1.7976931348623157e308::DOUBLE AS distance FROM led WHERE over OR pit <> inside UNION ALL SELECT inside, outside, len FROM led WHERE NOT over)
        SELECT f.idx, coalesce(n.rec, f.rec) AS rec, coalesce(n.distance, f.distance) AS distance FROM flow f LEFT JOIN new n ON n.idx = f.idx""",
    "mst_fill": f"{_d8()}{_PASSES}{_CARVED} SELECT idx, level, CAST(steps AS BIGINT) AS steps FROM high",
    "spl_step": f"{_d8()}{_PASSES}{_ERODED} SELECT idx, round(z - new, 6) + 0 AS erosion FROM eroded",
    "diffusion_step": f"""WITH RECURSIVE {_DEM}, start AS (SELECT r, c, z FROM dem){_HALF.format("one", "start")},
        flipped AS (SELECT c AS r, r AS c, z FROM one){_HALF.format("two", "flipped")}
        SELECT idx, round(dem.z - two.z, 6) + 0 AS erosion FROM dem JOIN two ON two.r = dem.c AND two.c = dem.r""",
    "ensemble_profiles": """WITH RECURSIVE ranked AS (SELECT CAST(c_nationkey AS BIGINT) AS grid_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS idx, CAST(floor(c_acctbal) AS DOUBLE) AS z, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
        node AS (SELECT grid_id, idx, z FROM ranked WHERE idx < (SELECT min(n) FROM ranked)),
        near AS (SELECT *, lag(z) OVER w AS before_, lead(z) OVER w AS after_ FROM node WINDOW w AS (PARTITION BY grid_id ORDER BY idx)),
        flow AS (SELECT grid_id, idx, CASE WHEN idx = 0 THEN idx WHEN before_ < z AND (after_ IS NULL OR before_ <= after_) THEN idx - 1 WHEN after_ < z THEN idx + 1 ELSE idx END AS rec FROM near),
        path AS (SELECT grid_id, idx AS spot FROM flow UNION ALL SELECT p.grid_id, f.rec FROM path p JOIN flow f ON f.grid_id = p.grid_id AND f.idx = p.spot WHERE f.rec <> f.idx)
        SELECT f.grid_id, f.idx, f.rec, n * 2.0::DOUBLE AS acc FROM flow f JOIN (SELECT grid_id, spot, count(*) AS n FROM path GROUP BY 1, 2) a ON a.grid_id = f.grid_id AND a.spot = f.idx""",
    "sphere_areas": """WITH s AS (SELECT count(*) AS k FROM region), pixel AS (SELECT unnest(range(0, CAST(12 * k * k AS BIGINT))) AS idx, k FROM s),
        up AS (SELECT *, least(idx, 12 * k * k - 1 - idx) AS u, idx >= 6 * k * k AS south FROM pixel),
        ring AS (SELECT *, CASE WHEN u < 2 * k * (k - 1) THEN CAST(floor((1 + sqrt(1 + 2 * u)) / 2) AS BIGINT) ELSE k + (u - 2 * k * (k - 1)) // (4 * k) END AS i FROM up),
        high AS (SELECT *, CASE WHEN u < 2 * k * (k - 1) THEN 1 - i * i / (3.0 * k * k) ELSE 2 * (2.0 * k - i) / (3.0 * k) END AS h FROM ring)
        SELECT idx, round(4 * pi() / (12 * k * k), 12) AS area, round(CASE WHEN south AND h <> 0 THEN -h ELSE h END, 9) AS z FROM high""",
    "mst_carve_outlets": f"WITH {_DEM} SELECT count(*) FILTER (r = 0) AS n_outlets, count(*)::DOUBLE AS area FROM dem",
    "mst_basic_outlets": f"WITH {_DEM} SELECT count(*) FILTER (r = 0) AS n_outlets, count(*)::DOUBLE AS area FROM dem",
    "pflood_outlets": f"WITH {_DEM} SELECT count(*) FILTER (r = 0) AS n_outlets, count(*)::DOUBLE AS area FROM dem",
    "pflood_profile": "SELECT idx, round(max(z) OVER (ORDER BY idx), 6) AS z FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS idx, p_size::DOUBLE AS z FROM part)",
    "trimesh_edges": f"WITH {_DEM}{_TRIANGLES} SELECT a, b, uses FROM u",
    "trimesh_areas": f"""WITH {_DEM}{_TRIANGLES} SELECT idx, CAST(CASE WHEN r IN (0, nr - 1) OR c IN (0, 49) THEN 1 ELSE 0 END AS INTEGER) AS status,
        round(CASE WHEN r IN (0, nr - 1) THEN 0.5 ELSE 1.0 END * CASE WHEN c IN (0, 49) THEN 0.5 ELSE 1.0 END, 6) AS area FROM dem""",
    "kernel_accumulate": f"{_d8()} SELECT idx, 1.0 + coalesce(k, 0)::DOUBLE AS acc FROM flow LEFT JOIN (SELECT spot, count(*) AS k FROM path GROUP BY spot) ON spot = idx",
    "snapshot_before_after": f"{_d8()} SELECT idx, rec AS rec_before FROM flow WHERE rec = idx",
    "mesh_receivers": f"""WITH {_DEM}{_TRIANGLES}, n AS (SELECT a AS src, b AS dst FROM u UNION ALL SELECT b, a FROM u),
        s AS (SELECT src, dst, sqrt(CAST((x.r - y.r) ** 2 + (x.c - y.c) ** 2 AS DOUBLE)) AS distance, x.z - y.z AS drop FROM n JOIN dem x ON x.idx = src JOIN dem y ON y.idx = dst WHERE x.r > 0 AND x.z > y.z),
        best AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY drop / distance DESC, dst) AS i FROM s)
        SELECT idx, coalesce(dst, idx) AS rec, coalesce(distance, 0.0) AS distance FROM dem LEFT JOIN best ON src = idx AND i = 1""",
    "kernel_accumulate_depth": f"{_d8()} SELECT idx, 1.0 + coalesce(k, 0)::DOUBLE AS acc FROM flow LEFT JOIN (SELECT spot, count(*) AS k FROM path GROUP BY spot) ON spot = idx",
    "kernel_lengths_depth": _d8() + _LENGTHS,
    "kernel_lengths_levels": _d8() + _LENGTHS,
    "kernel_erosion": f"{_d8()} SELECT f.idx, 0.25::DOUBLE * (f.z - g.z) AS erosion FROM flow f JOIN flow g ON g.idx = f.rec",
    "own_operator": f"{_d8().replace(_DEM, _DEM.replace('dem AS', 'raw AS') + ', dem AS (SELECT idx, r, c, 64.0::DOUBLE * floor(z / 64) AS z, nr FROM raw)')} SELECT idx, rec, z FROM flow",
    "elevation_snapshot": f"{_d8()}{_PASSES}{_CARVED} SELECT dem.idx, dem.z, level > dem.z OR steps > 0 AS raised FROM dem JOIN high ON high.idx = dem.idx",
    "spaced_nodes": f"WITH {_DEM}, {_SPACED} SELECT idx, CAST(status AS INTEGER) AS status, 6.0::DOUBLE AS area FROM spaced",
    "neighbor_records": f"""WITH {_DEM}, {_offsets(RasterConnect.QUEEN)}, {_edges()}, {_SPACED}
        SELECT src, e.slot, dst, sqrt(CAST(4 * dr * dr + 9 * dc * dc AS DOUBLE)) AS distance, s.r AS "row", s.c AS col, CAST(s.status AS INTEGER) AS status FROM e JOIN o USING (slot) JOIN spaced s ON s.idx = dst""",
    "profile_edges": """WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS src, count(*) OVER () AS n FROM part)
        SELECT src, 0 AS slot, (src + n - 1) % n AS dst, 2.5::DOUBLE AS distance FROM p UNION ALL SELECT src, 1, (src + 1) % n, 2.5::DOUBLE FROM p""",
    "own_base_levels": f"{_d8(base='a.idx % 97 = 5')} SELECT idx, rec, rec = idx AND idx % 97 <> 5 AS pit FROM flow",
    "donor_lists": f"{_d8()} SELECT f.idx, coalesce(string_agg(CAST(d.idx AS VARCHAR), ',' ORDER BY d.idx), '') AS donors FROM flow f LEFT JOIN flow d ON d.rec = f.idx AND d.idx <> f.idx GROUP BY f.idx",
    "receiver_lists": f"""{_mfd('slope')}, all_ AS (SELECT idx, slot, rec, distance FROM w UNION ALL SELECT idx, 0, idx, 0.0 FROM dem WHERE idx NOT IN (SELECT idx FROM w))
        SELECT idx, string_agg(CAST(rec AS VARCHAR), ',' ORDER BY slot) AS receivers, count(*) AS n, round(sum(distance), 6) AS length FROM all_ GROUP BY idx""",
    "bfs_order": f"{_d8()} SELECT idx, row_number() OVER (ORDER BY depth, idx) - 1 AS place FROM root",
    "dfs_order": f"""{_d8()}, walk AS (SELECT idx, idx AS root, CAST([] AS BIGINT[]) AS above, CAST([] AS BIGINT[]) AS own, true AS first FROM flow WHERE rec = idx
            UNION ALL SELECT f.idx, w.root, w.own, list_append(w.own, -f.idx), false FROM walk w JOIN flow f ON f.rec = w.idx AND f.idx <> f.rec)
        SELECT idx, row_number() OVER (ORDER BY root, NOT first, above, idx) - 1 AS place FROM walk""",
    "synthetic_surfaces": """WITH n AS (SELECT count(*) AS rows FROM nation), p AS (SELECT unnest(range(0, rows * 40)) AS idx, rows FROM n),
        xy AS (SELECT idx, (idx % 40) * (2.0::DOUBLE / 39) - 1 AS x, (idx // 40) * (2.0::DOUBLE / (rows - 1)) - 1 AS y FROM p)
        SELECT idx, 'cone' AS kind, round(sqrt(2) - sqrt(x * x + y * y), 9) + 0 AS z FROM xy
        UNION ALL SELECT idx, 'cone_inv', round(sqrt(x * x + y * y) - sqrt(2), 9) + 0 FROM xy
        UNION ALL SELECT idx, 'gauss', round(exp(-(x * x + y * y) / 2), 9) + 0 FROM xy""",
    "spl_newton_step": f"{_d8()}{_PASSES}{_ERODED_SQUARE} SELECT idx, round(z - new, 3) + 0 AS erosion FROM eroded",
    "diffusion_varied_step": f"""WITH RECURSIVE {_DEM}, start AS (SELECT r, c, z, 0.05::DOUBLE * (1 + idx % 3) AS k FROM dem){_HALF_VARIED.format("one", "start")},
        flipped AS (SELECT c AS r, r AS c, z, k FROM one){_HALF_VARIED.format("two", "flipped")}
        SELECT idx, round(dem.z - two.z, 3) + 0 AS erosion FROM dem JOIN two ON two.r = dem.c AND two.c = dem.r""",
}
