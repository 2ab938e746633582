"""The flow graph: a checked sequence of operators over surfaces, and what can be asked of its outcome."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from numbers import Real
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runoff.operators import analytics, grouped
from runoff.operators.basin_graph import BasinGraph, fill
from runoff.operators.routing import multi_flow
from runoff.plans import sheets
from runoff.plans.iterate import doubled, durable, least
from runoff.schema import FLOW, NODE, FlowDirection, MSTMethod, MSTRouteMethod, NodeStatus
from runoff.sources.grids import Grid


class _Deferred:
    """A field that holds a value or a function without arguments, which makes the value when it is first asked for."""

    def __set_name__(self, owner: type, name: str) -> None:
        self._at = f"_{name}"

    def __get__(self, state: Any, owner: type | None = None) -> Any:
        if state is None:
            raise AttributeError(self._at)
        if callable(value := getattr(state, self._at)):
            setattr(state, self._at, value := value())
        return value

    def __set__(self, state: Any, value: Any) -> None:
        setattr(state, self._at, value)


@dataclass
class FlowState:
    grid: Grid
    surface: DataFrame = _Deferred()  #: grid_id, idx, z, masked, is_base
    flow: DataFrame | None = None
    single: bool = True
    graphs: dict[str, DataFrame] = field(default_factory=dict)
    elevations: dict[str, DataFrame] = field(default_factory=dict)


class FlowOperator(Protocol):
    """What an operator declares, and its step; own operators need only these."""

    name: str
    elevation_updated: bool
    graph_updated: bool
    in_flowdir: FlowDirection
    out_flowdir: FlowDirection

    def apply(self, state: FlowState) -> FlowState: ...


class _Operator:
    elevation_updated = graph_updated = False
    in_flowdir = out_flowdir = FlowDirection.UNDEFINED

    @property
    def name(self) -> str:
        return type(self).__name__

    def __repr__(self) -> str:
        return self.name


class SingleFlowRouter(_Operator):
    graph_updated, out_flowdir = True, FlowDirection.SINGLE

    def apply(self, state: FlowState) -> FlowState:
        return replace(state, flow=sheets.single_flow(state.grid, state.surface), single=True)


class MultiFlowRouter(_Operator):
    graph_updated, out_flowdir = True, FlowDirection.MULTI

    def __init__(self, slope_exp: float = 1.0) -> None:
        self.slope_exp = slope_exp

    def apply(self, state: FlowState) -> FlowState:
        return replace(state, flow=durable(multi_flow(state.grid, state.surface, self.slope_exp)), single=False)


class PFloodSinkResolver(_Operator):
    """Raises closed depressions to the least surface that drains. A surface is flooded in one task; one of over
    grouped.LOCAL_NODES nodes is filled along carved routes first, which is too high by steps at most, and lowered to the
    same outcome in blocks of that many nodes."""

    elevation_updated = True

    def apply(self, state: FlowState) -> FlowState:
        if state.grid.size > grouped.LOCAL_NODES:
            filled, flow = state.surface, sheets.single_flow(state.grid, state.surface)
            if sheets.has_pits(flow, state.surface):
                filled = fill(state.surface, BasinGraph(state.grid, state.surface, flow).routed(carve=True))
            return replace(state, surface=durable(grouped.flood_by_blocks(state.grid, state.surface, filled, grouped.LOCAL_NODES)))

        def work(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
            near = grouped.Adjacency(len(nodes), edges)
            z = grouped.priority_flood(nodes["z"].to_numpy(float), nodes["is_base"].to_numpy(bool), nodes["masked"].to_numpy(bool), near)
            return nodes[["idx", "masked", "is_base"]].assign(z=z)

        flooded = grouped.per_grid(state.surface, state.grid.neighbors(state.surface), work, "grid_id long, idx long, z double, masked boolean, is_base boolean")
        return replace(state, surface=durable(flooded))


class MSTSinkResolver(_Operator):
    """Leads pits over the passes of a minimum spanning tree of basins, then fills along the new routes.

    Both tree methods order equal passes alike and give the same routes. Kruskal's gathers a surface in a task, which is
    the way of ensembles of small surfaces; Borůvka's, and any surface of over grouped.LOCAL_NODES nodes, is resolved by
    plans over all nodes. Inner basins that the mask cuts off keep their pits.
    """

    elevation_updated = graph_updated = True
    in_flowdir = out_flowdir = FlowDirection.SINGLE

    def __init__(self, basin_method: MSTMethod = MSTMethod.KRUSKAL, route_method: MSTRouteMethod = MSTRouteMethod.CARVE) -> None:
        self.basin_method, self.route_method = basin_method, route_method

    def apply(self, state: FlowState) -> FlowState:
        if not sheets.has_pits(state.flow, state.surface):
            return state
        carve = self.route_method == MSTRouteMethod.CARVE
        if self.basin_method == MSTMethod.BORUVKA or state.grid.size > grouped.LOCAL_NODES:
            surface = state.surface
            flow = BasinGraph(state.grid, surface, state.flow).routed(carve)
            return replace(state, surface=lambda: fill(surface, flow), flow=flow)  # filled when it is asked for

        def work(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
            near = grouped.Adjacency(len(nodes), edges)
            rec, distance, z = grouped.resolve_by_tree(nodes["z"].to_numpy(float), nodes["rec"].to_numpy(), nodes["distance"].to_numpy(), nodes["is_base"].to_numpy(bool), nodes["masked"].to_numpy(bool), near, carve)
            return nodes[["idx", "masked", "is_base"]].assign(z=z, rec=rec, distance=distance)

        nodes = state.surface.join(state.flow.select("grid_id", F.col("src").alias("idx"), "rec", "distance"), NODE)
        done = durable(grouped.per_grid(nodes, state.grid.neighbors(state.surface), work, "grid_id long, idx long, z double, masked boolean, is_base boolean, rec long, distance double"))
        flow = done.select("grid_id", F.col("idx").alias("src"), F.lit(0).alias("slot"), "rec", "distance", F.lit(1.0).alias("weight"))
        return replace(state, surface=done.drop("rec", "distance"), flow=flow)


class FlowSnapshot(_Operator):
    def __init__(self, snapshot_name: str, save_graph: bool = True, save_elevation: bool = False) -> None:
        self.snapshot_name, self.save_graph, self.save_elevation = snapshot_name, save_graph, save_elevation

    def apply(self, state: FlowState) -> FlowState:
        graphs = {**state.graphs, self.snapshot_name: state.flow} if self.save_graph else state.graphs
        elevations = {**state.elevations, self.snapshot_name: state.surface.select(*NODE, "z")} if self.save_elevation else state.elevations
        return replace(state, graphs=graphs, elevations=elevations)


def _where(where: Sequence[int] | F.Column | DataFrame) -> F.Column | DataFrame:
    return F.col("idx").isin(list(where)) if isinstance(where, (list, tuple, set)) else where


class FlowGraph:
    """A grid and a sequence of operators; `update_routes` runs them on elevations (grid_id, idx, z)."""

    def __init__(self, grid: Grid, operators: Sequence[FlowOperator]) -> None:
        direction, routed = FlowDirection.UNDEFINED, False
        for op in operators:
            if not all(hasattr(op, a) for a in ("apply", "in_flowdir", "out_flowdir", "graph_updated", "elevation_updated")):
                raise TypeError(f"not a flow operator: {op!r}")
            if op.in_flowdir not in (FlowDirection.UNDEFINED, direction):
                raise ValueError(f"{op.name} takes {op.in_flowdir.name} flow, but it is {direction.name} there")
            if isinstance(op, FlowSnapshot) and op.save_graph and not routed:
                raise ValueError("a graph can't be saved before it is made")
            routed |= op.graph_updated
            direction = op.out_flowdir if op.out_flowdir != FlowDirection.UNDEFINED else direction
        if not routed:
            raise ValueError("some operator must update the graph")
        self.grid, self.operators, self.direction = grid, tuple(operators), direction
        self._base = F.col("status") == int(NodeStatus.FIXED_VALUE)
        self._mask = F.lit(False)
        self.state: FlowState | None = None

    def __repr__(self) -> str:
        return f"FlowGraph({self.grid.size} nodes, {list(self.operators)})"

    @property
    def single_flow(self) -> bool:
        return self.direction == FlowDirection.SINGLE

    @property
    def size(self) -> int:
        return self.grid.size

    @property
    def grid_shape(self) -> tuple[int, ...]:
        return self.grid.shape

    def set_base_levels(self, where: Sequence[int] | F.Column | DataFrame) -> None:
        """Node numbers, a condition on the grid's nodes, or a table (grid_id, idx); takes the place of those before."""
        self._base = _where(where)

    def set_mask(self, where: Sequence[int] | F.Column | DataFrame) -> None:
        """As set_base_levels, of nodes that take no part."""
        self._mask = _where(where)

    def _marked(self, nodes: DataFrame | None = None, *more: str) -> DataFrame:
        nodes = self.grid.nodes if nodes is None else nodes
        for name, where in (("masked", self._mask), ("is_base", self._base)):
            if isinstance(where, DataFrame):
                nodes = nodes.join(where.select(*NODE).distinct().withColumn(name, F.lit(True)), NODE, "left").withColumn(name, F.coalesce(name, F.lit(False)))
            else:
                nodes = nodes.withColumn(name, F.coalesce(where, F.lit(False)))
        return nodes.select(*NODE, *more, "masked", "is_base")

    def base_levels(self) -> DataFrame:
        return self._marked().where("is_base").select(*NODE)

    def mask(self) -> DataFrame:
        return self._marked().select(*NODE, "masked")

    def _surface(self, elevation: DataFrame) -> DataFrame:
        """grid_id, idx, z, masked, is_base; elevations must be of all nodes, once each, and numbers where not masked."""
        if sheets.fit(self.grid):  # marks of a node follow from its number, so nothing is joined
            made = sheets.packed(self.grid, self._marked(self.grid.place(elevation.select(*NODE, F.col("z").cast("double").alias("z")), "z"), "z"))
            n, known, strange, bad = (x or 0 for x in made.agg(*[F.sum(c) for c in ("n", "known", "strange", "bad")]).first())
            missing = self.grid.n_nodes - known
            self._check(n + missing, strange, missing, bad)
            return sheets.surface_of(made)
        given = elevation.select(*NODE, F.col("z").cast("double").alias("z"), F.lit(True).alias("given"))
        surface = durable(given.join(self._marked(), NODE, "full"))
        count = lambda where: F.count(F.when(where, 1))
        wrong = (F.col("z").isNull() | F.isnan("z")) & ~F.coalesce("masked", F.lit(False))
        self._check(*surface.agg(F.count(F.lit(1)), count(F.col("masked").isNull()), count(F.col("given").isNull()), count(wrong)).first())
        return surface.drop("given")

    def _check(self, n: int, strange: int, missing: int, bad: int) -> None:
        if strange or missing or n != self.grid.n_nodes:
            raise ValueError(f"elevations must be of the grid's {self.grid.n_nodes} nodes, once each: {strange} are of none, {missing} nodes have none, {n} rows in all")
        if bad:
            raise ValueError(f"{bad} elevations are no numbers")

    def update_routes(self, elevation: DataFrame) -> DataFrame:
        """The elevations (grid_id, idx, z) that the operators leave."""
        self.route(elevation)
        return self.state.surface.select(*NODE, "z")

    def route(self, elevation: DataFrame) -> None:
        """As update_routes, where the elevations aren't needed: what the last resolver fills is only filled once its surface is read."""
        state = FlowState(self.grid, self._surface(elevation))
        for op in self.operators:
            state = op.apply(state)
        self.state = state

    @property
    def flow(self) -> DataFrame:
        """grid_id, src, slot, rec, distance, weight."""
        if self.state is None:
            raise RuntimeError("update_routes hasn't run")
        return self.state.flow

    def accumulate(self, source: float | DataFrame = 1.0) -> DataFrame:
        return analytics.accumulate(self.flow, self.grid.nodes_areas(), source, self.single_flow)

    def basins(self) -> DataFrame:
        if not self.single_flow:
            raise ValueError("basins need single flow")
        return analytics.basins(self.flow, self.state.surface)

    def outlets(self) -> DataFrame:
        return analytics.outlets(self.flow, self.state.surface).select(*NODE)

    def pits(self) -> DataFrame:
        return analytics.pits(self.flow, self.state.surface)

    def apply_kernel(self, kernel: Any, data: Any) -> DataFrame:
        """The kernel's outputs (grid_id, idx, ...), which the data then holds too."""
        return kernel.run(data)

    def donors_count(self, include_pit_self: bool = True) -> DataFrame:
        return analytics.donors_count(self.flow, self.state.surface, include_pit_self)

    def receivers_count(self) -> DataFrame:
        return self.flow.groupBy("grid_id", F.col("src").alias("idx")).agg(F.count(F.lit(1)).alias("n"))

    def bfs_levels(self) -> DataFrame:
        return analytics.bfs_levels(self.flow, self.single_flow)

    def basin_edges(self) -> DataFrame:
        return self.basin_graph().edges().drop("z0", "z1")

    def basin_graph(self) -> BasinGraph:
        if not self.single_flow:
            raise ValueError("basins need single flow")
        return BasinGraph(self.grid, self.state.surface, self.flow)

    def donors(self) -> DataFrame:
        return analytics.donors(self.flow, self.state.surface)

    def bfs_order(self) -> DataFrame:
        return analytics.bfs_order(self.flow, self.single_flow)

    def dfs_order(self) -> DataFrame:
        """grid_id, idx, place: depth first from the outlets; with several receivers bfs_order, where each node also comes
        after all its receivers."""
        return analytics.dfs_order(self.flow) if self.single_flow else self.bfs_order().drop("level")

    def receivers(self) -> DataFrame:
        """grid_id, idx and by slot: receivers, distances, weights."""
        each = F.sort_array(F.collect_list(F.struct("slot", "rec", "distance", "weight")))
        found = self.flow.groupBy("grid_id", F.col("src").alias("idx")).agg(each.alias("r"))
        return found.select(*NODE, F.col("r.rec").alias("receivers"), F.col("r.distance").alias("distances"), F.col("r.weight").alias("weights"))

    def graph_snapshot_keys(self) -> list[str]:
        return sorted(op.snapshot_name for op in self.operators if isinstance(op, FlowSnapshot) and op.save_graph)

    def elevation_snapshot_keys(self) -> list[str]:
        return sorted(op.snapshot_name for op in self.operators if isinstance(op, FlowSnapshot) and op.save_elevation)

    def graph_snapshot(self, name: str) -> DataFrame:
        return self.state.graphs[name]

    def elevation_snapshot(self, name: str) -> DataFrame:
        return self.state.elevations[name]


def _eroded_by_doubling(nodes: DataFrame, flow: DataFrame, dt: float, area_exp: float) -> DataFrame:
    """The linear implicit step on surfaces of any size, for one receiver each.

    A node's new elevation is the least of c and a + b * x, with x its receiver's: such functions composed are such
    functions, so whole paths are composed by pointer doubling. Limits come from rounding alone there; there are none.
    """
    below = nodes.select("grid_id", F.col("idx").alias("rec"), F.col("z").alias("zr"))
    met = flow.join(nodes.withColumnRenamed("idx", "src"), ["grid_id", "src"]).join(below, ["grid_id", "rec"])
    drains = (F.col("src") != F.col("rec")) & (F.col("zr") <= F.col("z"))
    f = F.when(drains, F.col("k") * dt * F.pow("acc", F.lit(float(area_exp))) / F.col("distance")).otherwise(0.0)
    parts = durable(met.withColumn("f", f).select("grid_id", "src", "rec", F.col("z").alias("c"), (F.col("z") / (1 + F.col("f"))).alias("a"), (F.col("f") / (1 + F.col("f"))).alias("b"), "z"))
    whole = doubled(parts, None, {"c": lambda x, up: least(x["c"], x["a"] + x["b"] * up["c"]), "a": lambda x, up: x["a"] + x["b"] * up["a"], "b": lambda x, up: x["b"] * up["b"], "z": lambda x, up: x["z"]}, flow.count())
    return whole.select(*NODE, (F.col("z") - F.least("c", "a")).alias("erosion"), F.lit(False).alias("limited"))


def _coefficient(grid: Grid, value: float | np.ndarray | DataFrame) -> float | DataFrame:
    """A number, or a table (grid_id, idx, k) with a row for each node; an array is of one surface, for all of them."""
    if isinstance(value, Real):
        return float(value)
    if isinstance(value, np.ndarray):
        if value.shape not in ((grid.size,), tuple(grid.shape)):
            raise ValueError(f"a coefficient must have {grid.size} values, one for each node")
        rows = pd.DataFrame({"idx": np.arange(grid.size), "k": value.ravel().astype(float)})
        return grid.nodes.select(*NODE).join(grid.nodes.sparkSession.createDataFrame(rows), "idx").select(*NODE, "k")
    if not isinstance(value, DataFrame):
        raise TypeError("a coefficient is a number, an array or a table")
    given = value.select(*NODE, F.col("k").cast("double").alias("k"))
    rows, known = given.join(grid.nodes.select(*NODE, F.lit(True).alias("known")), NODE, "left").agg(F.count(F.lit(1)), F.count_distinct(F.when(F.col("known") & F.col("k").isNotNull(), F.struct(*NODE)))).first()
    if rows != known or known != grid.n_nodes:
        raise ValueError(f"a coefficient must be of the grid's {grid.n_nodes} nodes, once each")
    return given


class SPLEroder:
    """Stream-power erosion, implicit in time. Exponents up to 1 are solved as linear unless strict_exponent."""

    def __init__(self, graph: FlowGraph, k_coef: float | np.ndarray | DataFrame, area_exp: float, slope_exp: float, tolerance: float = 1e-3, strict_exponent: bool = False) -> None:
        self.graph, self.k_coef, self.area_exp, self.tolerance, self.strict = graph, k_coef, area_exp, tolerance, strict_exponent
        self.slope_exp = slope_exp
        self._eroded: DataFrame | None = None

    @property
    def k_coef(self) -> float | DataFrame:
        return self._k_coef

    @k_coef.setter
    def k_coef(self, value: float | np.ndarray | DataFrame) -> None:
        self._k_coef = _coefficient(self.graph.grid, value)

    @property
    def n_corr(self) -> int:
        """Nodes that the last step limited to the level of their receivers."""
        return 0 if self._eroded is None else self._eroded.where("limited").count()

    @property
    def slope_exp(self) -> float:
        return self._slope_exp

    @slope_exp.setter
    def slope_exp(self, value: float) -> None:
        self.linear = value == 1 if self.strict else abs(value) - 1 <= np.finfo(float).eps
        if not self.linear and not self.graph.single_flow:
            raise ValueError("slope exponents over 1 need single flow")
        self._slope_exp = value

    def erode(self, elevation: DataFrame, drainage_area: DataFrame, dt: float) -> DataFrame:
        """grid_id, idx, erosion, limited."""
        self._eroded = self._step(elevation, drainage_area, dt)
        return self._eroded

    def _step(self, elevation: DataFrame, drainage_area: DataFrame, dt: float) -> DataFrame:
        m, n, tol, linear = self.area_exp, self._slope_exp, self.tolerance, self.linear
        k = F.lit(float(self.k_coef)) if not isinstance(self.k_coef, DataFrame) else F.col("k")
        nodes = elevation.select(*NODE, "z").join(drainage_area.select(*NODE, "acc"), NODE)
        nodes = nodes if not isinstance(self.k_coef, DataFrame) else nodes.join(self.k_coef.select(*NODE, "k"), NODE)

        if self.graph.grid.size > grouped.LOCAL_NODES:
            if linear and self.graph.single_flow:
                return durable(_eroded_by_doubling(nodes.withColumn("k", k), self.graph.flow, dt, m))
            return durable(grouped.erode_by_blocks(nodes.withColumn("k", k), self.graph.flow, grouped.LOCAL_NODES, dt, m, n, tol, linear))

        def work(nodes: pd.DataFrame, flow: pd.DataFrame) -> pd.DataFrame:
            z = nodes["z"].to_numpy(float)
            new, limited = grouped.stream_power(z, nodes["acc"].to_numpy(), nodes["k"].to_numpy(), flow, dt, m, n, tol, linear)
            return nodes[["idx"]].assign(erosion=z - new, limited=limited)

        return durable(grouped.per_grid(nodes.withColumn("k", k), self.graph.flow, work, "grid_id long, idx long, erosion double, limited boolean"))


class DiffusionADIEroder:
    """Hillslope diffusion on rasters by alternating directions; borders keep their elevation."""

    def __init__(self, grid: Grid, k_coef: float | np.ndarray | DataFrame) -> None:
        if not hasattr(grid, "connect"):
            raise TypeError("diffusion needs a raster")
        self.grid, self.k_coef = grid, k_coef

    @property
    def k_coef(self) -> float | DataFrame:
        return self._k_coef

    @k_coef.setter
    def k_coef(self, value: float | np.ndarray | DataFrame) -> None:
        self._k_coef = _coefficient(self.grid, value)

    def erode(self, elevation: DataFrame, dt: float) -> DataFrame:
        shape, (dy, dx) = self.grid.shape, self.grid.spacing
        rows = elevation.select(*NODE, "z")
        rows = rows.join(self.k_coef.select(*NODE, "k"), NODE) if isinstance(self.k_coef, DataFrame) else rows.withColumn("k", F.lit(float(self.k_coef)))

        if self.grid.size > grouped.LOCAL_NODES:
            return grouped.diffuse_by_blocks(rows, shape, grouped.LOCAL_NODES, dt, dy, dx)

        def work(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
            nodes = nodes.sort_values("idx", ignore_index=True)
            z = nodes["z"].to_numpy(float).reshape(shape)
            new = grouped.diffuse(z, nodes["k"].to_numpy(float).reshape(shape), dt, dy, dx)
            return nodes[["grid_id", "idx"]].assign(erosion=(z - new).ravel())

        return rows.groupBy("grid_id").applyInPandas(work, "grid_id long, idx long, erosion double")


__all__ = ["FLOW", "DiffusionADIEroder", "FlowGraph", "FlowOperator", "FlowSnapshot", "FlowState", "MSTSinkResolver", "MultiFlowRouter", "PFloodSinkResolver", "SPLEroder", "SingleFlowRouter"]
