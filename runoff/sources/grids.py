"""Grids as node tables; adjacency of regular grids is computed from node numbers, that of meshes is a table."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runoff.schema import EARTH_RADIUS, NODE, Neighbor, NodeStatus, RasterConnect, RasterNeighbor

#: Which status wins where borders meet: later ones.
_RANK = [NodeStatus.CORE, NodeStatus.LOOPED, NodeStatus.FIXED_GRADIENT, NodeStatus.FIXED_VALUE]


@dataclass(frozen=True)
class ProfileBoundaryStatus:
    left: NodeStatus
    right: NodeStatus

    def __post_init__(self) -> None:
        if (self.left == NodeStatus.LOOPED) != (self.right == NodeStatus.LOOPED):
            raise ValueError("looped boundaries must be on both ends")

    @classmethod
    def of(cls, *status: NodeStatus) -> ProfileBoundaryStatus:
        return cls(*(status * 2 if len(status) == 1 else status))

    @property
    def is_horizontal_looped(self) -> bool:
        return self.left == NodeStatus.LOOPED


@dataclass(frozen=True)
class RasterBoundaryStatus:
    left: NodeStatus
    right: NodeStatus
    top: NodeStatus
    bottom: NodeStatus

    def __post_init__(self) -> None:
        for a, b in ((self.left, self.right), (self.top, self.bottom)):
            if (a == NodeStatus.LOOPED) != (b == NodeStatus.LOOPED):
                raise ValueError("looped boundaries must be on both sides of an axis")

    @classmethod
    def of(cls, *status: NodeStatus) -> RasterBoundaryStatus:
        return cls(*(status * 4 if len(status) == 1 else status))

    @property
    def is_horizontal_looped(self) -> bool:
        return self.left == NodeStatus.LOOPED

    @property
    def is_vertical_looped(self) -> bool:
        return self.top == NodeStatus.LOOPED


@dataclass
class Grid:
    """nodes: grid_id, idx, status, area and coordinates; every grid_id is a surface of its own."""

    nodes: DataFrame
    size: int
    shape: tuple[int, ...]
    is_structured: bool = False
    is_uniform: bool = False
    n_neighbors_max: int = 20
    _edges: DataFrame | None = field(default=None, repr=False)
    _n_nodes: int | None = field(default=None, repr=False)

    @property
    def n_nodes(self) -> int:
        """Nodes of all surfaces."""
        if self._n_nodes is None:
            self._n_nodes = self.nodes.count()
        return self._n_nodes

    def neighbors(self, rows: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
        """grid_id, src, slot, dst, distance and the carried columns, for the nodes in rows."""
        kept = rows.select("grid_id", F.col("idx").alias("src"), *carry)
        return kept.join(self._edges, ["grid_id", "src"]).select("grid_id", "src", "slot", "dst", "distance", *carry)

    def linked(self, rows: DataFrame) -> DataFrame:
        """rows and linked: the numbers of each node's neighbours."""
        near = self._edges.groupBy("grid_id", F.col("src").alias("idx")).agg(F.collect_list("dst").alias("linked"))
        return rows.join(near, NODE, "left").withColumn("linked", F.coalesce("linked", F.array().cast("array<long>")))

    @property
    def edges(self) -> DataFrame:
        return self.neighbors(self.nodes)

    def nodes_indices(self, status: NodeStatus | None = None) -> DataFrame:
        return (self.nodes if status is None else self.nodes.where(F.col("status") == int(status))).select(*NODE)

    def nodes_status(self) -> DataFrame:
        return self.nodes.select(*NODE, "status")

    def nodes_areas(self) -> DataFrame:
        return self.nodes.select(*NODE, "area")

    def around(self, rows: DataFrame, sent: Sequence[str], kept: Sequence[str] = (), speaks: Column | None = None) -> DataFrame:
        """grid_id, idx, the columns sent and kept of each of rows, and near: (slot, dst, distance, the columns sent) of
        its neighbours among those rows that speak, in the order of slots. The first column sent is never null."""
        there = rows.where(speaks) if speaks is not None else rows
        there = there.select("grid_id", F.col("idx").alias("dst"), *sent)
        each = F.struct("slot", "dst", "distance", *sent)
        near = self.neighbors(rows).join(there, ["grid_id", "dst"]).groupBy("grid_id", F.col("src").alias("idx")).agg(F.sort_array(F.collect_list(each)).alias("near"))
        return rows.select(*NODE, *sent, *kept).join(near, NODE, "left").withColumn("near", F.coalesce("near", F.array()))

    def neighbors_count(self) -> DataFrame:
        counts = self.edges.groupBy("grid_id", F.col("src").alias("idx")).agg(F.count(F.lit(1)).alias("n"))
        return self.nodes.select(*NODE).join(counts, NODE, "left").select(*NODE, F.coalesce("n", F.lit(0)).alias("n"))

    def neighbors_records(self) -> DataFrame:
        """grid_id, src, slot, dst, distance and the neighbour's status, of all nodes; row and col too where nodes have them."""
        more = [c for c in ("row", "col") if c in self.nodes.columns]
        met = self.around(self.nodes, ["status", *more]).select("grid_id", F.col("idx").alias("src"), F.explode("near").alias("n"))
        return met.select("grid_id", "src", "n.slot", "n.dst", "n.distance", "n.status", *[f"n.{c}" for c in more])

    def _one(self, idx: int, grid_id: int) -> DataFrame:
        if not 0 <= idx < self.size:
            raise IndexError(f"node {idx} is out of range")
        return self.nodes.where((F.col("grid_id") == grid_id) & (F.col("idx") == idx))

    def node_status(self, idx: int, grid_id: int = 0) -> NodeStatus:
        return NodeStatus(self._one(idx, grid_id).first()["status"])

    def node_area(self, idx: int, grid_id: int = 0) -> float:
        return self._one(idx, grid_id).first()["area"]

    def neighbors_of(self, idx: int, grid_id: int = 0) -> DataFrame:
        """slot, dst, distance and status of one node's neighbours."""
        found = self.neighbors(self._one(idx, grid_id))
        there = self.nodes.select("grid_id", F.col("idx").alias("dst"), "status")
        return found.join(there, ["grid_id", "dst"]).select("slot", "dst", "distance", "status").orderBy("slot")

    def neighbor_records(self, idx: int, grid_id: int = 0) -> list[Neighbor]:
        return [Neighbor(r["dst"], r["distance"], NodeStatus(r["status"])) for r in self.neighbors_of(idx, grid_id).collect()]

    def neighbors_indices(self, idx: int, grid_id: int = 0) -> list[int]:
        return [n.idx for n in self.neighbor_records(idx, grid_id)]

    def neighbors_distances(self, idx: int, grid_id: int = 0) -> list[float]:
        return [n.distance for n in self.neighbor_records(idx, grid_id)]


def _ids(spark: SparkSession, size: int, grids: int) -> DataFrame:
    return spark.range(grids * size).select(F.floor(F.col("id") / size).cast("long").alias("grid_id"), (F.col("id") % size).alias("idx"))


def _overridden(status: Column, given: Mapping[int, NodeStatus], size: int, looped: bool = True) -> Column:
    for k, v in given.items():
        if not 0 <= k < size:
            raise IndexError(f"node {k} is out of range")
        if v == NodeStatus.LOOPED and looped:
            raise ValueError("looped can't be set for single nodes")
    if not given:
        return status.cast("byte")
    table = F.create_map(*[F.lit(x) for k, v in given.items() for x in (k, int(v))])
    return F.coalesce(F.try_element_at(table, F.col("idx").cast("int")), status).cast("byte")


@dataclass(frozen=True)
class Steps:
    """The steps of a regular grid on arrays of node numbers: what tasks need of it."""

    shape: tuple[int, int]
    steps: tuple[tuple[int, int], ...]
    lengths: tuple[float, ...]
    over_rows: bool
    over_cols: bool

    @property
    def reach(self) -> int:
        """No step inside of the grid leads further in node numbers, but for those over looped rows."""
        return self.shape[1] * (2 if self.over_cols else 1) + 1

    def to(self, idx: np.ndarray, slot: int) -> np.ndarray:
        """The node that a slot leads each node to; -1 where it leads out."""
        (n, m), (down, right) = self.shape, self.steps[slot]
        row, col = idx // m + down, idx % m + right
        inside = np.ones(len(idx), bool)
        row, inside = (row % n, inside) if self.over_rows else (row, inside & (row >= 0) & (row < n))
        col, inside = (col % m, inside) if self.over_cols else (col, inside & (col >= 0) & (col < m))
        return np.where(inside, row * m + col, -1)

    def seen(self, ids: np.ndarray, own: slice) -> Iterator[tuple[int, np.ndarray]]:
        """Each slot, and where in sorted ids the nodes are that it leads those of the slice to; -1 where there is none."""
        for k in range(len(self.steps)):
            to = self.to(ids[own], k)
            at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
            yield k, np.where(ids[at] == to, at, -1)


class _Regular(Grid):
    """A grid whose neighbours are steps over rows and columns. The slot of a step back is the last slot less the slot."""

    steps: tuple[tuple[int, int], ...]  #: of each slot, in rows and columns
    place: Callable[..., DataFrame] | None  #: nodes' columns beside those of rows (grid_id, idx, ...), from their numbers; None for given nodes

    def _moved(self, idx: Column, step: tuple[int, int]) -> tuple[Column, Column]:
        """The node that a step leads to, and whether there is one; a step over a looped border comes in on the other side."""
        n, m = self.shape if len(self.shape) == 2 else (1, *self.shape)
        row, col = F.floor(idx / m).cast("long") + step[0], idx % m + step[1]
        over_rows, over_cols = getattr(self.bounds, "is_vertical_looped", False), self.bounds.is_horizontal_looped
        inside = F.lit(True)
        if step[0]:
            row, inside = (F.pmod(row, F.lit(n)), inside) if over_rows else (row, inside & row.between(0, n - 1))
        if step[1]:
            col, inside = (F.pmod(col, F.lit(m)), inside) if over_cols else (col, inside & col.between(0, m - 1))
        return (row * m + col).cast("long"), inside

    def _length(self, step: tuple[int, int]) -> float:
        dy, dx = self.spacing if isinstance(self.spacing, tuple) else (0.0, self.spacing)
        return math.sqrt((step[0] * dy) ** 2 + (step[1] * dx) ** 2)

    def _reached(self, idx: Column, numbers: Sequence[int]) -> Column:
        """Nodes that each numbered slot leads to, by slot."""
        found = []
        for k in numbers:
            to, inside = self._moved(idx, self.steps[k])
            found.append(F.struct(F.lit(k).alias("slot"), F.when(inside, to).alias("dst"), F.lit(self._length(self.steps[k])).alias("distance")))
        return F.filter(F.array(*found), lambda x: x["dst"].isNotNull())

    def neighbors(self, rows: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
        """Computed from node numbers, so it takes no join; a wrapped step is as long as any other."""
        out = rows.select("grid_id", F.col("idx").alias("src"), *carry, F.explode(self._reached(F.col("idx"), range(len(self.steps)))).alias("k"))
        return out.select("grid_id", "src", "k.slot", "k.dst", "k.distance", *carry)

    def around(self, rows: DataFrame, sent: Sequence[str], kept: Sequence[str] = (), speaks: Column | None = None) -> DataFrame:
        """Each node sends its columns to its neighbours, and all that is sent to a node meets in one exchange. Rows that
        lie near each other are combined before it, so little more than a row for each node is shuffled."""
        last = len(self.steps) - 1
        own = F.array(F.struct(F.lit(-1).alias("slot"), F.col("idx").alias("to")))
        others = F.transform(self._reached(F.col("idx"), range(len(self.steps))), lambda x: F.struct((last - x["slot"]).alias("slot"), x["dst"].alias("to")))
        sends = F.concat(own, others) if speaks is None else F.when(speaks, F.concat(own, others)).otherwise(own)
        out = rows.select("grid_id", *sent, *kept, F.explode(sends).alias("k")).select("grid_id", F.col("k.to").alias("idx"), "k.slot", *sent, *kept)
        at = lambda c, k: F.max(F.when(F.col("slot") == k, F.col(c)))
        met = out.groupBy(*NODE).agg(F.max(F.col("slot") == -1).alias("here"), *[at(c, -1).alias(c) for c in (*sent, *kept)], *[at(c, k).alias(f"{c}_{k}") for c in sent for k in range(last + 1)])
        found = []
        for k, step in enumerate(self.steps):
            to, _ = self._moved(F.col("idx"), step)
            found.append(F.struct(F.lit(k).alias("slot"), to.alias("dst"), F.lit(self._length(step)).alias("distance"), *[F.col(f"{c}_{k}").alias(c) for c in sent]))
        near = F.filter(F.array(*found), lambda x: x[sent[0]].isNotNull())
        return met.where("here").select(*NODE, *sent, *kept, near.alias("near"))

    def on_arrays(self) -> Steps:
        shape = self.shape if len(self.shape) == 2 else (1, *self.shape)
        return Steps(shape, tuple(self.steps), tuple(self._length(s) for s in self.steps), getattr(self.bounds, "is_vertical_looped", False), self.bounds.is_horizontal_looped)

    def by_seen_block(self, rows: DataFrame, block: int, work: Callable[[pd.DataFrame, slice, Steps], pd.DataFrame], schema: str) -> DataFrame:
        """work on the rows of each block of node numbers and on their neighbours beyond, sorted by idx, with the slice of
        the block's own rows. One exchange, in which only rows near borders of blocks go to several."""
        steps, i = self.on_arrays(), F.col("idx")
        beside = F.array_distinct(F.concat(F.array(F.expr(f"idx div {block}")), F.transform(self._reached(i, range(len(self.steps))), lambda x: F.floor(x["dst"] / block))))
        near = (i % block < steps.reach) | (i % block >= block - steps.reach)
        if steps.over_rows:
            near |= (i < steps.shape[1]) | (i >= (steps.shape[0] - 1) * steps.shape[1])
        sent = rows.select("*", F.explode(F.when(near, beside).otherwise(F.array(F.expr(f"idx div {block}")))).alias("_block"))

        def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("idx", ignore_index=True)
            low, high = np.searchsorted(part["idx"].to_numpy(), [key[1] * block, (key[1] + 1) * block])
            return work(part, slice(low, high), steps).assign(grid_id=key[0])

        return sent.groupBy("grid_id", "_block").applyInPandas(run, schema)

    def linked(self, rows: DataFrame) -> DataFrame:
        """Computed from node numbers, without a join."""
        return rows.withColumn("linked", F.transform(self._reached(F.col("idx"), range(len(self.steps))), lambda x: x["dst"]))

    def neighbors_count(self) -> DataFrame:
        """A sum over slots of whether a step stays inside, without a shuffle."""
        return self.nodes.select(*NODE, F.size(self._reached(F.col("idx"), range(len(self.steps)))).cast("long").alias("n"))


class ProfileGrid(_Regular):
    steps = ((0, -1), (0, 1))

    def __init__(self, spark: SparkSession, size: int, spacing: float, bounds: ProfileBoundaryStatus, nodes_status: Mapping[int, NodeStatus] | None = None, grids: int = 1, ids: DataFrame | None = None) -> None:
        if bounds.is_horizontal_looped and set(nodes_status or ()) & {0, size - 1}:
            raise ValueError("a looped node can't be overridden")
        self.spacing, self.length, self.bounds = spacing, spacing * (size - 1), bounds
        border = F.when(F.col("idx") == 0, int(bounds.left)).when(F.col("idx") == size - 1, int(bounds.right)).otherwise(0)
        place = lambda at, *more: at.select(*NODE, _overridden(border, nodes_status or {}, size).alias("status"), F.lit(float(spacing)).alias("area"), *more)
        nodes, self.place = place(ids if ids is not None else _ids(spark, size, grids)), place if ids is None else None
        super().__init__(nodes, size, (size,), True, True, 2, _n_nodes=None if ids is not None else size * grids)

    @classmethod
    def from_length(cls, spark: SparkSession, size: int, length: float, bounds: ProfileBoundaryStatus, nodes_status: Mapping[int, NodeStatus] | None = None) -> ProfileGrid:
        return cls(spark, size, length / (size - 1), bounds, nodes_status)


class RasterGrid(_Regular):
    def __init__(self, spark: SparkSession, shape: tuple[int, int], spacing: tuple[float, float], bounds: RasterBoundaryStatus, nodes_status: Mapping[int, NodeStatus] | None = None, connect: RasterConnect = RasterConnect.QUEEN, grids: int = 1, ids: DataFrame | None = None) -> None:
        rows, cols = shape
        if min(shape) < 2:
            raise ValueError("an axis needs two nodes at least")
        self.spacing, self.bounds, self.connect, self.steps = tuple(spacing), bounds, connect, connect.value
        self.length = tuple(s * (n - 1) for s, n in zip(spacing, shape, strict=True))
        for k in nodes_status or ():
            if bounds.is_horizontal_looped and k % cols in (0, cols - 1) or bounds.is_vertical_looped and k // cols in (0, rows - 1):
                raise ValueError("a looped node can't be overridden")
        row, col = F.floor(F.col("idx") / cols).cast("long"), F.col("idx") % cols
        rank = lambda where, status: F.when(where, _RANK.index(status)).otherwise(0)
        best = F.greatest(rank(col == 0, bounds.left), rank(col == cols - 1, bounds.right), rank(row == 0, bounds.top), rank(row == rows - 1, bounds.bottom))
        status = F.element_at(F.array(*[F.lit(int(s)) for s in _RANK]), best + 1)
        place = lambda at, *more: at.select(*NODE, row.alias("row"), col.alias("col"), *more).select(*NODE, "row", "col", _overridden(status, nodes_status or {}, rows * cols).alias("status"), F.lit(float(spacing[0] * spacing[1])).alias("area"), *more)
        nodes, self.place = place(ids if ids is not None else _ids(spark, rows * cols, grids)), place if ids is None else None
        super().__init__(nodes, rows * cols, (rows, cols), True, True, len(connect.value), _n_nodes=None if ids is not None else rows * cols * grids)

    @classmethod
    def from_length(cls, spark: SparkSession, shape: tuple[int, int], length: tuple[float, float], bounds: RasterBoundaryStatus, nodes_status: Mapping[int, NodeStatus] | None = None, connect: RasterConnect = RasterConnect.QUEEN) -> RasterGrid:
        return cls(spark, shape, tuple(a / (n - 1) for a, n in zip(length, shape, strict=True)), bounds, nodes_status, connect)

    def nodes_codes(self) -> DataFrame:
        """Position 0 to 8: three times that of the row (first, inner, last) and that of the column."""
        part = lambda c, n: F.when(F.col(c) == 0, 0).when(F.col(c) == n - 1, 2).otherwise(1)
        return self.nodes.select(*NODE, (3 * part("row", self.shape[0]) + part("col", self.shape[1])).alias("code"))

    def ravel_idx(self, row: int, col: int) -> int:
        if not (0 <= row < self.shape[0] and 0 <= col < self.shape[1]):
            raise IndexError(f"node ({row}, {col}) is out of range")
        return row * self.shape[1] + col

    def unravel_idx(self, idx: int) -> tuple[int, int]:
        if not 0 <= idx < self.size:
            raise IndexError(f"node {idx} is out of range")
        return divmod(idx, self.shape[1])

    def raster_neighbors(self, row: int, col: int, grid_id: int = 0) -> list[RasterNeighbor]:
        """The neighbours of the node at a row and column."""
        return [RasterNeighbor(n.idx, *self.unravel_idx(n.idx), n.distance, n.status) for n in self.neighbor_records(self.ravel_idx(row, col), grid_id)]


def mesh_edges(triangles: DataFrame) -> DataFrame:
    """grid_id, a, b, uses: each undirected edge once, a < b."""
    corner = triangles.select("grid_id", F.explode(F.array(*[F.struct(F.col(x).alias("p"), F.col(y).alias("q")) for x, y in (("t0", "t1"), ("t1", "t2"), ("t2", "t0"))])).alias("e"))
    return corner.groupBy("grid_id", F.least("e.p", "e.q").alias("a"), F.greatest("e.p", "e.q").alias("b")).agg(F.count(F.lit(1)).alias("uses"))


def mesh_areas(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """grid_id, idx, area: circumcentric parts of each triangle, (|AB|^2 cot C + |AC|^2 cot B) / 8 at corner A."""
    at = lambda k: points.select("grid_id", F.col("idx").alias(f"t{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    t = triangles
    for k in range(3):
        t = t.join(at(k), ["grid_id", f"t{k}"])
    side = lambda i, j: (F.col(f"x{i}") - F.col(f"x{j}")) ** 2 + (F.col(f"y{i}") - F.col(f"y{j}")) ** 2
    t = t.select("*", side(1, 2).alias("s0"), side(2, 0).alias("s1"), side(0, 1).alias("s2"))
    cross = F.abs((F.col("x1") - F.col("x0")) * (F.col("y2") - F.col("y0")) - (F.col("x2") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    cot = lambda i: (F.col(f"s{(i + 1) % 3}") + F.col(f"s{(i + 2) % 3}") - F.col(f"s{i}")) / (2 * cross)
    part = [F.col(f"s{i}") * cot(i) / 8 for i in range(3)]
    each = F.array(*[F.struct(F.col(f"t{i}").alias("idx"), (part[(i + 1) % 3] + part[(i + 2) % 3]).alias("w")) for i in range(3)])
    return t.select("grid_id", F.explode(each).alias("p")).groupBy("grid_id", F.col("p.idx").alias("idx")).agg(F.sum("p.w").alias("area"))


class TriMesh(Grid):
    """points (grid_id, idx, x, y) and triangles (grid_id, t0, t1, t2); slots follow the neighbours' numbers."""

    def __init__(self, points: DataFrame, triangles: DataFrame, nodes_status: Mapping[int, NodeStatus] | DataFrame | None = None) -> None:
        edges = mesh_edges(triangles)
        size = points.count()
        if isinstance(nodes_status, DataFrame):
            status = points.select(*NODE).join(nodes_status.select(*NODE, F.col("status").cast("byte").alias("status")), NODE)
            if nodes_status.count() != size or status.distinct().count() != size or status.where("status is null").limit(1).count():
                raise ValueError("a status is needed for every node, once")
        elif nodes_status:
            status = points.select(*NODE, _overridden(F.lit(0), nodes_status, size).alias("status"))
        else:
            border = edges.where("uses = 1").select("grid_id", F.explode(F.array("a", "b")).alias("idx")).distinct().withColumn("status", F.lit(int(NodeStatus.FIXED_VALUE)))
            status = points.select(*NODE).join(border, NODE, "left").select(*NODE, F.coalesce("status", F.lit(0)).cast("byte").alias("status"))
        tiny = F.lit(float(np.finfo(float).tiny))
        areas = mesh_areas(points, triangles)
        nodes = points.select(*NODE, "x", "y").join(status, NODE).join(areas, NODE, "left").withColumn("area", F.coalesce("area", tiny))
        both = edges.select("grid_id", F.col("a").alias("src"), F.col("b").alias("dst")).union(edges.select("grid_id", "b", "a"))
        place = lambda name, p: points.select("grid_id", F.col("idx").alias(name), F.col("x").alias(f"x{p}"), F.col("y").alias(f"y{p}"))
        both = both.join(place("src", 0), ["grid_id", "src"]).join(place("dst", 1), ["grid_id", "dst"])
        from pyspark.sql import Window

        slot = (F.row_number().over(Window.partitionBy("grid_id", "src").orderBy("dst")) - 1).alias("slot")
        distance = F.sqrt((F.col("x0") - F.col("x1")) ** 2 + (F.col("y0") - F.col("y1")) ** 2).alias("distance")
        super().__init__(nodes, size, (size,), False, False, 20, both.select("grid_id", "src", slot, "dst", distance))


def healpix_lonlat(pixel: np.ndarray, nside: int) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude of RING pixel centres: polar caps and equatorial belt of Gorski et al. 2005, eqs. 4-9."""
    p, n = np.asarray(pixel, np.int64), 12 * nside * nside
    cap = 2 * nside * (nside - 1)
    south, folded = p >= n - cap, np.where(p >= n - cap, n - 1 - p, p)
    belt = (p >= cap) & ~south
    ring = ((1 + np.sqrt(1.0 + 2 * folded)) / 2).astype(np.int64)
    ring = np.where(2 * ring * (ring - 1) > folded, ring - 1, ring)
    ring = np.where(2 * ring * (ring + 1) <= folded, ring + 1, ring)
    ring = np.maximum(ring, 1)
    j = folded - 2 * ring * (ring - 1)
    j = np.where(south, 4 * ring - 1 - j, j)
    q = p - cap
    i_belt, j_belt = q // (4 * nside) + nside, q % (4 * nside)
    offset = np.where((i_belt - nside) % 2 == 0, 0.5, 0.0)
    lon = np.where(belt, (j_belt + offset) * np.pi / (2 * nside), (j + 0.5) * np.pi / (2 * ring))
    z = np.where(belt, (2.0 * nside - i_belt) * 2 / (3.0 * nside), np.where(south, -1, 1) * (1 - ring**2 / (3.0 * nside * nside)))
    flat = ring / (np.sqrt(3.0) * nside)  # sin of half the colatitude is flat / sqrt(2), exact near the poles
    lat = np.where(belt, np.arcsin(np.clip(z, -1, 1)), np.where(south, -1, 1) * (np.pi / 2 - 2 * np.arcsin(np.clip(flat / np.sqrt(2.0), 0, 1))))
    return lon, lat


#: Steps over the diamonds of the sphere, x to the north-east and y to the north-west: slots SW, W, NW, N, NE, E, SE, S.
_STEPS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def _ring_of(face: np.ndarray, x: np.ndarray, y: np.ndarray, nside: int) -> np.ndarray:
    """RING numbers of places (x, y) on the 12 base diamonds: Gorski et al. 2005, eqs. 16-21."""
    tier = face // 4
    ring = (tier + 2) * nside - x - y - 1
    centre = 2 * (face % 4) + (tier != 1)
    short = np.minimum(np.minimum(ring, 4 * nside - ring), nside)  # a quarter of the ring's pixels
    odd = np.where(short < nside, 1, (ring - nside + 1) % 2)
    j = ((centre * short + x - y + odd) // 2 - 1) % (4 * short)
    south, cap = ring > 3 * nside, 2 * nside * (nside - 1)
    before = np.where(south, 12 * nside**2 - 2 * short * (short + 1), np.where(ring < nside, 2 * ring * (ring - 1), cap + (ring - nside) * 4 * nside))
    return before + j


def _diamond_of(pixel: np.ndarray, nside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """face, x, y of RING numbers: the one diamond of twelve that holds a pixel's ring and its place in the ring."""
    n, cap = 12 * nside**2, 2 * nside * (nside - 1)
    up = np.minimum(pixel, n - 1 - pixel)
    k = ((1 + np.sqrt(1.0 + 2 * up)) / 2).astype(np.int64)
    k = np.maximum(np.where(2 * k * (k - 1) > up, k - 1, np.where(2 * k * (k + 1) <= up, k + 1, k)), 1)
    south, belt = pixel >= n - cap, (pixel >= cap) & (pixel < n - cap)
    ring = np.where(belt, (pixel - cap) // (4 * nside) + nside, np.where(south, 4 * nside - k, k))
    short = np.where(belt, nside, k)
    j = 1 + np.where(belt, (pixel - cap) % (4 * nside), np.where(south, pixel - (n - 2 * k * (k + 1)), pixel - 2 * k * (k - 1)))
    odd = np.where(short < nside, 1, (ring - nside + 1) % 2)
    face, x, y = (np.full(pixel.shape, -1, np.int64) for _ in range(3))
    for f in range(12):
        sum_ = (f // 4 + 2) * nside - 1 - ring
        turn = 8 * short
        diff = (2 * j - odd - (2 * (f % 4) + (f // 4 != 1)) * short + turn // 2) % turn - turn // 2
        a, b = (sum_ + diff) // 2, (sum_ - diff) // 2
        here = (face < 0) & ((sum_ + diff) % 2 == 0) & (a >= 0) & (a < nside) & (b >= 0) & (b < nside)
        face, x, y = np.where(here, f, face), np.where(here, a, x), np.where(here, b, y)
    return face, x, y


def healpix_neighbors(pixel: np.ndarray, nside: int) -> np.ndarray:
    """[pixel, slot]: RING numbers of neighbours in the order of _STEPS, -1 where three diamonds meet and there is none.

    A step that leaves a diamond is carried on over the one beside it. Diamonds of one tier around a pole are turned by
    a quarter towards each other; a diagonal step over a corner is two steps, or the diamond opposite.
    """
    face, x0, y0 = _diamond_of(np.asarray(pixel, np.int64), nside)
    tier, k, last = face // 4, face % 4, nside - 1
    out = np.full((len(face), len(_STEPS)), -1, np.int64)
    for slot, (dx, dy) in enumerate(_STEPS):
        x, y = x0 + dx, y0 + dy
        left, right, low, high = x < 0, x > last, y < 0, y > last
        wx, wy = x % nside, y % nside  # the place in an unturned diamond
        f, a, b = np.full_like(face, -1), wx.copy(), wy.copy()
        inside = ~(left | right | low | high)
        f[inside] = face[inside]
        plain = lambda p, q: ~(p | q)
        ones, none = np.full_like(x, last), np.zeros_like(x)
        east, west, over, under = right & plain(low, high), left & plain(low, high), high & plain(left, right), low & plain(left, right)
        north, middle, south = tier == 0, tier == 1, tier == 2
        for where, of_tier, turn, a_, b_ in (
            (north & east, 0, 1, y, ones), (north & over, 0, -1, ones, x), (north & west, 1, 0, wx, wy), (north & under, 1, 1, wx, wy),
            (middle & east, 0, 0, wx, wy), (middle & over, 0, -1, wx, wy), (middle & west, 2, -1, wx, wy), (middle & under, 2, 0, wx, wy),
            (south & east, 1, 1, wx, wy), (south & over, 1, 0, wx, wy), (south & west, 2, -1, y, none), (south & under, 2, 1, none, x),
            (north & right & high, 0, 2, ones, ones), (north & left & low, 2, 0, wx, wy), (middle & right & low, 1, 1, wx, wy),
            (middle & left & high, 1, -1, wx, wy), (south & left & low, 2, 2, none, none), (south & right & high, 0, 0, wx, wy),
        ):
            f[where], a[where], b[where] = (4 * of_tier + (k + turn) % 4)[where], a_[where], b_[where]
        found = f >= 0
        out[found, slot] = _ring_of(f[found], a[found], b[found], nside)
    return out


class HealpixGrid(Grid):
    """12 * nside**2 pixels of equal area in RING order; nodes carry lon, lat (radians) and x, y, z (times radius)."""

    def __init__(self, spark: SparkSession, nside: int, nodes_status: Mapping[int, NodeStatus] | DataFrame | None = None, radius: float = EARTH_RADIUS, strict: bool = False) -> None:
        size = 12 * nside * nside
        table = nodes_status if isinstance(nodes_status, DataFrame) else None
        given = {} if table is not None else dict(nodes_status or {})
        statuses = {r["status"] for r in table.select("status").distinct().collect()} if table is not None else set(given.values())  # one row a status
        if NodeStatus.LOOPED in statuses:
            raise ValueError("looped nodes don't exist on a sphere")
        self.nside, self.radius, self.strict = nside, radius, strict

        def place(batches):
            for rows in batches:
                lon, lat = healpix_lonlat(rows["idx"].to_numpy(), nside)
                yield pd.DataFrame({"grid_id": rows["grid_id"], "idx": rows["idx"], "lon": lon, "lat": lat, "x": radius * np.cos(lat) * np.cos(lon), "y": radius * np.cos(lat) * np.sin(lon), "z3": radius * np.sin(lat)})

        placed = _ids(spark, size, 1).mapInPandas(place, "grid_id long, idx long, lon double, lat double, x double, y double, z3 double")
        if table is None:
            placed = placed.withColumn("status", _overridden(F.lit(0), given, size))
        else:
            if table.where((F.col("idx") < 0) | (F.col("idx") >= size)).limit(1).count():
                raise IndexError("a node of the status table is out of range")
            if table.groupBy("idx").count().where("count > 1").limit(1).count():
                raise ValueError("a node has more than one status")
            placed = placed.join(table.select("idx", F.col("status").cast("byte").alias("status")), "idx", "left").withColumn("status", F.coalesce("status", F.lit(0).cast("byte")))
        nodes = placed.select(*NODE, "lon", "lat", "x", "y", "z3", "status", F.lit(4 * math.pi * radius**2 / size).alias("area"))
        super().__init__(nodes, size, (size,), False, True, 8, _n_nodes=size)
        self.ghosts = nodes.where(F.col("status") == int(NodeStatus.GHOST)).select(*NODE) if NodeStatus.GHOST in statuses else None

    def nodes_lonlat(self) -> DataFrame:
        return self.nodes.select(*NODE, "lon", "lat")

    def nodes_xyz(self) -> DataFrame:
        return self.nodes.select(*NODE, "x", "y", F.col("z3").alias("z"))

    def neighbors(self, rows: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
        """Computed from pixel numbers, in parts of a batch. Distances are chords of the unit sphere and slot 0 (SW) is
        left out, unless the grid is strict: then all slots count and distances are of the grid's radius. Ghost pixels
        have no neighbours and are nobody's."""
        nside, first, scale = self.nside, 0 if self.strict else 1, self.radius if self.strict else 1.0
        kept = rows.select("grid_id", F.col("idx").alias("src"), *carry)
        if self.ghosts is not None:
            kept = kept.join(self.ghosts.withColumnRenamed("idx", "src"), ["grid_id", "src"], "left_anti")
        steps = kept.withColumn("_k", F.lit(0)).withColumn("_dst", F.lit(0).cast("long")).withColumn("distance", F.lit(0.0))

        def walk(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    src = part.column("src").to_numpy(zero_copy_only=False)
                    dst = healpix_neighbors(src, nside)[:, first:]
                    row, slot = np.nonzero(dst >= 0)
                    to = dst[row, slot]
                    (lon0, lat0), (lon1, lat1) = healpix_lonlat(src[row], nside), healpix_lonlat(to, nside)
                    square = np.sin((lat1 - lat0) / 2) ** 2 + np.cos(lat0) * np.cos(lat1) * np.sin((lon1 - lon0) / 2) ** 2
                    columns = part.take(pa.array(row)).columns[:-3]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array((slot + first).astype(np.int32)), pa.array(to), pa.array(2 * scale * np.sqrt(square))], names=batch.schema.names)

        out = steps.mapInArrow(walk, steps.schema).select("grid_id", "src", F.col("_k").alias("slot"), F.col("_dst").alias("dst"), "distance", *carry)
        return out if self.ghosts is None else out.join(self.ghosts.withColumnRenamed("idx", "dst"), ["grid_id", "dst"], "left_anti").select("grid_id", "src", "slot", "dst", "distance", *carry)
