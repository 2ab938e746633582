"""Surfaces of large regular grids as sheets: a row for each block of node numbers, with its nodes, and those that it sees
beyond, as arrays. A step over all nodes takes a task for each block, and only what lies on borders is exchanged.

Sheets stand beside the tables (grid_id, idx, ...) that are read from them; a table that is made in another way has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runoff.operators import analytics, grouped, routing
from runoff.plans import iterate
from runoff.plans.iterate import ENDS, durable, few
from runoff.schema import FLOW, NODE
from runoff.sources.grids import Grid, Steps

#: n own rows, how many of them are distinct nodes, are of none, have no number; and the slice of them in the arrays.
_SURFACE = "grid_id long, block long, n long, known long, strange long, bad long, low long, high long, ids binary, z binary, marks binary"
_ROUTED = "grid_id long, block long, low long, high long, pits boolean, ids binary, z binary, marks binary, rec binary, distance binary"
_MASKED, _BASE, _NONE = 1, 2, 4

_surfaces: WeakKeyDictionary[DataFrame, DataFrame] = WeakKeyDictionary()
_flows: WeakKeyDictionary[DataFrame, tuple[DataFrame, DataFrame]] = WeakKeyDictionary()


def fit(grid: Grid) -> bool:
    """Whether a grid's surfaces are kept as sheets."""
    return grid.size > grouped.LOCAL_NODES and getattr(grid, "place", None) is not None


def of_flow(flow: DataFrame, surface: DataFrame) -> DataFrame | None:
    """The sheets of a flow, if it is the one that was found for just this surface."""
    sheets, routed = _flows.get(flow, (None, None))
    return sheets if routed is surface else None


def _kept(values: np.ndarray) -> bytes:
    """Compressed, since checkpoints hold on to many rows at once as they are written."""
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _array(row, name: str, kind: type) -> np.ndarray:
    kept = getattr(row, name)
    return np.frombuffer(pa.decompress(kept[8:], int.from_bytes(kept[:8], "little"), "zstd", asbytes=True), kind)


def _ids(row) -> np.ndarray:
    return np.cumsum(_array(row, "ids", np.int64))


def _rec(row, ids: np.ndarray) -> np.ndarray:
    return ids + _array(row, "rec", np.int64)


def _each(parts: Iterator[pd.DataFrame]) -> Iterator:
    return (row for part in parts for row in part.itertuples(index=False))


def packed(grid: Grid, rows: DataFrame) -> DataFrame:
    """Sheets of rows (grid_id, idx, z, masked, is_base); those of no node are counted in any block."""
    inside = F.col("grid_id").between(0, grid.n_nodes // grid.size - 1) & F.col("idx").between(0, grid.size - 1)
    rows = rows.withColumn("strange", ~F.coalesce(inside, F.lit(False))).withColumn("none", F.col("z").isNull())
    at = {"grid_id": F.lit(0), "idx": F.pmod(F.xxhash64(*NODE), F.lit(grid.size))}
    rows = rows.select(*[F.when(F.col("strange"), x).otherwise(F.col(c)).cast("long").alias(c) for c, x in at.items()], "z", "masked", "is_base", "strange", "none")
    block = iterate.BLOCK

    def work(part: pd.DataFrame, own: slice, steps: Steps) -> pd.DataFrame:
        if own.start == own.stop:
            return pd.DataFrame({c.split()[0]: [] for c in _SURFACE.split(", ")})
        n, strange = own.stop - own.start, part["strange"].to_numpy(bool)
        first = int(part["idx"].iloc[own.start]) // block
        low, count = own.start - strange[: own.start].sum(), n - strange[own].sum()
        part = part[~strange]
        own = slice(low, low + count)
        ids, z, masked, base, none = (part[c].to_numpy(t) for c, t in (("idx", np.int64), ("z", float), ("masked", bool), ("is_base", bool), ("none", bool)))
        marks = masked * _MASKED + base * _BASE + none * _NONE
        bad = (np.isnan(z) & ~masked)[own].sum()
        return pd.DataFrame([{"block": first, "n": n, "known": len(np.unique(ids[own])), "strange": n - count, "bad": bad, "low": own.start, "high": own.stop, "ids": _kept(np.diff(ids, prepend=0)), "z": _kept(z), "marks": _kept(marks.astype(np.uint8))}])

    return durable(grid.by_seen_block(rows, block, work, _SURFACE))


def surface_of(sheets: DataFrame) -> DataFrame:
    """grid_id, idx, z, masked, is_base."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(part.to_pandas() for part in parts):
            own = slice(row.low, row.high)
            ids, z, marks = _ids(row)[own], _array(row, "z", float)[own], _array(row, "marks", np.uint8)[own]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row.grid_id)), pa.array(ids), pa.array(z, mask=marks & _NONE > 0), pa.array(marks & _MASKED > 0), pa.array(marks & _BASE > 0)], names=[*NODE, "z", "masked", "is_base"])

    surface = sheets.mapInArrow(rows, "grid_id long, idx long, z double, masked boolean, is_base boolean")
    _surfaces[surface] = sheets
    return surface


def flow_of(sheets: DataFrame, surface: DataFrame) -> DataFrame:
    """grid_id, src, slot, rec, distance, weight, as found for the surface."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(part.to_pandas() for part in parts):
            ids = _ids(row)[row.low : row.high]
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(n, row.grid_id), ids, np.zeros(n, np.int32), _rec(row, ids), _array(row, "distance", float), np.ones(n))], names=["grid_id", "src", "slot", "rec", "distance", "weight"])

    flow = sheets.mapInArrow(rows, FLOW)
    _flows[flow] = sheets, surface
    return flow


def _nodes(row) -> tuple[np.ndarray, slice, np.ndarray, np.ndarray]:
    """Node numbers, the slice of the block's own, and which are masked and base levels."""
    marks = _array(row, "marks", np.uint8)
    return _ids(row), slice(row.low, row.high), marks & _MASKED > 0, marks & _BASE > 0


def _with_routes(row, rec: np.ndarray, distance: np.ndarray) -> dict:
    ids, own, masked, base = _nodes(row)
    pits = bool(((rec == ids[own]) & ~masked[own] & ~base[own]).any())
    return {"grid_id": row.grid_id, "block": row.block, "low": row.low, "high": row.high, "pits": pits, "ids": row.ids, "z": row.z, "marks": row.marks, "rec": _kept(rec - ids[own]), "distance": _kept(distance)}


def single_flow(grid: Grid, surface: DataFrame) -> DataFrame:
    """As routing.single_flow, kept; on the surface's sheets, if it has some."""
    sheets = _surfaces.get(surface)
    if sheets is None:
        return durable(routing.single_flow(grid, surface))
    steps = grid.on_arrays()

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _each(parts):
            ids, own, masked, base = _nodes(row)
            found = routing._steepest(pd.DataFrame({"idx": ids, "z": _array(row, "z", float), "masked": masked, "is_base": base}), own, steps)
            yield pd.DataFrame([_with_routes(row, found["rec"].to_numpy(np.int64), found["distance"].to_numpy(float))])

    return flow_of(durable(sheets.mapInPandas(work, _ROUTED)), surface)


def has_pits(flow: DataFrame, surface: DataFrame) -> bool:
    sheets = of_flow(flow, surface)
    return (analytics.pits(flow, surface) if sheets is None else sheets.where("pits")).limit(1).count() > 0


def rerouted(sheets: DataFrame, surface: DataFrame, changed: DataFrame) -> DataFrame:
    """The flow of sheets, with the nodes of changed (grid_id, src, to, d) led there."""
    here = changed.select("grid_id", F.expr(f"src div {iterate.BLOCK}").alias("block"), "src", "to", "d")

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = []
        for row in left.itertuples(index=False):
            ids = _ids(row)[row.low : row.high]
            rec, distance = _rec(row, ids), _array(row, "distance", float).copy()
            at = np.searchsorted(ids, right["src"].to_numpy(np.int64))
            rec[at], distance[at] = right["to"].to_numpy(np.int64), right["d"].to_numpy(float)
            made.append(_with_routes(row, rec, distance))
        return pd.DataFrame(made, columns=[c.split()[0] for c in _ROUTED.split(", ")])

    return flow_of(durable(_met(sheets, here, work, _ROUTED)), surface)


def _met(sheets: DataFrame, rows: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    sheets, rows = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (sheets, rows))  # columns of their own
    return sheets.groupBy("grid_id", "block").cogroup(rows.groupBy("grid_id", "block")).applyInPandas(lambda left, right: work(left, right), schema)


def _ends(ids: np.ndarray, rec: np.ndarray) -> np.ndarray:
    """Where each node's path ends or leaves sorted ids."""
    at = np.minimum(np.searchsorted(ids, rec), len(ids) - 1)
    step = np.where(ids[at] == rec, at, np.arange(len(ids)))
    end = step
    for _ in range(len(ids).bit_length() + 1):
        further = end[end]
        if np.array_equal(further, end):
            break
        end = further
    if not np.array_equal(step[end], end):
        raise ValueError("the flow runs in a circle")
    return end


def _outlets(ids: np.ndarray, rec: np.ndarray, masked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unmasked outlets, and each node's rank as one of them."""
    out = (rec == ids) & ~masked
    return out, np.cumsum(out) - 1


#: Kinds of rows that blocks make for each other: how many outlets they have, where nodes near borders lead, nodes asked for.
_COUNT, _LEADS, _ASKED = 0, 1, 2
#: Kinds of rows that basins make.
_OUTLET, _PASS = 0, 1


def basin_passes(grid: Grid, sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outlets (grid_id, basin, outlet, outer), and the lowest passes as analytics.passes has them.

    Blocks number their own outlets. Where nodes near borders lead is solved over these nodes alone; then each block
    knows the basins of its nodes and of those that it sees.
    """
    steps, block, size = grid.on_arrays(), iterate.BLOCK, grid.size

    def leads(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _each(parts):
            every, own, masked, base = _nodes(row)
            ids = every[own]
            rec = _rec(row, ids)
            out, rank = _outlets(ids, rec, masked[own])
            near = (ids % block < steps.reach) | (ids % block >= block - steps.reach)
            if steps.over_rows:
                near |= (ids < steps.shape[1]) | (ids >= size - steps.shape[1])
            near = np.flatnonzero(near)
            end = _ends(ids, rec)[near]
            p = np.where(rec[end] == ids[end], ENDS, rec[end])
            asked = np.delete(every, np.r_[own])
            kinds = [("kind", [_COUNT], np.full(len(near), _LEADS), np.full(len(asked), _ASKED)), ("idx", [-1], ids[near], asked), ("p", [ENDS], p, np.full(len(asked), ENDS)),
                     ("basin", [out.sum()], np.where(out[end], rank[end], -1), np.full(len(asked), -1)), ("outer", [0], base[own][end].astype(np.int64), np.zeros(len(asked), np.int64))]
            yield pd.DataFrame({c: np.concatenate(x) for c, *x in kinds}).assign(grid_id=row.grid_id, block=row.block)

    made = durable(sheets.mapInPandas(leads, "kind long, idx long, p long, basin long, outer long, grid_id long, block long"))
    before = Window.partitionBy("grid_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = durable(made.where(F.col("kind") == _COUNT).select("grid_id", "block", F.coalesce(F.sum("basin").over(before), F.lit(0)).cast("long").alias("start")))
    led = made.where(F.col("kind") == _LEADS).join(F.broadcast(starts), ["grid_id", "block"])
    led = durable(led.select(*NODE, "p", F.when(F.col("basin") >= 0, F.col("basin") + F.col("start")).otherwise(F.lit(-1)).cast("long").alias("basin"), "outer"))
    n = led.count()
    solved = durable(iterate._solved(led, {c: lambda a, b, c=c: b[c] for c in ("basin", "outer")}, None if n <= iterate.GATHERED else block, n))
    if solved.count() != n:
        raise ValueError("the flow runs in a circle or leads to nodes that it doesn't have")
    seen = made.where(F.col("kind") == _ASKED).select(*NODE, "block").join(few(solved.drop("p"), n), NODE).select("grid_id", "block", "idx", "basin", "outer")

    def passes(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for row in left.itertuples(index=False):
            every, own, masked, base = _nodes(row)
            ids = every[own]
            rec = _rec(row, ids)
            out, rank = _outlets(ids, rec, masked[own])
            known = right.sort_values("idx")
            end, basin, outer = _ends(ids, rec), np.full(len(every), -1), np.zeros(len(every), bool)
            at = np.searchsorted(every, known["idx"].to_numpy(np.int64))
            basin[at], outer[at] = known["basin"].to_numpy(np.int64), known["outer"].to_numpy(np.int64) > 0
            to = np.where(rec[end] == ids[end], end + own.start, np.searchsorted(every, rec[end]))
            basin[own], outer[own] = np.where(out, rank + row.start, -1), base[own] & out
            basin[own], outer[own] = basin[to], outer[to]
            parts.append(pd.DataFrame({"b0": basin[own][out], "src": ids[out], "slot": outer[own][out].astype(int)}).assign(kind=_OUTLET, b1=-1, dst=-1, e=0.0, distance=0.0, z0=0.0, z1=0.0, grid_id=row.grid_id))
            use = ~masked
            low = int(use[: own.start].sum())
            nodes = pd.DataFrame({"idx": every[use], "z": _array(row, "z", float)[use], "basin": basin[use], "outer": outer[use]})
            if len(nodes):
                parts.append(analytics._lowest(nodes, slice(low, low + int(use[own].sum())), steps).assign(kind=_PASS, grid_id=row.grid_id))
        names = [c.split()[0] for c in schema.split(", ")]
        return pd.concat(parts, ignore_index=True)[names] if parts else pd.DataFrame({c: [] for c in names})

    schema = "grid_id long, kind int, b0 long, b1 long, e double, src long, slot int, dst long, distance double, z0 double, z1 double"
    found = durable(_met(sheets.join(F.broadcast(starts), ["grid_id", "block"]), seen, passes, schema))
    outlets = found.where(F.col("kind") == _OUTLET).select("grid_id", F.col("b0").alias("basin"), F.col("src").alias("outlet"), (F.col("slot") == 1).alias("outer"))
    return outlets, analytics.least_passes(found.where(F.col("kind") == _PASS))
