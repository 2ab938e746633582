"""Whole surfaces in one task: numpy on the arrays of one grid_id, many grids side by side.

`per_grid` cogroups nodes and edges by grid_id. It is the way of the operators that are sequential by nature; a surface
must fit into a task, and ensembles of surfaces scale out.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runoff.functions.ordinals import from_ordinal, from_ordinal_column, ordinal, ordinal_column


#: Nodes of a surface that a task may gather; larger surfaces take the plans over all nodes, or go block by block.
LOCAL_NODES = 1 << 18


def per_grid(nodes: DataFrame, edges: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work(nodes sorted by idx, edges sorted by src and slot) for each grid_id, node numbers 0 to n - 1."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        out = work(left.sort_values("idx", ignore_index=True), right.sort_values(["src", "slot"], ignore_index=True))
        return out.assign(grid_id=key[0])

    nodes, edges = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (nodes, edges))  # columns of their own
    return nodes.groupBy("grid_id").cogroup(edges.groupBy("grid_id")).applyInPandas(run, schema)


class Adjacency:
    def __init__(self, n: int, edges: pd.DataFrame, to: str = "dst") -> None:
        self.src, self.to, self.distance = (edges[c].to_numpy() for c in ("src", to, "distance"))
        self.start = np.searchsorted(self.src, np.arange(n + 1))

    def of(self, i: int) -> range:
        return range(self.start[i], self.start[i + 1])


def node_levels(n: int, src: np.ndarray, rec: np.ndarray) -> np.ndarray:
    """0 where a node only receives itself, else one more than its highest receiver."""
    real = src != rec
    src, rec = src[real], rec[real]
    left = np.bincount(src, minlength=n)
    by_rec = np.argsort(rec, kind="stable")
    start = np.searchsorted(rec[by_rec], np.arange(n + 1))
    level, front, k = np.zeros(n, np.int64), np.flatnonzero(left == 0), 0
    while len(front):
        level[front] = k
        counts = start[front + 1] - start[front]
        at = np.repeat(start[front] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        donors = src[by_rec[at]]
        np.subtract.at(left, donors, 1)
        front = np.unique(donors[left[donors] == 0])
        k += 1
    return level


def depth_order(n: int, src: np.ndarray, rec: np.ndarray) -> list[int]:
    """Nodes from the outlets up, depth first; for several receivers, the reverse of a descent from the nodes without donors."""
    real = src != rec
    pairs = sorted(zip(rec[real].tolist(), src[real].tolist(), strict=True))
    donors: dict[int, list[int]] = {}
    for r, s in pairs:
        donors.setdefault(r, []).append(s)
    out: list[int] = []
    if len(src) == n:
        for root in np.sort(src[~real]).tolist():
            out.append(root)
            open_ = [root]
            while open_:
                met = donors.get(open_.pop(), [])
                out += met
                open_ += met
        return out
    below: dict[int, list[int]] = {}
    for s, r in zip(src[real].tolist(), rec[real].tolist(), strict=True):
        below.setdefault(s, []).append(r)
    waits = {i: len(d) for i, d in donors.items()}
    for first in range(n):
        open_ = [] if first in waits else [first]
        while open_:
            out.append(i := open_.pop())
            for r in below.get(i, []):
                waits[r] -= 1
                if not waits[r]:
                    open_.append(r)
    return out[::-1]


def accumulate_np(n: int, src: np.ndarray, rec: np.ndarray, weight: np.ndarray, own: np.ndarray) -> np.ndarray:
    level, acc = node_levels(n, src, rec), own.astype(float).copy()
    real = np.flatnonzero(src != rec)
    real = real[np.argsort(-level[src[real]], kind="stable")]
    cuts = np.flatnonzero(np.diff(level[src[real]])) + 1
    for part in np.split(real, cuts):
        np.add.at(acc, rec[part], acc[src[part]] * weight[part])
    return acc


def priority_flood(z: np.ndarray, base: np.ndarray, masked: np.ndarray, near: Adjacency) -> np.ndarray:
    """The least surface on which every reached node lies above some neighbour: Dijkstra on ordinals, a step up is one."""
    own = ordinal(z)
    level, done = own.copy(), masked.copy()
    heap = [(int(own[i]), int(i)) for i in np.flatnonzero(base & ~masked)]
    heapq.heapify(heap)
    done[base] = True
    while heap:
        at, i = heapq.heappop(heap)
        for k in near.of(i):
            j = near.to[k]
            if not done[j]:
                done[j] = True
                level[j] = max(own[j], at + 1)
                heapq.heappush(heap, (int(level[j]), int(j)))
    return from_ordinal(level)


def outlets_of(rec: np.ndarray) -> np.ndarray:
    """Each node's outlet."""
    root = rec.copy()
    while True:
        further = root[root]
        if np.array_equal(further, root):
            return root
        root = further


def lowest_passes(z: np.ndarray, basin: np.ndarray, outer: np.ndarray, masked: np.ndarray, near: Adjacency) -> tuple[np.ndarray, ...]:
    """b0, b1, edge number and elevation of the lowest pass of each pair of neighbouring basins (see basin_edges)."""
    i, j = near.src, near.to
    b, c = basin[i], basin[j]
    fit = np.flatnonzero(~masked[i] & ~masked[j] & (b != c) & ~outer[b] & ((c > b) | outer[c]))
    e = np.maximum(z[i[fit]], z[j[fit]])
    order = np.lexsort((fit, e, c[fit], b[fit]))
    pair = np.stack([b[fit][order], c[fit][order]], 1)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(pair, axis=0) != 0).any(1)])) if len(pair) else np.zeros(0, int)
    at = order[first]
    return pair[first, 0], pair[first, 1], fit[at], e[at]


def spanning_tree(b0: np.ndarray, b1: np.ndarray, elev: np.ndarray, n: int) -> list[int]:
    """Kruskal's tree in the order (elevation, b0, b1)."""
    parent, tree = list(range(n)), []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in np.lexsort((b1, b0, elev)).tolist():
        p, q = top(int(b0[k])), top(int(b1[k]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            tree.append(k)
    return tree


def resolve_by_tree(z: np.ndarray, rec: np.ndarray, distance: np.ndarray, base: np.ndarray, masked: np.ndarray, near: Adjacency, carve: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Receivers, distances and elevations with every reachable pit led over its basin's pass, and sinks filled."""
    rec, distance, z = rec.copy(), distance.copy(), z.copy()
    root = outlets_of(rec)
    outlet = np.flatnonzero((rec == np.arange(len(rec))) & ~masked)
    if base[outlet].all():
        return rec, distance, z
    basin = np.full(len(rec), -1)
    basin[outlet] = np.arange(len(outlet))
    basin = np.where(masked, -1, basin[root])
    outer = base[outlet]
    b0, b1, at, elev = lowest_passes(z, basin, outer, masked, near)
    outers = np.flatnonzero(outer)
    b0, b1 = np.concatenate([b0, np.full(max(len(outers) - 1, 0), outers[0] if len(outers) else 0)]), np.concatenate([b1, outers[1:]])
    at, elev = np.concatenate([at, np.full(max(len(outers) - 1, 0), -1)]).astype(int), np.concatenate([elev, np.full(max(len(outers) - 1, 0), -np.inf)])
    beside: dict[int, list[int]] = {}
    for k in spanning_tree(b0, b1, elev, len(outlet)):
        beside.setdefault(int(b0[k]), []).append(k)
        beside.setdefault(int(b1[k]), []).append(k)
    seen, stack = set(outers[:1].tolist()), outers[:1].tolist()
    while stack:
        b = stack.pop()
        for k in beside.get(b, ()):
            up = int(b1[k] if b0[k] == b else b0[k])
            if up in seen:
                continue
            seen.add(up)
            stack.append(up)
            if at[k] < 0:
                continue
            i, j = int(near.src[at[k]]), int(near.to[at[k]])
            inside, outside = (i, j) if basin[i] == up else (j, i)
            length, pit = float(near.distance[at[k]]), int(outlet[up])
            if carve:  # turn the path from the pass down to the pit around
                path = [inside]
                while path[-1] != pit:
                    path.append(int(rec[path[-1]]))
                old = distance[path].copy()
                rec[path[1:]], distance[path[1:]] = path[:-1], old[:-1]
                rec[inside], distance[inside] = outside, length
            else:
                distance[pit] = np.finfo(float).max
                if z[inside] < z[outside]:
                    rec[pit] = outside
                else:
                    rec[pit] = inside
                    rec[inside], distance[inside] = outside, length
    level, n = node_levels(len(rec), np.arange(len(rec)), rec), len(rec)
    order = np.argsort(level, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):
        low = part[(z[part] <= z[rec[part]]) & (rec[part] != part)]
        z[low] = np.nextafter(z[rec[low]], np.inf)
    return rec, distance, z


def stream_power(z: np.ndarray, area: np.ndarray, k: np.ndarray, flow: pd.DataFrame, dt: float, m: float, n: float, tolerance: float, linear: bool, start_from: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """New elevations by the implicit scheme, level by level from the outlets up, and which nodes were limited. Nodes
    without a receiver keep what start_from holds, or z."""
    src, rec, distance, weight = (flow[c].to_numpy() for c in ("src", "rec", "distance", "weight"))
    level, new, limited = node_levels(len(z), src, rec), (z if start_from is None else start_from).astype(float).copy(), np.zeros(len(z), bool)
    real = np.flatnonzero(src != rec)
    real = real[np.lexsort((real, level[src[real]]))]
    for part in np.split(real, np.flatnonzero(np.diff(level[src[real]])) + 1) if len(real) else []:
        s, r = src[part], rec[part]
        ids, inv = np.unique(s, return_inverse=True)
        floor = np.full(len(ids), np.inf)
        np.minimum.at(floor, inv, new[r])
        open_ = z[ids] > floor
        use = open_[inv] & (z[r] <= z[s])
        factor = k[s] * dt * (area[s] * weight[part]) ** m
        if linear:
            f = np.where(use, factor / distance[part], 0.0)
            value = (z[ids] + np.bincount(inv, f * new[r], len(ids))) / (1 + np.bincount(inv, f, len(ids)))
        else:
            f, start = factor / distance[part] ** n, z[s] - new[r]
            delta, live = start.copy(), use & (start > 0)
            while live.any():
                power = f[live] * delta[live] ** n
                gap = delta[live] + power - start[live]
                on = gap > tolerance
                at = np.flatnonzero(live)[on]
                delta[at] -= gap[on] / (1 + n * power[on] / delta[at])
                live[:] = False
                live[at] = delta[at] > 0
            value = z[ids].copy()
            value[inv[use]] = z[s[use]] - (start[use] - delta[use])
        low = open_ & (value < floor)
        value[low] = floor[low] + np.finfo(float).tiny
        limited[ids[low]] = True
        new[ids] = np.where(open_, value, z[ids])
    return new, limited


def erode_by_blocks(nodes: DataFrame, flow: DataFrame, block: int, dt: float, m: float, n: float, tolerance: float, linear: bool) -> DataFrame:
    """stream_power for surfaces of any size: grid_id, idx, erosion, limited. nodes: grid_id, idx, z, acc, k.

    Blocks of node numbers are eroded side by side, from what nodes beyond them were in the round before (at first, as
    high as they are), until none of those changes; only blocks beside a change are eroded again. Flow runs in no circle,
    so the outcome is the same as in a task, after as many rounds as a way down enters blocks at most. Rounds make rows
    of borders only; the last pass makes all.
    """
    from runoff.plans.iterate import durable, few
    from runoff.schema import NODE

    of = lambda c: F.expr(f"{c} div {block}")
    own = ["grid_id", "block"]
    edges = durable(flow.where("src <> rec").select("grid_id", "src", "slot", "rec", "distance", "weight", of("src").alias("block"), (of("src") != of("rec")).alias("across")))
    met = durable(edges.where("across").select("grid_id", F.col("rec").alias("idx")).distinct())
    count = met.count()
    known = durable(nodes.select(*NODE, "z").join(few(met, count), NODE, "left_semi").select(*NODE, "z", F.col("z").alias("new")))
    if known.count() != count:
        raise ValueError("the flow leads to nodes that it doesn't have")
    reads = durable(edges.where("across").select(*own, F.col("rec").alias("idx")).distinct())
    state = durable(nodes.select(*NODE, "z", "acc", "k", of("idx").alias("block")).join(few(met.withColumn("met", F.lit(True)), count), NODE, "left").withColumn("met", F.coalesce("met", F.lit(False))))

    def eroded(left: pd.DataFrame, right: pd.DataFrame, beyond: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("idx", ignore_index=True), right.sort_values(["src", "slot"], ignore_index=True)
        size, ids, out = len(left), left["idx"].to_numpy(), right["across"].to_numpy(bool)
        beyond = beyond.sort_values("idx", ignore_index=True)
        src, rec = np.searchsorted(ids, right["src"].to_numpy()), np.searchsorted(ids, right["rec"].to_numpy())
        rec[out] = size + np.searchsorted(beyond["idx"].to_numpy(), right["rec"].to_numpy()[out])
        local = pd.DataFrame({"src": src, "rec": rec, "distance": right["distance"].to_numpy(), "weight": right["weight"].to_numpy()})
        z, start = (np.concatenate([left["z"].to_numpy(float), beyond[c].to_numpy(float)]) for c in ("z", "new"))
        area, k = (np.concatenate([left[c].to_numpy(float), np.zeros(len(beyond))]) for c in ("acc", "k"))
        new, limited = stream_power(z, area, k, local, dt, m, n, tolerance, linear, start)
        return left[["grid_id", "idx", "z", "met"]].assign(new=new[:size], limited=limited[:size])

    def step(blocks: DataFrame | None, whole: bool) -> DataFrame:
        """Blocks with all their rows, or with those that others read."""
        there = reads.join(few(known, count), NODE)
        parts = [(state, ["idx", "z", "acc", "k", "met"]), (edges, ["src", "slot", "rec", "distance", "weight", "across"])]
        (left, _), (right, _) = [(df if blocks is None else df.join(F.broadcast(blocks), own, "left_semi"), c) for df, c in parts]
        there = there if blocks is None else there.join(F.broadcast(blocks), own, "left_semi")
        none = lambda t: F.lit(None).cast(t)
        right = right.withColumn("new", none("double")).unionByName(there.select(*own, none("long").alias("src"), none("int").alias("slot"), F.col("idx").alias("rec"), F.col("z").alias("distance"), none("double").alias("weight"), none("boolean").alias("across"), "new"))

        def work(key: tuple, rows: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
            at = more["src"].isna().to_numpy()
            beyond = more.loc[at, ["rec", "distance", "new"]].rename(columns={"rec": "idx", "distance": "z"})
            flowing = more[~at].assign(src=more.loc[~at, "src"].astype("int64"))
            done = eroded(rows, flowing, beyond)
            return (done if whole else done[done["met"]])[["grid_id", "idx", "z", "new", "limited"]]

        return durable(left.groupBy(*own).cogroup(right.groupBy(*own)).applyInPandas(work, "grid_id long, idx long, z double, new double, limited boolean"))

    blocks, rounds = None, state.select(*own).distinct().count() * max(count, 1) + 2
    for _ in range(rounds if count else 0):
        now = step(blocks, False).select(*NODE, F.col("new").alias("now"))
        changed = durable(known.join(few(now, count), NODE).where("new <> now"))
        if not changed.limit(1).count():
            break
        known = durable(known.join(few(now, count), NODE, "left").select(*NODE, "z", F.coalesce("now", "new").alias("new")))
        blocks = durable(reads.join(few(changed.select(*NODE), count), NODE).select(*own).distinct())
    else:
        if count:
            raise ValueError("the flow runs in a circle or leads to nodes that it doesn't have")
    return step(None, True).select(*NODE, (F.col("z") - F.col("new")).alias("erosion"), "limited")


def thomas(lower: np.ndarray, diag: np.ndarray, upper: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Tridiagonal systems, one in each row, solved side by side."""
    cp, dp = np.empty_like(right), np.empty_like(right)
    pivot = diag[:, 0]
    for c in range(right.shape[1]):
        if c:
            pivot = diag[:, c] - lower[:, c] * cp[:, c - 1]
        if (pivot == 0).any():
            raise ZeroDivisionError("a pivot of the tridiagonal system is zero")
        cp[:, c] = upper[:, c] / pivot
        dp[:, c] = (right[:, c] - (lower[:, c] * dp[:, c - 1] if c else 0)) / pivot
    for c in range(right.shape[1] - 2, -1, -1):
        dp[:, c] -= cp[:, c] * dp[:, c + 1]
    return dp


def _faces(k: np.ndarray | float, shape: tuple[int, ...], axis: int, d: float) -> tuple[np.ndarray, ...]:
    """Conductances to the node before, at the node, and to the node after along an axis."""
    whole = np.broadcast_to(np.asarray(k, float), shape)
    before, after = np.roll(whole, 1, axis), np.roll(whole, -1, axis)
    return 0.25 * (before + whole) / d**2, 0.125 * (before + 2 * whole + after) / d**2, 0.25 * (whole + after) / d**2


def across_step(z: np.ndarray, k: np.ndarray | float, dt: float, across: float) -> np.ndarray:
    """The explicit part of half an ADI step, of z and the rows beside; the first and last row and column stay."""
    inner, right = slice(1, -1), z.copy()
    a, b, c = (f[inner] for f in _faces(k, z.shape, 0, across))
    right[inner, inner] = ((1 - 2 * b * dt) * z[inner] + a * dt * z[:-2] + c * dt * z[2:])[:, inner]
    return right


def along_step(right: np.ndarray, k: np.ndarray | float, dt: float, along: float) -> np.ndarray:
    """The implicit part of half an ADI step, along rows, each for itself; the first and last column stay."""
    beside = _faces(k, right.shape, 1, along)
    lower, diag, upper = -beside[0] * dt, 1 + 2 * beside[1] * dt, -beside[2] * dt
    for edge in (0, -1):
        lower[:, edge], diag[:, edge], upper[:, edge] = 0, 1, 0
    return thomas(lower, diag, upper, right)


def half_step(z: np.ndarray, k: np.ndarray | float, dt: float, across: float, along: float) -> np.ndarray:
    """Half an ADI step, implicit along rows; the first and last row and column stay. Each row needs those beside it."""
    whole, inner, out = np.broadcast_to(np.asarray(k, float), z.shape), slice(1, -1), z.copy()
    if len(z) > 2:
        out[inner] = along_step(across_step(z, k, dt, across)[inner], whole[inner], dt, along)
    return out


def diffuse(z: np.ndarray, k: np.ndarray | float, dt: float, dy: float, dx: float) -> np.ndarray:
    """One ADI step: implicit along rows, then along columns; borders stay."""
    first = half_step(z, k, dt, dy, dx)
    return half_step(first.T.copy(), np.asarray(k, float).T, dt, dx, dy).T


def diffuse_by_blocks(rows: DataFrame, shape: tuple[int, int], block: int, dt: float, dy: float, dx: float) -> DataFrame:
    """diffuse for surfaces of any size: grid_id, idx, erosion. rows: grid_id, idx, z, k.

    A task takes rows of `block` nodes in all and the rows beside them, for the half along rows and what the other half
    needs of the columns beside; then a task takes a column, or several that are `block` nodes in all.
    """
    n, m = shape
    lines, columns = max(1, block // m), max(1, block // n)
    dealt = rows.withColumn("row", F.expr(f"idx div {m}"))
    own, last = F.expr(f"row div {lines}"), (n - 1) // lines
    before = F.when((F.col("row") % lines == 0) & (own > 0), own - 1)
    after = F.when((F.col("row") % lines == lines - 1) & (own < last), own + 1)
    dealt = dealt.select("grid_id", "idx", "z", "k", F.explode(F.filter(F.array(own, before, after), lambda x: x.isNotNull())).alias("block"))

    def along_rows(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx", ignore_index=True)
        z, k = (part[c].to_numpy(float).reshape(-1, m) for c in ("z", "k"))
        half = half_step(z, k, dt, dy, dx)
        done = part[["grid_id", "idx", "z", "k"]].assign(right=across_step(half.T, k.T, dt, dx).T.ravel(), half=half.ravel())
        at = part["idx"].to_numpy() // m
        return done.loc[at // lines == key[1], ["grid_id", "idx", "z", "k", "half", "right"]]

    first = dealt.groupBy("grid_id", "block").applyInPandas(along_rows, "grid_id long, idx long, z double, k double, half double, right double")

    def along_columns(part: pd.DataFrame) -> pd.DataFrame:
        at = part["idx"].to_numpy()
        part = part.iloc[np.lexsort((at, at % m))]
        right, k, half = (part[c].to_numpy(float).reshape(-1, n) for c in ("right", "k", "half"))
        new, moves = half.copy(), ~np.isin(part["idx"].to_numpy()[::n] % m, (0, m - 1))
        if moves.any():
            new[moves] = along_step(right[moves], k[moves], dt, dy)
        return part[["grid_id", "idx"]].assign(erosion=part["z"].to_numpy() - new.ravel())

    return first.groupBy("grid_id", F.expr(f"idx % {m} div {columns}")).applyInPandas(along_columns, "grid_id long, idx long, erosion double")


def relaxed(own: np.ndarray, base: np.ndarray, masked: np.ndarray, level: np.ndarray, near: Adjacency, moves: np.ndarray) -> np.ndarray:
    """Levels lowered to the least surface that they lead to: each node but a base level is at the highest of its own
    ordinal and the least step above its lowest neighbour. Nodes that don't move are others' to lower."""
    level = level.copy()
    fixed = base | masked | ~moves
    use = ~masked[near.src] & ~masked[near.to] & ~fixed[near.src]
    lowest = np.full(len(own), np.iinfo(np.int64).max)
    np.minimum.at(lowest, near.src[use], level[near.to[use]])
    open_ = lowest < np.iinfo(np.int64).max
    could = np.where(open_, np.maximum(own, np.where(open_, lowest, 0) + 1), level)
    heap = [(int(could[i]), int(i)) for i in np.flatnonzero(~fixed & (could < level))]
    heapq.heapify(heap)
    while heap:
        at, i = heapq.heappop(heap)
        if at >= level[i]:
            continue
        level[i] = at
        for k in near.of(i):
            j = near.to[k]
            if not fixed[j] and level[j] > (there := max(int(own[j]), at + 1)):
                heapq.heappush(heap, (there, int(j)))
    return level


def flood_by_blocks(grid, surface: DataFrame, filled: DataFrame, block: int) -> DataFrame:
    """As priority_flood, for surfaces of any size. filled: the surface filled along some way from each node to a base
    level, its elevations no lower than the least surface that drains.

    Levels only fall from there, to the one surface on which each node is at the highest of its own elevation and a step
    above its lowest neighbour: block by block of node numbers, until none changes that another block sees.
    """
    from runoff.plans.iterate import durable, few
    from runoff.schema import NODE

    of = lambda c: F.expr(f"{c} div {block}")
    own = ["grid_id", "block"]
    crossing = durable(grid.neighbors(surface.where("not masked").select(*NODE)).where(of("src") != of("dst")).select("grid_id", of("src").alias("block"), F.col("dst").alias("idx")).distinct())
    nodes = surface.select(*NODE, "z", "masked", "is_base").join(filled.select(*NODE, ordinal_column(F.col("z")).alias("level")), NODE).withColumn("block", of("idx"))
    levels, blocks = durable(nodes), None
    beyond = durable(levels.drop("block").join(crossing, NODE).select(*nodes.columns))

    def work(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({c: [] for c in [*names, "changed"]})
        part = pd.concat([left.assign(moves=True), right.assign(moves=False)]).sort_values("idx", ignore_index=True)
        ids, moves = part["idx"].to_numpy(), part["moves"].to_numpy(bool)
        near = part["linked"][moves].tolist()
        src, to = np.repeat(np.flatnonzero(moves), [len(x) for x in near]), np.concatenate([*near, np.zeros(0, np.int64)]).astype(np.int64)
        at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
        near = Adjacency(len(ids), pd.DataFrame({"src": src, "dst": at, "distance": 0.0})[ids[at] == to])
        level = relaxed(ordinal(part["z"].to_numpy(float)), part["is_base"].to_numpy(bool), part["masked"].to_numpy(bool), part["level"].to_numpy(), near, moves)
        return part.assign(level=level, changed=level != part["level"].to_numpy())[moves][[*names, "changed"]]

    names = ["grid_id", "idx", "z", "masked", "is_base", "level", "block"]
    while True:
        here = levels if blocks is None else levels.join(F.broadcast(blocks), own, "left_semi")
        there = beyond if blocks is None else beyond.join(F.broadcast(blocks), own, "left_semi")
        now = durable(grid.linked(here.select(*names)).groupBy(*own).cogroup(there.select(*names).groupBy(*own)).applyInPandas(work, "grid_id long, idx long, z double, masked boolean, is_base boolean, level long, block long, changed boolean"))
        rest = levels.select(*names) if blocks is None else levels.select(*names).join(F.broadcast(blocks), own, "left_anti")
        levels = now.select(*names) if blocks is None else durable(rest.unionByName(now.select(*names)))
        changed = durable(now.where("changed").select(*NODE, F.col("level").alias("now")).join(crossing.select(*NODE).distinct(), NODE))
        count = changed.count()
        if not count:
            break
        beyond = durable(beyond.join(few(changed, count), NODE, "left").select(*NODE, "z", "masked", "is_base", F.coalesce("now", "level").alias("level"), "block"))
        blocks = durable(beyond.join(few(changed.select(*NODE), count), NODE, "left_semi").select(*own).distinct())
    own_level = ordinal_column(F.col("z"))
    z = F.when(F.col("level") > own_level, from_ordinal_column(F.col("level"))).otherwise(F.col("z"))
    return levels.select(*NODE, z.alias("z"), "masked", "is_base")
