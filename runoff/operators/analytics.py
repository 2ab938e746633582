"""What a flow graph tells: accumulation, basins, outlets, pits, donors, orders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runoff.operators import grouped
from runoff.plans import iterate
from runoff.plans.iterate import ancestors, dense_index, doubled, durable, few, levels, sum_by_levels, sum_downstream
from runoff.schema import NODE


def accumulate(flow: DataFrame, areas: DataFrame, source: float | DataFrame = 1.0, single: bool = True) -> DataFrame:
    """grid_id, idx, acc: area times source, of each node and of all that drains to it."""
    rate = areas.withColumn("src_", F.lit(float(source))) if not isinstance(source, DataFrame) else areas.join(source.select(*NODE, F.col("value").alias("src_")), NODE)
    own = rate.select(*NODE, (F.col("area") * F.col("src_")).alias("acc"))
    return (sum_downstream if single else sum_by_levels)(flow, own, "acc")


def labelled(flow: DataFrame, surface: DataFrame) -> DataFrame:
    """grid_id, idx, basin, outlet, and outer: whether the outlet is a base level. Basins count from 0 in the order of
    unmasked outlets; basin and outer are null where masked."""
    numbered = dense_index(outlets(flow, surface), "idx", name="basin", within="grid_id")
    return ancestors(flow, numbered.withColumnRenamed("is_base", "outer")).select(*NODE, "basin", F.col("root").alias("outlet"), "outer")


def basins(flow: DataFrame, surface: DataFrame) -> DataFrame:
    """grid_id, idx, basin, outlet."""
    return labelled(flow, surface).select(*NODE, "basin", "outlet")


def outlets(flow: DataFrame, surface: DataFrame) -> DataFrame:
    return flow.where("src = rec").select("grid_id", F.col("src").alias("idx")).join(surface.where("not masked").select(*NODE, "is_base"), NODE).distinct()


def pits(flow: DataFrame, surface: DataFrame) -> DataFrame:
    """Outlets that aren't base levels."""
    return outlets(flow, surface).where("not is_base").select(*NODE)


def donors_count(flow: DataFrame, surface: DataFrame, include_pit_self: bool = True) -> DataFrame:
    """grid_id, idx, n: nodes that drain here; a pit counts itself if include_pit_self."""
    real = flow.where("src <> rec").select("grid_id", F.col("rec").alias("idx"))
    if include_pit_self:
        real = real.unionByName(pits(flow, surface))
    counts = real.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"))
    return surface.select(*NODE).join(counts, NODE, "left").select(*NODE, F.coalesce("n", F.lit(0)).alias("n"))


def donors(flow: DataFrame, surface: DataFrame) -> DataFrame:
    """grid_id, idx, donors: the nodes that drain to each, in order; itself is none of them."""
    found = flow.where("src <> rec").groupBy("grid_id", F.col("rec").alias("idx")).agg(F.sort_array(F.collect_set("src")).alias("donors"))
    return surface.select(*NODE).join(found, NODE, "left").withColumn("donors", F.coalesce("donors", F.array().cast("array<long>")))


def bfs_order(flow: DataFrame, single: bool = True) -> DataFrame:
    """grid_id, idx, level, place: nodes by level, in a level by number; each comes after all its receivers."""
    return dense_index(bfs_levels(flow, single), "level", "idx", name="place", within="grid_id")


def dfs_order(flow: DataFrame) -> DataFrame:
    """grid_id, idx, place: from each outlet up, depth first, for a single-receiver flow.

    A node on top of the stack is taken off and its donors come next in the order, by number; then they are put on the
    stack. Nodes are so taken off in preorder, larger donors first: a node's turn is the sum, along its path, of one and
    of the nodes that drain through its larger siblings. The order is then by outlet, turn of the receiver and number.
    """
    counted = sum_downstream(flow, flow.select("grid_id", F.col("src").alias("idx"), F.lit(1.0).alias("n")), "n")
    one = durable(flow.select("grid_id", F.col("src").alias("idx"), "rec").join(counted, NODE))
    larger = Window.partitionBy("grid_id", "rec").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    below = one.where("idx <> rec").select(*NODE, (F.coalesce(F.sum("n").over(larger), F.lit(0.0)) + 1).cast("long").alias("turn"))
    turns = below.unionByName(one.where("idx = rec").select(*NODE, F.lit(0).cast("long").alias("turn")))
    own = one.join(turns, NODE).select(*NODE, "turn", F.col("rec").alias("root"))
    known = doubled(flow, own, {"turn": lambda a, b: a["turn"] + b["turn"], "root": lambda a, b: b["root"]})
    after = known.select("grid_id", F.col("idx").alias("rec"), F.col("turn").alias("after"))
    upper = one.where("idx <> rec").select(*NODE, "rec").join(after, ["grid_id", "rec"]).select(*NODE, "after")
    placed = known.join(upper, NODE, "left").select(*NODE, "root", F.coalesce("after", F.lit(-1)).alias("after"))
    return dense_index(placed, "root", "after", "idx", name="place", within="grid_id").select(*NODE, "place")


def bfs_levels(flow: DataFrame, single: bool = True) -> DataFrame:
    """grid_id, idx, level."""
    return ancestors(flow).select(*NODE, F.col("depth").alias("level")) if single else levels(flow)


def _lowest(part: pd.DataFrame, own: slice, steps) -> pd.DataFrame:
    """The lowest step between each two basins from the slice of sorted rows, as basin_edges orders them."""
    ids, z, basin, outer = (part[c].to_numpy(t) for c, t in (("idx", np.int64), ("z", float), ("basin", np.int64), ("outer", bool)))
    made = []
    for k, at in steps.seen(ids, own):
        use = np.flatnonzero((at >= 0) & ~outer[own] & (basin[at] != basin[own]) & ((basin[at] > basin[own]) | outer[at]))
        i, j = use + own.start, at[use]
        e = np.where(z[j] > z[i], z[j], z[i])
        made.append(pd.DataFrame({"b0": basin[i], "b1": basin[j], "e": e, "src": ids[i], "slot": k, "dst": ids[j], "distance": steps.lengths[k], "z0": z[i], "z1": z[j]}))
    every = pd.concat(made, ignore_index=True)
    every = every.iloc[np.lexsort([every[c] for c in ("slot", "src", "e", "b1", "b0")])]
    return every.drop_duplicates(["b0", "b1"])


def least_passes(steps: DataFrame) -> DataFrame:
    """The least of steps (grid_id, b0, b1, e, ...) between each two basins."""
    return steps.groupBy("grid_id", "b0", "b1").agg(F.min(F.struct("e", "src", "slot", "dst", "distance", "z0", "z1")).alias("p"))


def _passes(grid, known: DataFrame) -> DataFrame:
    """grid_id, b0, b1 and p: (e, src, slot, dst, distance, z0, z1) of the lowest step, least in that order."""
    if grid.size > grouped.LOCAL_NODES and hasattr(grid, "by_seen_block"):
        found = grid.by_seen_block(known, iterate.BLOCK, _lowest, "grid_id long, b0 long, b1 long, e double, src long, slot int, dst long, distance double, z0 double, z1 double")
        return least_passes(found)
    steps = grid.around(known, ["z", "basin", "outer"]).where("not outer").select("grid_id", F.col("idx").alias("src"), "z", "basin", F.explode("near").alias("n"))
    steps = steps.where("n.basin <> basin and (n.basin > basin or n.outer)")
    one = F.struct(F.greatest("z", "n.z").alias("e"), "src", "n.slot", "n.dst", "n.distance", F.col("z").alias("z0"), F.col("n.z").alias("z1"))
    return steps.groupBy("grid_id", F.col("basin").alias("b0"), F.col("n.basin").alias("b1")).agg(F.min(one).alias("p"))


def basin_edges(grid, surface: DataFrame, known: DataFrame) -> DataFrame:
    """grid_id, b0, b1, p0, p1, pass_elev, pass_len, z0, z1: the lowest pass from each inner basin to each basin beside it.

    known: grid_id, idx, basin, outlet, outer. Links from one inner basin to another are kept from the smaller number
    only. Outer basins are tied to the first of them by links without a pass.
    """
    outer = known.where("outer").select("grid_id", "basin").distinct()
    known = known.join(surface.where("not masked").select(*NODE, "z"), NODE).select(*NODE, "z", "basin", "outer")
    return linked(_passes(grid, known), outer)


def linked(passes: DataFrame, outer: DataFrame) -> DataFrame:
    """basin_edges from the lowest passes and the outer basins (grid_id, basin)."""
    inner = passes.select("grid_id", "b0", "b1", F.col("p.src").alias("p0"), F.col("p.dst").alias("p1"), F.col("p.e").alias("pass_elev"), F.col("p.distance").alias("pass_len"), "p.z0", "p.z1")
    first = outer.groupBy("grid_id").agg(F.min("basin").alias("b0"))
    none, no_z = F.lit(None).cast("long"), F.lit(None).cast("double")
    tied = outer.join(first, "grid_id").where("basin <> b0").select("grid_id", "b0", F.col("basin").alias("b1"), none.alias("p0"), none.alias("p1"), F.lit(float("-inf")).alias("pass_elev"), F.lit(0.0).alias("pass_len"), no_z.alias("z0"), no_z.alias("z1"))
    return inner.unionByName(tied)


def boruvka(edges: DataFrame) -> DataFrame:
    """The edges of a minimum spanning forest."""
    return spanning_forest(edges)[0]


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges of a minimum spanning forest and (grid_id, b, c): the component that each basin ends in.

    Equal passes are ordered by (b0, b1), so the tree is the one that any other method in that order finds. A task merges
    the basins of a block of numbers as far as their cheapest edges stay inside; what is left between blocks is merged in
    the same way, by a task where it is little, or by rounds of cheapest edges where blocks hardly shorten it.
    """
    edges = edges.select("*", F.col("b0").alias("n0"), F.col("b1").alias("n1"))
    tree, names = _forest(edges, iterate.BLOCK)
    return tree.drop("n0", "n1"), names.withColumnRenamed("n", "b")


#: Kinds of rows that merging a block makes: the component of a node, an edge of the forest, an edge that is left.
_NAME, _TREE, _LEFT = 0, 1, 2


def _merged(part: pd.DataFrame, low: int, high: int) -> pd.DataFrame:
    """Nodes from low to high of a surface merged along edges, in their order, as long as one side's cheapest edge is known.

    Edges to nodes beyond are there too. A component that has met one is stuck: its next edges may not be its cheapest.
    """
    part = part.iloc[np.lexsort((part["b1"], part["b0"], part["pass_elev"]))].reset_index(drop=True)
    n0, n1 = part["n0"].to_numpy(), part["n1"].to_numpy()
    in0, in1 = (n0 >= low) & (n0 < high), (n1 >= low) & (n1 < high)
    ids = np.unique(np.concatenate([n0[in0], n1[in1]]))
    at0, at1 = np.where(in0, np.searchsorted(ids, n0), -1).tolist(), np.where(in1, np.searchsorted(ids, n1), -1).tolist()
    parent, stuck, taken = list(range(len(ids))), bytearray(len(ids)), np.zeros(len(part), bool)

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, (i, j) in enumerate(zip(at0, at1, strict=True)):
        if i < 0 or j < 0:
            stuck[top(max(i, j))] = 1
            continue
        p, q = top(i), top(j)
        if p != q and not (stuck[p] and stuck[q]):
            p, q = min(p, q), max(p, q)
            parent[q], taken[k] = p, True
            stuck[p] |= stuck[q]
    root = np.array([top(x) for x in range(len(ids))], np.int64)
    ends = [np.where(w, root[np.clip(at, 0, None)], -1) for w, at in ((in0, at0), (in1, at1))] if len(ids) else [n0, n1]
    left = in0 & ~taken & (~in1 | (ends[0] != ends[1]))
    named = pd.DataFrame({"kind": _NAME, "n": ids, "c": ids[root]})
    return pd.concat([named, part[taken].assign(kind=_TREE), part[left].assign(kind=_LEFT)], ignore_index=True)


def _forest(edges: DataFrame, block: int | None, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The forest of edges between n0 and n1, and the component c of each node n."""
    names = ["grid_id", *[c for c in edges.columns if c != "grid_id"]]
    schema = "kind int, n long, c long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.select(*names).schema)
    columns = ["kind", "n", "c", *names]
    if block is None:
        met = edges.select(*names).groupBy("grid_id").applyInPandas(lambda part: _merged(part, 0, 1 << 62).assign(grid_id=part["grid_id"].iloc[0])[columns], schema)
    else:
        own = F.array_distinct(F.array(F.expr(f"n0 div {block}"), F.expr(f"n1 div {block}")))

        def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            return _merged(part, key[1] * block, (key[1] + 1) * block).assign(grid_id=key[0])[columns]

        met = edges.select(*names, F.explode(own).alias("block")).groupBy("grid_id", "block").applyInPandas(lambda key, part: work(key, part.drop(columns="block")), schema)
    met = durable(met)
    tree, known = met.where(F.col("kind") == _TREE).select(*names), met.where(F.col("kind") == _NAME).select("grid_id", "n", "c")
    left = durable(met.where(F.col("kind") == _LEFT).select(*names))
    n = 0 if block is None else left.count()
    if not n:
        return tree, known
    ends = durable(left.select("grid_id", F.explode(F.array("n0", "n1")).alias("n")).distinct())
    named = durable(known.join(few(ends, n), ["grid_id", "n"]))
    for k in ("n0", "n1"):
        left = left.join(few(named.select("grid_id", F.col("n").alias(k), F.col("c").alias(f"_{k}")), n), ["grid_id", k]).drop(k).withColumnRenamed(f"_{k}", k)
    left = durable(left.where("n0 <> n1").select(*names))
    if n <= iterate.GATHERED or size is None or n <= size // 2:
        more, upper = _forest(left, None if n <= iterate.GATHERED else block * 16, n)
    else:
        more, upper = _cheapest(left)
    upper = durable(upper.select("grid_id", F.col("n").alias("c"), F.col("c").alias("whole")))
    whole = known.join(few(upper, n), ["grid_id", "c"], "left").select("grid_id", "n", F.coalesce("whole", "c").alias("c"))
    kept = durable(more.select("grid_id", "b0", "b1"))
    rest = met.where(F.col("kind") == _LEFT).select(*names).join(few(kept, n), ["grid_id", "b0", "b1"], "left_semi").select(*names)
    return tree.unionByName(rest), durable(whole)


def _cheapest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """_forest by rounds of cheapest outgoing edges and pointer doubling."""
    edges = durable(edges)
    names = durable(edges.select("grid_id", F.explode(F.array("n0", "n1")).alias("n")).distinct().withColumn("c", F.col("n")))
    tree = None
    while True:
        ends = edges.join(names.select("grid_id", F.col("n").alias("n0"), F.col("c").alias("c0")), ["grid_id", "n0"]).join(names.select("grid_id", F.col("n").alias("n1"), F.col("c").alias("c1")), ["grid_id", "n1"]).where("c0 <> c1")
        key = F.struct("pass_elev", "b0", "b1", "c0", "c1")
        both = ends.select("grid_id", F.explode(F.array(F.struct(F.col("c0").alias("c"), key.alias("k")), F.struct(F.col("c1").alias("c"), key.alias("k")))).alias("x"))
        best = durable(both.groupBy("grid_id", F.col("x.c").alias("c")).agg(F.min("x.k").alias("k")))
        if not best.limit(1).count():
            break
        picked = best.select("grid_id", F.col("k.b0").alias("b0"), F.col("k.b1").alias("b1")).distinct()
        tree = durable(picked if tree is None else tree.unionByName(picked).distinct())
        hop = best.select("grid_id", F.col("c").alias("src"), F.when(F.col("k.c0") == F.col("c"), F.col("k.c1")).otherwise(F.col("k.c0")).alias("to"))
        back = hop.select("grid_id", F.col("src").alias("to"), F.col("to").alias("again"))
        cut = hop.join(back, ["grid_id", "to"], "left").select("grid_id", "src", F.when((F.col("again") == F.col("src")) & (F.col("src") < F.col("to")), F.col("src")).otherwise(F.col("to")).alias("rec"))
        alone = names.select("grid_id", F.col("c").alias("src")).distinct().join(cut, ["grid_id", "src"], "left_anti").withColumn("rec", F.col("src"))
        roots = ancestors(cut.unionByName(alone)).select("grid_id", F.col("idx").alias("c"), "root")
        names = durable(names.join(roots, ["grid_id", "c"]).select("grid_id", "n", F.col("root").alias("c")))
    return edges.join(tree, ["grid_id", "b0", "b1"], "left_semi").select(*edges.columns) if tree is not None else edges.limit(0), names


def orient(tree: DataFrame, names: DataFrame, outer: DataFrame) -> DataFrame:
    """grid_id, up, down, inside, outside, z_in, z_out, pass_elev, pass_len: each inner basin that the forest ties to an
    outer one, the basin that it leads to, and the pass.

    Without the outer basins the forest falls into trees, each with one edge to them, whose inner end is the tree's
    root. They are walked from their roots block by block, or ranked by a tour where blocks hardly shorten them. outer:
    grid_id, b.
    """
    outer = durable(outer)
    beside = few(outer.select("grid_id", F.col("b").alias("b1"), F.lit(True).alias("out")), outer.count())
    given = tree.where("p0 is not null").join(beside, ["grid_id", "b1"], "left")
    given = durable(given.select("*", F.col("b0").alias("n0"), F.when(F.col("out"), F.lit(-1)).otherwise(F.col("b1")).cast("long").alias("n1")).drop("out"))
    found = _rooted(given, iterate.BLOCK, given.count())
    if found is None:
        return _toured(tree, names, outer)
    side = lambda a, b, name: F.when(F.col("forward"), F.col(a)).otherwise(F.col(b)).alias(name)
    return found.select("grid_id", side("b0", "b1", "up"), side("b1", "b0", "down"), side("p0", "p1", "inside"), side("p1", "p0", "outside"), side("z0", "z1", "z_in"), side("z1", "z0", "z_out"), "pass_elev", "pass_len")


def _components(part: pd.DataFrame, low: int, high: int) -> pd.DataFrame:
    """Of edges with an end from low to high, those that lead out and root edges: side, the side that lies inside, and c, the
    component of that end along edges inside. Root edges of components that no edge leads out of are left out."""
    n0, n1 = part["n0"].to_numpy(), part["n1"].to_numpy()
    in0, in1 = (n0 >= low) & (n0 < high), (n1 >= low) & (n1 < high)
    ids = np.unique(np.concatenate([n0[in0], n1[in1]]))
    both = np.flatnonzero(in0 & in1)
    parent = list(range(len(ids)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(np.searchsorted(ids, n0[both]).tolist(), np.searchsorted(ids, n1[both]).tolist(), strict=True):
        parent[top(i)] = top(j)
    rest = np.flatnonzero(~(in0 & in1))
    side = np.where(in0[rest], 0, 1)
    c = np.array([top(x) for x in np.searchsorted(ids, np.where(side == 0, n0[rest], n1[rest])).tolist()], np.int64)
    use = (n1[rest] >= 0) | np.isin(c, c[n1[rest] >= 0])
    return part.iloc[rest[use]][["grid_id", "b0", "b1"]].assign(side=side[use], c=ids[c[use]] if len(c) else c)


def _walked(part: pd.DataFrame, roots: np.ndarray) -> pd.DataFrame:
    """Edges of a forest that its roots reach, and forward: whether n1 lies nearer to the root."""
    n0, n1 = part["n0"].to_numpy(), part["n1"].to_numpy()
    ids = np.unique(np.concatenate([n0, n1, roots]))
    a, b = np.searchsorted(ids, n0), np.searchsorted(ids, n1)
    ends, others = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(ends, kind="stable")
    start, near = np.searchsorted(ends[order], np.arange(len(ids) + 1)).tolist(), others[order].tolist()
    turn, open_ = [-1] * len(ids), np.searchsorted(ids, roots).tolist()
    for i in open_:
        turn[i] = 0
    for i in open_:  # grows as it goes
        for j in near[start[i] : start[i + 1]]:
            if turn[j] < 0:
                turn[j] = turn[i] + 1
                open_.append(j)
    turn = np.array(turn, np.int64)
    reached = turn[a] >= 0
    return part[reached].assign(forward=(turn[b] < turn[a])[reached])


def _rooted(edges: DataFrame, block: int | None, size: int) -> DataFrame | None:
    """Edges (grid_id, n0, n1, b0, b1, ...) of trees with one root edge each, whose n1 is -1, as far as those reach, and
    forward: whether n1 lies nearer to the root. None where blocks hardly shorten the trees.

    A task walks the trees inside of a block from the nodes where their ways to a root lead in. Those come from the trees
    between the parts that blocks hold, which are solved in the same way.
    """
    names = list(edges.columns)
    yes, of = F.lit(True).alias("forward"), lambda c: F.expr(f"{c} div {block}") if block is not None else F.lit(0).cast("long")
    done = edges.where("n1 < 0").select(*names, yes)
    cross = edges.where(F.col("n1") >= 0).where(of("n0") != of("n1"))
    n = 0 if block is None else cross.count()
    if n > iterate.GATHERED and n > size // 2:
        return None
    if n:
        touched = F.when(F.col("n1") < 0, F.array(of("n0"))).otherwise(F.array_distinct(F.array(of("n0"), of("n1"))))
        each = edges.select("grid_id", "n0", "n1", "b0", "b1", F.explode(touched).alias("block"))
        ends = each.groupBy("grid_id", "block").applyInPandas(lambda key, part: _components(part, key[1] * block, (key[1] + 1) * block), "grid_id long, b0 long, b1 long, side long, c long")
        at = lambda k: F.max(F.when(F.col("side") == k, F.col("c")))
        upper = durable(durable(ends).groupBy("grid_id", "b0", "b1").agg(at(0).alias("n0"), F.coalesce(at(1), F.lit(-1)).cast("long").alias("n1")))
        found = _rooted(upper, None if n <= iterate.GATHERED else block * 16, n)
        if found is None:
            return None
        led = few(durable(found.where("n1 >= 0").select("grid_id", "b0", "b1", "forward")), n)
        done = done.unionByName(durable(cross.join(led, ["grid_id", "b0", "b1"]).select(*names, "forward")))
    roots = done.select("grid_id", F.when(F.col("forward"), F.col("n0")).otherwise(F.col("n1")).alias("n")).select("grid_id", "n", of("n").alias("block"))
    inner = edges.where(F.col("n1") >= 0).where(of("n0") == of("n1")).withColumn("block", of("n0"))

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({c: [] for c in (*names, "forward")})
        return _walked(left, right["n"].to_numpy(np.int64))[[*names, "forward"]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema) + ", forward boolean"
    inner, roots = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (inner, roots))  # columns of their own
    walked = inner.groupBy("grid_id", "block").cogroup(roots.groupBy("grid_id", "block")).applyInPandas(lambda left, right: work(left, right), schema)
    return done.unionByName(walked)


def _toured(tree: DataFrame, names: DataFrame, outer: DataFrame) -> DataFrame:
    """orient by a tour along both sides of every edge (an arc's successor is the arc after its reverse around the node where
    it ends), ranked by pointer doubling: of an edge's two arcs the earlier one leads away from the root. Edges between
    inner basins are from the smaller number. Arcs are numbered in ranges, so a basin with many neighbours isn't gathered."""
    drained = durable(names.join(outer, ["grid_id", "b"], "left_semi").select("grid_id", "c").distinct())
    reached = names.join(few(drained, drained.count()), ["grid_id", "c"], "left_semi").select("grid_id", "b")
    given = tree.where("p0 is not null").join(reached.withColumnRenamed("b", "b0"), ["grid_id", "b0"], "left_semi")
    beside = outer.select("grid_id", F.col("b").alias("b1"), F.lit(True).alias("out"))
    given = durable(given.join(beside, ["grid_id", "b1"], "left").withColumn("out", F.coalesce("out", F.lit(False))))
    passes = ["pass_elev", "pass_len"]
    inward = lambda df: df.select("grid_id", F.col("b0").alias("up"), F.col("b1").alias("down"), F.col("p0").alias("inside"), F.col("p1").alias("outside"), F.col("z0").alias("z_in"), F.col("z1").alias("z_out"), *passes)
    turned = lambda df: df.select("grid_id", F.col("b1").alias("up"), F.col("b0").alias("down"), F.col("p1").alias("inside"), F.col("p0").alias("outside"), F.col("z1").alias("z_in"), F.col("z0").alias("z_out"), *passes)
    last = inward(given.where("out"))
    edges = given.where("not out")
    arcs = edges.select("grid_id", F.col("b0").alias("u"), F.col("b1").alias("v")).union(edges.select("grid_id", "b1", "b0"))
    arcs = durable(dense_index(arcs, "grid_id", "u", "v"))
    around = arcs.groupBy("grid_id", F.col("u").alias("v")).agg(F.min("idx").alias("low"), F.max("idx").alias("high"))
    around = around.join(last.select("grid_id", F.col("up").alias("v"), F.lit(True).alias("root")), ["grid_id", "v"], "left")
    side = lambda name: (F.max(F.when(F.col("u") < F.col("v"), F.col(name))).alias("x0"), F.max(F.when(F.col("u") > F.col("v"), F.col(name))).alias("x1"))
    both = arcs.groupBy("grid_id", F.least("u", "v").alias("b0"), F.greatest("u", "v").alias("b1")).agg(*side("idx"))
    arc = lambda u, v, idx, back: F.struct(F.col(u).alias("u"), F.col(v).alias("v"), F.col(idx).alias("idx"), F.col(back).alias("back"))
    ends = both.select("grid_id", F.explode(F.array(arc("b0", "b1", "x0", "x1"), arc("b1", "b0", "x1", "x0"))).alias("a")).select("grid_id", "a.*").join(around, ["grid_id", "v"])
    after = F.when(F.col("back") < F.col("high"), F.col("back") + 1).when(F.col("root"), F.col("idx")).otherwise(F.col("low"))
    tour = durable(ends.select("grid_id", "u", "v", F.col("idx").alias("src"), after.alias("rec")))
    left = ancestors(tour.select("grid_id", "src", "rec")).select("grid_id", F.col("idx").alias("src"), "depth")
    timed = tour.select("grid_id", "u", "v", "src").join(left, ["grid_id", "src"]).select("grid_id", "u", "v", "depth")
    met = timed.groupBy("grid_id", F.least("u", "v").alias("b0"), F.greatest("u", "v").alias("b1")).agg(*side("depth"))
    whole = edges.join(met, ["grid_id", "b0", "b1"])  # x0 > x1: b0 is met first
    return durable(last.unionByName(inward(whole.where("x0 < x1"))).unionByName(turned(whole.where("x0 > x1"))))
