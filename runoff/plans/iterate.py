"""Fixpoints on DataFrames: durable rounds, dense numbering, pointer doubling and level-synchronous passes."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runoff.schema import NODE


def durable(df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir, its lineage cut; a temporary folder only where a local master names none.

    A checkpoint keeps the size that was estimated for its plan. Joins multiply estimates, so in a loop their digits
    double each round until planning is all that runs; the rows are therefore handed on without an estimate.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="runoff-checkpoint-"))
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(kept.sparkSession().internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def dense_index(df: DataFrame, *keys: str, name: str = "idx", within: str | None = None) -> DataFrame:
    """df with a gapless number from 0 in the order of unique keys, without a sort in one task.

    Ranges of the keys are sorted apart; only their row counts meet, in a table of one row for each range, or for each
    range and group where numbers start anew for each group of `within`, which comes before the keys in the order.
    """
    group, order = [within] if within else [], [within, *keys] if within else list(keys)
    ranges = durable(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranges.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(*group) if group else Window).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", *group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within_range = F.row_number().over(Window.partitionBy("_range", *group).orderBy(*keys)) - 1
    met = ranges.withColumn("_at", within_range).join(starts if group else F.broadcast(starts), ["_range", *group])
    return met.withColumn(name, (F.col("_start") + F.col("_at")).cast("long")).drop("_range", "_start", "_at")


def _bounded(state: DataFrame) -> Iterator[int]:
    """As many rounds as doubling needs on paths through all rows, then an error."""
    most = max(state.count(), 1).bit_length() + 2
    yield from range(most)
    raise ValueError("the flow runs in a circle or leads to nodes that it doesn't have")


#: Node numbers of a block, whose paths a task composes.
BLOCK = 1 << 16
#: Rows of what is left between blocks that a task gathers, and that are broadcast.
GATHERED = 1 << 17
#: Pointers of nodes that have no further node, and of those that run in a circle; others are node numbers.
ENDS, CIRCLES = -1, -2


def greatest(a: Any, b: Any) -> Any:
    """Of columns or of arrays."""
    return F.greatest(a, b) if isinstance(a, Column) else np.maximum(a, b)


def least(a: Any, b: Any) -> Any:
    """Of columns or of arrays."""
    return F.least(a, b) if isinstance(a, Column) else np.minimum(a, b)


Combine = Mapping[str, Callable[[Mapping[str, Any], Mapping[str, Any]], Any]]


def _inside(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's pointer leads in rows sorted by idx, ENDS where it leads out of them, and the pointers."""
    ids, p = part["idx"].to_numpy(), part["p"].to_numpy().copy()
    at = np.minimum(np.searchsorted(ids, p), len(ids) - 1)
    return np.where((p >= 0) & (ids[at] == p), at, ENDS), p


def _composed(part: pd.DataFrame, combine: Combine) -> pd.DataFrame:
    """Pointers and values composed until every pointer leads out of the rows, or ends."""
    part = part.sort_values("idx", ignore_index=True)
    q, p = _inside(part)
    data = {c: part[c].to_numpy().copy() for c in combine}
    for _ in range(len(part).bit_length() + 2):
        live = np.flatnonzero(q >= 0)
        if not len(live):
            break
        to = q[live]
        own, up = ({c: data[c][at] for c in combine} for at in (live, to))
        new = {c: f(own, up) for c, f in combine.items()}
        q[live], p[live] = q[to], p[to]
        for c in combine:
            data[c][live] = new[c]
    p[q >= 0] = CIRCLES
    return part[["grid_id", "idx"]].assign(p=p, **data)


def _summed(part: pd.DataFrame) -> pd.DataFrame:
    """Sums `s` of v over each row and what drains to it inside of the rows, and the pointer `away` that its path leaves by."""
    part = part.sort_values("idx", ignore_index=True)
    q, away = _inside(part)
    s, leaves = part["v"].to_numpy().astype(float), (q < 0) & (away >= 0)
    for _ in range(len(part).bit_length() + 2):
        live = np.flatnonzero(q >= 0)
        if not len(live):
            break
        to = q[live]
        s += np.bincount(to, s[live], len(s))
        q[live], away[live] = q[to], away[to]
    away[q >= 0] = CIRCLES
    return part[["grid_id", "idx", "p", "v"]].assign(away=away, s=s, leaves=leaves)


def by_block(rows: DataFrame, block: int | None, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work on the rows of each block of node numbers; on all rows of a surface, if block is None."""
    on = [F.col("grid_id")] if block is None else [F.col("grid_id"), F.expr(f"idx div {block}")]
    return rows.groupBy(*on).applyInPandas(lambda part: work(part), schema)


def few(rows: DataFrame, n: int) -> DataFrame:
    """Rows that n numbers at most, to be broadcast where that is little."""
    return F.broadcast(rows) if n <= GATHERED else rows


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _solved(state: DataFrame, combine: Combine, block: int | None, size: int) -> DataFrame:
    """state (grid_id, idx, p, values) with pointers followed to their ends; rows whose pointers have none are left out.

    A task composes the paths inside of a block. What is left are the nodes where paths enter blocks: they are solved in
    the same way, by a task where they are few, or by rounds of pointer doubling where blocks hardly shorten the paths.
    """
    inner = durable(by_block(state, block, lambda part: _composed(part, combine), _schema(state)))
    entries = durable(inner.where("p >= 0").select("grid_id", F.col("p").alias("idx")).distinct())
    n = 0 if block is None else entries.count()
    if not n:
        return inner.where(F.col("p") == ENDS)
    if n <= GATHERED or n <= size // 2:
        left = inner.join(few(entries, n), NODE, "left_semi").select(*inner.columns)
        left = durable(_solved(left, combine, None if n <= GATHERED else block * 16, n))
    else:
        left = _rounds(inner, combine)
    up = left.select("grid_id", F.col("idx").alias("p"), *[F.col(c).alias(f"{c}_up") for c in combine])
    met = inner.where("p >= 0").join(few(up, n), ["grid_id", "p"])
    own, above = {c: F.col(c) for c in combine}, {c: F.col(f"{c}_up") for c in combine}
    done = met.select(*NODE, F.lit(ENDS).cast("long").alias("p"), *[f(own, above).alias(c) for c, f in combine.items()])
    return inner.where(F.col("p") == ENDS).unionByName(done)


def _rounds(state: DataFrame, combine: Combine) -> DataFrame:
    """_solved by pointer doubling over all rows. Nodes whose pointer is known to end at a root join nothing more, so a
    root is met by its own donors only, however many nodes drain to it."""
    own, above, names = {c: F.col(c) for c in combine}, {c: F.col(f"{c}_up") for c in combine}, list(combine)

    def step(first: bool) -> DataFrame:
        up = state.where(F.col("p") != CIRCLES).select("grid_id", F.col("idx").alias("p"), F.col("p").alias("pp"), *[F.col(c).alias(f"{c}_up") for c in names])
        met = state.where("p >= 0").join(up, ["grid_id", "p"])
        new = {c: f(own, above) for c, f in combine.items()}
        if first:  # only what drains straight to a root moves on
            ended = F.col("pp") == ENDS
            moved = met.select(*NODE, F.when(ended, F.col("pp")).otherwise(F.col("p")).alias("p"), *[F.when(ended, new[c]).otherwise(F.col(c)).alias(c) for c in names])
        else:
            moved = met.select(*NODE, F.col("pp").alias("p"), *[new[c].alias(c) for c in names])
        return durable(state.where(F.col("p") == ENDS).unionByName(moved))

    state = step(True)
    for _ in _bounded(state):
        if not state.where("p >= 0").limit(1).count():
            break
        state = step(False)
    return state


def _pointers(flow: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    return flow.select("grid_id", F.col("src").alias("idx"), F.when(F.col("src") != F.col("rec"), F.col("rec")).otherwise(F.lit(ENDS)).cast("long").alias("p"), *more)


def doubled(flow: DataFrame, values: DataFrame | None, combine: Combine, size: int | None = None) -> DataFrame:
    """grid_id, idx and the values of each node combined with those of all nodes that it drains through, for a
    single-receiver flow (grid_id, src, rec): by blocks of node numbers, then over the nodes where paths enter a block.

    `combine` gives a value from a node's own values and those of the node that its pointer leads to, of columns as of
    arrays; it must be associative, and values no nulls. Without `values` (grid_id, idx, ...) the flow holds them.
    """
    names = list(combine)
    state = _pointers(flow).join(values.select(*NODE, *names), NODE) if values is not None else _pointers(flow, names)
    size = flow.count() if size is None else size
    done = durable(_solved(state, combine, BLOCK, size))
    if done.count() != size:
        raise ValueError("the flow runs in a circle or leads to nodes that it doesn't have")
    return done.drop("p")


#: Stands for a null where paths are composed.
_NULL = -(2**63)


def ancestors(flow: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """grid_id, idx, root, depth of a single-receiver flow, and each root's columns of `given` (grid_id, idx, ...), which
    are whole numbers or booleans."""
    own = flow.select("grid_id", F.col("src").alias("idx"), "rec", F.col("rec").alias("root"), (F.col("src") != F.col("rec")).cast("long").alias("depth"))
    kinds = {f.name: f.dataType for f in given.schema if f.name not in NODE} if given is not None else {}
    if given is not None:
        coded = given.select(*NODE, *[F.col(c).cast("long").alias(c) for c in kinds])
        own = own.join(coded, NODE, "left").select(*own.columns, *[F.coalesce(c, F.lit(_NULL)).alias(c) for c in kinds])
    combine: Combine = {"root": lambda a, b: b["root"], "depth": lambda a, b: a["depth"] + b["depth"]} | {c: lambda a, b, c=c: b[c] for c in kinds}
    done = doubled(own.withColumnRenamed("idx", "src"), None, combine)
    return done.select(*NODE, "root", "depth", *[F.when(F.col(c) != _NULL, F.col(c)).cast(t).alias(c) for c, t in kinds.items()])


def sum_downstream(flow: DataFrame, own: DataFrame, value: str) -> DataFrame:
    """grid_id, idx and value summed over each node and all that drains to it, for a single-receiver flow.

    A task adds up what drains inside of a block. What blocks send to each other is summed over the nodes where it
    enters, in the same way; a second pass adds it to the nodes below.
    """
    state = durable(_pointers(flow).join(own.select(*NODE, F.col(value).cast("double").alias("v")), NODE))
    return _drained(state, BLOCK, state.count()).select(*NODE, F.col("s").alias(value))


_SUMS = "grid_id long, idx long, p long, v double, away long, s double, leaves boolean"


def _drained(state: DataFrame, block: int | None, size: int) -> DataFrame:
    """grid_id, idx, s: v of state (grid_id, idx, p, v) summed over each row and all that drains to it."""
    inner = durable(by_block(state, block, _summed, _SUMS))
    sent = durable(inner.where("leaves").groupBy("grid_id", F.col("p").alias("idx")).agg(F.sum("s").alias("more")))
    n, circles = sent.count(), inner.where(F.col("away") == CIRCLES).limit(1).count()
    if circles or n and block is None:
        raise ValueError("the flow runs in a circle or leads to nodes that it doesn't have")
    if not n:
        return inner
    left = durable(inner.select(*NODE, "away").join(few(sent, n), NODE).select(*NODE, F.col("away").alias("p"), F.col("more").alias("v")))
    if left.count() != n:
        raise ValueError("the flow leads to nodes that it doesn't have")
    if n <= GATHERED or n <= size // 2:
        entered = durable(_drained(left, None if n <= GATHERED else block * 16, n))
    else:
        entered = _summed_rounds(left)
    more = entered.select(*NODE, F.col("s").alias("more"))
    met = inner.select(*NODE, "p", "v").join(few(more, n), NODE, "left").select(*NODE, "p", (F.col("v") + F.coalesce("more", F.lit(0.0))).alias("v"))
    return by_block(met, block, _summed, _SUMS)


def _summed_rounds(state: DataFrame) -> DataFrame:
    """_drained by pointer doubling over all rows: round k adds to a node what its ancestors' pointers at distance 2**k
    bring. A pointer that ends at a root is known to, and needs no lookup; rows without one go by keys of their own."""
    roots = state.where("p < 0").select("grid_id", F.col("idx").alias("p"), F.lit(True).alias("last"))
    state = durable(state.join(roots, ["grid_id", "p"], "left").select(*NODE, F.when(F.col("p") >= 0, F.col("p")).alias("p"), F.coalesce("last", F.lit(False)).alias("last"), "v"))
    for _ in _bounded(state):
        if not state.where("p is not null").limit(1).count():
            break
        pushed = state.where("p is not null").groupBy("grid_id", F.col("p").alias("idx")).agg(F.sum("v").alias("more"))
        up = state.select("grid_id", F.col("idx").alias("k"), F.col("p").alias("pp"), F.col("last").alias("end"))
        key = F.when(F.col("p").isNull() | F.col("last"), -1 - F.col("idx")).otherwise(F.col("p"))
        met = state.join(pushed, NODE, "left").withColumn("k", key).join(up, ["grid_id", "k"], "left")
        state = durable(met.select(*NODE, F.col("pp").alias("p"), F.coalesce("end", F.lit(True)).alias("last"), (F.col("v") + F.coalesce("more", F.lit(0.0))).alias("v")))
    return state.select(*NODE, F.col("v").alias("s"))


def levels(flow: DataFrame) -> DataFrame:
    """grid_id, idx, level: 0 for nodes that receive themselves, else one more than the highest receiver's.

    For any number of receivers; a round settles one level.
    """
    steps = durable(flow.where("src <> rec").select("grid_id", "src", "rec"))
    done = durable(flow.where("src = rec").select("grid_id", F.col("src").alias("idx"), F.lit(0).cast("long").alias("level")))
    needed = durable(steps.groupBy("grid_id", "src").agg(F.count(F.lit(1)).alias("need")))
    while needed.limit(1).count():
        met = steps.join(done.select("grid_id", F.col("idx").alias("rec"), "level"), ["grid_id", "rec"]).groupBy("grid_id", "src").agg(F.count(F.lit(1)).alias("met"), (F.max("level") + 1).alias("level"))
        ready = durable(needed.join(met, ["grid_id", "src"]).where("met = need").select("grid_id", F.col("src").alias("idx"), "level"))
        if not ready.limit(1).count():
            raise ValueError("the flow runs in a circle or leads to nodes that it doesn't have")
        needed = durable(needed.join(ready.select("grid_id", F.col("idx").alias("src")), ["grid_id", "src"], "left_anti"))
        done = durable(done.unionByName(ready))
    return done


#: Rounds whose shares are added up together.
FOLD = 32
#: Kinds of rows that a block makes: what reaches a node, what leaves the block, and edges below the nodes where flow enters.
_REACHED, _LEFT, _BELOW, _CIRCLE = 0, 1, 2, 3


def _pushed(edges: pd.DataFrame, moving: pd.DataFrame) -> pd.DataFrame:
    """What moves in a block, led down its edges: kind, idx, rec, v."""
    made = {k: [] for k in ("kind", "idx", "rec", "v")}

    def add(kind: int, idx: np.ndarray, rec: np.ndarray | None, v: np.ndarray) -> None:
        for k, x in zip(made, (np.full(len(idx), kind), idx, np.full(len(idx), -1) if rec is None else rec, v), strict=True):
            made[k].append(x)

    src, rec, weight, across = (edges[c].to_numpy(t) for c, t in (("src", np.int64), ("rec", np.int64), ("weight", float), ("across", bool)))
    ids = np.unique(np.concatenate([src, rec[~across], moving["idx"].to_numpy(np.int64)]))
    v, enters = np.zeros(len(ids)), np.zeros(len(ids), bool)
    at = np.searchsorted(ids, moving["idx"].to_numpy())
    np.add.at(v, at, moving["v"].to_numpy())
    enters[at[moving["enters"].to_numpy(bool)]] = True
    s, r = np.searchsorted(ids, src), np.where(across, -1, np.searchsorted(ids, rec))
    inner = np.flatnonzero(~across)
    wait = np.bincount(r[inner], minlength=len(ids))
    by_src = np.argsort(s, kind="stable")
    start = np.searchsorted(s[by_src], np.arange(len(ids) + 1))
    front, seen, below = np.flatnonzero(wait == 0), 0, np.zeros(len(src), bool)
    while len(front):  # a node moves on once all that drains to it has
        seen += len(front)
        counts = start[front + 1] - start[front]
        edge = by_src[np.repeat(start[front] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        below[edge] = enters[s[edge]]
        edge = edge[r[edge] >= 0]
        np.add.at(v, r[edge], v[s[edge]] * weight[edge])
        enters[r[edge][enters[s[edge]]]] = True
        np.subtract.at(wait, r[edge], 1)
        front = np.unique(r[edge][wait[r[edge]] == 0])
    if seen < len(ids):
        add(_CIRCLE, ids[:1], None, np.zeros(1))
    there = np.flatnonzero(v)
    add(_REACHED, ids[there], None, v[there])
    out = np.flatnonzero(across & (v[s] != 0))
    add(_LEFT, src[out], rec[out], v[s[out]] * weight[out])
    add(_BELOW, src[below], rec[below], weight[below])
    return pd.DataFrame({k: np.concatenate(x) for k, x in made.items()})


def sum_by_levels(flow: DataFrame, own: DataFrame, value: str) -> DataFrame:
    """As sum_downstream, for flow with weights to several receivers.

    A round leads what moves down to the borders of its block; rounds end with the path that crosses most borders. After
    the first, only the edges below nodes where flow enters a block take part.
    """
    of = lambda c: F.expr(f"{c} div {BLOCK}")
    edges = flow.where("src <> rec").select("grid_id", of("src").alias("block"), "src", "rec", "weight", (of("src") != of("rec")).alias("across"))
    start = own.select(*NODE, F.col(value).cast("double").alias("v"), F.lit(False).alias("enters"))
    entered = edges.where("across").select("grid_id", F.col("rec").alias("idx"), F.lit(0.0).alias("v"), F.lit(True).alias("enters")).distinct()
    moving, most, below, parts = start.unionByName(entered), None, None, []

    def work(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty:
            return pd.DataFrame({c: [] for c in ("grid_id", "kind", "idx", "rec", "v")})
        return _pushed(left, right).assign(grid_id=key[0])

    while True:
        here = moving.select(*[F.col(c).alias(c) for c in moving.columns], of("idx").alias("block"))  # columns of its own
        made = durable(edges.groupBy("grid_id", "block").cogroup(here.groupBy("grid_id", "block")).applyInPandas(work, "grid_id long, kind long, idx long, rec long, v double"))
        counts = {r["kind"]: r["n"] for r in made.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        if _CIRCLE in counts:
            raise ValueError("the flow runs in a circle")
        parts.append(made.where(F.col("kind") == _REACHED).select(*NODE, "v"))
        if _LEFT not in counts:
            break
        if below is None:
            below, most = made.where(F.col("kind") == _BELOW), counts.get(_REACHED, 0)
            edges = durable(below.select("grid_id", of("idx").alias("block"), F.col("idx").alias("src"), "rec", F.col("v").alias("weight"), (of("idx") != of("rec")).alias("across")))
        elif len(parts) > most + 1:
            raise ValueError("the flow runs in a circle")
        if len(parts) > FOLD:  # the first part is of all nodes
            parts = [parts[0], durable(reduce(DataFrame.unionByName, parts[1:]).groupBy(*NODE).agg(F.sum("v").alias("v")))]
        moving = made.where(F.col("kind") == _LEFT).groupBy("grid_id", F.col("rec").alias("idx")).agg(F.sum("v").alias("v")).withColumn("enters", F.lit(False))
    zero = start.select(*NODE, F.lit(0.0).alias("v"))
    return durable(reduce(DataFrame.unionByName, [zero, *parts]).groupBy(*NODE).agg(F.sum("v").alias(value)))
