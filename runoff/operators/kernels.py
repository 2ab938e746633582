"""User functions along the flow graph: one call a node, in the order that a direction asks for."""

from __future__ import annotations

import inspect
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Mapping, Sequence
from numbers import Real
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runoff.operators import grouped
from runoff.plans import iterate
from runoff.plans.graph import FlowGraph
from runoff.plans.iterate import ancestors, durable
from runoff.schema import NODE, FlowGraphTraversalDir

_RESERVED = {"receivers", "donors", "count", "distance", "weight", "idx", "grid_id"}
#: What a spec may ask for: a number for all nodes, or a column.
SCALAR, COLUMN = "scalar", "column"


class _Side:
    """A node's receivers or donors: count, distance and weight, and every variable as an array that can be written to."""

    def __init__(self, data: dict[str, Any], ids: np.ndarray, distance: np.ndarray | None, weight: np.ndarray | None, outputs: frozenset[str]) -> None:
        self.__dict__.update(_data=data, _ids=ids, count=len(ids), distance=distance, weight=weight, _outputs=outputs)

    def __getattr__(self, name: str) -> np.ndarray:
        return self._data[name][self._ids]

    def __setattr__(self, name: str, value: Any) -> None:
        if name not in self._outputs:
            raise AttributeError(f"{name} is no output that can be written here")
        self._data[name][self._ids] = value


class _Node:
    def __init__(self, data: dict[str, Any], i: int, receivers: _Side, donors: _Side, outputs: frozenset[str]) -> None:
        self.__dict__.update(_data=data, _i=i, receivers=receivers, donors=donors, _outputs=outputs)

    def __getattr__(self, name: str) -> Any:
        value = self._data[name]
        return value[self._i] if isinstance(value, np.ndarray) else value

    def __setattr__(self, name: str, value: Any) -> None:
        if name not in self._outputs:
            raise AttributeError(f"{name} is no output")
        self._data[name][self._i] = value


class FlowKernelData(Mapping):
    """What a kernel reads and writes, by the names of its spec; None where nothing is bound yet."""

    def __init__(self, graph: FlowGraph, spec: Mapping[str, str]) -> None:
        self.__dict__.update(_graph=graph, _spec=dict(spec), _bound={})

    def __getitem__(self, name: str) -> Any:
        return self._bound.get(name)

    def __getattr__(self, name: str) -> Any:
        return self.__dict__["_bound"].get(name)

    def __iter__(self) -> Iterator[str]:
        return iter(self._spec)

    def __len__(self) -> int:
        return len(self._spec)

    @property
    def var_names(self) -> tuple[str, ...]:
        return tuple(self._spec)

    @property
    def grid_var_names(self) -> tuple[str, ...]:
        return tuple(k for k, v in self._spec.items() if v == COLUMN)

    def bind(self, **values: Any) -> None:
        """Scalars are numbers. A column is a number for all nodes, a table (grid_id, idx, value), or an array of one
        value for each node, flat or of the grid's shape, which holds for every surface."""
        for name, value in values.items():
            if name not in self._spec:
                raise KeyError(f"unknown: {name}")
            if self._spec[name] == SCALAR:
                if not isinstance(value, Real):
                    raise TypeError(f"{name} must be a number")
            elif isinstance(value, np.ndarray):
                if value.shape not in ((self._graph.size,), tuple(self._graph.grid_shape)):
                    raise ValueError(f"{name} must have {self._graph.size} values, one for each node")
                value = value.ravel()
            elif not isinstance(value, Real) and not isinstance(value, DataFrame):
                raise TypeError(f"{name} must be a number, an array or a table")
            self._bound[name] = value

    def check_bindings(self) -> None:
        if unbound := [k for k in self._spec if k not in self._bound]:
            raise ValueError(f"not bound: {unbound}")

    def columns(self) -> DataFrame:
        """grid_id, idx and a column for each grid variable."""
        rows = self._graph.grid.nodes.select(*NODE)
        for name in self.grid_var_names:
            value = self._bound[name]
            if isinstance(value, Real):
                rows = rows.withColumn(name, F.lit(float(value)))
            else:
                on = NODE
                if isinstance(value, np.ndarray):
                    on, value = ["idx"], rows.sparkSession.createDataFrame(pd.DataFrame({"idx": np.arange(len(value)), "value": value.astype(float)}))
                rows = rows.join(value.select(*on, F.col("value").cast("double").alias(name)), on)
        return rows.select(*NODE, *self.grid_var_names)


class FlowKernel:
    def __init__(self, graph: FlowGraph, func: Callable[[Any], Any], spec: Mapping[str, str], apply_dir: FlowGraphTraversalDir, outputs: Sequence[str], n_threads: int = 1) -> None:
        if not outputs:
            raise ValueError("a kernel needs an output")
        if missing := set(outputs) - set(spec):
            raise ValueError(f"outputs without a spec: {sorted(missing)}")
        if reserved := _RESERVED & set(spec):
            raise ValueError(f"reserved names: {sorted(reserved)}")
        if scalars := [o for o in outputs if spec[o] == SCALAR]:
            raise TypeError(f"outputs must be columns: {scalars}")
        if bad := [k for k, v in spec.items() if v not in (SCALAR, COLUMN)]:
            raise TypeError(f"neither scalar nor column: {bad}")
        if len(inspect.signature(func).parameters) != 1:
            raise TypeError("a kernel takes one argument, the node")
        if n_threads > 1 and apply_dir not in (FlowGraphTraversalDir.ANY, FlowGraphTraversalDir.BREADTH_UPSTREAM):
            raise ValueError("only ANY and BREADTH_UPSTREAM go level by level")
        self.graph, self.func, self.spec, self.apply_dir, self.outputs, self.n_threads = graph, func, dict(spec), apply_dir, tuple(outputs), n_threads

    def run(self, data: FlowKernelData) -> DataFrame:
        """Applies the kernel to bound data; the outputs are bound anew."""
        data.check_bindings()
        scalars, columns = {k: data[k] for k, v in self.spec.items() if v == SCALAR}, data.columns()
        if self.n_threads == 1:
            done = durable(self.apply(scalars, columns))
        elif self.apply_dir == FlowGraphTraversalDir.ANY or (bundles := self._bundles()) is None:
            done = durable(self.apply_by_levels(scalars, columns))
        else:  # in a basin a level's nodes are no neighbours, so one after the other is as side by side
            done = durable(self._by_bundle(scalars, columns, bundles, frozenset()))
        data.bind(**{o: done.select(*NODE, F.col(o).alias("value")) for o in self.outputs})
        return done

    def apply_by_levels(self, scalars: Mapping[str, float], columns: DataFrame) -> DataFrame:
        """As apply, with all nodes of a level side by side in as many tasks as there are: a level's nodes read what the
        levels before have made of their receivers. A node writes its own outputs, never its receivers' or donors'."""
        need = [k for k, v in self.spec.items() if v == COLUMN]
        func, outputs, values = self.func, self.outputs, {k: v for k, v in scalars.items() if self.spec.get(k) == SCALAR}
        flow = self.graph.flow
        order = self.graph.bfs_levels() if self.apply_dir == FlowGraphTraversalDir.BREADTH_UPSTREAM else columns.select(*NODE, F.lit(0).cast("long").alias("level"))
        state = durable(columns.select(*NODE, *need).join(order, NODE))
        last = state.agg(F.max("level")).first()[0]

        def side(here: DataFrame, own: str, other: str, name: str) -> DataFrame:
            there = state.select("grid_id", F.col("idx").alias(other), *need)
            met = flow.where("src <> rec" if own == "rec" else "true").join(here.select("grid_id", F.col("idx").alias(own)), ["grid_id", own]).join(there, ["grid_id", other])
            each = F.struct(F.col("slot" if own == "src" else "src").cast("long").alias("by"), "distance", "weight", *need)
            return met.groupBy("grid_id", F.col(own).alias("idx")).agg(F.sort_array(F.collect_list(each)).alias(name))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                out: dict[str, list] = {k: [] for k in need}
                for r in rows.to_dict("records"):
                    recs, dons = (r[s] if r[s] is not None else [] for s in ("recs", "dons"))
                    data = {k: np.array([r[k], *[x[k] for x in recs], *[x[k] for x in dons]], float) for k in need} | values
                    ids = np.arange(1, 1 + len(recs) + len(dons))
                    to = _Side(data, ids[: len(recs)], *(np.array([x[c] for x in recs], float) for c in ("distance", "weight")), frozenset())
                    func(_Node(data, 0, to, _Side(data, ids[len(recs) :], None, None, frozenset()), frozenset(outputs)))
                    for k in need:
                        out[k].append(data[k][0])
                yield rows[["grid_id", "idx", "level"]].assign(**out)

        for level in range((last if last is not None else -1) + 1):
            here = state.where(F.col("level") == level)
            full = here.join(side(here, "src", "rec", "recs"), NODE, "left").join(side(here, "rec", "src", "dons"), NODE, "left")
            new = full.mapInPandas(work, "grid_id long, idx long, level long, " + ", ".join(f"{k} double" for k in need))
            state = durable(state.where(F.col("level") != level).unionByName(new))
        return state.select(*NODE, *outputs)

    def apply(self, scalars: Mapping[str, float], columns: DataFrame) -> DataFrame:
        """The outputs for every node. columns: grid_id, idx and the spec's columns, outputs holding their first values."""
        unbound = [k for k, v in self.spec.items() if (k not in scalars if v == SCALAR else k not in columns.columns)]
        if unbound:
            raise ValueError(f"not bound: {unbound}")
        need = [k for k, v in self.spec.items() if v == COLUMN]
        bundles = self._bundles() if self.graph.grid.size > iterate.BLOCK else None
        if bundles is not None:
            return self._by_bundle(scalars, columns, bundles, frozenset(self.outputs))
        return grouped.per_grid(columns.select(*NODE, *need), self.graph.flow, self._work(scalars, frozenset(self.outputs)), self._schema())

    def _schema(self) -> str:
        return "grid_id long, idx long, " + ", ".join(f"{k} double" for k in self.outputs)

    def _bundles(self) -> DataFrame | None:
        """grid_id, idx, bundle: each node of single flow by the block of its outlet's number, if no bundle is larger than a
        task may gather. A node meets its receivers and donors only, so basins know nothing of each other."""
        if not self.graph.single_flow:
            return None
        bundles = durable(ancestors(self.graph.flow).select(*NODE, F.expr(f"root div {iterate.BLOCK}").alias("bundle")))
        most = bundles.groupBy("grid_id", "bundle").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        return bundles if most is None or most <= grouped.LOCAL_NODES else None

    def _by_bundle(self, scalars: Mapping[str, float], columns: DataFrame, bundles: DataFrame, beside: frozenset[str]) -> DataFrame:
        """The kernel on the basins of a bundle in a task; node numbers are made dense there, in their order."""
        need, work = [k for k, v in self.spec.items() if v == COLUMN], self._work(scalars, beside)
        flow = self.graph.flow.select("grid_id", F.col("src").alias("idx"), "rec", "distance", "weight")
        rows = columns.select(*NODE, *need).join(flow, NODE).join(bundles, NODE)

        def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("idx", ignore_index=True)
            ids = part["idx"].to_numpy()
            local = pd.DataFrame({"src": np.arange(len(ids)), "rec": np.searchsorted(ids, part["rec"].to_numpy()), "distance": part["distance"], "weight": part["weight"]})
            return work(part, local).assign(grid_id=key[0])[names]

        names = [*NODE, *self.outputs]
        return rows.groupBy("grid_id", "bundle").applyInPandas(run, self._schema())

    def _work(self, scalars: Mapping[str, float], beside: frozenset[str]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        """The kernel on nodes sorted by number and their flow; `beside`: what may be written to receivers and donors."""
        func, spec, outputs, direction = self.func, self.spec, self.outputs, self.apply_dir
        values = {k: v for k, v in scalars.items() if k in spec}

        def work(nodes: pd.DataFrame, flow: pd.DataFrame) -> pd.DataFrame:
            n = len(nodes)
            data: dict[str, Any] = {k: nodes[k].to_numpy(float).copy() for k, v in spec.items() if v == COLUMN} | values
            to = grouped.Adjacency(n, flow, "rec")
            real = np.flatnonzero(to.src != to.to)
            by_rec = real[np.argsort(to.to[real], kind="stable")]
            start = np.searchsorted(to.to[by_rec], np.arange(n + 1))
            weight = flow["weight"].to_numpy()
            if direction == FlowGraphTraversalDir.ANY:
                order = list(range(n))
            elif direction in (FlowGraphTraversalDir.DEPTH_DOWNSTREAM, FlowGraphTraversalDir.DEPTH_UPSTREAM):
                order = grouped.depth_order(n, to.src, to.to)
            else:
                order = np.argsort(grouped.node_levels(n, to.src, to.to), kind="stable").tolist()
            if direction in (FlowGraphTraversalDir.DEPTH_DOWNSTREAM, FlowGraphTraversalDir.BREADTH_DOWNSTREAM):
                order = order[::-1]
            wanted = frozenset(outputs)
            for i in order:
                s = slice(to.start[i], to.start[i + 1])
                donors = to.src[by_rec[start[i] : start[i + 1]]]
                func(_Node(data, i, _Side(data, to.to[s], to.distance[s], weight[s], beside), _Side(data, donors, None, None, beside), wanted))
            return nodes[["idx"]].assign(**{k: data[k] for k in outputs})

        return work


def create_flow_kernel(graph: FlowGraph, func: Callable[[Any], Any], spec: Mapping[str, Any], *, apply_dir: FlowGraphTraversalDir = FlowGraphTraversalDir.DEPTH_UPSTREAM, outputs: Sequence[str] = (), n_threads: int = 1) -> tuple[FlowKernel, FlowKernelData]:
    """A kernel and its data. A spec names SCALAR or COLUMN for each variable, or one of them with a first value.

    More than one thread means level by level, side by side; how many nodes run at a time is up to the cluster.
    """
    kinds = {k: v[0] if isinstance(v, tuple) else v for k, v in spec.items()}
    kernel, data = FlowKernel(graph, func, kinds, apply_dir, outputs, n_threads), FlowKernelData(graph, kinds)
    data.bind(**{k: v[1] for k, v in spec.items() if isinstance(v, tuple)})
    return kernel, data


class FlowKernelEroder(ABC):
    """An eroder whose law is a kernel; the kernel writes `erosion`."""

    def __init__(self, graph: FlowGraph) -> None:
        spec = {k: SCALAR for k in self.param_spec()} | {k: COLUMN for k in self.input_spec()} | {"erosion": COLUMN}
        self.kernel, _ = create_flow_kernel(graph, type(self).eroder_kernel, spec, apply_dir=self.kernel_apply_dir(), outputs=["erosion"])

    @staticmethod
    @abstractmethod
    def param_spec() -> Sequence[str]: ...

    @staticmethod
    @abstractmethod
    def input_spec() -> Sequence[str]: ...

    @staticmethod
    @abstractmethod
    def kernel_apply_dir() -> FlowGraphTraversalDir: ...

    @staticmethod
    @abstractmethod
    def eroder_kernel(node: Any) -> None: ...

    def erode(self, **inputs: Any) -> DataFrame:
        """grid_id, idx, erosion. A parameter is a number, an input a DataFrame (grid_id, idx, value)."""
        wanted = {*self.param_spec(), *self.input_spec()}
        if missing := wanted - set(inputs):
            raise KeyError(f"missing: {sorted(missing)}")
        if extra := set(inputs) - wanted:
            raise ValueError(f"unknown: {sorted(extra)}")
        rows = self.kernel.graph.grid.nodes.select(*NODE, F.lit(0.0).alias("erosion"))
        for k in self.input_spec():
            rows = rows.join(inputs[k].select(*NODE, F.col("value").alias(k)), NODE)
        return durable(self.kernel.apply({k: inputs[k] for k in self.param_spec()}, rows))
