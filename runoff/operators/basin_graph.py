"""The graph of basins of whole surfaces, and sinks led over its spanning tree, as plans over all nodes.

Nothing here gathers a surface: the lowest passes are one aggregation, the spanning forest takes rounds of cheapest
edges, orientation is a ranked tour, routes are overrides of a few nodes, and filling is a running maximum along paths.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runoff.functions.ordinals import from_ordinal_column, ordinal_column
from runoff.operators import analytics
from runoff.plans import sheets
from runoff.plans.iterate import doubled, durable, greatest, sum_downstream
from runoff.schema import NODE


class BasinGraph:
    """Basins of a routed surface (grid_id, idx, z, masked, is_base) and the passes between them."""

    def __init__(self, grid, surface: DataFrame, flow: DataFrame) -> None:
        self.grid, self.surface, self.flow = grid, surface, flow
        self.sheets = sheets.of_flow(flow, surface)
        if self.sheets is None:
            self.known = durable(analytics.labelled(flow, surface))
        else:
            self._outlets, self._passes = sheets.basin_passes(grid, self.sheets)
        self._edges: DataFrame | None = None
        self._forest: tuple[DataFrame, DataFrame] | None = None

    def outlets(self) -> DataFrame:
        """grid_id, basin, outlet, outer."""
        if self.sheets is not None:
            return self._outlets
        return self.known.where("idx = outlet and basin is not null").select("grid_id", "basin", "outlet", "outer")

    def basins_count(self) -> DataFrame:
        """grid_id, n."""
        return self.outlets().groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"))

    def edges(self) -> DataFrame:
        if self._edges is None:
            made = analytics.linked(self._passes, self._outlets.where("outer").select("grid_id", "basin")) if self.sheets is not None else analytics.basin_edges(self.grid, self.surface, self.known)
            self._edges = durable(made)
        return self._edges

    def tree(self) -> DataFrame:
        """The edges of the minimum spanning forest."""
        return self._spanned()[0]

    def _spanned(self) -> tuple[DataFrame, DataFrame]:
        if self._forest is None:
            tree, names = analytics.spanning_forest(self.edges())
            self._forest = durable(tree), names
        return self._forest

    def oriented(self) -> DataFrame:
        """Each inner basin that can reach an outer one, and the pass that it leaves by: see analytics.orient."""
        tree, names = self._spanned()
        return analytics.orient(tree, names, self.outlets().where("outer").select("grid_id", F.col("basin").alias("b")))

    def routed(self, carve: bool) -> DataFrame:
        """Flow with every reachable pit led over its pass; `fill` raises the surface along it."""
        pits = self.outlets().select("grid_id", F.col("basin").alias("up"), F.col("outlet").alias("pit"))
        passes = durable(self.oriented().join(pits, ["grid_id", "up"]))
        over = passes.select("grid_id", F.col("inside").alias("src"), F.col("outside").alias("to"), F.col("pass_len").alias("d"))
        if carve:  # turn the path from the pass down to the pit around
            marks = self.surface.select(*NODE).join(passes.select("grid_id", F.col("inside").alias("idx"), F.lit(1.0).alias("m")), NODE, "left").select(*NODE, F.coalesce("m", F.lit(0.0)).alias("m"))
            path = sum_downstream(self.flow, marks, "m").where("m > 0").select("grid_id", F.col("idx").alias("src"))
            turned = self.flow.where("src <> rec").join(path, ["grid_id", "src"], "left_semi").select("grid_id", F.col("rec").alias("src"), F.col("src").alias("to"), F.col("distance").alias("d"))
            changed = turned.unionByName(over)
        else:
            far = F.lit(float(np.finfo(float).max))
            down = passes.where("z_in < z_out").select("grid_id", F.col("pit").alias("src"), F.col("outside").alias("to"), far.alias("d"))
            back = passes.where("z_in >= z_out and inside <> pit").select("grid_id", F.col("pit").alias("src"), F.col("inside").alias("to"), far.alias("d"))
            changed = down.unionByName(back).unionByName(passes.where("z_in >= z_out").select("grid_id", F.col("inside").alias("src"), F.col("outside").alias("to"), F.col("pass_len").alias("d")))
        if self.sheets is not None:
            return sheets.rerouted(self.sheets, self.surface, changed)
        met = self.flow.join(changed, ["grid_id", "src"], "left")
        return durable(met.select("grid_id", "src", "slot", F.coalesce("to", "rec").alias("rec"), F.coalesce("d", "distance").alias("distance"), "weight"))


def fill(surface: DataFrame, flow: DataFrame) -> DataFrame:
    """The surface with each node raised to lie at least the least step above its receiver.

    In ordinals a node is at the highest of (ordinal + steps to it) over itself and all that it drains through. Masked
    nodes drain nowhere and stay as they are.
    """
    kept = [c for c in surface.columns if c not in NODE]
    own = surface.where("not masked").withColumnRenamed("idx", "src").join(flow.select("grid_id", "src", "rec"), ["grid_id", "src"])
    own = durable(own.select("grid_id", "src", "rec", ordinal_column(F.col("z")).alias("m"), (F.col("src") != F.col("rec")).cast("long").alias("steps"), *kept))
    high = doubled(own, None, {"m": lambda a, b: greatest(a["m"], b["m"] + a["steps"]), "steps": lambda a, b: a["steps"] + b["steps"]} | {c: lambda a, b, c=c: a[c] for c in kept})
    z = F.when(F.col("m") > ordinal_column(F.col("z")), from_ordinal_column(F.col("m"))).otherwise(F.col("z"))
    rest = [c for c in kept if c != "z"]
    return durable(high.select(*NODE, z.alias("z"), *rest).unionByName(surface.where("masked").select(*NODE, "z", *rest)))
