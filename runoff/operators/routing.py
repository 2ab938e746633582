"""Routers: which neighbours a node drains to. A surface is (grid_id, idx, z, masked, is_base)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runoff.operators import grouped
from runoff.plans import iterate
from runoff.schema import NODE
from runoff.sources.grids import Grid, Steps

#: A slope must exceed the smallest normal double.
LEAST_SLOPE = 2.2250738585072014e-308


def _lower(grid: Grid, surface: DataFrame) -> DataFrame:
    """grid_id, idx and low: (slope, slot, dst, distance) of the lower unmasked neighbours of each node that may drain."""
    near = grid.around(surface, ["z"], ["masked", "is_base"], ~F.col("masked"))
    steps = F.filter("near", lambda x: x["z"] < F.col("z"))
    low = F.transform(steps, lambda x: F.struct(((F.col("z") - x["z"]) / x["distance"]).alias("slope"), x["slot"].alias("slot"), x["dst"].alias("dst"), x["distance"].alias("distance")))
    return near.select(*NODE, F.when(F.col("masked") | F.col("is_base"), F.slice(low, 1, 0)).otherwise(low).alias("low"))


def _steepest(part: pd.DataFrame, own: slice, steps: Steps) -> pd.DataFrame:
    """single_flow of the slice of sorted rows."""
    ids, z, masked, base = (part[c].to_numpy(t) for c, t in (("idx", np.int64), ("z", float), ("masked", bool), ("is_base", bool)))
    here, may = z[own], ~masked[own] & ~base[own]
    rec, distance, best = ids[own].copy(), np.zeros(len(here)), np.full(len(here), LEAST_SLOPE)
    for k, at in steps.seen(ids, own):
        lower = np.flatnonzero(may & (at >= 0) & ~masked[at] & (z[at] < here))
        slope = (here[lower] - z[at[lower]]) / steps.lengths[k]
        steeper = slope > best[lower]
        lower = lower[steeper]
        best[lower], rec[lower], distance[lower] = slope[steeper], ids[at[lower]], steps.lengths[k]
    return pd.DataFrame({"src": ids[own], "rec": rec, "distance": distance})


def single_flow(grid: Grid, surface: DataFrame) -> DataFrame:
    """Steepest descent, the first slot of equals; one row for each node, itself where nothing is lower.

    Large regular grids go block by block on arrays: an exchange of rows, and no columns for each slot.
    """
    if grid.size > grouped.LOCAL_NODES and hasattr(grid, "by_seen_block"):
        found = grid.by_seen_block(surface.select(*NODE, "z", "masked", "is_base"), iterate.BLOCK, _steepest, "grid_id long, src long, rec long, distance double")
        return found.select("grid_id", "src", F.lit(0).alias("slot"), "rec", "distance", F.lit(1.0).alias("weight"))
    steep = F.filter("low", lambda x: x["slope"] > LEAST_SLOPE)
    best = F.array_max(F.transform(steep, lambda x: F.struct(x["slope"].alias("slope"), (-x["slot"]).alias("s"), x["dst"].alias("dst"), x["distance"].alias("distance"))))
    found = _lower(grid, surface).select(*NODE, best.alias("b"))
    return found.select("grid_id", F.col("idx").alias("src"), F.lit(0).alias("slot"), F.coalesce("b.dst", "idx").alias("rec"), F.coalesce("b.distance", F.lit(0.0)).alias("distance"), F.lit(1.0).alias("weight"))


def multi_flow(grid: Grid, surface: DataFrame, slope_exp: float = 1.0) -> DataFrame:
    """All lower neighbours, weighted by slope**slope_exp; itself with weight 0 where nothing is lower."""
    power = lambda x: F.pow(x["slope"], F.lit(float(slope_exp)))
    total = F.aggregate("low", F.lit(0.0), lambda a, x: a + power(x))
    some = F.transform("low", lambda x: F.struct(x["dst"].alias("rec"), x["distance"].alias("distance"), (power(x) / F.col("total")).alias("weight")))
    none = F.array(F.struct(F.col("idx").alias("rec"), F.lit(0.0).alias("distance"), F.lit(0.0).alias("weight")))
    found = _lower(grid, surface).withColumn("total", total).select("grid_id", F.col("idx").alias("src"), F.posexplode(F.when(F.size("low") > 0, some).otherwise(none)).alias("slot", "r"))
    return found.select("grid_id", "src", "slot", "r.rec", "r.distance", "r.weight")
