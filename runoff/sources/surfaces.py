"""Surfaces: synthetic ones on [-1, 1] squared, and those that the test tables are read as."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runoff.plans.iterate import dense_index, durable
from runoff.schema import NODE, NodeStatus, RasterConnect
from runoff.sources.grids import Grid, RasterBoundaryStatus, RasterGrid

KINDS = ("cone", "cone_inv", "cone_noise", "flat_noise", "gauss")
COLS = 50


def synthetic(grid: RasterGrid, kind: str, seed: int = 0) -> DataFrame:
    """grid_id, idx, z. Noise is a hash of seed and node, so it is the same on every run."""
    rows, cols = grid.shape
    x, y = F.col("col") * (2.0 / (cols - 1)) - 1, F.col("row") * (2.0 / (rows - 1)) - 1
    noise = F.pmod(F.xxhash64(F.lit(seed), *NODE), F.lit(1 << 52)) / float(1 << 52)
    cone = math.sqrt(2.0) - F.sqrt(x * x + y * y)
    z = {"cone": cone, "cone_inv": -cone, "cone_noise": cone + noise * 5 / rows, "flat_noise": noise, "gauss": F.exp(-(x * x + y * y) / 2)}[kind]
    return grid.nodes.select(*NODE, z.alias("z"))


def orders_raster(spark: SparkSession, sf_dir: str, connect: RasterConnect = RasterConnect.QUEEN, bounds: RasterBoundaryStatus | None = None, once: bool = False) -> tuple[Grid, DataFrame]:
    """A raster of COLS columns whose nodes are orders by key; z is whole: part of the price, and a slope down to row 0.
    Elevations that are read once only aren't kept."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ranked = dense_index(orders.select("o_orderkey", "o_totalprice"), "o_orderkey")
    rows = orders.count() // COLS
    z = F.floor("o_totalprice") % 1024 + 128 * F.floor(F.col("idx") / COLS)
    dem = ranked.where(F.col("idx") < rows * COLS).select(F.lit(0).cast("long").alias("grid_id"), "idx", z.cast("double").alias("z"))
    bounds = bounds or RasterBoundaryStatus(NodeStatus.CORE, NodeStatus.CORE, NodeStatus.FIXED_VALUE, NodeStatus.CORE)
    return RasterGrid(spark, (rows, COLS), (1.0, 1.0), bounds, connect=connect), dem if once else durable(dem)
