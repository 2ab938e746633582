"""Landscape evolution: uplift, routing, incision and diffusion, step after step, each step's surface durable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runoff.plans.graph import DiffusionADIEroder, FlowGraph, SPLEroder
from runoff.plans.iterate import durable
from runoff.schema import NODE, NodeStatus


def simulate(graph: FlowGraph, elevation: DataFrame, steps: int, dt: float, uplift: float, spl: SPLEroder | None = None, diffusion: DiffusionADIEroder | None = None) -> DataFrame:
    """grid_id, idx, z after the steps. Fixed-value nodes aren't lifted."""
    lift = graph.grid.nodes.select(*NODE, F.when(F.col("status") == int(NodeStatus.FIXED_VALUE), 0.0).otherwise(uplift * dt).alias("u"))
    z = durable(elevation.select(*NODE, F.col("z").cast("double").alias("z")))
    for _ in range(steps):
        raised = durable(z.join(lift, NODE).select(*NODE, (F.col("z") + F.col("u")).alias("z")))
        routed = graph.update_routes(raised)
        now = raised
        if spl is not None:
            e = spl.erode(routed, graph.accumulate(1.0), dt)
            now = now.join(e, NODE).select(*NODE, (F.col("z") - F.col("erosion")).alias("z"))
        if diffusion is not None:
            e = diffusion.erode(routed, dt)
            now = now.join(e, NODE).select(*NODE, (F.col("z") - F.col("erosion")).alias("z"))
        z = durable(now)
    return z
