"""Grading of a partitioning and a placement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hardware, metrics
from ..operators.hardware import Hardware
from ..operators.metrics import Constraints
from ..operators.ordering import feed_forward_order
from ..operators.structure import dedupe
from ..schema import HGraph


def grade(graph: HGraph, parts: DataFrame | None = None, limits: Constraints | None = None, placement: DataFrame | None = None, hw: Hardware | None = None, feed_forward: bool = False) -> dict[str, dict]:
    """{'partitioning': {...}, 'placement': {...}}; a placement is of the quotient if parts are given, else of the graph itself.

    With ``feed_forward`` the placement's rows are places in the feed-forward order, not node ids.
    """
    out: dict[str, dict] = {}
    graph = graph.with_pins(dedupe(graph.pins, 2))
    if parts is not None:
        row = metrics.cut_metrics(graph, parts).join(metrics.overlap_means(graph.pins, parts)).first()  # one row each
        out["partitioning"] = row.asDict() | (metrics.validity(graph, parts, limits).first().asDict() if limits else {})
        graph = metrics.quotient_graph(graph, parts, rule=2, squish=True)
        out["quotient"] = metrics.quotient_metrics(graph).first().asDict()
    if placement is not None:
        if feed_forward:
            placement = placement.withColumnRenamed("v", "idx").join(feed_forward_order(graph), "idx").select("v", "x", "y")
        check = hardware.placement_validity(placement, hw).first()
        unplaced = graph.nodes.join(placement, "v", "left_anti").limit(1).count()
        valid = bool(check.valid) and not unplaced
        out["placement"] = hardware.all_metrics(graph.pins, graph.edges.withColumn("w", F.col("w").cast("double")), placement, hw).first().asDict() if valid else {"valid": False}
    return out
