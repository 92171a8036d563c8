"""The data model: a directed, weighted hypergraph as three DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "v bigint, size bigint"
EDGES = "e bigint, w double"
PINS = "e bigint, v bigint, is_src boolean"
PARTS = "v bigint, p bigint"
PLACEMENT = "v bigint, x int, y int"


@dataclass(frozen=True)
class HGraph:
    """nodes(v, size), edges(e, w), pins(e, v, is_src); a pin is one node in one role of one hyperedge.

    Ids are BIGINT and start at 0. Pins are distinct by (e, v) after ``structure.dedupe``.
    """

    nodes: DataFrame
    edges: DataFrame
    pins: DataFrame

    def with_pins(self, pins: DataFrame) -> HGraph:
        return replace(self, pins=pins)

    @staticmethod
    def of(spark: SparkSession, n_nodes: int, hedges: list[tuple[list[int], list[int], float]]) -> HGraph:
        """From (sources, destinations, weight) lists; for small graphs and tests."""
        pins = [(e, v, role) for e, (s, d, _) in enumerate(hedges) for role, vs in ((True, s), (False, d)) for v in vs]
        nodes = spark.range(n_nodes).select(F.col("id").alias("v"), F.lit(1).cast("bigint").alias("size"))
        return HGraph(nodes, spark.createDataFrame([(e, float(h[2])) for e, h in enumerate(hedges)], EDGES), spark.createDataFrame(pins, PINS))


class GraphError(ValueError):
    """An integrity rule does not hold."""


def broken_rules(graph: HGraph, require_source: bool = False) -> list[tuple[str, DataFrame]]:
    """Each rule that loaders rely on, with the rows that break it.

    Every hyperedge has a weight and a destination (and with ``require_source`` a source), every pin
    names a known node and hyperedge.
    """
    per_edge = graph.pins.groupBy("e").agg(F.sum((~F.col("is_src")).cast("long")).alias("d"), F.sum(F.col("is_src").cast("long")).alias("s"))
    checks = [
        ("hyperedges without a weight", per_edge.join(graph.edges, "e", "left_anti")),
        ("weights without a hyperedge", graph.edges.join(per_edge, "e", "left_anti")),
        ("hyperedges without a destination", per_edge.where("d = 0")),
        ("pins of unknown nodes", graph.pins.join(graph.nodes, "v", "left_anti")),
    ]
    return [*checks, ("hyperedges without a source", per_edge.where("s = 0"))] if require_source else checks


def violations(graph: HGraph, require_source: bool = False) -> DataFrame:
    """(rule, n): how many rows break each rule."""
    counts = [bad.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n") for rule, bad in broken_rules(graph, require_source)]
    return reduce(DataFrame.unionByName, counts)


def validate(graph: HGraph, require_source: bool = False) -> HGraph:
    """Raise where a rule does not hold; one pass over each table."""
    for rule, bad in broken_rules(graph, require_source):
        if row := bad.limit(1).collect():
            raise GraphError(f"{rule}, e.g. {row[0].asDict()}")
    return graph
