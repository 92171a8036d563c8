"""Random hypergraphs that scale a given one up."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.u32 import uniform
from ..schema import GraphError, HGraph
from ..tables import prefix_sums, stored


def scaled(graph: HGraph, factor: float, reuse: float = 0.2, seed: int = 86, most_rounds: int = 64) -> HGraph:
    """``ceil(factor * E)`` hyperedges: the given ones, then copies of random ones' sizes and weights.

    Each pin of a copy is a given node with probability ``reuse``, else one of the new ids. Repeated
    pins of a copy fall together; a copy that is left with fewer than two is drawn again, in a further
    round. All draws are hashes of (seed, round, ids).
    """
    spark = graph.nodes.sparkSession
    sizes = prefix_sums(graph.pins.groupBy("e").agg(F.count("*").cast("bigint").alias("n")).join(graph.edges, "e"), ["e"], {})
    sizes = stored(sizes.select(F.col("row").alias("k"), "n", "w"), "sizes")
    n_edges, n_nodes = sizes.count(), graph.nodes.count()
    extra, top = max(0, math.ceil(n_edges * factor) - n_edges), max(n_nodes, math.ceil(n_nodes * factor))
    missing = spark.range(extra).select((F.col("id") + n_edges).alias("e"))
    w_type = sizes.schema["w"].dataType
    made = spark.createDataFrame([], "e bigint, v bigint").withColumn("w", F.lit(None).cast(w_type))
    for r in range(most_rounds):
        draw = lambda what, *ids, r=r: uniform(seed, what, r, *ids)
        e, i = F.col("e"), F.col("i")
        copies = missing.select("e", F.floor(draw("edge", e) * n_edges).cast("bigint").alias("k")).join(sizes, "k")
        drawn = copies.select("e", "w", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("i"))
        old = F.floor(draw("old", e, i) * n_nodes)
        new = n_nodes + F.floor(draw("new", e, i) * max(top - n_nodes, 1))
        pick = old if top == n_nodes else F.when(draw("pick", e, i) < reuse, old).otherwise(new)
        pins = stored(drawn.select("e", pick.cast("bigint").alias("v"), "w").distinct(), "drawn")
        enough = pins.groupBy("e").agg(F.count("*").alias("n")).where("n > 1").select("e")
        made = made.unionByName(pins.join(enough, "e", "left_semi"))
        missing = stored(missing.join(enough, "e", "left_anti"), "missing")
        if not missing.limit(1).count():
            break
    else:
        raise GraphError("copies of one pin only: no given hyperedge has two pins, or there is but one node")
    made = stored(made, "copies")
    ids = prefix_sums(graph.edges, ["e"], {}).select("e", F.col("row").alias("k"))
    given = graph.pins.join(ids, "e").select(F.col("k").alias("e"), "v", "is_src")
    nodes = spark.range(top).select(F.col("id").alias("v"), F.lit(1).cast("bigint").alias("size"))
    edges = graph.edges.join(ids, "e").select(F.col("k").alias("e"), "w").unionByName(made.groupBy("e").agg(F.first("w").alias("w")))
    return HGraph(nodes, edges, given.unionByName(made.select("e", "v", F.lit(False).alias("is_src"))))
