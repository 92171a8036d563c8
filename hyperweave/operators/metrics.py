"""Quality and validity of partitionings, and the quotient hypergraph."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import GraphError, HGraph
from ..tables import BLOCK, observed, prefix_sums, run_starts, stored


@dataclass(frozen=True)
class Constraints:
    """Most nodes and most distinct inbound hyperedges of a part, and most parts."""

    nodes_per_part: int
    inbound_per_part: int
    max_parts: int
    name: str = "manual"

    def __post_init__(self):
        if min(self.nodes_per_part, self.inbound_per_part, self.max_parts) <= 0:
            raise GraphError("constraints must be positive")

    @staticmethod
    def kway(n_nodes: int, k: int, eps: float) -> Constraints:
        """Balanced parts: ceil((1 + eps) n / k) nodes each, inbound unbounded."""
        return Constraints(math.ceil((1 + eps) * n_nodes / k), 2**31 - 1, k, f"{k}-way")


# Nodes per part, inbound hyperedges per part, parts.
PRESETS = {
    "loihi64": Constraints(1024, 4096, 4096, "loihi64"),
    "loihi84": Constraints(4096, 65536, 7056, "loihi84"),
    "loihi1024": Constraints(4096, 65536, 1048576, "loihi1024"),
    "truenorth": Constraints(256, 256, 4096, "truenorth"),
}


def preset(name: str) -> Constraints:
    if name not in PRESETS:
        raise GraphError(f"unknown constraints {name!r}; known: {', '.join(PRESETS)}")
    return PRESETS[name]


def spread(pins: DataFrame, parts: DataFrame) -> DataFrame:
    """(e, lambda_, n_pins): distinct parts and pins of each hyperedge. Partial aggregation by (e, p) first."""
    per_part = pins.join(parts, "v").groupBy("e", "p").agg(F.count("*").alias("n"))
    return per_part.groupBy("e").agg(F.count("*").alias("lambda_"), F.sum("n").alias("n_pins"))


def cut_metrics(graph: HGraph, parts: DataFrame) -> DataFrame:
    """One row: connectivity = sum w(l-1), cut_net = sum w[l>1], soed = sum w(l-1)#e over all pins."""
    cut = spread(graph.pins, parts).join(graph.edges, "e")
    w, over = F.col("w"), F.col("lambda_") - 1
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return cut.agg(total(w * over, "connectivity"), total(F.when(over > 0, w).otherwise(F.lit(0) * w), "cut_net"), total(w * over * F.col("n_pins"), "soed"))


def quotient_metrics(quotient: HGraph) -> DataFrame:
    """The same from a quotient graph, whose pins are parts; here soed = sum w #e."""
    sizes = quotient.pins.groupBy("e").agg(F.count("*").alias("n"))
    w, n = F.col("w"), F.col("n")
    return sizes.join(quotient.edges, "e").agg(F.sum(w * (n - 1)).alias("connectivity"), F.sum(F.when(n > 1, w)).alias("cut_net"), F.sum(w * n).alias("soed"))


def reuse(pins: DataFrame, parts: DataFrame) -> DataFrame:
    """(p, pins, hedges): destination pins of each part and distinct hyperedges with one there."""
    dst = pins.where("NOT is_src").join(parts, "v").groupBy("e", "p").agg(F.count("*").alias("n"))
    return dst.groupBy("p").agg(F.sum("n").alias("pins"), F.count("*").alias("hedges"))


def overlap_means(pins: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: mean and geometric mean of pins / hedges over parts 0..max; parts without a pin count as 0 in the divisor only."""
    ratio = F.col("pins") / F.col("hedges")
    sums = reuse(pins, parts).agg(F.coalesce(F.sum(ratio), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.log(ratio)), F.lit(0.0)).alias("l"))
    n = parts.agg((F.max("p") + 1).alias("n"))
    return sums.join(n).select((F.col("s") / F.col("n")).alias("ar_mean"), F.exp(F.col("l") / F.col("n")).alias("geo_mean"))  # one row each


def loads(graph: HGraph, parts: DataFrame) -> DataFrame:
    """(p, size, inbound): node sizes and distinct inbound hyperedges of each part."""
    sizes = graph.nodes.join(parts, "v").groupBy("p").agg(F.sum("size").alias("size"))
    inbound = graph.pins.where("NOT is_src").join(parts, "v").select("e", "p").distinct().groupBy("p").agg(F.count("*").alias("inbound"))
    return sizes.join(inbound, "p", "left").select("p", "size", F.coalesce("inbound", F.lit(0)).alias("inbound"))


def validity(graph: HGraph, parts: DataFrame, limits: Constraints) -> DataFrame:
    """One row: n_parts, contiguous, max_size, max_inbound, valid."""
    row = loads(graph, parts).agg(F.count("*").alias("n_parts"), F.coalesce(F.max("p") + 1, F.lit(0)).alias("top"), F.coalesce(F.max("size"), F.lit(0)).alias("max_size"), F.coalesce(F.max("inbound"), F.lit(0)).alias("max_inbound"))
    contiguous = F.col("top") == F.col("n_parts")
    valid = contiguous & (F.col("n_parts") <= limits.max_parts) & (F.col("max_size") <= limits.nodes_per_part) & (F.col("max_inbound") <= limits.inbound_per_part)
    return row.select("n_parts", contiguous.alias("contiguous"), "max_size", "max_inbound", valid.alias("valid"))


def fit(graph: HGraph, limits: Constraints, already_partitioned: bool = False, greedy: bool = True) -> DataFrame:
    """One row: n_nodes, max_inbound, n_sequential, fits.

    The graph fits if the parts can hold all nodes, no node alone breaks the inbound limit, and taking
    nodes in id order needs at most max_parts parts (n_sequential; null where a node alone is too much).
    A graph that is a quotient already needs a part for each node. Without ``greedy`` the last check is left out.
    """
    inbound = graph.pins.where("NOT is_src").groupBy("v").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_inbound"))
    row = graph.nodes.agg(F.count("*").alias("n_nodes")).join(inbound)  # one row each
    if not greedy:
        needed = graph.nodes.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("n_sequential"))
    elif already_partitioned:
        needed = graph.nodes.agg(F.count("*").alias("n_sequential"))
    else:
        needed = sequential_parts(graph, Constraints(limits.nodes_per_part, limits.inbound_per_part, 2**31 - 1)).agg((F.coalesce(F.max("p") + 1, F.lit(0))).alias("n_sequential"))
    row = row.join(needed)
    most = limits.max_parts * (1 if already_partitioned else limits.nodes_per_part)
    light = F.col("max_inbound") <= limits.inbound_per_part
    fits = (F.col("n_nodes") <= most) & light & (F.col("n_sequential") <= limits.max_parts)
    return row.select("n_nodes", "max_inbound", F.when(light, F.col("n_sequential")).alias("n_sequential"), fits.alias("fits"))


def window_ends(batches, most_nodes: int, most_hedges: int, chunk: int):
    """Rows (row, to) for each row of a chunk: the first row that no longer fits a window that starts here; rows that see no end have none.

    Batches of (part, row, before, after), by (part, row): a chunk's rows and those that its last windows reach. before and
    after: for each inbound hyperedge the row where it occurred last and where it will next. One count slides along: a hyperedge
    counts where its last occurrence lies before the window's start.
    """
    part, window, count = None, deque(), 0
    for batch in batches:
        rows, to = [], []
        for p, r, before, after in zip(*(batch.column(c).to_pylist() for c in ("part", "row", "before", "after"))):
            if p != part:
                part, window, count = p, deque(), 0
            start = window[0][0] if window else r
            count += sum(b < start for b in before)
            window.append((r, after))
            while len(window) > 1 and (len(window) > most_nodes or count > most_hedges):
                first, nexts = window.popleft()
                count -= sum(a > r for a in nexts)
                if first // chunk == p:
                    rows.append(first)
                    to.append(r)
        yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(to, pa.int64())], ["row", "to"])


def sequential_parts(graph: HGraph, limits: Constraints, chunk: int = BLOCK) -> DataFrame:
    """parts(v, p) by taking nodes in id order and starting a part where a limit would break. Raises if more than max_parts are needed.

    The end of a window from each node is found in chunks of nodes at a time, each with the nodes that its last windows
    reach; the parts' starts are the rows that row 0 leads to (``tables.run_starts``). A node's inbound list must fit a row.
    """
    chunk = max(chunk, limits.nodes_per_part)
    rows, figure = observed(prefix_sums(graph.nodes.select("v"), ["v"], {}), "order", n=F.count("*"))
    if graph.pins.where("NOT is_src").count() <= limits.inbound_per_part:  # no part can have more inbound hyperedges than pins
        each = max(1, limits.nodes_per_part)
        if figure["n"] > each * limits.max_parts:
            raise GraphError(f"more than {limits.max_parts} parts are needed")
        return rows.select("v", F.floor(F.col("row") / each).alias("p"))
    pins = graph.pins.where("NOT is_src").select("e", "v").distinct().join(rows, "v")
    along = Window.partitionBy("e").orderBy("row")
    never = F.lit((1 << 62)).cast("bigint")
    pins = pins.select("row", F.coalesce(F.lag("row").over(along), F.lit(-1).cast("bigint")).alias("before"), F.coalesce(F.lead("row").over(along), never).alias("after"))
    lists = pins.groupBy("row").agg(F.collect_list("before").alias("before"), F.collect_list("after").alias("after"))
    none = F.array().cast("array<bigint>")
    own = F.floor(F.col("row") / chunk)
    reached = F.when((F.col("row") >= chunk) & (F.col("row") % chunk < limits.nodes_per_part), F.array(own, own - 1)).otherwise(F.array(own))
    seen = rows.select("row").join(lists, "row", "left").select(F.explode(reached).alias("part"), "row", F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"))
    ends = seen.repartition("part").sortWithinPartitions("part", "row").mapInArrow(lambda batches: window_ends(batches, limits.nodes_per_part, limits.inbound_per_part, chunk), "row bigint, to bigint")
    runs = run_starts(stored(rows.select("row").join(ends, "row", "left"), "following"))
    parts, figure = observed(runs.join(rows, "row").select("v", F.col("run").alias("p")), "sequential", top=F.max("p"))
    if (figure["top"] or 0) >= limits.max_parts:
        raise GraphError(f"more than {limits.max_parts} parts are needed")
    return parts


def quotient(graph: HGraph, parts: DataFrame, rule: int = 2, squish: bool = False) -> DataFrame:
    """(srcs, dsts, w[, e]): hyperedges between parts, sorted distinct part ids per role.

    ``rule`` settles a part in both roles (as in ``structure.dedupe``). An edge goes if it is left
    with no destination and at most one source. ``squish`` merges equal (srcs, dsts) and sums w.
    """
    roles = graph.pins.join(parts, "v").groupBy("e", "p").agg(F.max("is_src").alias("s"), F.max(~F.col("is_src")).alias("d"))
    s, d = F.col("s"), F.col("d")
    if rule == 1:
        s = s & ~d
    elif rule == 2:
        d = d & ~s
    ids = lambda role: F.array_sort(F.array_compact(F.collect_list(F.when(role, F.col("p")))))
    lists = roles.groupBy("e").agg(ids(s).alias("srcs"), ids(d).alias("dsts")).where("size(srcs) > 1 OR size(dsts) > 0")
    out = lists.join(graph.edges, "e").select("e", "srcs", "dsts", "w")
    return out.groupBy("srcs", "dsts").agg(F.sum("w").alias("w")) if squish else out


def quotient_graph(graph: HGraph, parts: DataFrame, rule: int = 2, squish: bool = True) -> HGraph:
    """The quotient as a graph: nodes are part ids with summed sizes. Ids must be 0..P-1."""
    check = parts.agg(F.max("p").alias("top"), F.countDistinct("p").alias("n")).first()
    if check.n and check.top + 1 != check.n:
        raise GraphError("part ids must be 0..P-1")
    edges = quotient(graph, parts, rule, squish)
    if squish:
        edges = prefix_sums(edges.withColumn("key", F.concat_ws("|", F.concat_ws(",", "srcs"), F.concat_ws(",", "dsts"))), ["key"], {}).withColumnRenamed("row", "e")
    pin = lambda column, role: edges.select("e", F.explode(column).alias("v"), F.lit(role).alias("is_src"))
    nodes = graph.nodes.join(parts, "v").groupBy("p").agg(F.sum("size").alias("size")).withColumnRenamed("p", "v")
    return HGraph(nodes, edges.select("e", "w"), pin("srcs", True).unionByName(pin("dsts", False)))
