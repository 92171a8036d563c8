"""Structure of a hypergraph: roles, incidence, neighbourhoods, relabelling, overlap.

Every operator is a narrow projection, one aggregation or one equi-join; pins are the fact table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import HGraph
from ..tables import observed, prefix_sums, stored


def dedupe(pins: DataFrame, rule: int = 2) -> DataFrame:
    """Distinct pins. Where a node is source and destination of a hyperedge: 0 keeps both roles, 1 drops the source, 2 the destination."""
    if rule == 0:
        return pins.select("e", "v", "is_src").distinct()
    role = {1: F.min("is_src"), 2: F.max("is_src")}[rule]
    return pins.groupBy("e", "v").agg(role.alias("is_src"))


def sources(pins: DataFrame, e: int) -> DataFrame:
    return pins.where((F.col("e") == e) & F.col("is_src")).select("v")


def destinations(pins: DataFrame, e: int) -> DataFrame:
    return pins.where((F.col("e") == e) & ~F.col("is_src")).select("v")


def members(pins: DataFrame, e: int) -> DataFrame:
    return pins.where(F.col("e") == e).select("v").distinct()


def incident(pins: DataFrame, v: int, inbound: bool | None = None, ordered: bool = False) -> DataFrame:
    """Hyperedges of a node; ``inbound`` picks those it is a destination (True) or source (False) of."""
    out = pins.where(F.col("v") == v)
    if inbound is not None:
        out = out.where(F.col("is_src") != F.lit(inbound))
    out = out.select("e").distinct()
    return out.orderBy("e") if ordered else out


def stats(graph: HGraph) -> DataFrame:
    """One row: n_nodes, n_hedges, n_pins, total_weight, connectivity = sum of w (#e - 1)."""
    sizes = graph.pins.groupBy("e").agg(F.count("*").alias("n"))
    edges = graph.edges.join(sizes, "e", "left").agg(F.count("*").alias("n_hedges"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pins"), F.sum("w").alias("total_weight"), F.sum(F.col("w") * (F.col("n") - 1)).alias("connectivity"))
    return graph.nodes.agg(F.count("*").alias("n_nodes")).join(edges)  # one row each


def edge_sizes(pins: DataFrame) -> DataFrame:
    """(e, n_pins, n_src)."""
    return pins.groupBy("e").agg(F.count("*").alias("n_pins"), F.sum(F.col("is_src").cast("bigint")).alias("n_src"))


def incidence(pins: DataFrame) -> DataFrame:
    """(v, touching, inbound)."""
    return pins.groupBy("v").agg(F.count("*").alias("touching"), F.sum((~F.col("is_src")).cast("bigint")).alias("inbound"))


#: Hyperedges whose sizes are broadcast: the largest ones. Any other holds at most one in so many of all pins.
LARGEST_HEDGES = 4096


def pairs(pins: DataFrame, large: int = 2048, largest: int = LARGEST_HEDGES, one_order: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(e, v, u, v_dst, u_dst, and of the hyperedge ``keep``) for ordered pairs of pins of a hyperedge, v <> u; with ``one_order`` v < u.

    A hyperedge of more than ``large`` pins is cut into blocks and joined block by block, so that its
    pairs are spread over tasks; the result is the same. Pins of the ``largest`` hyperedges get their
    blocks by a broadcast of that many sizes, so no task gathers a hyperedge before it is cut.
    """
    sizes = pins.groupBy("e").agg(F.count("*").alias("n")).where(F.col("n") > large).select("e", "n", F.ceil(F.col("n") / large).cast("int").alias("blocks"))
    top = F.broadcast(sizes.orderBy(F.desc("n"), "e").limit(largest).select("e", "blocks"))
    marked = pins.join(top, "e", "left")
    known = lambda df: df.select("e", "v", "is_src", *keep, "blocks")
    # beyond the largest ones, sizes are looked up by a join
    rest = sizes.join(top.select("e"), "e", "left_anti").select("e", F.col("blocks").alias("more"))
    sized = known(marked.where("blocks IS NOT NULL")).unionByName(
        known(marked.where("blocks IS NULL").drop("blocks").join(rest, "e", "left").withColumn("blocks", F.coalesce("more", F.lit(1))))
    )
    block = F.pmod(F.xxhash64("v"), F.col("blocks").cast("bigint")).cast("int")
    left = sized.select("e", "v", *keep, (~F.col("is_src")).alias("v_dst"), block.alias("b"))
    right = sized.select("e", F.col("v").alias("u"), (~F.col("is_src")).alias("u_dst"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    # a join that makes many rows of few: by number of tasks, or adaptive execution would put small inputs into one
    tasks = int(pins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(tasks, "e", "b").join(right.repartition(tasks, "e", "b"), ["e", "b"]).where("v < u" if one_order else "v <> u").drop("b")


def neighbours(pins: DataFrame) -> DataFrame:
    """(v, u): distinct co-pins in either role, without v itself."""
    return pairs(pins).select("v", "u").distinct()


#: Pins from which on a hyperedge's pairs are marked in matrices (``neighbourhood_sizes``), and the rows and columns of one.
#: A place in either fits a SMALLINT; a matrix holds a bit for each pair.
MARKED_PINS, MARKED_NODES, MARKED_IDS = 64, 8192, 16384
#: Most pins of a node in a matrix; the pairs of a node with more are spread over tasks. Pins in a matrix, beyond one node's.
HOT_PINS, MATRIX_PINS = 1 << 16, 1 << 20


def neighbourhood_sizes(pins: DataFrame) -> DataFrame:
    """(v, n_neighbours): distinct co-pins of each node that has any.

    Pairs of large hyperedges are many and repeat: they are not rows. Nodes fall into blocks and ids into ranges, a task marks
    the pairs of a block and a range in a matrix, and the marks of each node are counted. What small hyperedges link is marked there, too.
    """
    pins = stored(pins.select("e", "v", "is_src"), "pins")
    large = pins.groupBy("e").agg(F.count("*").alias("n")).where(F.col("n") > MARKED_PINS).select("e")
    if not large.limit(1).count():
        return neighbours(pins).groupBy("v").agg(F.count("*").alias("n_neighbours"))
    degree = stored(pins.groupBy("v").agg(F.count("*").alias("n")), "degrees")
    hot = degree.where(F.col("n") > HOT_PINS).select("v")
    ids = prefix_sums(degree.where(F.col("n") <= HOT_PINS), ["v"], {"upto": "n"})
    ids = stored(ids.select("v", F.floor(F.col("row") / MARKED_NODES).alias("b"), F.floor(F.col("upto") / MATRIX_PINS).alias("q"), (F.col("row") % MARKED_NODES).cast("smallint").alias("at")), "blocks")
    # rows go to their hyperedge and block once, and become lists there: lists of parts of them would be most of what is shuffled
    tasks, range_, place = int(pins.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.floor(F.col("u") / MARKED_IDS), F.pmod("u", F.lit(MARKED_IDS)).cast("smallint")
    listed = lambda rows, keys, c: rows.repartition(tasks, *keys).groupBy(*keys).agg(F.collect_set(c[0]).alias(c[1]))
    big = pins.join(large, "e", "left_semi").select("e", "v")
    wide = listed(big.where("v IS NOT NULL").select("e", F.col("v").alias("u")).select("e", range_.alias("c"), place.alias("at")), ("e", "c"), ("at", "us"))
    tall = listed(big.join(ids, "v").select("e", "b", "q", "at"), ("e", "b", "q"), ("at", "vs"))
    few = pairs(pins.join(large, "e", "left_anti")).select("v", "u").unionByName(degree.select("v", F.col("v").alias("u")))
    single = few.join(ids, "v").groupBy("b", "q", "at", range_.alias("c")).agg(F.collect_set(place).alias("us"))
    rows = tall.join(wide, "e").select("b", "q", "c", "vs", "us").unionByName(single.select("b", "q", "c", F.array("at").alias("vs"), "us"))
    # by number of tasks: these rows are small for the work that they make
    dealt = rows.repartition(tasks, "b", "q", "c")
    counts = dealt.groupBy("b", "q", "c").applyInPandas(_marked, "b bigint, at smallint, n bigint").groupBy("b", "at").agg((F.sum("n") - 1).alias("n_neighbours"))
    out = counts.where("n_neighbours > 0").join(ids, ["b", "at"]).select("v", "n_neighbours")
    near = pins.join(hot, "v", "left_semi").select("e", "v").join(pins.select("e", F.col("v").alias("u")), "e").where("v <> u").select("v", "u").distinct()
    return out.unionByName(near.groupBy("v").agg(F.count("*").alias("n_neighbours")))


def _marked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """How many ids of a range each node of a block is linked with, by rows of (nodes, ids) that are all linked."""
    linked = np.zeros((MARKED_NODES, -(-MARKED_IDS // 8)), np.uint8)
    for vs, us in zip(rows["vs"], rows["us"]):
        row = np.zeros(MARKED_IDS, bool)
        row[us] = True
        bits = np.packbits(row)
        first, last = us.min() >> 3, (us.max() >> 3) + 1
        linked[vs, first:last] |= bits[first:last]
    n = np.bitwise_count(linked).sum(axis=1, dtype=np.int64)
    at = np.flatnonzero(n)
    return pd.DataFrame({"b": key[0], "at": at, "n": n[at]})


def components(pins: DataFrame) -> DataFrame:
    """(v, root): the least node that each pin's node is connected with by hyperedges.

    Large-star and small-star steps over links to the least node of each hyperedge, until they stay; each step is written.
    """
    least = pins.groupBy("e").agg(F.min("v").alias("root"))
    links = pins.join(least, "e").where("v > root").select("v", "root").distinct()
    digest = {"n": F.count("*"), "x": F.bit_xor(F.xxhash64("v", "root"))}
    links, now = observed(links, "links", **digest)
    before = None
    while now != before and now["n"]:
        before = now
        both = links.unionByName(links.select(F.col("root").alias("v"), F.col("v").alias("root")))
        top = stored(both.groupBy("v").agg(F.min("root").alias("m")).select("v", F.least("v", "m").alias("m")), "minima")
        large = stored(both.where("root > v").join(top, "v").select(F.col("root").alias("v"), F.col("m").alias("root")).distinct(), "links")
        top = stored(large.groupBy("v").agg(F.min("root").alias("m")), "minima")
        small = large.join(top, "v").select(F.col("root").alias("v"), F.col("m").alias("root")).unionByName(top.select("v", F.col("m").alias("root")))
        links, now = observed(small.where("v > root").distinct(), "links", **digest)
    alone = pins.select("v").distinct().join(links, "v", "left")
    return alone.select("v", F.coalesce("root", "v").alias("root"))


def sampled_max_neighbourhood(graph: HGraph, samples: int = 2400) -> DataFrame:
    """One row: the largest neighbourhood among equally spaced nodes (an estimate; all nodes if few)."""
    step = F.greatest(F.floor(F.count("*") / samples), F.lit(1)).alias("step")
    chosen = graph.nodes.join(F.broadcast(graph.nodes.agg(step))).where(F.col("v") % F.col("step") == 0).select("v")
    near = graph.pins.join(chosen, "v").select("v", "e").join(graph.pins.select("e", F.col("v").alias("u")), "e").where("v <> u").select("v", "u").distinct()
    return near.groupBy("v").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_neighbours"))


def relabel(graph: HGraph, ids: DataFrame) -> HGraph:
    """Rename nodes by ids(v, new_id)."""
    rename = lambda df: df.join(ids, "v").drop("v").withColumnRenamed("new_id", "v")
    return HGraph(rename(graph.nodes).select("v", "size"), graph.edges, rename(graph.pins).select("e", "v", "is_src"))


def overlap(pins: DataFrame, n_edges: DataFrame) -> DataFrame:
    """(e, shared, avg_overlap): pins shared with all other hyperedges, sum of (deg - 1), and its mean over them.

    ``n_edges``: one row with column n.
    """
    degree = pins.groupBy("v").agg(F.count("*").alias("deg"))
    shared = pins.join(degree, "v").groupBy("e").agg(F.sum(F.col("deg") - 1).alias("shared"))
    return shared.join(F.broadcast(n_edges)).select("e", "shared", F.when(F.col("n") > 1, F.col("shared") / (F.col("n") - 1)).otherwise(0.0).alias("avg_overlap"))


def bin_of(key: str, bins: int, low: float, high: float):
    """Number of the bin of [low, high); values outside go to the first or last one."""
    return F.least(F.greatest(F.floor((F.col(key) - low) * bins / (high - low)), F.lit(0)), F.lit(bins - 1)).cast("int")


def binned(df: DataFrame, key: str, bins: int, low: float, high: float, sort: bool = True) -> DataFrame:
    """Multi-way binning by sorting: each row with its bin, bins in order when ``sort``."""
    out = df.withColumn("bin", bin_of(key, bins, low, high))
    return out.repartitionByRange("bin", key).sortWithinPartitions("bin", key) if sort else out


def scattered(df: DataFrame, key: str, bins: int, low: float, high: float) -> DataFrame:
    """Multi-way binning by counts: each row with its bin and its place (0-based) in an array that holds bin after bin.

    Partitions count their rows by bin; a place is the bin's start, plus what partitions before hold of the
    bin, plus the row's number in its partition. There is no global sort: rows move once, to their
    (partition, bin). They are written first, so that partitions and their order stay.
    """
    rows = stored(df.select("*", bin_of(key, bins, low, high).alias("bin")).withColumns({"chunk_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()}), "binned")
    counts = stored(rows.groupBy("bin", "chunk_").agg(F.count("*").alias("n_")), "counts")
    starts = prefix_sums(counts, ["bin", "chunk_"], {"upto_": "n_"}).select("bin", "chunk_", (F.col("upto_") - F.col("n_")).alias("start_"))
    within = Window.partitionBy("chunk_", "bin").orderBy("at_")
    placed = rows.withColumn("nth_", F.row_number().over(within) - 1).join(F.broadcast(starts), ["bin", "chunk_"])  # a row for each partition and bin
    return placed.select(*df.columns, "bin", (F.col("start_") + F.col("nth_")).alias("place"))
