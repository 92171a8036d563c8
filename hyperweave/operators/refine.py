"""Refinement of a partitioning: gains, ranked moves, event streams and the best valid prefix.

A round proposes one move per node, ranks the moves, computes for every prefix of them what it
gains and whether it is valid, and applies the best prefix. Prefix quantities are running sums of
events per part, or per (part, hyperedge), so no step is quadratic in the moves. What gains are made of is
kept between rounds and changed by what a prefix changes (``State``).
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.u32 import size_bucket
from ..schema import GraphError, HGraph
from ..tables import BLOCK, Log, observed, prefix_sums, running_sums, stored
from . import blocks
from .metrics import Constraints, loads

log = logging.getLogger("hyperweave")
#: Weights of the state are whole numbers of this fraction, so that sums of changes equal new sums exactly.
SCALE = 262144
#: Arrivals of a part, and of a size bucket, that are followed by a departure.
LINKS = 4


def pins_per_part(pins: DataFrame, parts: DataFrame) -> DataFrame:
    """(e, p, n, n_in): pins and destination pins of each hyperedge in each part it touches."""
    return pins.join(parts, "v").groupBy("e", "p").agg(F.count("*").alias("n"), F.sum((~F.col("is_src")).cast("bigint")).alias("n_in"))


def gains(graph: HGraph, parts: DataFrame, limits: Constraints, ppp: DataFrame | None = None, kway: bool = True, discount: int | None = None) -> DataFrame:
    """(v, src, dst, gain): the best other part for each node, even at a loss; ties go to the highest part.

    saving: weight of hyperedges that lose the source part (``kway``), or w / count^2 for all of them.
    loss of a part: weight of the node's hyperedges that do not touch it. Parts that no hyperedge of
    the node touches all lose the same, so only the highest one that has room is tried. A part has
    room if its size plus s - floor(s / discount) stays within the limit.
    """
    ppp = pins_per_part(graph.pins, parts) if ppp is None else ppp
    mine = graph.pins.join(graph.edges, "e").join(parts, "v").select("e", "v", "w", F.col("p").alias("src"))
    own = ppp.select("e", F.col("p").alias("src"), "n")
    keep = F.when(F.col("n") == 1, F.col("w")).otherwise(F.lit(0) * F.col("w")) if kway else F.col("w") / (F.col("n") * F.col("n"))
    saved = mine.join(own, ["e", "src"]).groupBy("v", "src").agg(F.sum(keep).alias("saving"), F.sum("w").alias("total"))
    node = graph.nodes.join(parts, "v").select("v", F.col("p").alias("src"), "size").join(saved, ["v", "src"], "left")
    node = node.select("v", "src", "size", F.coalesce("saving", F.lit(0)).alias("saving"), F.coalesce("total", F.lit(0)).alias("total"))
    touched = mine.join(ppp.select("e", F.col("p").alias("dst")), "e").where("dst <> src").groupBy("v", "dst").agg(F.sum("w").alias("touched"))
    size = loads(graph, parts).select(F.col("p").alias("dst"), F.col("size").alias("dst_size"))
    counted = F.lit(0) if discount is None else F.floor(F.col("size") / discount)
    if discount is None:
        room = F.col("dst_size") + F.col("size") <= limits.nodes_per_part
    else:
        room = F.col("dst_size") + F.col("size") - counted <= limits.nodes_per_part
    near = node.join(touched, "v").join(size, "dst").where(room).select("v", "src", "dst", (F.col("saving") - F.col("total") + F.col("touched")).alias("gain"))
    # the highest part that a node does not touch is among the first n_touched + 2 that have room for
    # its size: those ranks are joined by (size, rank), so rows stay near those of ``touched``
    classes = node.select("size").distinct().join(size).where(room)  # sizes x parts, few rows each
    falling = Window.partitionBy("size").orderBy(F.desc("dst"))
    classes = classes.select("size", "dst", F.row_number().over(falling).alias("k"))
    n_touched = touched.groupBy("v").agg(F.count("*").alias("n_touched"))
    tries = node.join(n_touched, "v", "left").withColumn("k", F.explode(F.sequence(F.lit(1), F.coalesce("n_touched", F.lit(0)).cast("int") + 2)))
    far = tries.join(classes, ["size", "k"]).where("dst <> src").join(touched.select("v", "dst"), ["v", "dst"], "left_anti")
    far = far.groupBy("v", "src").agg(F.max("dst").alias("dst"), F.first(F.col("saving") - F.col("total")).alias("gain"))
    best = Window.partitionBy("v").orderBy(F.desc("gain"), F.desc("dst"))
    return near.unionByName(far).withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def ranked(moves: DataFrame) -> DataFrame:
    """Add rank (0-based) by gain, then id. Global, but no single task sorts all rows."""
    keyed = moves.withColumn("order_", -F.col("gain"))
    return prefix_sums(keyed, ["order_", "v"], {}).withColumnRenamed("row", "rank").drop("order_")


def linked(moves: DataFrame, nodes: DataFrame, links: int = LINKS) -> DataFrame:
    """(v, next, gain): the i-th best move into a part is followed by the i-th best move out of it, i <= ``links``, among moves of one size bucket.

    Best: by gain, then lowest id; ``gain`` is that of both. Only ``links`` moves for each part and bucket are looked at, and that limit is
    taken before the shuffle, so a part that most moves enter or leave is like any other.
    """
    sized = moves.join(nodes.select("v", "size"), "v").withColumn("bucket", size_bucket(F.col("size")))

    def best(part: str, name: str) -> DataFrame:
        order = Window.partitionBy(part, "bucket").orderBy(F.desc("gain"), "v")
        return sized.withColumn("k", F.row_number().over(order)).where(F.col("k") <= links).select(F.col("v").alias(name), F.col(part).alias("p"), "bucket", "k", F.col("gain").alias(f"{name}_gain"))

    return best("dst", "v").join(best("src", "next"), ["p", "bucket", "k"]).select("v", "next", (F.col("v_gain") + F.col("next_gain")).alias("gain"))


def paired(links: DataFrame) -> DataFrame:
    """(v, head, depth) of links(v, next, gain) that share no move: those that gain more, then have the lower v, than the links before and after them."""
    key = lambda name: F.struct("gain", (-F.col("v")).alias("low")).alias(name)
    after = links.select(F.col("v").alias("next"), key("later"))
    before = links.select(F.col("next").alias("v"), key("sooner"))
    own = F.struct("gain", (-F.col("v")).alias("low"))
    kept = links.join(after, "next", "left").join(before, "v", "left").where((F.col("later").isNull() | (own > F.col("later"))) & (F.col("sooner").isNull() | (own > F.col("sooner"))))
    ends = F.explode(F.array(F.struct(F.col("v").alias("v"), F.lit(0).alias("depth")), F.struct(F.col("next").alias("v"), F.lit(1).alias("depth")))).alias("x")
    return kept.select(F.col("v").alias("head"), ends).select("x.v", "head", F.col("x.depth").cast("bigint").alias("depth"))


def chained(moves: DataFrame, nodes: DataFrame, links: int = LINKS, whole: bool = True) -> DataFrame:
    """Add rank so that moves form chains: a move into a part is followed by one out of it (``linked``).

    Chains are ranked by total gain, then the id of their head, and moves by their place in the chain; a cycle is cut after its
    highest id. Without ``whole`` chains are cut to two moves (``paired``), which takes no loop.
    """
    found = linked(moves, nodes, links)
    chain = _chains(stored(found.select("v", "next"), "links")) if whole else paired(found)
    placed = moves.join(chain, "v", "left").select("v", "src", "dst", "gain", F.coalesce("head", "v").alias("head"), F.coalesce("depth", F.lit(0)).alias("depth"))
    total = moves.join(chain, "v").groupBy("head").agg(F.sum("gain").alias("total"))  # the others are their own chain
    placed = placed.join(total, "head", "left").withColumn("order_", -F.coalesce("total", "gain")).drop("total")
    return prefix_sums(placed, ["order_", "head", "depth", "v"], {}).withColumnRenamed("row", "rank").select("v", "src", "dst", "gain", "rank")


def _chains(links: DataFrame) -> DataFrame:
    """(v, head, depth) of the moves in links(v, next); a cycle is cut after its highest id.

    Pointer doubling over predecessors, one written table a step: ``at`` is 2^k places back, ``depth`` how
    many places that is, ``top`` the highest id from v up to the one after ``at``. A chain is done when it has come to its
    head. Once a step finishes no more chains only cycles are left; ``span`` places, as many as are left,
    hold all of a cycle.
    """
    before = links.select(F.col("next").alias("v"), F.col("v").alias("at"))
    moves = links.select("v").unionByName(links.select(F.col("next").alias("v"))).distinct()
    first = moves.join(before, "v", "left").select("v", F.coalesce("at", "v").alias("at"), F.when(F.col("at").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), F.col("v").alias("top"), F.col("at").isNull().alias("done"))
    open_, span = None, 1
    state, seen = observed(first, "chains", left=F.count_if(~F.col("done")))
    while left := seen["left"]:
        if left == open_ and span >= left:
            return _chains(stored(links.join(state.where("NOT done AND v = top").select("v"), "v", "left_anti"), "links"))
        open_, span = left, 2 * span
        step = state.select(F.col("v").alias("at"), F.col("at").alias("further"), F.col("depth").alias("more"), F.col("top").alias("top2"), F.col("done").alias("ended"))
        moved = state.where("NOT done").join(step, "at").select("v", F.col("further").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.greatest("top", "top2").alias("top"), F.col("ended").alias("done"))
        state, seen = observed(moved.unionByName(state.where("done")), "chains", left=F.count_if(~F.col("done")))
    return state.select("v", F.col("at").alias("head"), "depth")


def hedge_events(pins: DataFrame, moves: DataFrame, ppp: DataFrame, block: int = BLOCK, places: int | None = None) -> DataFrame:
    """(v, rank, p, c, t): what each move changes at each of its hyperedges and at both of its parts, if all moves of lower rank are applied before it.

    pins(e, v, is_src, w). ``c``: weight gained by leaving a part that the hyperedge then no longer touches, or lost by entering one
    that it did not touch; ``t``: 1 if the part gains an inbound hyperedge, -1 if it loses one. Both follow from running
    counts of pins and destination pins by (hyperedge, part).
    """
    rows = pins.join(moves.select("v", "src", "dst", "rank"), "v")
    ends = F.explode(F.array(F.struct(F.col("src").alias("p"), F.lit(-1).cast("bigint").alias("d")), F.struct(F.col("dst").alias("p"), F.lit(1).cast("bigint").alias("d")))).alias("x")
    events = rows.select("e", "v", "w", "rank", "is_src", ends).select("e", "v", "w", "rank", "x.p", "x.d", F.when(F.col("is_src"), 0).otherwise(F.col("x.d")).alias("d_in"))
    events = running_sums(events, ["e", "p"], "rank", {"moved": "d", "moved_in": "d_in"}, block, places).join(ppp.select("e", "p", "n", "n_in"), ["e", "p"], "left")
    now, now_in = F.coalesce("n", F.lit(0)) + F.col("moved"), F.coalesce("n_in", F.lit(0)) + F.col("moved_in")
    change = F.when((F.col("d") == -1) & (now == 0), F.col("w")).when((F.col("d") == 1) & (now == 1), -F.col("w")).otherwise(F.lit(0) * F.col("w"))
    turn = (now_in > 0).cast("bigint") - (now_in - F.col("d_in") > 0).cast("bigint")
    return events.select("v", "rank", "p", change.alias("c"), turn.alias("t"))


def cascade(graph: HGraph, moves: DataFrame, ppp: DataFrame) -> DataFrame:
    """(v, src, dst, rank, gain): gain of each move if all of lower rank are applied before it."""
    total = hedge_events(graph.pins.join(graph.edges, "e"), moves, ppp).groupBy("v").agg(F.sum("c").alias("gain"))
    return moves.drop("gain").join(total, "v", "left").select("v", "src", "dst", "rank", F.coalesce("gain", F.lit(0)).alias("gain"))


def _sides(moves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rank, p, s): what each move takes from its source part and brings to its destination."""
    sized = moves.select("v", "src", "dst", "rank").join(nodes.select("v", "size"), "v")
    ends = F.explode(F.array(F.struct(F.col("src").alias("p"), (-F.col("size")).alias("s")), F.struct(F.col("dst").alias("p"), F.col("size").alias("s")))).alias("x")
    return sized.select("rank", ends).select("rank", "x.p", "x.s")


def _over(x: Column, limits: Constraints) -> Column:
    return F.greatest(x - limits.nodes_per_part, F.lit(0))


def _broken(x: Column, limits: Constraints) -> Column:
    return (x > limits.inbound_per_part).cast("bigint")


def size_excess(nodes: DataFrame, moves: DataFrame, sizes: DataFrame, limits: Constraints) -> DataFrame:
    """(rank, excess): by how much a move changes the sum of sizes above the limit. sizes(p, size)."""
    events = running_sums(_sides(moves, nodes), ["p"], "rank", {"moved": "s"})
    events = events.join(sizes.select("p", F.col("size").alias("start")), "p", "left").withColumn("now", F.col("moved") + F.coalesce("start", F.lit(0)))
    return events.withColumn("c", _over(F.col("now"), limits) - _over(F.col("now") - F.col("s"), limits)).groupBy("rank").agg(F.sum("c").alias("excess"))


def inbound_breaks(pins: DataFrame, moves: DataFrame, ppp: DataFrame, limits: Constraints) -> DataFrame:
    """(rank, broken): change of the number of parts with more distinct inbound hyperedges than allowed."""
    turns = hedge_events(pins.where("NOT is_src").withColumn("w", F.lit(0)), moves, ppp)
    per_rank = turns.where("t <> 0").groupBy("p", "rank").agg(F.sum("t").alias("t")).where("t <> 0")
    start = ppp.where("n_in > 0").groupBy("p").agg(F.count("*").alias("inbound"))
    turned = running_sums(per_rank, ["p"], "rank", {"turned": "t"})
    flags = turned.join(start, "p", "left").withColumn("now", F.col("turned") + F.coalesce("inbound", F.lit(0)))
    return flags.withColumn("c", _broken(F.col("now"), limits) - _broken(F.col("now") - F.col("t"), limits)).groupBy("rank").agg(F.sum("c").alias("broken"))


def prefixes(moves: DataFrame, excess: DataFrame, broken: DataFrame) -> DataFrame:
    """(rank, gain, excess, broken): totals over all moves up to each rank."""
    rows = moves.select("rank", "gain").join(excess, "rank", "left").join(broken, "rank", "left").na.fill(0, ["excess", "broken"])
    return running_sums(rows.toDF("rank", "g", "x", "b"), [], "rank", {"gain": "g", "excess": "x", "broken": "b"}).select("rank", "gain", "excess", "broken")


def prefix_totals(pins: DataFrame, nodes: DataFrame, moves: DataFrame, ppp: DataFrame, sizes: DataFrame, limits: Constraints, block: int = BLOCK, places: int | None = None) -> DataFrame:
    """(rank, gain, excess, broken) as ``prefixes`` of ``cascade``, ``size_excess`` and ``inbound_breaks``, with one pass over the events.

    pins(e, v, is_src, w), sizes(p, size).
    """
    zero = F.lit(0).cast("bigint")
    hedges = hedge_events(pins, moves, ppp, block, places).groupBy("p", "rank").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    sides = _sides(moves, nodes).select("p", "rank", F.lit(0.0).alias("c"), zero.alias("t"), "s")
    events = hedges.select("p", "rank", F.col("c").cast("double").alias("c"), "t", zero.alias("s")).unionByName(sides)
    events = events.groupBy("p", "rank").agg(F.sum("c").alias("c"), F.sum("t").alias("t"), F.sum("s").alias("s"))
    events = running_sums(events, ["p"], "rank", {"turned": "t", "moved": "s"}, block, places)
    inbound = ppp.where("n_in > 0").groupBy("p").agg(F.count("*").alias("inbound"))
    start = sizes.select("p", F.col("size").alias("start")).join(inbound, "p", "left").select("p", "start", F.coalesce("inbound", zero).alias("inbound"))
    events = events.join(start, "p", "left")
    size, hedges_now = F.col("moved") + F.coalesce("start", zero), F.col("turned") + F.coalesce("inbound", zero)
    events = events.select("rank", "c", (_over(size, limits) - _over(size - F.col("s"), limits)).alias("x"), (_broken(hedges_now, limits) - _broken(hedges_now - F.col("t"), limits)).alias("b"))
    per_rank = events.groupBy("rank").agg(F.sum("c").alias("g"), F.sum("x").alias("x"), F.sum("b").alias("b"))
    return running_sums(per_rank, [], "rank", {"gain": "g", "excess": "x", "broken": "b"}, block, places).select("rank", "gain", "excess", "broken")


def best_prefix(totals: DataFrame, start_excess: int | Column = 0, start_broken: int = 0) -> DataFrame:
    """At most one row: fewest broken parts (0 counts as valid), least excess, most gain, then lowest rank."""
    order = (F.greatest(F.col("broken") + start_broken, F.lit(0)), F.greatest(F.col("excess") + start_excess, F.lit(0)), F.desc("gain"), F.col("rank"))
    return totals.orderBy(*order).limit(1)


def best_valid_prefix(totals: DataFrame, start_excess: int = 0, start_broken: int = 0) -> DataFrame:
    """At most one row: of the prefixes that break no limit, the one with most gain, then lowest rank."""
    valid = totals.where((F.col("broken") + start_broken <= 0) & (F.col("excess") + start_excess <= 0))
    return valid.orderBy(F.desc("gain"), "rank").limit(1)


def applied(parts: DataFrame, moves: DataFrame, upto: int) -> DataFrame:
    """parts after all moves of rank 0..upto."""
    new = moves.where(F.col("rank") <= upto).select("v", "dst")
    return parts.join(new, "v", "left").select("v", F.coalesce("dst", "p").alias("p"))


def discount_of(step: int, repeats: int) -> int | None:
    """Size discount over thirds of the repeats: 1 (size ignored), 2 (half), none."""
    return 1 if 3 * step < repeats else 2 if 3 * step < 2 * repeats else None


class State:
    """What the gains of a level are made of, kept from round to round.

    nodes(v, p, size, total, saving): each node's part, the weight of its hyperedges, and what it saves by leaving; a written table.
    counts(e, p, n, n_in) and touch(v, p, t): pins of each hyperedge in each part, and the weight of each node's
    hyperedges that touch a part; logs of changes, summed where they are read. After a prefix of moves only the (hyperedge, part)
    counts of moved pins change, and only the nodes on those hyperedges get a change of touch and saving.
    Weights are whole numbers of 1 / SCALE, so that the state equals one that is made anew.
    """

    def __init__(self, graph: HGraph, parts: DataFrame, kway: bool = True):
        self.kway = kway
        pins = graph.pins.join(graph.edges, "e").select("e", "v", "is_src", "w", F.floor(F.col("w") * SCALE).cast("bigint").alias("f"))
        self.pins = stored(pins, "weighted")
        self.counts = Log(pins_per_part(graph.pins, parts), "counts")
        now = self.counts.rows()
        self.touch = Log(self.pins.join(now.select("e", "p"), "e").groupBy("v", "p").agg(F.sum("f").alias("t")), "touch")
        own = self.pins.join(parts, "v").join(now.select("e", "p", "n"), ["e", "p"])
        sums = own.groupBy("v").agg(F.sum("f").alias("total"), F.sum(self._kept(F.col("n"))).alias("saving"))
        nodes = graph.nodes.join(parts, "v").join(sums, "v", "left")
        self.nodes = stored(nodes.select("v", "p", "size", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("saving", F.lit(0)).alias("saving")), "nodes")

    def _kept(self, n: Column) -> Column:
        """What a pin saves by leaving a part where its hyperedge has n pins: the weight if it is the only one, or (INCC) weight / n^2."""
        return F.when(n == 1, F.col("f")).otherwise(F.lit(0).cast("bigint")) if self.kway else F.floor(F.col("f") / (n * n)).cast("bigint")

    @property
    def parts(self) -> DataFrame:
        return self.nodes.select("v", "p")

    @property
    def sizes(self) -> DataFrame:
        return self.nodes.groupBy("p").agg(F.sum("size").alias("size"))

    def counted(self) -> DataFrame:
        """(e, p, n, n_in) of now."""
        return self.counts.rows().groupBy("e", "p").agg(F.sum("n").alias("n"), F.sum("n_in").alias("n_in")).where("n > 0")

    def touched(self) -> DataFrame:
        """(v, p, t) of now."""
        return self.touch.rows().groupBy("v", "p").agg(F.sum("t").alias("t")).where("t > 0")

    def gains(self, limits: Constraints, discount: int | None = None) -> DataFrame:
        """(v, src, dst, gain) as the function ``gains``, from what is kept.

        A part that the node's hyperedges touch loses less than any other, so the others are tried only where no touched part has room.
        """
        node = self.nodes.withColumnRenamed("p", "src")
        sizes = self.sizes.select(F.col("p").alias("dst"), F.col("size").alias("dst_size"))
        counted = F.lit(0) if discount is None else F.floor(F.col("size") / discount)
        room = F.col("dst_size") + F.col("size") - counted <= limits.nodes_per_part
        touched = self.touched().withColumnRenamed("p", "dst")
        near = node.join(touched, "v").where("dst <> src").join(sizes, "dst").groupBy("v").agg(F.max(F.when(room, F.struct("t", "dst"))).alias("top"), F.count("*").alias("n_touched"))
        node = node.join(near, "v", "left").withColumn("loss", F.col("saving") - F.col("total"))
        gain = lambda weight: (weight / F.lit(float(SCALE))).alias("gain")
        by_near = node.where("top IS NOT NULL").select("v", "src", "top.dst", gain(F.col("loss") + F.col("top.t")))
        lost = node.where("top IS NULL")
        classes = lost.select("size").distinct().join(sizes).where(room)  # sizes x parts, few rows each
        classes = classes.select("size", "dst", F.row_number().over(Window.partitionBy("size").orderBy(F.desc("dst"))).alias("k"))
        tries = lost.withColumn("k", F.explode(F.sequence(F.lit(1), F.coalesce("n_touched", F.lit(0)).cast("int") + 2)))
        far = tries.join(classes, ["size", "k"]).where("dst <> src").join(touched.select("v", "dst"), ["v", "dst"], "left_anti")
        return by_near.unionByName(far.groupBy("v", "src").agg(F.max("dst").alias("dst"), F.first(gain(F.col("loss"))).alias("gain")))

    def propose(self, limits: Constraints, discount: int | None) -> tuple[DataFrame, dict]:
        """``gains``, written, with their number and a digest."""
        return observed(self.gains(limits, discount), "gains", moves=F.count("*"), digest=F.bit_xor(F.xxhash64("v", "dst", "gain")))

    def best(self, proposed: DataFrame, seen: dict, by_chain: bool, limits: Constraints, whole_chains: bool) -> tuple[DataFrame, dict]:
        """The moves (v, src, dst, best) of the best prefix, how many they are and what they gain; none where no prefix is valid or all lose."""
        moves = chained(proposed, self.nodes, whole=whole_chains) if by_chain else ranked(proposed)
        totals = prefix_totals(self.pins, self.nodes, moves, self.counted(), self.sizes, limits, places=seen["moves"])
        now = self.sizes.agg(F.coalesce(F.sum(_over(F.col("size"), limits)), F.lit(0)).alias("now"))
        best = best_prefix(totals.join(F.broadcast(now)), F.col("now")).where("broken <= 0 AND excess + now <= 0 AND gain >= 0")  # one row is broadcast
        took = moves.join(F.broadcast(best.select(F.col("rank").alias("last"), F.col("gain").alias("best"))), F.col("rank") <= F.col("last"))
        return observed(took.select("v", "src", "dst", "best"), "took", n=F.count("*"), gain=F.max("best"))

    def apply(self, took: DataFrame) -> None:
        """Move took(v, src, dst)."""
        rows = self.pins.join(took.select("v", "src", "dst"), "v")
        ends = F.explode(F.array(F.struct(F.col("src").alias("p"), F.lit(-1).cast("bigint").alias("d")), F.struct(F.col("dst").alias("p"), F.lit(1).cast("bigint").alias("d")))).alias("x")
        moved = rows.select("e", "is_src", ends).groupBy("e", "x.p").agg(F.sum("x.d").alias("n"), F.sum(F.when(F.col("is_src"), 0).otherwise(F.col("x.d"))).alias("n_in")).where("n <> 0 OR n_in <> 0")
        old = self.counts.rows().groupBy("e", "p").agg(F.sum("n").alias("before"))
        change = stored(moved.join(old, ["e", "p"], "left").withColumn("before", F.coalesce("before", F.lit(0))), "change")
        # parts that hyperedges come to touch, or no longer do
        turned = change.withColumn("sign", (F.col("before") + F.col("n") > 0).cast("bigint") - (F.col("before") > 0).cast("bigint")).where("sign <> 0")
        self.touch.add(turned.join(self.pins, "e").groupBy("v", "p").agg(F.sum(F.col("sign") * F.col("f")).alias("t")).where("t <> 0"))
        # what pins of changed hyperedges saved in the part they were in, and save in the one they are in
        some = self.pins.join(rows.select("e").distinct(), "e", "left_semi").join(self.parts, "v").join(took.select("v", "dst"), "v", "left").withColumn("now", F.coalesce("dst", "p"))
        before = self.counted().select("e", "p", F.col("n").alias("n0"))
        self.counts.add(change)
        after = self.counted().select("e", F.col("p").alias("now"), F.col("n").alias("n1"))
        saved = some.join(before, ["e", "p"]).join(after, ["e", "now"]).groupBy("v").agg(F.sum(self._kept(F.col("n1")) - self._kept(F.col("n0"))).alias("more"))
        nodes = self.nodes.join(took.select("v", "dst"), "v", "left").join(saved, "v", "left")
        self.nodes = stored(nodes.select("v", F.coalesce("dst", "p").alias("p"), "size", "total", (F.col("saving") + F.coalesce("more", F.lit(0))).alias("saving")), "nodes")


def placed(parts: DataFrame, held: blocks.Held) -> np.ndarray:
    """The part of each node in the order of ids."""
    rows = parts.select("v", "p").toArrow().sort_by("v")
    if not np.array_equal(rows.column("v").to_numpy(), held.ids):
        raise GraphError("each node must have one part")
    return rows.column("p").to_numpy()


def parts_table(spark, ids: np.ndarray, p: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({"v": pa.array(ids, pa.int64()), "p": pa.array(p, pa.int64())}))


class Near:
    """The part of ``State`` for graphs of few nodes (``blocks``): the driver holds part and size of each node, tasks the pins."""

    def __init__(self, held: blocks.Held, parts: DataFrame | np.ndarray, kway: bool):
        self.kway, self.as_table = kway, not isinstance(parts, np.ndarray)
        self.ids, self.size, self.bare, self.blocks, self.n_pins, self.spark = held.ids, held.size, held.bare, held.blocks, held.n_pins, held.blocks.rows.sparkSession
        self.names, self.part = np.unique(placed(parts, held) if self.as_table else parts, return_inverse=True)

    @property
    def parts(self) -> DataFrame | np.ndarray:
        """As they were given: a table, or the part of each node in the order of ids."""
        p = self.names[self.part]
        return parts_table(self.spark, self.ids, p) if self.as_table else p

    def propose(self, limits: Constraints, discount: int | None) -> tuple[tuple, dict]:
        n, n_parts = len(self.ids), len(self.names)
        self.loads = np.zeros(n_parts, np.int64)
        np.add.at(self.loads, self.part, self.size)
        open_ = np.where(np.bincount(self.part, minlength=n_parts) > 0, self.loads, 1 << 60)  # a part that was left by all is none
        if blocks.summed(n, self.n_pins, self.blocks.n, n_parts):
            return self._propose_by_sums(open_, limits.nodes_per_part, discount)
        found = self.blocks.each(blocks.proposed, self.part, self.size, open_, limits.nodes_per_part, discount, self.kway, SCALE)
        self.inbound = np.sum([f[3] for f in found], axis=0) if found else np.zeros(n_parts, np.int64)
        dst, gain = np.full(n, -1), np.zeros(n)
        for v, to, g, _ in found:
            dst[v], gain[v] = to, g / float(SCALE)
        need, roomy = blocks.needed(self.size, discount), {}
        for v in self.bare:
            dst[v] = blocks.untouched(self.part[v], need[v], set(), open_, limits.nodes_per_part, roomy)
        return _proposal(dst, gain)

    def _propose_by_sums(self, loads: np.ndarray, most: int, discount: int | None) -> tuple[tuple, dict]:
        n_parts = len(self.names)
        t, loss, self.inbound = np.zeros((len(self.ids), n_parts), np.int64), np.zeros(len(self.ids), np.int64), np.zeros(n_parts, np.int64)
        for found in self.blocks.each(blocks.touching, self.part, n_parts, self.kway, SCALE, own=True):
            for total, more in zip((t, loss, self.inbound), found):
                total += more
        dst, gain = blocks.choices(t, loss, self.part, blocks.needed(self.size, discount), loads, most)
        return _proposal(dst, gain / float(SCALE))

    def best(self, proposed: tuple, seen: dict, by_chain: bool, limits: Constraints, whole_chains: bool) -> tuple[tuple, dict]:
        v, dst, gain = proposed
        src, size = self.part[v], self.size[v]
        order = blocks.chain_order(v, src, dst, gain, size, LINKS) if by_chain else np.lexsort((v, -gain))
        v, src, dst, size = v[order], src[order], dst[order], size[order]
        to, rank = np.full(len(self.ids), -1), np.full(len(self.ids), -1)
        to[v], rank[v] = dst, np.arange(len(v))
        bounded = limits.inbound_per_part < self.n_pins
        found = self.blocks.each(blocks.changed, self.part, to, rank, len(v), len(self.names), bounded, own=True)
        gains, left, entered = (np.cumsum(sum(f[0] for f in found)), *(sum(f[i] for f in found) for i in (1, 2))) if found else [np.zeros(len(v), np.int64)] * 3
        over = lambda x: np.maximum(x - limits.nodes_per_part, 0)
        excess = np.cumsum(blocks.excesses(src, dst, -size, size, self.loads, over)) + over(self.loads).sum()
        broken = np.zeros(len(v), np.int64)  # no part has more inbound hyperedges than pins
        if found and bounded:
            broken = np.cumsum(blocks.excesses(src, dst, left, entered, self.inbound, lambda x: x > limits.inbound_per_part))
        last = np.lexsort((np.arange(len(v)), -gains, np.maximum(excess, 0), np.maximum(broken, 0)))[0]
        if broken[last] > 0 or excess[last] > 0 or gains[last] < 0:
            return (), {"n": 0, "gain": None}
        return (v[: last + 1], dst[: last + 1]), {"n": int(last) + 1, "gain": float(gains[last])}

    def apply(self, took: tuple) -> None:
        self.part[took[0]] = took[1]


def _proposal(dst: np.ndarray, gain: np.ndarray) -> tuple[tuple, dict]:
    v = np.flatnonzero(dst >= 0)
    return (v, dst[v], gain[v]), {"moves": len(v), "digest": hash((v.tobytes(), dst[v].tobytes(), gain[v].tobytes()))}


def refined(graph: HGraph | None, parts: DataFrame | np.ndarray, limits: Constraints, repeats: int = 16, kway: bool = True, least_share: float = 0.0, whole_chains: bool = False, figures: list | None = None, held: blocks.Held | None = None) -> DataFrame | np.ndarray:
    """parts after up to ``repeats`` rounds; a round is applied if its best prefix is valid and does not lose.

    Chains come first (of two moves, or with ``whole_chains`` of any number, at several jobs more a round); after an invalid size the order is by gain; a further failure jumps to the next
    third of the schedule, and so does a round that gains no more than ``least_share`` of the best one. A third that proposes the
    moves which failed before is passed over. ``figures`` gets a dict for each round. With ``held``, the same graph in
    blocks, the driver holds the parts of nodes, given and returned as a table or in the order of ids; rounds of ``whole_chains`` go by tables.
    """
    state = State(graph, parts, kway) if held is None or whole_chains else Near(held, parts, kway)
    step, by_chain, most = 0, True, 0.0
    proposed = shown = failed = None
    while step < repeats:
        discount = discount_of(step, repeats)
        if proposed is None or shown != discount:
            (proposed, seen), shown = state.propose(limits, discount), discount
        if not seen["moves"]:
            break
        if not by_chain and seen == failed:
            step = _next_third(step, repeats)
            continue
        took, done = state.best(proposed, seen, by_chain, limits, whole_chains)
        row = {"step": step, "moves": seen["moves"], "by_chain": by_chain, "applied": done["n"], "gain": done["gain"]}
        log.info("round %s", row)
        if figures is not None:
            figures.append(row)
        if done["n"]:
            state.apply(took)
            proposed, failed, most = None, None, max(most, done["gain"])
            if done["gain"] <= least_share * most:
                step = _next_third(step, repeats) - 1
        elif by_chain:
            by_chain = False
        else:
            failed, step = seen, _next_third(step, repeats) - 1
        step += 1
    return state.parts


def _next_third(step: int, repeats: int) -> int:
    thirds = [-(-repeats // 3), -(-2 * repeats // 3), repeats]
    return next(t for t in thirds if t > step)
