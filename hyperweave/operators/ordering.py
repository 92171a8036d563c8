"""One-dimensional orders of nodes: recursive bisection and the feed-forward frontier."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.u32 import uniform
from ..schema import HGraph
from ..tables import observed, prefix_sums, running_sums, sized, stored
from .structure import components
from .walks import walked


def split_halves(parts: DataFrame, seed: int = 86) -> DataFrame:
    """Each part p becomes 2p (its first half, rounded up, in hashed order) and 2p + 1."""
    keyed = prefix_sums(parts.withColumn("key", uniform(seed, F.col("v"))), ["p", "key", "v"], {})
    start = keyed.groupBy("p").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    at = F.col("row") - F.col("first")
    return keyed.join(start, "p").select("v", (2 * F.col("p") + (at >= F.ceil(F.col("n") / 2)).cast("bigint")).alias("p"))


def numbered(nodes: DataFrame) -> DataFrame:
    """(v, idx): nodes in the order of their ids."""
    return prefix_sums(nodes.select("v"), ["v"], {}).select("v", F.col("row").alias("idx"))


def sibling_counts(pins: DataFrame, parts: DataFrame) -> DataFrame:
    """(e, h, even, odd): pins of each hyperedge in the two parts of each sibling pair h = p div 2."""
    p = F.col("p")
    return pins.join(parts, "v").groupBy("e", F.shiftright(p, 1).alias("h")).agg(F.sum(1 - p % 2).alias("even"), F.sum(p % 2).alias("odd"))


def split_cost(pins: DataFrame, edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(h, cost): sum of w * pins on the smaller side."""
    return sibling_counts(pins, parts).join(edges, "e").groupBy("h").agg(F.sum(F.col("w") * F.least("even", "odd")).alias("cost"))


def label_gains(pins: DataFrame, edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(v, p, gain): gain of moving to the sibling part, w * (min(a, b) - min(a - 1, b + 1)) over hyperedges; all nodes."""
    counts = sibling_counts(pins, parts).join(edges, "e")
    mine = pins.join(parts, "v").withColumn("h", F.shiftright("p", 1)).join(counts, ["e", "h"])
    a = F.when(F.col("p") % 2 == 0, F.col("even")).otherwise(F.col("odd"))
    b = F.col("even") + F.col("odd") - a
    return mine.groupBy("v", "p").agg(F.sum(F.col("w") * (F.least(a, b) - F.least(a - 1, b + 1))).alias("gain"))


def paired_moves(gains: DataFrame) -> DataFrame:
    """(h, k, v, src, dst): k-th best mover of the even part swaps with the k-th best of the odd one.

    Places within a part come from one order over all parts, so the two halves of the whole graph are spread like any others.
    """
    placed = prefix_sums(gains.where("gain > 0").withColumn("order_", -F.col("gain")), ["p", "order_", "v"], {})
    placed = stored(placed.select("v", "p", "row"), "movers")
    first = placed.groupBy("p").agg(F.min("row").alias("first"))
    ranked = placed.join(first, "p").select("v", "p", (F.col("row") - F.col("first") + 1).alias("k"), F.shiftright("p", 1).alias("h"))
    even = ranked.where("p % 2 = 0").select("h", "k", F.col("v").alias("a"))
    odd = ranked.where("p % 2 = 1").select("h", "k", F.col("v").alias("b"))
    both = even.join(odd, ["h", "k"])
    ends = F.explode(F.array(*[F.struct(F.col(v).alias("v"), (2 * F.col("h") + s).alias("src"), (2 * F.col("h") + d).alias("dst")) for v, s, d in (("a", 0, 1), ("b", 1, 0))])).alias("x")
    return both.select("h", "k", ends).select("h", "k", "x.*")


def pair_cascade(pins: DataFrame, edges: DataFrame, parts: DataFrame, moves: DataFrame) -> DataFrame:
    """(h, k, gain): gain of each paired swap if the pairs before it are done; exact, by running counts."""
    events = pins.select("e", "v").join(moves, "v").groupBy("e", "h", "k").agg(F.sum(F.when(F.col("dst") % 2 == 0, 1).otherwise(-1)).alias("d"))
    at = running_sums(events, ["e", "h"], "k", {"after": "d"}).join(sibling_counts(pins, parts), ["e", "h"]).join(edges, "e")
    cost = lambda d: F.least(F.col("even") + d, F.col("odd") - d)
    return at.groupBy("h", "k").agg(F.sum(F.col("w") * (cost(F.col("after") - F.col("d")) - cost(F.col("after")))).alias("gain"))


def best_pairs(swaps: DataFrame) -> DataFrame:
    """(h, upto): the prefix of each sibling pair's swaps with the most gain, if positive; the shortest of equal ones."""
    best = running_sums(swaps, ["h"], "k", {"total": "gain"}).groupBy("h").agg(F.max(F.struct("total", (-F.col("k")).alias("k"))).alias("b"))
    return best.where("b.total > 0").select("h", (-F.col("b.k")).alias("upto"))


def sibling_strength(pins: DataFrame, edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(p, score): weight of pin pairs between part p and the sibling pair beside its own, per pin of p."""
    at = pins.join(parts, "v").groupBy("e", "p").agg(F.count("*").alias("n"))
    half = at.withColumn("h", F.shiftright("p", 1)).groupBy("e", "h").agg(F.sum("n").alias("m"))
    other = half.select("e", F.col("h").bitwiseXOR(F.lit(1)).alias("h"), "m")
    return at.withColumn("h", F.shiftright("p", 1)).join(other, ["e", "h"]).join(edges, "e").groupBy("p").agg(F.sum(F.col("w") * F.col("n") * F.col("m")).alias("score"))


def reversals(strength: DataFrame) -> DataFrame:
    """(h, reverse): whether the pair (2h, 2h + 1) turns round so that its stronger side faces the sibling pair."""
    left = F.coalesce(F.max(F.when(F.col("p") % 2 == 0, F.col("score"))), F.lit(0))
    right = F.coalesce(F.max(F.when(F.col("p") % 2 == 1, F.col("score"))), F.lit(0))
    sides = strength.groupBy(F.shiftright("p", 1).alias("h")).agg(left.alias("l"), right.alias("r"))
    return sides.select("h", (((F.col("h") % 2 == 1) & (F.col("l") < F.col("r"))) | ((F.col("h") % 2 == 0) & (F.col("l") > F.col("r")))).alias("reverse"))


def reversed_segments(order: DataFrame, flags: DataFrame) -> DataFrame:
    """order(v, p, idx) with the places of each flagged part (p = h) turned round."""
    ends = order.groupBy("p").agg((F.min("idx") + F.max("idx")).alias("ends"))
    out = order.join(ends, "p").join(flags.select(F.col("h").alias("p"), "reverse"), "p", "left")
    return out.select("v", "p", F.when(F.col("reverse"), F.col("ends") - F.col("idx")).otherwise(F.col("idx")).alias("idx"))


def span(pins: DataFrame, edges: DataFrame, order: DataFrame) -> DataFrame:
    """One row: sum of w * (largest - smallest place of a hyperedge's pins)."""
    ends = pins.join(order.select("v", "idx"), "v").groupBy("e").agg((F.max("idx") - F.min("idx")).alias("len")).join(edges, "e")
    return ends.agg(F.coalesce(F.sum(F.col("w") * F.col("len")), F.lit(0)).alias("span"))


#: Most nodes whose parts and moves the driver holds while hyperedges stay in tables.
FEW_NODES = 4096


def bisected(graph: HGraph, repeats: int = 8, seed: int = 86) -> list[DataFrame]:
    """Partitions by level, each splitting every part of the one before in two; parts of the last level have at most one node."""
    n = graph.nodes.count()
    if n <= FEW_NODES:
        return _few_bisected(graph, repeats, seed)
    levels, parts = [], stored(graph.nodes.select("v", F.lit(0).cast("bigint").alias("p")), "parts")
    while 1 << len(levels) < n:
        parts = stored(split_halves(parts, seed + len(levels)), "parts")
        for _ in range(repeats):
            moves = stored(paired_moves(label_gains(graph.pins, graph.edges, parts)), "moves")
            take = stored(best_pairs(pair_cascade(graph.pins, graph.edges, parts, moves)), "take")
            if not take.limit(1).count():
                break
            new = moves.join(take, "h").where("k <= upto").select("v", "dst")
            parts = stored(parts.join(new, "v", "left").select("v", F.coalesce("dst", "p").alias("p")), "parts")
        levels.append(parts)
    return levels or [parts]


def _few_bisected(graph: HGraph, repeats: int, seed: int) -> list[DataFrame]:
    """``bisected`` of few nodes under any number of hyperedges.

    Only pins in the same part weigh in what splits it, so each level starts from the hyperedges within parts, equal ones merged:
    they get fewer by level. A repeat is two jobs over them, for gains and for swaps; what comes back is a row for each node or swap.
    """
    spark, many = graph.nodes.sparkSession, F.size("vs") > 1
    # the places of nodes in the order of their ids stand for them in lists
    ids = [r.v for r in graph.nodes.select("v").orderBy("v").collect()]
    place = F.broadcast(spark.createDataFrame([(v, i) for i, v in enumerate(ids)], "v bigint, i int"))
    merged = lambda lists: lists.where(many).groupBy("vs").agg(F.sum("w").alias("w"))
    lists = graph.pins.join(place, "v").groupBy("e").agg(F.array_sort(F.collect_list("i")).alias("vs")).join(graph.edges, "e")
    rows, levels, before = stored(merged(lists), "rows"), [], np.zeros(len(ids), int)
    parts = graph.nodes.select("v", F.lit(0).cast("bigint").alias("p"))
    while 1 << len(levels) < len(ids):
        if levels:
            of = F.broadcast(spark.createDataFrame([(i, int(p)) for i, p in enumerate(before)], "i int, p int"))
            flat = rows.withColumn("id", F.monotonically_increasing_id()).select("id", "w", F.explode("vs").alias("i")).join(of, "i")
            rows = stored(merged(flat.groupBy("id", "p").agg(F.array_sort(F.collect_list("i")).alias("vs"), F.first("w").alias("w"))), "rows")
        with sized(spark, len(ids)):
            at = {r.v: r.p for r in split_halves(parts, seed + len(levels)).collect()}
        p = np.array([at[v] for v in ids])
        for _ in range(repeats):
            gains = _summed(rows, _label_sums(p), "i")
            ranked = sorted((int(p[i]), -g, i) for i, g in gains.items() if g > 0)
            movers: dict[int, list[int]] = {}
            for q, _, i in ranked:
                movers.setdefault(q, []).append(i)
            swaps = [(q >> 1, a, b) for q in sorted(movers) if q % 2 == 0 for a, b in zip(movers[q], movers.get(q + 1, []))]
            if not swaps:
                break
            gain = _summed(rows, _swap_sums(p, swaps), "i")
            best: dict[int, tuple[float, int]] = {}
            total, pair = 0, None
            for k, (h, _, _) in enumerate(swaps):
                total = gain.get(k, 0) + (total if h == pair else 0)
                pair = h
                if total > best.get(h, (0, 0))[0]:
                    best[h] = total, k
            if not best:
                break
            for k, (h, a, b) in enumerate(swaps):
                if h in best and k <= best[h][1]:
                    p[a], p[b] = p[b], p[a]
        parts, before = spark.createDataFrame([(v, int(q)) for v, q in zip(ids, p)], "v bigint, p bigint"), p.copy()
        levels.append(parts)
    return levels or [parts]


def _summed(rows: DataFrame, sums, key: str) -> dict:
    """{key: sum} of what ``sums`` yields for the partitions of ``rows``."""
    found = rows.mapInPandas(sums, f"{key} int, x double").groupBy(key).agg(F.sum("x").alias("x"))
    return {r[key]: r.x for r in found.collect()}


def _flat(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of all lists, the number of each one's row, and the rows' weights."""
    row = np.repeat(np.arange(len(batch)), batch["vs"].map(len).to_numpy())
    return np.concatenate(batch["vs"].to_list()), row, batch["w"].to_numpy(dtype=float)


def _label_sums(p: np.ndarray):
    """``label_gains`` of lists within sibling pairs of parts."""

    def sums(batches):
        total = np.zeros(len(p))
        for batch in batches:
            if len(batch):
                i, row, w = _flat(batch)
                odd = p[i] % 2
                n, n_odd = np.bincount(row), np.bincount(row, weights=odd)
                a = np.where(odd == 1, n_odd[row], n[row] - n_odd[row])
                b = n[row] - a
                total += np.bincount(i, weights=w[row] * (np.minimum(a, b) - np.minimum(a - 1, b + 1)), minlength=len(p))
        yield pd.DataFrame({"i": np.arange(len(p)), "x": total})

    return sums


def _swap_sums(p: np.ndarray, swaps: list[tuple[int, int, int]]):
    """``pair_cascade`` of lists within sibling pairs of parts; swaps are numbered as they come."""
    swap, to_even = np.full(len(p), -1), np.zeros(len(p), int)
    for k, (_, a, b) in enumerate(swaps):
        swap[a] = swap[b] = k
        to_even[a], to_even[b] = -1, 1

    def sums(batches):
        total = np.zeros(len(swaps))
        for batch in batches:
            if len(batch):
                i, row, w = _flat(batch)
                n, even = np.bincount(row), np.bincount(row, weights=p[i] % 2 == 0)
                moved = swap[i] >= 0
                # one event for each row and swap, in their order
                events, of = np.unique(row[moved] * len(swaps) + swap[i[moved]], return_inverse=True)
                d = np.bincount(of, weights=to_even[i[moved]], minlength=len(events))
                at, k = events // len(swaps), events % len(swaps)
                upto = np.cumsum(d)
                first = np.flatnonzero(np.diff(at, prepend=-1))
                after = upto - np.repeat(upto[first] - d[first], np.diff([*first, len(at)]))
                cost = lambda x: np.minimum(even[at] + x, n[at] - even[at] - x)  # noqa: E731, B023
                total += np.bincount(k, weights=w[at] * (cost(after - d) - cost(after)), minlength=len(swaps))
        yield pd.DataFrame({"i": np.arange(len(swaps)), "x": total})

    return sums


def locality_order(graph: HGraph, repeats: int = 8, seed: int = 86) -> DataFrame:
    """order(v, idx): recursive bisection, then pairs turned towards their siblings, bottom up."""
    with sized(graph.nodes.sparkSession, graph.pins.count()):
        levels = bisected(graph, repeats, seed)
        order = prefix_sums(levels[-1], ["p", "v"], {}).select("v", F.col("row").alias("idx"))
        for parts in reversed(levels):
            # the pair above a level is the segment that turns
            flags = reversals(sibling_strength(graph.pins, graph.edges, parts))
            placed = order.join(parts.select("v", F.shiftright("p", 1).alias("p")), "v")
            order = stored(reversed_segments(placed, flags).select("v", "idx"), "order")
    return order


def feed_forward_order(graph: HGraph) -> DataFrame:
    """order(v, idx): a frontier that starts at nodes without inbound hyperedges and takes the most strongly reached node next.

    Ties go to the lower id; where no seed is left, unplaced nodes with the fewest inbound hyperedges are seeds. Seeds come
    first, by id, so what they reach is one aggregation. From there each step depends on the one before, but only within a
    component of the hyperedges that other nodes may fire: a task walks components one by one (``walks.walked``), and a sort by the
    head of each run merges their orders. A component of most pins is a long task that holds its pins as arrays.
    """
    into = graph.pins.groupBy("v").agg(F.sum((~F.col("is_src")).cast("bigint")).alias("inbound"))
    left, seen = observed(graph.nodes.select("v").join(into, "v", "left").select("v", F.coalesce("inbound", F.lit(0)).alias("inbound")), "left", n=F.count("*"), fewest=F.min("inbound"))
    pins, live = observed(_with_source(graph.pins.join(graph.edges, "e").select("e", "v", "is_src", F.col("w").cast("double").alias("w"))), "pins", n=F.count("*"))
    done, base = [], 0
    while seen["n"]:
        if not live["n"]:  # no node reaches another: all further seeds, by their inbound hyperedges
            done.append(prefix_sums(left, ["inbound", "v"], {}).select("v", (F.col("row") + base).alias("idx")))
            break
        seeds = left.where(F.col("inbound") == seen["fewest"]).select("v", F.lit(True).alias("seed"))
        marked = stored(pins.join(seeds, "v", "left"), "marked")
        others = marked.where("seed IS NULL").drop("seed")
        fired = marked.where("seed AND is_src").groupBy("e").agg(F.count("*").alias("k"))
        start = stored(others.join(fired, "e").groupBy("v").agg(F.sum(F.col("w") * F.col("k")).alias("w")), "reached")
        fires = stored(_with_source(others), "fires")
        roots = stored(components(fires), "components")
        # a component's nodes by id come first, so that its task holds pins by the places of nodes
        within = roots.join(start.withColumn("is_src", F.lit(True)), "v", "left").select("root", F.lit(0).alias("kind"), F.col("v").alias("e"), "v", F.coalesce("is_src", F.lit(False)).alias("is_src"), "w")
        rows = fires.withColumn("kind", F.lit(1)).join(roots, "v").select("root", "kind", "e", "v", "is_src", "w").unionByName(within)
        walks = rows.repartition("root").sortWithinPartitions("root", "kind", "e")
        lone = start.join(roots, "v", "left_anti").select((-F.col("w")).alias("low"), F.col("v").alias("head"), F.lit(0).cast("bigint").alias("nth"), "v")
        first = seeds.select(F.lit(float("-inf")).alias("low"), F.col("v").alias("head"), F.lit(0).cast("bigint").alias("nth"), "v")
        order = stored(first.unionByName(lone).unionByName(walks.mapInArrow(walked, "low double, head bigint, nth bigint, v bigint")), "walks")
        order, placed = observed(prefix_sums(order, ["low", "head", "nth"], {}).select("v", (F.col("row") + base).alias("idx")), "order", n=F.count("*"))
        done.append(order)
        base += placed["n"]
        left, seen = observed(left.join(order, "v", "left_anti"), "left", n=F.count("*"), fewest=F.min("inbound"))
        pins, live = observed(_with_source(pins.join(order, "v", "left_anti")), "pins", n=F.count("*"))
    return reduce(DataFrame.unionByName, done) if done else left.select("v", F.col("inbound").alias("idx"))


def _with_source(pins: DataFrame) -> DataFrame:
    """Pins of hyperedges that have a source and another pin among them."""
    fire = pins.groupBy("e").agg(F.max("is_src").alias("s"), F.count("*").alias("n")).where("s AND n > 1")
    return pins.join(fire, "e", "left_semi")
