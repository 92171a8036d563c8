"""Placement on a lattice: forces, tensions, exclusive swaps and multi-start refinement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.curves import curve
from ..schema import GraphError, HGraph
from ..tables import observed, prefix_sums, running_sums, sized, stored
from .hardware import Hardware, max_source_distance, routes, weighted_tree_span
from .ordering import feed_forward_order, locality_order
from .structure import pairs

FORCE_SCALE = 131072
#: direction, its x and y step, the opposite direction
DIRECTIONS = (("left", -1, 0, "right"), ("right", 1, 0, "left"), ("up", 0, -1, "down"), ("down", 0, 1, "up"))


def pair_weights(pins: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, u, w): weight of the hyperedges that hold both, for ordered pairs of co-pins."""
    return pairs(pins).select("e", "v", "u").join(edges, "e").groupBy("v", "u").agg(F.sum("w").alias("w"))


def forces(pins: DataFrame, edges: DataFrame, placement: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(v, left, right, up, down): gain in weighted distance of one step each way.

    For a co-pin at signed distance d along the axis the step changes |d| by one, but a neighbour at
    distance 1 gets no closer (a swap trades places). ``weights``: ``pair_weights``, if known.
    """
    other = placement.select(F.col("v").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    weights = pair_weights(pins, edges) if weights is None else weights  # one row a pair before places are joined
    near = weights.join(placement, "v").join(other, "u")
    dx, dy = F.col("ux") - F.col("x"), F.col("uy") - F.col("y")
    far = F.abs(dx) + F.abs(dy)

    def gain(sx: int, sy: int):
        after = F.abs(dx - sx) + F.abs(dy - sy)
        return F.sum(F.col("w") * (far - F.greatest(after, F.lit(1))))

    return near.groupBy("v").agg(*[gain(sx, sy).alias(name) for name, sx, sy, _ in DIRECTIONS])


def tensions(force: DataFrame, placement: DataFrame, hw: Hardware, k: int = 4) -> DataFrame:
    """(v, rank, u, dir, score): up to k swaps of each node, u null for an empty cell; only positive ones, in fixed point.

    A swap's tension is the force on both nodes; best first, then an empty cell, then the higher id.
    """
    if not 1 <= k <= 4:
        raise ValueError("1 to 4 candidates")
    steps = F.explode(F.array(*[F.struct(F.lit(d).alias("dir"), F.lit(o).alias("opp"), (F.col("x") + sx).alias("nx"), (F.col("y") + sy).alias("ny"), F.col(d).cast("double").alias("f")) for d, sx, sy, o in DIRECTIONS]))
    mine = placement.join(force, "v").select("v", steps.alias("s")).select("v", "s.*").where(F.col("nx").between(0, hw.width - 1) & F.col("ny").between(0, hw.height - 1))
    cells = placement.select(F.col("v").alias("u"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    theirs = force.select(F.col("v").alias("u"), F.expr("stack(4, 'left', left, 'right', right, 'up', up, 'down', down) AS (opp, g)"))
    both = mine.join(cells, ["nx", "ny"], "left").join(theirs, ["u", "opp"], "left")
    score = F.floor((F.col("f") + F.coalesce(F.col("g").cast("double"), F.lit(0.0))) * FORCE_SCALE).cast("bigint")
    order = Window.partitionBy("v").orderBy(F.desc("score"), F.col("u").isNotNull(), F.desc("u"), F.expr("array_position(array('left', 'right', 'up', 'down'), dir)"))
    return both.select("v", "u", "dir", score.alias("score")).where("score > 0").withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).select("v", "rank", "u", "dir", "score")


def exclusive(swaps: DataFrame, placement: DataFrame) -> DataFrame:
    """(lo, hi, x, y, score): swaps in which each node and each cell takes part at most once, as if claimed one by one from the best score down.

    Ties go to the lower ids. Each round takes every swap that is the best at both of the cells that it touches and drops those that
    touch its cells; the best swap of all is always taken, and rounds go on until none is left, so the result is that of the
    one-by-one claim. ``hi`` is null for a move into an empty cell, (x, y) is the other cell.
    """
    step = reduce(lambda acc, d: acc.when(F.col("dir") == d[0], F.struct(F.lit(d[1]).alias("sx"), F.lit(d[2]).alias("sy"))), DIRECTIONS[1:], F.when(F.col("dir") == DIRECTIONS[0][0], F.struct(F.lit(DIRECTIONS[0][1]).alias("sx"), F.lit(DIRECTIONS[0][2]).alias("sy"))))
    at = swaps.join(placement, "v").withColumn("st", step)
    at = at.select(F.when(F.col("u").isNull(), F.col("v")).otherwise(F.least("v", "u")).alias("lo"), F.when(F.col("u").isNotNull(), F.greatest("v", "u")).alias("hi"), "score",
                   F.array(F.struct("x", "y"), F.struct((F.col("x") + F.col("st.sx")).alias("x"), (F.col("y") + F.col("st.sy")).alias("y"))).alias("cells"), (F.col("v") == F.least("v", F.coalesce("u", "v"))).alias("first"))
    # a swap proposed from both sides is one; the cell of ``lo`` comes first
    cells = F.when(F.col("first"), F.col("cells")).otherwise(F.reverse("cells"))
    left, seen = observed(at.select("lo", "hi", "score", cells.alias("cells")).groupBy("lo", "hi", "cells").agg(F.max("score").alias("score")), "swaps", n=F.count("*"))
    done = left.limit(0)
    while seen["n"]:
        key = F.struct("score", (-F.col("lo")).alias("a"), (-F.coalesce("hi", F.lit(-1))).alias("b"), "cells")
        flat = left.select("lo", "hi", "cells", "score", key.alias("key"), F.explode("cells").alias("cell"))
        top = flat.groupBy("cell").agg(F.max("key").alias("top"))
        won = flat.join(top, "cell").where("key = top").groupBy("lo", "hi", "cells", "score").agg(F.count("*").alias("n")).where("n = 2").drop("n")
        won = stored(won, "won")
        done = done.unionByName(won)
        used = won.select(F.explode("cells").alias("cell"))
        lost = flat.join(used, "cell", "left_semi").select("lo", "cells").distinct()
        left, seen = observed(left.join(lost, ["lo", "cells"], "left_anti").select("lo", "hi", "cells", "score"), "swaps", n=F.count("*"))
    return done.select("lo", "hi", F.element_at("cells", 2)["x"].alias("x"), F.element_at("cells", 2)["y"].alias("y"), "score")


def swapped(placement: DataFrame, swaps: DataFrame) -> DataFrame:
    """placement after swaps(lo, hi, x, y) that share no node and no cell."""
    own = placement.select(F.col("v").alias("lo"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    both = swaps.join(own, "lo")
    moves = both.select(F.col("lo").alias("v"), F.col("x").alias("nx"), F.col("y").alias("ny")).unionByName(both.where("hi IS NOT NULL").select(F.col("hi").alias("v"), F.col("lx").alias("nx"), F.col("ly").alias("ny")))
    return placement.join(moves, "v", "left").select("v", F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y"))


def swap_cascade(pins: DataFrame, edges: DataFrame, placement: DataFrame, swaps: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(rank, gain): change of the pairwise weighted distance by each ranked swap if those before it are done.

    A pair of co-pins changes when either moves: with the later of the two the other is already at its
    new place, so each pair needs only both ranks. ``weights``: ``pair_weights``, if known.
    """
    own = placement.select(F.col("v").alias("lo"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    both = swaps.join(own, "lo")
    move = both.select(F.col("lo").alias("v"), "rank", F.col("x").alias("nx"), F.col("y").alias("ny")).unionByName(both.where("hi IS NOT NULL").select(F.col("hi").alias("v"), "rank", F.col("lx").alias("nx"), F.col("ly").alias("ny")))
    at = placement.join(move, "v", "left").select("v", "x", "y", F.coalesce("nx", "x").alias("nx"), F.coalesce("ny", "y").alias("ny"), "rank")
    side = lambda c: at.select(F.col("v").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("x", "y", "nx", "ny", "rank")])
    near = (pair_weights(pins, edges) if weights is None else weights).where("v < u")
    near = near.join(side("v"), "v").join(side("u"), "u").where("rank_v IS NOT NULL OR rank_u IS NOT NULL")
    d = lambda a, b: F.abs(F.col(f"{a}x_v") - F.col(f"{b}x_u")) + F.abs(F.col(f"{a}y_v") - F.col(f"{b}y_u"))
    # places before and after the move of v, given whether u has moved by then, and the same for u
    u_first, v_first = F.col("rank_u") < F.col("rank_v"), F.col("rank_v") < F.col("rank_u")
    together = F.col("rank_v") == F.col("rank_u")
    of_v = F.when(together, d("", "") - d("n", "n")).when(u_first, d("", "n") - d("n", "n")).otherwise(d("", "") - d("n", ""))
    of_u = F.when(v_first, d("n", "") - d("n", "n")).otherwise(d("", "") - d("", "n"))
    rows = near.where("rank_v IS NOT NULL").select(F.col("rank_v").alias("rank"), (F.col("w") * of_v).alias("g"))
    rows = rows.unionByName(near.where("rank_u IS NOT NULL AND NOT coalesce(rank_v = rank_u, false)").select(F.col("rank_u").alias("rank"), (F.col("w") * of_u).alias("g")))
    return rows.groupBy("rank").agg(F.sum("g").alias("gain"))


def refined(graph: HGraph, placement: DataFrame, hw: Hardware, iterations: int = 64, k: int = 4, least_gain: float = 1e-3) -> DataFrame:
    """Force-directed refinement: per round the best prefix of ranked exclusive swaps, until one gains less than ``least_gain``."""
    weights, seen = observed(pair_weights(graph.pins, graph.edges), "weights", n=F.count("*"))  # all rounds read a row a pair, not the pins
    with sized(graph.nodes.sparkSession, seen["n"]):
        for _ in range(iterations):
            force = stored(forces(graph.pins, graph.edges, placement, weights), "forces")
            wanted, seen = observed(tensions(force, placement, hw, k), "tensions", n=F.count("*"))
            if not seen["n"]:
                break
            swaps = exclusive(wanted, placement).withColumn("order_", -F.col("score"))
            ranked = stored(prefix_sums(swaps, ["order_", "lo"], {}).withColumnRenamed("row", "rank").drop("order_"), "ranked")
            gains = swap_cascade(graph.pins, graph.edges, placement, ranked, weights)
            rows = ranked.select("rank").join(gains, "rank", "left").select("rank", F.coalesce("gain", F.lit(0)).alias("g"))
            best = running_sums(rows, [], "rank", {"total": "g"}).orderBy(F.desc("total"), "rank").first()
            if best is None or best.total < least_gain:
                break
            placement = stored(swapped(placement, ranked.where(F.col("rank") <= best["rank"])), "placement")
    return placement


def on_curve(graph: HGraph, order: DataFrame, hw: Hardware, name: str = "hilb") -> DataFrame:
    """placement(v, x, y): nodes in their order along a space-filling curve."""
    n = graph.nodes.count()
    if n > hw.cores:
        raise GraphError(f"{n} nodes on {hw.cores} cells")
    return order.join(curve(graph.nodes.sparkSession, name, n, hw.width, hw.height), "idx").select("v", "x", "y")


def score(graph: HGraph, placement: DataFrame) -> float:
    """0.4 * farthest-destination distance + 0.6 * spanning-tree length; lower is better."""
    far = max_source_distance(routes(graph.pins, graph.edges, placement)).first()[0]
    return 0.4 * float(far) + 0.6 * float(weighted_tree_span(graph.pins, graph.edges, placement).first()[0])


def place(graph: HGraph, hw: Hardware, curve_name: str = "hilb", order: str = "bisect", starts: int = 1, seed: int = 86, repeats: int = 8, iterations: int = 64, k: int = 4) -> DataFrame:
    """placement(v, x, y): order the nodes, lay them along a curve, refine; the best of ``starts`` seeds."""
    if order not in ("bisect", "feedforward"):
        raise GraphError(f"unknown order {order!r}")
    best = None
    for s in range(1 if order == "feedforward" else starts):
        line = feed_forward_order(graph) if order == "feedforward" else locality_order(graph, repeats, seed + s)
        found = refined(graph, stored(on_curve(graph, line, hw, curve_name), "placement"), hw, iterations, k)
        cost = score(graph, found) if starts > 1 else 0.0
        if best is None or cost < best[0]:
            best = (cost, found)
    return best[1]
