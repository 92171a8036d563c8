"""Coarsening: candidate pairs, matching, orphans, and the coarse tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.u32 import noise
from ..schema import HGraph
from ..tables import observed, prefix_sums, stored
from . import blocks
from .metrics import Constraints
from .structure import incidence, pairs

SCALE = 262144
MAX_CANDIDATES = 16
#: Candidates that are matched by a single task, without a job for each step of the trees.
TASK_CANDIDATES = 1 << 19


def candidates(graph: HGraph | None, limits: Constraints, k: int = 4, held: blocks.Held | None = None) -> DataFrame:
    """(v, rank, u, score): best k partners of each node, by score, then higher id.

    score = noise(u, v) + sum over shared hyperedges of floor(floor(w * 2^18) / #e). A pair is allowed
    if sizes and the union of inbound sets fit the limits; shared inbound hyperedges come from the
    same self-join as the score, so pairs need one join and one aggregation. Pins are stored once, with their
    hyperedge's share, and each pair is made in one order only. ``held``, the same graph in blocks, gives the same in one job.
    """
    if not 1 <= k <= MAX_CANDIDATES:
        raise ValueError(f"1 to {MAX_CANDIDATES} candidates")
    if held is not None:
        return held.blocks.table("v bigint, rank bigint, u bigint, score bigint", blocks.candidates, held.ids, held.size, held.inbound, limits.nodes_per_part, limits.inbound_per_part, k, SCALE)
    sizes = graph.pins.groupBy("e").agg(F.count("*").alias("n"))
    share = sizes.join(graph.edges, "e").select("e", F.floor(F.floor(F.col("w") * SCALE) / F.col("n")).cast("bigint").alias("part"))
    pins = stored(graph.pins.join(share, "e").select("e", "v", "is_src", "part"), "shares")
    scored = pairs(pins, one_order=True, keep=("part",)).groupBy("v", "u").agg(F.sum("part").alias("score"), F.sum((F.col("v_dst") & F.col("u_dst")).cast("bigint")).alias("shared"))
    node = graph.nodes.join(incidence(pins), "v", "left").select("v", "size", F.coalesce("inbound", F.lit(0)).alias("inb"))
    side = lambda c: node.select(F.col("v").alias(c), F.col("size").alias(f"size_{c}"), F.col("inb").alias(f"inb_{c}"))
    fits = (F.col("size_v") + F.col("size_u") <= limits.nodes_per_part) & (F.col("inb_v") + F.col("inb_u") - F.col("shared") <= limits.inbound_per_part)
    allowed = scored.join(side("v"), "v").join(side("u"), "u").where(fits).select("v", "u", (F.col("score") + noise(F.col("v"), F.col("u"))).alias("score"))
    ends = F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")))).alias("x")
    order = Window.partitionBy("v").orderBy(F.desc("score"), F.desc("u"))  # the limit on the rank is taken before the shuffle, too
    return allowed.select(ends, "score").select("x.v", "x.u", "score").withColumn("rank", (F.row_number().over(order) - 1)).where(F.col("rank") < k).select("v", "rank", "u", "score")


def asymmetric(proposals: DataFrame) -> DataFrame:
    """(v, rank, u, score) of candidates that break the symmetry which matching relies on; none, if scores are symmetric.

    The partner u must hold v among its candidates, or hold no worse ones: its candidate of the same
    rank has a higher score, or an equal one and a higher id.
    """
    theirs = proposals.select(F.col("v").alias("u"), "rank", F.col("u").alias("w"), F.col("score").alias("w_score"))
    back = proposals.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("rank").alias("back"))
    both = proposals.join(theirs, ["u", "rank"]).join(back, ["v", "u"], "left")
    better = (F.col("w_score") > F.col("score")) | (F.col("w_score") == F.col("score")) & (F.col("w") > F.col("v"))
    return both.where((F.col("w") != F.col("v")) & (F.col("back").isNull() | (F.col("back") > F.col("rank"))) & ~better).select("v", "rank", "u", "score")


def _through(m: tuple, x: tuple) -> tuple[Column, Column]:
    """The (max, +) product of a 2 x 2 matrix and a vector; null stands for minus infinity, which ``greatest`` passes over."""
    return F.greatest(m[0] + x[0], m[1] + x[1]), F.greatest(m[2] + x[0], m[3] + x[1])


def tree_values(hung: DataFrame) -> DataFrame:
    """(v, u, score, best, free) for every node of the forest hung(v, u, score): u is the parent of v, roots have none.

    ``free`` is the most that a matching below v can weigh without v, ``best`` with or without it:
    free = sum of the children's best, best = free + max(0, the largest score + free - best of a child).

    Rake and compress. A node whose children are all valued is valued. A node that waits for one child only is a 2 x 2
    (max, +) matrix applied to that child's (best, free); such nodes double their pointers down the chain, multiplying
    matrices, until they point at a valued node. So the number of rounds, one written table each, is
    logarithmic in the nodes, not in the depth.
    """
    kids = hung.groupBy(F.col("u").alias("v")).agg(F.count("*").alias("m"), F.sum("v").alias("ids"), F.sum("score").alias("scores"))
    nodes = hung.join(kids, "v", "full")
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    m, leaf, one = F.coalesce("m", zero), F.col("m").isNull(), F.col("m") == 1
    # f, g: of the valued children, the sum of best and the largest gain; to, a..d: the chain of a node with one child left
    start = nodes.select("v", "u", "score", m.alias("m"), "ids", "scores", zero.alias("f"), zero.alias("g"), F.when(one, F.col("ids")).alias("to"), F.when(one, zero).alias("a"), F.when(one, F.col("scores")).alias("b"), F.when(one, zero).alias("c"), none.alias("d"), F.when(leaf, zero).alias("best"), F.when(leaf, zero).alias("free"), leaf.alias("fresh"))
    state = stored(start, "forest")
    while True:
        got = state.where("fresh AND u IS NOT NULL").groupBy(F.col("u").alias("v")).agg(F.count("*").alias("m_"), F.sum("v").alias("ids_"), F.sum("score").alias("scores_"), F.sum("best").alias("f_"), F.max(F.col("score") + F.col("free") - F.col("best")).alias("g_"))
        end = state.select(F.col("v").alias("to"), *[F.col(c).alias(f"{c}2") for c in ("to", "a", "b", "c", "d", "best", "free")])
        row = state.join(got, "v", "left").join(end, "to", "left")
        open_, chain = F.col("best").isNull(), F.col("to").isNotNull()
        by_end, doubled = F.col("best2").isNotNull(), F.col("to2").isNotNull()
        matrix, further = tuple(map(F.col, "abcd")), tuple(map(F.col, ("a2", "b2", "c2", "d2")))
        (a, c), (b, d) = _through(matrix, (further[0], further[2])), _through(matrix, (further[1], further[3]))
        value = _through(matrix, (F.col("best2"), F.col("free2")))
        more = {c_: F.coalesce(f"{c_}_", zero) for c_ in ("m", "ids", "scores", "f")}
        left, ids, scores, f = F.col("m") - more["m"], F.col("ids") - more["ids"], F.col("scores") - more["scores"], F.col("f") + more["f"]
        g = F.greatest("g", F.col("g_"))
        waits = open_ & ~chain  # two or more children were left
        to_leaf, to_chain = waits & (left == 0), waits & (left == 1)
        jump = open_ & chain & ~by_end & doubled
        pick = lambda now, hop, old: F.when(to_chain, now).when(jump, hop).otherwise(F.col(old)).alias(old)
        new = row.select(
            "v", "u", "score",
            *[F.when(waits, x).otherwise(F.col(k)).alias(k) for k, x in (("m", left), ("ids", ids), ("scores", scores), ("f", f), ("g", g))],
            pick(ids, F.col("to2"), "to"), pick(f + g, a, "a"), pick(f + scores, b, "b"), pick(f, c, "c"), pick(none, d, "d"),
            F.when(to_leaf, f + g).when(open_ & chain & by_end, value[0]).otherwise(F.col("best")).alias("best"),
            F.when(to_leaf, f).when(open_ & chain & by_end, value[1]).otherwise(F.col("free")).alias("free"),
            (to_leaf | (open_ & chain & by_end)).alias("fresh"),
        )
        state, seen = observed(new, "forest", left=F.count_if(F.col("best").isNull()))
        if not seen["left"]:
            return state.select("v", "u", "score", "best", "free")


def forest_matching(points: DataFrame) -> DataFrame:
    """(v, u): a heaviest matching of the forest of points(v, u, score), where a mutual pair is the root of its tree.

    Each node prefers the child with the largest positive gain, then the lowest id. Preferred children form paths from
    the top down, of which every second edge is taken: a node that its parent takes cannot take its child.
    The depth of a node in its path comes by pointer doubling.
    """
    turned = points.select(F.col("v").alias("u"), F.col("u").alias("v"))
    hung = points.join(turned.where("v < u"), ["v", "u"], "left_anti")  # the lower id of a mutual pair is a root
    values = tree_values(hung).where("u IS NOT NULL")
    gain = F.col("score") + F.col("free") - F.col("best")
    first = values.where(gain > 0).groupBy("u").agg(F.max(F.struct(gain.alias("gain"), (-F.col("v")).alias("lower"))).alias("top"))
    paths = first.select((-F.col("top.lower")).alias("v"), "u")
    state = stored(paths.select("v", "u", F.col("u").alias("up"), F.lit(1).cast("bigint").alias("depth")), "paths")
    while True:
        above = state.select(F.col("v").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        step = state.join(above, "up", "left").select("v", "u", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("more").isNotNull().alias("moved"))
        state, seen = observed(step, "paths", moved=F.count_if("moved"))
        if not seen["moved"]:
            return state.where("depth % 2 = 1").select("v", "u")
        state = state.drop("moved")


def tree_pairs(up: list[int], score: list[int]) -> list[tuple[int, int]]:
    """(v, u): ``forest_matching`` of rows: node v points at up[v] (or at none: -1)."""
    n = len(up)
    up = [-1 if u >= 0 and up[u] == v and v < u else u for v, u in enumerate(up)]  # the lower id of a mutual pair is a root
    kids, free, best, top = [0] * n, [0] * n, [0] * n, [(0, 0)] * n
    for u in up:
        if u >= 0:
            kids[u] += 1
    order = [v for v in range(n) if not kids[v]]
    for v in order:  # grows: a node follows all its children
        best[v] = free[v] + top[v][0]
        if (u := up[v]) >= 0:
            free[u] += best[v]
            gain = score[v] + free[v] - best[v]
            if gain > 0:
                top[u] = max(top[u], (gain, -v))
            kids[u] -= 1
            if not kids[u]:
                order.append(u)
    if len(order) < n:
        raise ValueError("pointers form a cycle")
    taken, out = [False] * n, []
    for u in reversed(order):
        gain, v = top[u][0], -top[u][1]
        if gain and not taken[u]:
            taken[v] = True
            out.append((v, u))
    return out


def _columns(batches) -> list[np.ndarray]:
    """v, rank, u and score of all candidates."""
    batches = list(batches)
    return [np.concatenate([np.zeros(0, np.int64), *(b.column(c).to_numpy() for b in batches)]) for c in ("v", "rank", "u", "score")]


def matched(v: np.ndarray, rank: np.ndarray, u: np.ndarray, score: np.ndarray) -> np.ndarray:
    """``matching`` of arrays: rows v < u."""
    ids, at = np.unique(np.concatenate([v, u]), return_inverse=True)
    order = np.lexsort((u, score, v))
    v, u, score = at[: len(v)][order], at[len(v) :][order], score[order].astype(np.int64)
    free, pairs_ = np.ones(len(ids), bool), []
    for _ in range(int(rank.max()) + 1 if len(rank) else 0):
        some = free[v] & free[u]
        v, u, score = v[some], u[some], score[some]
        if not len(v):
            break
        last = np.append(np.diff(v) != 0, True)
        up, weight = np.full(len(ids), -1), np.zeros(len(ids), np.int64)
        up[v[last]], weight[v[last]] = u[last], score[last]
        new = tree_pairs(up.tolist(), weight.tolist())
        pairs_ += new
        free[[x for pair in new for x in pair]] = False
    ends = np.array(pairs_, np.int64).reshape(-1, 2)
    return ids[np.sort(ends, axis=1)]


def _matched(batches):
    """Rows (v, u) of ``matching``, of all candidates at once."""
    ends = matched(*_columns(batches))
    yield pa.record_batch([pa.array(ends[:, 0], pa.int64()), pa.array(ends[:, 1], pa.int64())], ["v", "u"])


def matching(proposals: DataFrame, rows: int | None = None) -> DataFrame:
    """pairs(v, u) from candidates(v, rank, u, score), each node at most once.

    One round per rank: every free node points at its best candidate that is still free. As scores are
    symmetric and ties go to the higher id, pointers form trees that end in a mutual pair or in a node
    without a pointer; a heaviest matching of each tree is taken (``forest_matching``). Up to
    ``TASK_CANDIDATES`` ``rows``, if their number is given, are matched by one task, which needs no job for each step.
    """
    if rows is not None and rows <= TASK_CANDIDATES:
        return proposals.select("v", "rank", "u", F.col("score").cast("bigint").alias("score")).coalesce(1).mapInArrow(_matched, "v bigint, u bigint")
    spark, done = proposals.sparkSession, None
    rounds = (proposals.agg(F.max("rank")).first()[0] or 0) + 1
    for _ in range(rounds):
        free = proposals
        if done is not None:
            taken = done.select(F.explode(F.array("v", "u")).alias("x"))
            free = free.join(taken, F.col("v") == F.col("x"), "left_anti").join(taken, F.col("u") == F.col("x"), "left_anti")
        best = free.groupBy("v").agg(F.max(F.struct("score", "u")).alias("b"))
        points, seen = observed(best.select("v", F.col("b.u").alias("u"), F.col("b.score").alias("score")), "pointers", n=F.count("*"))
        if not seen["n"]:
            break
        new = forest_matching(points).select(F.least("v", "u").alias("v"), F.greatest("v", "u").alias("u"))
        done = new if done is None else done.unionByName(new)
    return done if done is not None else spark.createDataFrame([], "v bigint, u bigint")


def orphan_pairs(nodes: DataFrame, proposals: DataFrame, pins: DataFrame, limits: Constraints) -> DataFrame:
    """(v, u, g): nodes without a first candidate, k-th smallest with k-th largest by (size, id), where both limits hold for the sums."""
    lone = nodes.join(proposals.where("rank = 0"), "v", "left_anti").join(incidence(pins).select("v", "inbound"), "v", "left")
    lone = lone.select("v", "size", F.coalesce("inbound", F.lit(0)).alias("inbound"))
    ranked = prefix_sums(lone, ["size", "v"], {}).select("v", "size", "inbound", F.col("row").alias("k"))
    n = ranked.agg(F.count("*").alias("n"))
    low = ranked.join(F.broadcast(n)).where(F.col("k") < F.floor(F.col("n") / 2))
    high = ranked.join(F.broadcast(n)).select(F.col("v").alias("u"), F.col("size").alias("u_size"), F.col("inbound").alias("u_inbound"), (F.col("n") - 1 - F.col("k")).alias("k"))
    fits = (F.col("size") + F.col("u_size") <= limits.nodes_per_part) & (F.col("inbound") + F.col("u_inbound") <= limits.inbound_per_part)
    return low.join(high, "k").where(fits).select("v", "u", F.least("v", "u").alias("g"))


def compressed(groups: DataFrame, column: str = "g") -> DataFrame:
    """Group labels made 0..G-1 in their order, by a prefix count over the distinct labels."""
    ids = prefix_sums(groups.select(column).distinct(), [column], {}).withColumnRenamed("row", "new_id")
    return groups.join(ids, column).drop(column).withColumnRenamed("new_id", column)


def group_sizes(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    return nodes.join(groups, "v").groupBy("g").agg(F.sum("size").alias("size"), F.count("*").alias("n_nodes"))


def coarse_pins(pins: DataFrame, groups: DataFrame) -> DataFrame:
    """(e, g, is_src): distinct groups of each hyperedge; a group in both roles is a destination."""
    return pins.join(groups, "v").groupBy("e", "g").agg(F.min("is_src").alias("is_src"))


def coarse_graph(graph: HGraph, groups: DataFrame) -> HGraph:
    """Groups as nodes; hyperedges keep their ids and weights."""
    nodes = group_sizes(graph.nodes, groups).select(F.col("g").alias("v"), "size")
    return HGraph(nodes, graph.edges, coarse_pins(graph.pins, groups).withColumnRenamed("g", "v"))


def coarse_neighbours(near: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, h) from neighbours(v, u)."""
    other = groups.select(F.col("v").alias("u"), F.col("g").alias("h"))
    return near.join(groups, "v").join(other, "u").where("g <> h").select("g", "h").distinct()


def uncoarsened(parts: DataFrame, groups: DataFrame) -> DataFrame:
    """parts of groups (v = g) to parts of their members."""
    return groups.join(parts.withColumnRenamed("v", "g"), "g").select("v", "p")


def grouped(graph: HGraph, limits: Constraints, nodes: int, k: int = 4, held: blocks.Held | None = None) -> tuple[DataFrame, int, dict]:
    """groups(v, g), how many they are, and figures of the level: one round of matching and orphan pairing. A group is named by its least member.

    ``nodes``: how many nodes the graph has; ``held``: the graph in blocks, if they are few.
    """
    proposals, seen = observed(candidates(graph, limits, k, held), "candidates", proposals=F.count("*"), proposers=F.count_if(F.col("rank") == 0))
    pairs_ = matching(proposals, seen["proposals"])
    if seen["proposers"] < nodes:
        pairs_ = pairs_.unionByName(orphan_pairs(graph.nodes, proposals, graph.pins, limits).select("v", "u"))
    label = pairs_.select(F.explode(F.array("v", "u")).alias("v"), F.least("v", "u").alias("g"))
    named = graph.nodes.select("v").join(label, "v", "left").select("v", F.coalesce("g", "v").alias("g"))
    groups, count = observed(named, "groups", groups=F.count_if(F.col("v") == F.col("g")), nodes=F.count("*"))
    return groups, count["groups"], {**seen, **count}


def least_members(candidates_: list[np.ndarray], ids: np.ndarray, size: np.ndarray, inbound: np.ndarray, most_size: int, most_inbound: int) -> tuple[np.ndarray, int]:
    """The place of the least member of each node's group, as ``grouped`` (matches and ``orphan_pairs``), and how many nodes have a candidate."""
    v, rank, _, _ = candidates_
    pairs_ = np.searchsorted(ids, matched(*candidates_))
    proposes = np.zeros(len(ids), bool)
    proposes[np.searchsorted(ids, v[rank == 0])] = True
    lone = np.flatnonzero(~proposes)
    lone = lone[np.lexsort((lone, size[lone]))]
    ends = np.stack([lone, lone[::-1]], axis=1)[: len(lone) // 2]
    ends = ends[(size[ends].sum(axis=1) <= most_size) & (inbound[ends].sum(axis=1) <= most_inbound)]
    label = np.arange(len(ids))
    for some in (pairs_, ends):
        label[some] = some.min(axis=1, keepdims=True)
    return label, int(proposes.sum())


def grouped_near(held: blocks.Held, limits: Constraints, k: int = 4) -> tuple[np.ndarray, int, dict]:
    """``grouped`` of a graph of few nodes in one job: the place of each node's group, groups in the order of their least members.

    One task matches all candidates, at most ``TASK_CANDIDATES``.
    """
    given = held.ids, held.size, held.inbound, limits.nodes_per_part, limits.inbound_per_part

    def labelled(batches):
        rows = _columns(batches)
        label, proposers = least_members(rows, *given)
        yield pa.record_batch([pa.array(label), pa.array(np.full(len(label), len(rows[0]))), pa.array(np.full(len(label), proposers))], ["label", "proposals", "proposers"])

    out = candidates(None, limits, k, held).repartition(1).mapInArrow(labelled, "label bigint, proposals bigint, proposers bigint").toArrow()
    out = out if out.num_rows else next(labelled([]))  # no pins, no task
    least, at = np.unique(out.column("label").to_numpy(), return_inverse=True)
    return at, len(least), {"proposals": out.column("proposals")[0].as_py(), "proposers": out.column("proposers")[0].as_py(), "groups": len(least), "nodes": len(at)}
