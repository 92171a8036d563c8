"""Queries over the operators, on hypergraphs derived from the relational tables.

Stand-ins where an operator needs a partition, a grouping, a placement or moves are fixed rules on
ids, so that SQL can state them: parts v % 8, groups v div 2, part p at cell (p % 8, p div 8), and for moves
every fifth node from v % 8 to (v + 3) % 8.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import curves, u32
from ..operators import coarsen, hardware, initial, metrics, ordering, placement, refine, structure
from ..operators.metrics import Constraints
from .. import schema
from ..schema import HGraph
from ..sources import files
from ..sources.generate import scaled
from ..sources.relational import basket, supply, user_events
from ..tables import shared_dir, stored
from .partition import KWAY_NODES, partition

LIMITS = Constraints(300, 12_000, 64)
PAIR_LIMITS = Constraints(64, 60, 4096)
HW = hardware.HARDWARE["loihi64"]


def parts_of(graph: HGraph, k: int = 8) -> DataFrame:
    return graph.nodes.select("v", (F.col("v") % k).alias("p"))


def groups_of(graph: HGraph) -> DataFrame:
    return graph.nodes.select("v", F.floor(F.col("v") / 2).cast("bigint").alias("g"))


def moves_of(graph: HGraph) -> DataFrame:
    moves = graph.nodes.where("v % 5 = 0").select("v", (F.col("v") % 8).alias("src"), ((F.col("v") + 3) % 8).alias("dst"), ((F.col("v") * 7919) % 10007).alias("gain"))
    return refine.ranked(moves)


def raw_pins(spark, sf_dir) -> DataFrame:
    """Every line a pin: the first of an order (by line number, then part) is the source, repeated parts stay."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber")
    first = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")) == 1
    return lines.select(F.col("l_orderkey").alias("e"), F.col("l_partkey").alias("v"), first.alias("is_src"))


def quotient64(spark, sf_dir, k: int = 64) -> tuple[HGraph, DataFrame]:
    """The directed basket graph between k parts, and their places."""
    graph = basket(spark, sf_dir, directed=True)
    rows = stored(metrics.quotient(graph, parts_of(graph, k)), "quotient")
    pin = lambda c, role: rows.select("e", F.explode(c).alias("v"), F.lit(role).alias("is_src"))
    nodes = spark.range(k).select(F.col("id").alias("v"), F.lit(1).cast("bigint").alias("size"))
    return HGraph(nodes, rows.select("e", "w"), pin("srcs", True).unionByName(pin("dsts", False))), places64(spark, k)


def places64(spark, k: int = 64) -> DataFrame:
    nodes = spark.range(k).select(F.col("id").alias("v"))
    return nodes.select("v", (F.col("v") % 8).cast("int").alias("x"), F.floor(F.col("v") / 8).cast("int").alias("y"))


def six(column: str) -> F:
    return F.round(F.col(column).cast("double"), 6).alias(column)


QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def graph_stats(spark, sf_dir):
    return structure.stats(basket(spark, sf_dir))


for _rule in (0, 1, 2):
    QUERIES[f"pins_dedupe_rule{_rule}"] = lambda spark, sf_dir, rule=_rule: structure.dedupe(raw_pins(spark, sf_dir), rule)


@query
def incidence_counts(spark, sf_dir):
    return structure.incidence(basket(spark, sf_dir, directed=True).pins)


@query
def edge_sizes(spark, sf_dir):
    return structure.edge_sizes(basket(spark, sf_dir, directed=True).pins)


@query
def neighbors_degree(spark, sf_dir):
    return structure.neighbourhood_sizes(basket(spark, sf_dir).pins)


@query
def neighbors_sample_max(spark, sf_dir):
    return structure.sampled_max_neighbourhood(basket(spark, sf_dir))


def _roles(graph: HGraph, e: int) -> DataFrame:
    """Sources, destinations and members of a hyperedge."""
    parts = {"source": structure.sources(graph.pins, e), "destination": structure.destinations(graph.pins, e), "member": structure.members(graph.pins, e)}
    return reduce(DataFrame.unionByName, [df.select("v", F.lit(role).alias("role")) for role, df in parts.items()])


@query
def hedge_roles(spark, sf_dir):
    return _roles(basket(spark, sf_dir, directed=True), 7)


@query
def incident_hedges(spark, sf_dir):
    """Inbound, outbound and all hyperedges of a node."""
    pins = basket(spark, sf_dir, directed=True).pins
    kinds = {"inbound": True, "outbound": False, "any": None}
    return reduce(DataFrame.unionByName, [structure.incident(pins, 7, inbound).select("e", F.lit(kind).alias("kind")) for kind, inbound in kinds.items()])


@query
def supply_neighbors(spark, sf_dir):
    """Few very large hyperedges: the skewed self-join."""
    return structure.neighbourhood_sizes(supply(spark, sf_dir).pins)


@query
def relabel_nodes(spark, sf_dir):
    graph = basket(spark, sf_dir)
    ids = graph.nodes.select("v", (F.col("v") * 2 + 7).alias("new_id"))
    return structure.relabel(graph, ids).pins.select("e", "v")


@query
def pairwise_overlap(spark, sf_dir):
    graph = basket(spark, sf_dir)
    out = structure.overlap(graph.pins, graph.edges.agg(F.count("*").alias("n")))
    return out.select("e", "shared", six("avg_overlap"))


@query
def binning(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_extendedprice")
    return structure.binned(rows, "l_extendedprice", 8, 0.0, 100000.0).groupBy("bin").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query
def binning_places(spark, sf_dir):
    """By counts and places: each bin's rows lie side by side."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_extendedprice")
    placed = structure.scattered(rows, "l_extendedprice", 8, 0.0, 100000.0)
    return placed.groupBy("bin").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"), F.count_distinct("place").alias("places"))


@query
def hash_values(spark, sf_dir):
    """The integer hashes and the size bucket of every node id."""
    v = F.col("v")
    hashes = {"h32": u32.hash_u32(v), "mad": u32.hash_u32_mad(v), "linear": u32.hash_u32_linear(v), "bucket": u32.size_bucket(v).cast("bigint")}
    rows = basket(spark, sf_dir).nodes.select("v", *[c.alias(n) for n, c in hashes.items()], F.lpad(F.lower(F.hex(u32.hash_u64(v))), 16, "0").alias("h64"))
    return rows


def _cut(spark, sf_dir):
    graph = basket(spark, sf_dir)
    return metrics.cut_metrics(graph, parts_of(graph))


@query
def connectivity_km1(spark, sf_dir):
    return _cut(spark, sf_dir).select("connectivity")


@query
def cut_net(spark, sf_dir):
    return _cut(spark, sf_dir).select("cut_net")


@query
def soed(spark, sf_dir):
    return _cut(spark, sf_dir).select("soed")


@query
def hedge_overlap_reuse(spark, sf_dir):
    graph = basket(spark, sf_dir, directed=True)
    return metrics.overlap_means(graph.pins, parts_of(graph)).select(six("ar_mean"), six("geo_mean"))


@query
def part_loads(spark, sf_dir):
    graph = basket(spark, sf_dir, directed=True)
    return metrics.loads(graph, parts_of(graph))


@query
def partition_validity(spark, sf_dir):
    graph = basket(spark, sf_dir, directed=True)
    return metrics.validity(graph, parts_of(graph), LIMITS)


@query
def constraint_fit(spark, sf_dir):
    return metrics.fit(basket(spark, sf_dir, directed=True), LIMITS)


@query
def kway_validity(spark, sf_dir):
    graph = basket(spark, sf_dir, directed=True)
    return metrics.validity(graph, parts_of(graph), Constraints.kway(graph.nodes.count(), 8, 0.03))


@query
def hardware_fit(spark, sf_dir):
    """The quotient on a chip: a core for each part."""
    graph, _ = quotient64(spark, sf_dir)
    return metrics.fit(graph, hardware.HARDWARE["truenorth"].constraints, already_partitioned=True)


@query
def sequential_partition(spark, sf_dir):
    return metrics.sequential_parts(basket(spark, sf_dir, directed=True), Constraints(64, 1000, 1 << 20))


def _quotient(spark, sf_dir, squish):
    graph = basket(spark, sf_dir, directed=True)
    out = metrics.quotient(graph, parts_of(graph), squish=squish)
    return out.withColumn("srcs", F.concat_ws(",", "srcs")).withColumn("dsts", F.concat_ws(",", "dsts"))


@query
def quotient_edges(spark, sf_dir):
    return _quotient(spark, sf_dir, False)


@query
def quotient_squished(spark, sf_dir):
    return _quotient(spark, sf_dir, True)


@query
def squished_users(spark, sf_dir):
    """Very few distinct nodes: most hyperedges are equal and merge."""
    graph = user_events(spark, sf_dir)
    return initial.deduped_hedges(graph.pins, graph.edges).select(F.concat_ws(",", "members").alias("members"), "w")


@query
def quotient_totals(spark, sf_dir):
    graph = basket(spark, sf_dir, directed=True)
    return metrics.quotient_metrics(metrics.quotient_graph(graph, parts_of(graph)))


@query
def candidates_topk(spark, sf_dir):
    return coarsen.candidates(basket(spark, sf_dir, directed=True), PAIR_LIMITS, 4)


@query
def candidate_symmetry(spark, sf_dir):
    """How many candidates there are by rank, and how many of them break the symmetry."""
    found = stored(candidates_topk(spark, sf_dir))
    broken = coarsen.asymmetric(found).groupBy("rank").agg(F.count("*").alias("b"))
    return found.groupBy("rank").agg(F.count("*").alias("n"), F.count_distinct("u").alias("partners")).join(broken, "rank", "left").select("rank", "n", "partners", F.coalesce("b", F.lit(0)).alias("broken"))


@query
def forest_matching(spark, sf_dir):
    """Of the binary tree in which node v hangs on v div 2, with a fixed score for each edge: a heaviest matching."""
    nodes = basket(spark, sf_dir).nodes.where("v > 1")
    return coarsen.forest_matching(nodes.select("v", F.floor(F.col("v") / 2).cast("bigint").alias("u"), (F.col("v") * 7919 % 101 + 1).alias("score")))


@query
def presets(spark, sf_dir):
    """How every part of v % 64 fits each named set of constraints."""
    graph = basket(spark, sf_dir, directed=True)
    loads = stored(metrics.loads(graph, parts_of(graph, 64)), "loads")

    def over(name: str) -> DataFrame:
        limits = metrics.preset(name)
        full = F.count_if((F.col("size") > limits.nodes_per_part) | (F.col("inbound") > limits.inbound_per_part))
        return loads.agg(full.alias("over"), (F.count("*") <= limits.max_parts).alias("enough")).select(F.lit(name).alias("preset"), "over", "enough")

    return reduce(DataFrame.unionByName, map(over, metrics.PRESETS))


@query
def integrity(spark, sf_dir):
    """Hyperedges that keep the rules of a directed graph, and those of all lines that break one."""
    pins, graph = raw_pins(spark, sf_dir), basket(spark, sf_dir, directed=True)
    return schema.violations(HGraph(graph.nodes.where("v % 10 <> 3"), graph.edges.where("e % 10 <> 3"), structure.dedupe(pins, 2)), require_source=True)


@query
def matched_pairs(spark, sf_dir):
    return coarsen.matching(stored(coarsen.candidates(basket(spark, sf_dir, directed=True), PAIR_LIMITS, 4)))


@query
def orphan_pairs(spark, sf_dir):
    graph = basket(spark, sf_dir, directed=True)
    nodes = graph.nodes.select("v", (F.col("v") % 9 + 1).alias("size"))
    proposals = nodes.where("v % 3 <> 0").select("v", F.lit(0).alias("rank"))
    return coarsen.orphan_pairs(nodes, proposals, graph.pins, Constraints(10, 50, 4096))


@query
def group_compress(spark, sf_dir):
    graph = basket(spark, sf_dir)
    return coarsen.compressed(graph.nodes.select("v", (F.floor(F.col("v") / 3) * 5 + 2).cast("bigint").alias("g")))


@query
def group_sizes(spark, sf_dir):
    graph = basket(spark, sf_dir)
    return coarsen.group_sizes(graph.nodes, groups_of(graph))


@query
def coarsen_hedges(spark, sf_dir):
    graph = basket(spark, sf_dir, directed=True)
    return coarsen.coarse_pins(graph.pins, groups_of(graph))


@query
def coarsen_incidence(spark, sf_dir):
    graph = basket(spark, sf_dir, directed=True)
    return structure.incidence(coarsen.coarse_graph(graph, groups_of(graph)).pins)


@query
def coarsen_neighbors(spark, sf_dir):
    graph = basket(spark, sf_dir)
    return coarsen.coarse_neighbours(structure.neighbours(graph.pins), groups_of(graph))


@query
def uncoarsen(spark, sf_dir):
    graph = basket(spark, sf_dir)
    groups = groups_of(graph)
    return coarsen.uncoarsened(groups.select(F.col("g").alias("v"), (F.col("g") % 8).alias("p")).distinct(), groups)


@query
def pins_per_partition(spark, sf_dir):
    graph = basket(spark, sf_dir, directed=True)
    return refine.pins_per_part(graph.pins, parts_of(graph))


@query
def fm_gains(spark, sf_dir):
    graph = basket(spark, sf_dir, directed=True)
    return refine.gains(graph, parts_of(graph), LIMITS)


@query
def fm_gains_incc(spark, sf_dir):
    """The rule that encourages nearly empty parts, at half the size."""
    graph = basket(spark, sf_dir, directed=True)
    return refine.gains(graph, parts_of(graph), Constraints(300, 12_000, 64), kway=False, discount=2).select("v", "src", "dst", six("gain"))


@query
def move_ranks(spark, sf_dir):
    return moves_of(basket(spark, sf_dir))


@query
def move_sequence(spark, sf_dir):
    """Real gains in the order of a round, with the totals of every prefix."""
    graph = basket(spark, sf_dir, directed=True)
    graph, parts = HGraph(graph.nodes, graph.edges, stored(graph.pins, "pins")), parts_of(graph)
    ppp = stored(refine.pins_per_part(graph.pins, parts), "ppp")
    moves = stored(refine.ranked(stored(refine.gains(graph, parts, LIMITS, ppp), "gains")), "ranked")
    sizes = parts.groupBy("p").agg(F.count("*").alias("size"))
    totals = refine.prefix_totals(graph.pins.join(graph.edges, "e"), graph.nodes, moves, ppp, sizes, LIMITS)
    return moves.select("v", "src", "dst", "rank").join(totals, "rank").select("v", "src", "dst", "rank", F.col("gain").cast("bigint").alias("total"), "excess", "broken")


@query
def chain_moves(spark, sf_dir):
    graph = basket(spark, sf_dir)
    return refine.chained(moves_of(graph).drop("rank"), graph.nodes)


@query
def cascade_gain(spark, sf_dir):
    graph = basket(spark, sf_dir)
    return refine.cascade(graph, moves_of(graph), refine.pins_per_part(graph.pins, parts_of(graph)))


def _size_events(spark, sf_dir):
    graph = basket(spark, sf_dir)
    sizes = parts_of(graph).groupBy("p").agg(F.count("*").alias("size"))
    cap = Constraints(max(1, graph.nodes.count() // 8 + 3), 1, 8)
    return refine.size_excess(graph.nodes, moves_of(graph), sizes, cap)


@query
def size_events_valid(spark, sf_dir):
    return _size_events(spark, sf_dir)


def _inbound_events(spark, sf_dir):
    graph = basket(spark, sf_dir, directed=True)
    ppp = refine.pins_per_part(graph.pins, parts_of(graph))
    cap = ppp.where("n_in > 0").groupBy("p").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return refine.inbound_breaks(graph.pins, moves_of(graph), ppp, Constraints(1, max(1, cap - 5), 8))


@query
def inbound_events_valid(spark, sf_dir):
    return _inbound_events(spark, sf_dir)


def _prefixes(spark, sf_dir):
    """Totals of the fixed moves: gains on the undirected graph, sizes and inbound hyperedges on the directed one."""
    graph, directed = basket(spark, sf_dir), basket(spark, sf_dir, directed=True)
    moves, parts = stored(moves_of(graph), "moves"), parts_of(graph)
    gains = refine.cascade(graph, moves, refine.pins_per_part(graph.pins, parts))
    sizes = parts.groupBy("p").agg(F.count("*").alias("size"))
    excess = refine.size_excess(graph.nodes, moves, sizes, Constraints(max(1, graph.nodes.count() // 8 + 3), 1, 8))
    directed = HGraph(directed.nodes, directed.edges, stored(directed.pins, "pins"))
    ppp = stored(refine.pins_per_part(directed.pins, parts), "ppp")
    cap = ppp.where("n_in > 0").groupBy("p").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return graph, refine.prefixes(gains, excess, refine.inbound_breaks(directed.pins, moves, ppp, Constraints(1, max(1, cap - 5), 8)))


@query
def best_prefix(spark, sf_dir):
    return refine.best_prefix(_prefixes(spark, sf_dir)[1])


@query
def best_valid_prefix(spark, sf_dir):
    return refine.best_valid_prefix(_prefixes(spark, sf_dir)[1])


@query
def apply_moves(spark, sf_dir):
    graph = basket(spark, sf_dir)
    return refine.applied(parts_of(graph), moves_of(graph), 99)


@query
def harmonic_score(spark, sf_dir):
    return initial.harmonic_scores(basket(spark, sf_dir)).select("e", six("ratio"))


@query
def prune_hedges(spark, sf_dir):
    return initial.pruned(basket(spark, sf_dir)).select("e", six("w"))


@query
def dedupe_hedges(spark, sf_dir):
    graph = basket(spark, sf_dir)
    return initial.deduped_hedges(graph.pins, graph.edges).select(F.concat_ws(",", "members").alias("members"), "w")


@query
def pack_small_parts(spark, sf_dir):
    graph = basket(spark, sf_dir, directed=True)
    rows = metrics.loads(graph, parts_of(graph, 97)).select(F.col("p").alias("id"), "size", "inbound")
    return initial.packed(rows, Constraints(120, 4000, 97))


@query
def random_partition(spark, sf_dir):
    return initial.random_parts(basket(spark, sf_dir).nodes, 8)


@query
def jacobi_accept(spark, sf_dir):
    """What the parts take of each node's best move, with a tenth more room than an even share."""
    graph = basket(spark, sf_dir, directed=True)
    pins = stored(graph.pins.join(graph.edges, "e"), "pins")
    nodes = stored(graph.nodes.join(parts_of(graph), "v"), "nodes")
    wanted = initial.offers(pins, nodes, refine.pins_per_part(pins, nodes.select("v", "p")))
    return initial.accepted(wanted, initial.part_sizes(nodes), Constraints.kway(nodes.count(), 8, 0.1).nodes_per_part)


@query
def state_hash(spark, sf_dir):
    return initial.state_hash(parts_of(basket(spark, sf_dir)))


@query
def split_random_half(spark, sf_dir):
    return ordering.split_halves(parts_of(basket(spark, sf_dir)))


@query
def split_cost(spark, sf_dir):
    graph = basket(spark, sf_dir)
    return ordering.split_cost(graph.pins, graph.edges, parts_of(graph))


@query
def labelprop_gain(spark, sf_dir):
    graph = basket(spark, sf_dir)
    return ordering.label_gains(graph.pins, graph.edges, parts_of(graph))


@query
def labelprop_cascade(spark, sf_dir):
    graph = basket(spark, sf_dir)
    gains = ordering.label_gains(graph.pins, graph.edges, parts_of(graph)).withColumn("gain", (F.col("v") * 7919) % 1009)
    return ordering.pair_cascade(graph.pins, graph.edges, parts_of(graph), ordering.paired_moves(gains))


@query
def labelprop_prefix(spark, sf_dir):
    """The best prefix of the pairs that each two sibling parts swap."""
    return ordering.best_pairs(labelprop_cascade(spark, sf_dir))


@query
def sibling_strength(spark, sf_dir):
    graph = basket(spark, sf_dir)
    return ordering.sibling_strength(graph.pins, graph.edges, parts_of(graph))


@query
def segment_reverse(spark, sf_dir):
    order = basket(spark, sf_dir).nodes.select("v", F.floor(F.col("v") / 10).cast("bigint").alias("p"), F.col("v").alias("idx"))
    return ordering.reversed_segments(order, order.select(F.col("p").alias("h"), (F.col("p") % 3 == 0).alias("reverse")).distinct())


@query
def sequence_span(spark, sf_dir):
    graph = basket(spark, sf_dir)
    return ordering.span(graph.pins, graph.edges, graph.nodes.select("v", F.col("v").alias("idx")))


def _along(curve: str):
    """Query: every part of the table at its cell of the curve, on the smallest square lattice with a power of two as side."""

    def run(spark, sf_dir):
        nodes = basket(spark, sf_dir).nodes
        n = nodes.count()
        order = ordering.numbered(nodes.select("v"))
        side = 1 << math.isqrt(max(n - 1, 0)).bit_length()
        return order.join(curves.curve(spark, curve, n, side, side), "idx").select("v", "x", "y")

    return run


for _name, _curve in (("snake", "snak"), ("zorder", "zord"), ("quad", "quad"), ("hilbert", "hilb")):
    QUERIES[f"curve_{_name}"] = _along(_curve)


def _routes(spark, sf_dir):
    """The quotient between 64 parts with equal hyperedges merged (all sums of weights stay), its places and routes."""
    graph, at = _squished(spark, sf_dir), places64(spark)
    return graph, at, hardware.routes(graph.pins, graph.edges, at)


@query
def energy(spark, sf_dir):
    return hardware.energy(_routes(spark, sf_dir)[2], HW).select(F.round("energy", 3).alias("energy"))


@query
def avg_latency(spark, sf_dir):
    graph, _, routed = _routes(spark, sf_dir)
    return hardware.latency(routed, graph.pins, graph.edges, HW).select(six("avg_latency"))


@query
def max_latency(spark, sf_dir):
    graph, _, routed = _routes(spark, sf_dir)
    return hardware.latency(routed, graph.pins, graph.edges, HW).select(six("max_latency"))


@query
def avg_congestion(spark, sf_dir):
    return hardware.average_congestion(_routes(spark, sf_dir)[2], HW).select(six("congestion"), six("congestion_ref"))


@query
def max_congestion(spark, sf_dir):
    return hardware.max_congestion(_routes(spark, sf_dir)[2]).select(F.round("max_congestion", 3).alias("max_congestion"), F.round("max_congestion_ref", 3).alias("max_congestion_ref"))


@query
def max_src_dst(spark, sf_dir):
    return hardware.max_source_distance(_routes(spark, sf_dir)[2])


@query
def placement_validity(spark, sf_dir):
    at = basket(spark, sf_dir).nodes.select("v", (F.col("v") % 70).cast("int").alias("x"), F.floor(F.col("v") / 75).cast("int").alias("y"))
    return hardware.placement_validity(at, HW)


@query
def forces(spark, sf_dir):
    graph, at, _ = _routes(spark, sf_dir)
    return placement.forces(graph.pins, graph.edges, at)


@query
def tensions_topk(spark, sf_dir):
    graph, at, _ = _routes(spark, sf_dir)
    return placement.tensions(placement.forces(graph.pins, graph.edges, at), at, replace(HW, width=10, height=8), 2)


@query
def exclusive_swaps(spark, sf_dir):
    graph, at, _ = _routes(spark, sf_dir)
    return placement.exclusive(placement.tensions(placement.forces(graph.pins, graph.edges, at), at, replace(HW, width=10, height=8), 2), at)


@query
def mst_span(spark, sf_dir):
    graph, at, _ = _routes(spark, sf_dir)
    return hardware.weighted_tree_span(graph.pins, graph.edges, at)


@query
def hull_locality(spark, sf_dir):
    graph, at = quotient64(spark, sf_dir)
    return hardware.locality(graph.pins, graph.edges, at).select(*map(six, ("ar_mean", "geo_mean", "ar_mean_weighted", "geo_mean_weighted")))


@query
def placement_metrics(spark, sf_dir):
    """All placement metrics in one row."""
    graph, at = quotient64(spark, sf_dir)
    row = hardware.all_metrics(graph.pins, graph.edges, at, HW)
    return row.select("valid", F.round("energy", 3).alias("energy"), six("avg_latency"), six("max_latency"), six("congestion"), F.round("max_congestion", 3).alias("max_congestion"), six("ar_mean"), "max_distance", "tree_span")


def _ranked_swaps(placed: DataFrame) -> DataFrame:
    """Swaps of parts 2k and 2k + 1 for odd k, ranked by k, as (lo, hi, x, y, rank)."""
    rows = placed.where("v % 4 = 2").select(F.col("v").alias("lo"), (F.col("v") + 1).alias("hi"), F.floor(F.col("v") / 4).cast("bigint").alias("rank"))
    return rows.join(placed.select(F.col("v").alias("hi"), "x", "y"), "hi").select("lo", "hi", "x", "y", "rank")


@query
def swap_gains(spark, sf_dir):
    graph, at, _ = _routes(spark, sf_dir)
    return placement.swap_cascade(graph.pins, graph.edges, at, _ranked_swaps(at))


@query
def apply_swaps(spark, sf_dir):
    """Every part of the table in a row of eight cells; the second and third of each four trade places with their partners."""
    at = basket(spark, sf_dir).nodes.select("v", (F.col("v") % 8).cast("int").alias("x"), F.floor(F.col("v") / 8).cast("int").alias("y"))
    return placement.swapped(at, _ranked_swaps(at))


def _squished(spark, sf_dir, k=64):
    """The quotient between k parts with equal hyperedges merged, as a placer expects it."""
    graph = basket(spark, sf_dir, directed=True)
    quotient = metrics.quotient_graph(graph, parts_of(graph, k))
    return HGraph(stored(quotient.nodes), stored(quotient.edges), stored(quotient.pins))


@query
def locality_order(spark, sf_dir):
    return ordering.locality_order(_squished(spark, sf_dir))


def _scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}"


def _pins_back(graph: HGraph) -> DataFrame:
    return graph.pins.join(graph.edges, "e").select("e", "v", "is_src", F.col("w").cast("double").alias("w"))


def _written_and_read(spark, graph: HGraph, kind: str) -> DataFrame:
    path = _scratch(spark, f"round-{uuid.uuid4().hex}.{kind}")
    files.write_hypergraph(graph, path)
    return _pins_back(files.read_hypergraph(spark, path))


@query
def snn_round_trip(spark, sf_dir):
    """Written as .snn (one source each) and read again: hyperedges are numbered in their order."""
    return _written_and_read(spark, basket(spark, sf_dir, directed=True), "snn")


@query
def axh_round_trip(spark, sf_dir):
    """Many sources: every node of an id that 3 divides is one, too."""
    graph = basket(spark, sf_dir, directed=True)
    pins = graph.pins.select("e", "v", (F.col("is_src") | (F.col("v") % 3 == 0)).alias("is_src"))
    kept = pins.groupBy("e").agg(F.min("is_src").alias("all_src")).where("NOT all_src").select("e")
    return _written_and_read(spark, HGraph(graph.nodes, graph.edges.join(kept, "e", "left_semi"), pins.join(kept, "e", "left_semi")), "axh")


@query
def hmetis_round_trip(spark, sf_dir):
    """Weights come back times 1024, hyperedges of one pin not at all."""
    return _written_and_read(spark, basket(spark, sf_dir), "hgr")


@query
def partitioning_round_trip(spark, sf_dir):
    graph, path = basket(spark, sf_dir), _scratch(spark, f"round-{uuid.uuid4().hex}.part")
    files.write_partitioning(parts_of(graph), path)
    return files.read_partitioning(spark, path, graph.nodes.count())


@query
def placement_round_trip(spark, sf_dir):
    path = _scratch(spark, f"round-{uuid.uuid4().hex}.bin")
    files.write_placement(basket(spark, sf_dir).nodes.select("v", (F.col("v") % 64).cast("int").alias("x"), (-F.floor(F.col("v") / 64)).cast("int").alias("y")), path)
    return files.read_placement(spark, path)


@query
def scaled_counts(spark, sf_dir):
    """Sizes of a graph scaled by 1.5: hyperedges are as many as asked for, none has fewer than two pins."""
    given = basket(spark, sf_dir, directed=True)
    big = scaled(given, 1.5)
    sizes = big.pins.groupBy("e").agg(F.count("*").alias("n"))
    return big.nodes.agg(F.count("*").alias("n_nodes")).join(big.edges.agg(F.count("*").alias("n_hedges"))).join(sizes.agg((F.min("n") > 1).alias("all_joined")))  # one row each


@query
def feed_forward(spark, sf_dir):
    return ordering.feed_forward_order(basket(spark, sf_dir, directed=True))


@query
def place(spark, sf_dir):
    return placement.place(_squished(spark, sf_dir), HW)


#: Partitions by session and folder, so that the queries which look at one don't make it again.
_made: dict = {}


def _partitioned(spark, sf_dir, name: str) -> tuple[HGraph, Constraints, DataFrame]:
    """The whole basket graph, written once for the partition and what is asked of it, partitioned with the operator's defaults."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        graph = basket(spark, sf_dir, directed=True)
        graph = HGraph(stored(graph.nodes, "nodes"), stored(graph.edges, "edges"), stored(graph.pins, "pins"))
        if name == "kway":
            n = graph.nodes.count()
            limits = Constraints.kway(n, 4, 0.1)
            # a third of the nodes at most, so that tables of any size are coarsened and refined
            parts = partition(graph, k=4, eps=0.1, kway_nodes=min(KWAY_NODES, n // 3))
        else:
            limits = metrics.preset("truenorth")
            parts = partition(graph, constraints="truenorth")
        _made[key] = graph, limits, parts
    return _made[key]


@query
def partition_kway(spark, sf_dir):
    return _partitioned(spark, sf_dir, "kway")[2]


@query
def partition_incc(spark, sf_dir):
    return _partitioned(spark, sf_dir, "incc")[2]


def _checked(spark, sf_dir, name: str) -> DataFrame:
    """Of the partition: its nodes, whether it is valid, and whether its connectivity is below that of taking nodes in id order."""
    graph, limits, parts = _partitioned(spark, sf_dir, name)
    # what it is compared with may need more parts than the limits have; whether the partition does, ``valid`` tells
    plain = metrics.sequential_parts(graph, replace(limits, max_parts=2**31 - 1))
    cost = lambda p, c: metrics.cut_metrics(graph, p).select(F.col("connectivity").alias(c))
    rows = parts.join(graph.nodes, "v").agg(F.count("*").alias("n_nodes"), F.count_distinct("v").alias("n_distinct"))
    row = rows.join(metrics.validity(graph, parts, limits)).join(cost(parts, "ours")).join(cost(plain, "theirs"))  # one row each
    return row.select("n_nodes", "n_distinct", "valid", (F.col("ours") < F.col("theirs")).alias("better"))


@query
def partition_kway_checked(spark, sf_dir):
    return _checked(spark, sf_dir, "kway")


@query
def partition_incc_checked(spark, sf_dir):
    return _checked(spark, sf_dir, "incc")
