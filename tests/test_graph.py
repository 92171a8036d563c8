"""Operators on small graphs against brute force, file round trips, and plans by their invariants."""

import heapq
import itertools
import random
import struct
import types

import numpy as np
import pyarrow as pa
import pytest

from hyperweave.functions import curves, geometry, u32
from hyperweave.operators import blocks, coarsen, hardware, initial, metrics, ordering, placement, refine, structure, walks
from hyperweave.operators.metrics import Constraints
from hyperweave.plans import queries
from hyperweave.plans.grade import grade
from hyperweave.plans.partition import partition
from hyperweave.schema import GraphError, HGraph, validate
from hyperweave.sources import binary, files, relational
from hyperweave.sources.generate import scaled
from hyperweave.streaming.metrics import watch
from hyperweave.tables import running_sums
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
PATH4 = (4, [([0], [1], 1), ([1], [2], 1), ([2], [3], 1)])


def random_hedges(n, m, seed, directed=True):
    rng = random.Random(seed)
    out = []
    for _ in range(m):
        vs = rng.sample(range(n), rng.randrange(2, min(6, n)))
        out.append((vs[:1] if directed else [], vs[1:] if directed else vs, rng.randrange(1, 9)))
    return out


def parts_df(spark, part):
    return spark.createDataFrame(list(enumerate(part)), "v bigint, p bigint")


def brute_cut(hedges, part):
    km1 = cut = soed = 0
    for s, d, w in hedges:
        vs = set(s) | set(d)
        lam = len({part[v] for v in vs})
        km1, cut, soed = km1 + w * (lam - 1), cut + w * (lam > 1), soed + w * (lam - 1) * len(vs)
    return km1, cut, soed


def test_dedupe_rules(spark):
    pins = HGraph.of(spark, 3, [([0, 0, 1], [1, 2, 2], 1)]).pins
    rows = lambda rule: sorted((r.v, r.is_src) for r in structure.dedupe(pins, rule).collect())
    assert rows(0) == [(0, True), (1, False), (1, True), (2, False)]
    assert rows(1) == [(0, True), (1, False), (2, False)]
    assert rows(2) == [(0, True), (1, True), (2, False)]


def test_validation(spark):
    validate(HGraph.of(spark, *PATH4), require_source=True)
    with pytest.raises(GraphError, match="destination"):
        validate(HGraph.of(spark, 2, [([0], [], 1)]))
    with pytest.raises(GraphError, match="unknown"):
        validate(HGraph.of(spark, 2, [([0], [5], 1)]))
    with pytest.raises(GraphError):
        Constraints(0, 1, 1)
    with pytest.raises(GraphError):
        metrics.preset("nothing")
    assert metrics.PRESETS["loihi84"].max_parts == 84 * 84


def test_cut_metrics_and_quotient(spark):
    hedges = random_hedges(12, 30, 1)
    part = [v % 4 for v in range(12)]
    graph, parts = HGraph.of(spark, 12, hedges), parts_df(spark, part)
    row = metrics.cut_metrics(graph, parts).first()
    assert (row.connectivity, row.cut_net, row.soed) == brute_cut(hedges, part)
    quotient = metrics.quotient_graph(graph, parts)
    assert metrics.quotient_metrics(quotient).first().connectivity == row.connectivity
    kept = metrics.quotient_graph(graph, parts, squish=False)
    assert metrics.quotient_metrics(kept).first().connectivity == row.connectivity
    multi = HGraph.of(spark, 3, [([0, 1], [2], 1)])
    rows = metrics.quotient(multi, parts_df(spark, [0, 1, 0])).collect()
    assert [(r.srcs, r.dsts) for r in rows] == [([0, 1], [])]
    with pytest.raises(GraphError):
        metrics.quotient_graph(multi, parts_df(spark, [0, 2, 0]))


def test_large_hyperedges_are_joined_in_blocks(spark):
    pins = HGraph.of(spark, 30, [([], list(range(30)), 1), ([], [0, 1], 1)]).pins
    plain = sorted((r.e, r.v, r.u) for r in structure.pairs(pins).collect())
    cut = sorted((r.e, r.v, r.u) for r in structure.pairs(pins, large=4).collect())
    assert plain == cut and len(cut) == 30 * 29 + 2


def test_noise_and_hashes(spark):
    def noise(a, b):
        m = 0xFFFFFFFF
        lo, hi = min(a, b), max(a, b)
        x = lo * 0x9E3779B1 & m
        x ^= (hi + 0x85EBCA6B + (x << 6 & m) + (x >> 2)) & m
        x = (x ^ x >> 16) * 0x7FEB352D & m
        x = (x ^ x >> 13) * 0x9E3779B1 & m
        return (x ^ x >> 16) & 63

    def h64(x):
        m = (1 << 64) - 1
        x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & m
        x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 & m
        x ^= x >> 33
        return x - (1 << 64) if x >> 63 else x

    rng = random.Random(2)
    rows = [(rng.randrange(1 << 32), rng.randrange(1 << 32)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    for r in df.select("a", "b", u32.noise(F.col("a"), F.col("b")).alias("n"), u32.noise(F.col("b"), F.col("a")).alias("m"), u32.hash_u64(F.col("a") * 2147483647).alias("h"), u32.size_bucket(F.col("a")).alias("s"), u32.hash_u32(F.col("a")).alias("q")).collect():
        assert r.n == r.m == noise(r.a, r.b) and r.h == h64(r.a * 2147483647) and r.s == max(r.a.bit_length() - 1, 0) and 0 <= r.q < 1 << 32


def test_candidates_and_matching(spark):
    hedges = random_hedges(14, 40, 3)
    graph, limits = HGraph.of(spark, 14, hedges), Constraints(2, 12, 14)
    found = coarsen.candidates(graph, limits, 4).collect()
    score = {(r.v, r.u): r.score for r in found}
    assert all(score.get((u, v), s) == s for (v, u), s in score.items())
    inbound = [{e for e, (_, d, _) in enumerate(hedges) if v in d} for v in range(14)]
    assert all(len(inbound[v] | inbound[u]) <= 12 for v, u in score)
    pairs = [(r.v, r.u) for r in coarsen.matching(spark.createDataFrame(found)).collect()]
    assert len({v for p in pairs for v in p}) == 2 * len(pairs)
    assert all((v, u) in score or (u, v) in score for v, u in pairs)
    want, free = [], list(found)
    for _ in range(4):
        best = {}
        for r in free:
            best[r.v] = max(best.get(r.v, (-1, -1)), (r.score, r.u))
        new = match_tree([(v, u, s) for v, (s, u) in best.items()])
        taken = {x for p in new for x in p}
        want += new
        free = [r for r in free if not {r.v, r.u} & taken]
    assert sorted(pairs) == sorted((min(p), max(p)) for p in want)


def match_tree(rows):
    """(parent, child) pairs of a heaviest matching of each tree of pointers (v, u, score), one node after the other."""
    target, weight = {v: u for v, u, _ in rows}, {v: s for v, _, s in rows}
    nodes = sorted(set(target) | set(target.values()))
    children = {v: [] for v in nodes}
    for v, u in target.items():
        if target.get(u) != v or v > u:  # of a mutual pair the higher id hangs below the lower
            children[u].append(v)
    todo = [v for v in nodes if v not in target or target.get(target[v]) == v and v < target[v]]
    order = []
    while todo:
        order.append(v := todo.pop())
        todo += children[v]
    best, free, pick = {}, {}, {}
    for v in reversed(order):
        free[v] = sum(best[c] for c in children[v])
        gain, low = max(((weight[c] + free[c] - best[c], -c) for c in children[v]), default=(0, 0))
        pick[v], best[v] = (-low, free[v] + gain) if gain > 0 else (None, free[v])
    out, taken = [], set()
    for v in order:
        if v not in taken and pick[v] is not None:
            out.append((v, pick[v]))
            taken |= {v, pick[v]}
    return out


def test_forest_matching_is_heaviest(spark):
    rng = random.Random(4)
    rows, best = [], 0
    for t in range(120):
        n = rng.randrange(2, 9)
        tree = [(100 * t + v, 100 * t + rng.randrange(v), rng.randrange(1, 20)) for v in range(1, n)]
        rows += tree
        best += max(sum(r[2] for r in c) for k in range(n) for c in itertools.combinations(tree, k) if len({x for r in c for x in r[:2]}) == 2 * k)
    weight = {(u, v): s for v, u, s in rows}
    got = [(r.u, r.v) for r in coarsen.forest_matching(spark.createDataFrame(rows, POINTS)).collect()]
    assert sum(weight[p] for p in got) == best and len({x for p in got for x in p}) == 2 * len(got)


POINTS = "v bigint, u bigint, score bigint"


def test_forests_of_any_depth(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for t in range(30):  # every second tree ends in a mutual pair, every third has a hub, few scores so that ties occur
        base, n = 1000 * t, rng.randrange(2, 40)
        tree = [(base + v, base + (0 if t % 3 == 0 else rng.randrange(max(0, v - 4), v)), rng.randrange(1, 9)) for v in range(1, n)]
        if t % 2:
            tree.append((base, *next((v, s) for v, u, s in tree if u == base)))
        rows += tree
    rows += [(100_000 + v, 100_000 + v - 1, rng.randrange(1, 9)) for v in range(1, 700)]  # a path
    rows += [(200_000 + v, 200_000 + (v - 2 if v % 2 else v - 1) * (v > 1), rng.randrange(1, 9)) for v in range(1, 400)]  # a path with a leaf at each node
    tables = []
    keep = coarsen.observed
    monkeypatch.setattr(coarsen, "observed", lambda df, name, **figures: tables.append(name) or keep(df, name, **figures))
    got = sorted((r.u, r.v) for r in coarsen.forest_matching(spark.createDataFrame(rows, POINTS)).collect())
    assert got == sorted(match_tree(rows))
    assert tables.count("forest") <= 24 and tables.count("paths") <= 13  # some two for each doubling of 700 nodes
    # a hub on which others hang: with mutual pointers only, the pairs (2, 3) and (4, 5) are lost
    found = [(0, 0, 1, 90), (1, 0, 0, 90), (2, 0, 0, 5), (3, 0, 2, 4), (4, 0, 0, 3), (5, 0, 4, 2)]
    found = spark.createDataFrame(found, "v bigint, rank int, u bigint, score bigint")
    assert sorted((r.v, r.u) for r in coarsen.matching(found).collect()) == [(0, 1), (2, 3), (4, 5)]
    assert coarsen.matching(found.limit(0)).count() == 0


def test_orphans_pair_small_with_large(spark):
    nodes = spark.createDataFrame([(v, v + 1) for v in range(5)], "v bigint, size bigint")
    none = spark.createDataFrame([], "v bigint, rank int, u bigint, score bigint")
    pins = spark.createDataFrame([], "e bigint, v bigint, is_src boolean")
    rows = coarsen.orphan_pairs(nodes, none, pins, Constraints(6, 9, 9)).collect()
    assert sorted((r.v, r.u) for r in rows) == [(0, 4), (1, 3)]
    assert coarsen.orphan_pairs(nodes, none, pins, Constraints(5, 9, 9)).count() == 0


def test_refinement_primitives_replay(spark):
    hedges = random_hedges(16, 40, 5)
    part = [v % 4 for v in range(16)]
    graph, parts = HGraph.of(spark, 16, hedges), parts_df(spark, part)
    limits = Constraints(5, 14, 4)
    moves = refine.ranked(refine.gains(graph, parts, limits)).collect()
    assert [r["rank"] for r in sorted(moves, key=lambda r: (-r.gain, r.v))] == list(range(len(moves)))
    for r in moves:  # gains in isolation, and that no better part with room exists
        options = {}
        for p in range(4):
            if p != part[r.v] and part.count(p) + 1 <= 5:
                new = [p if v == r.v else q for v, q in enumerate(part)]
                options[p] = brute_cut(hedges, part)[0] - brute_cut(hedges, new)[0]
        assert r.gain == options[r.dst] == max(options.values()) and r.dst == max(p for p, g in options.items() if g == r.gain)
    df = spark.createDataFrame(moves)
    ppp = refine.pins_per_part(graph.pins, parts)
    cascade = refine.cascade(graph, df, ppp)
    sizes = metrics.loads(graph, parts)
    totals = refine.prefixes(cascade, refine.size_excess(graph.nodes, df, sizes, limits), refine.inbound_breaks(graph.pins, df, ppp, limits))
    rows = {r["rank"]: r for r in totals.collect()}
    now, start = list(part), brute_cut(hedges, part)[0]

    def broken(part):
        return sum(len({e for e, (_, d, _) in enumerate(hedges) if any(part[v] == p for v in d)}) > 14 for p in range(4))

    before = broken(part)
    for r in sorted(moves, key=lambda r: r["rank"]):
        now[r.v] = r.dst
        total = rows[r["rank"]]
        assert total.gain == start - brute_cut(hedges, now)[0]
        assert total.excess == sum(max(0, now.count(p) - 5) for p in range(4))
        assert total.broken == broken(now) - before
    for block, places in ((refine.BLOCK, None), (3, None), (3, len(moves)), (99, len(moves))):
        again = refine.prefix_totals(graph.pins.join(graph.edges, "e"), graph.nodes, df, ppp, sizes, limits, block, places)
        assert {r["rank"]: (r.gain, r.excess, r.broken) for r in again.collect()} == {k: (r.gain, r.excess, r.broken) for k, r in rows.items()}
    gain = {r.v: r.gain for r in moves}
    for whole in (True, False):
        chained = refine.chained(df.drop("rank"), graph.nodes, whole=whole).orderBy("rank").collect()
        assert [r["rank"] for r in chained] == list(range(len(moves))) and {r.v: r.gain for r in chained} == gain
    links = {(r.v, r.next): r.gain for r in refine.linked(df, graph.nodes).collect()}
    by_id = {r.v: r for r in moves}
    assert links and all(by_id[v].dst == by_id[n].src and g == gain[v] + gain[n] for (v, n), g in links.items())
    pairs = {}
    for r in refine.paired(refine.linked(df, graph.nodes)).collect():
        pairs.setdefault(r.head, {})[r.depth] = r.v
    assert pairs and all((p[0], p[1]) in links for p in pairs.values()) and len({v for p in pairs.values() for v in p.values()}) == 2 * len(pairs)


@pytest.mark.parametrize("kway", [True, False])
def test_kept_state_equals_a_new_one(spark, kway):
    rng = random.Random(8)
    graph, limits = HGraph.of(spark, 20, random_hedges(20, 40, 9)), Constraints(7, 40, 5)
    part = [v % 5 for v in range(20)]
    state = refine.State(graph, parts_df(spark, part), kway)
    show = lambda df: sorted(map(tuple, df.collect()))
    for _ in range(2):
        took = [(v, part[v], rng.choice([p for p in range(5) if p != part[v]])) for v in rng.sample(range(20), 4)]
        for v, _, p in took:
            part[v] = p
        state.apply(spark.createDataFrame(took, "v bigint, src bigint, dst bigint"))
        new = refine.State(graph, parts_df(spark, part), kway)
        assert show(state.nodes) == show(new.nodes) and show(state.counted()) == show(new.counted()) and show(state.touched()) == show(new.touched())
        plain = {r.v: (r.src, r.dst, r.gain) for r in refine.gains(graph, new.parts, limits, kway=kway, discount=2).collect()}
        kept = {r.v: (r.src, r.dst, r.gain) for r in state.gains(limits, 2).collect()}
        assert kept.keys() == plain.keys() and all(kept[v][2] == pytest.approx(plain[v][2], abs=1e-3) for v in plain)
        assert kept == plain or not kway


def test_refined_never_gets_worse_kway(spark):
    hedges = random_hedges(16, 30, 6, directed=False)
    graph, parts = HGraph.of(spark, 16, hedges), parts_df(spark, [v % 2 for v in range(16)])
    limits = Constraints.kway(16, 2, 0.2)
    out = refine.refined(graph, parts, limits, repeats=2)
    assert metrics.cut_metrics(graph, out).first().connectivity <= metrics.cut_metrics(graph, parts).first().connectivity
    assert metrics.validity(graph, out, limits).first().valid


@pytest.mark.parametrize("kway", [True, False])
def test_rounds_in_blocks_equal_rounds_of_tables(spark, kway, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_PINS", 40)  # several blocks
    monkeypatch.setattr(blocks, "PAIRS", 20)
    hedges, rng = random_hedges(30, 60, 8), random.Random(4)
    graph = HGraph.of(spark, 32, hedges)  # two nodes have no pin
    graph = HGraph(spark.createDataFrame([(v, rng.randrange(1, 6)) for v in range(32)], "v bigint, size bigint"), graph.edges, graph.pins)
    parts, limits = parts_df(spark, [v % 5 for v in range(32)]), Constraints(26 if kway else 30, 10**6 if kway else 34, 9)
    tables, by_blocks = [], []
    want = refine.refined(graph, parts, limits, 4, kway, figures=tables)
    got = refine.refined(graph, parts, limits, 4, kway, figures=by_blocks, held=blocks.Held(graph, graph.pins.count()))
    assert tables == by_blocks and any(f["applied"] for f in tables)
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect()))


def test_candidates_and_matching_in_tasks_equal_those_by_jobs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_PINS", 200)  # several blocks
    graph, limits = HGraph.of(spark, 60, random_hedges(60, 150, 5)), Constraints(2, 11, 60)
    found = spark.createDataFrame(coarsen.candidates(graph, limits, 4).collect())
    held = blocks.Held(graph, graph.pins.count())
    assert sorted((r.v, r["rank"], r.u, r.score) for r in coarsen.candidates(graph, limits, 4, held).collect()) == sorted((r.v, r["rank"], r.u, r.score) for r in found.collect())
    pairs = lambda df: sorted((r.v, r.u) for r in df.collect())
    assert pairs(coarsen.matching(found, found.count())) == pairs(coarsen.matching(found))
    assert coarsen.matching(found.limit(0), 0).count() == 0


def test_levels_in_blocks_equal_those_of_tables_in_two_jobs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_PINS", 150)  # several blocks
    rng, limits = random.Random(6), Constraints(9, 40, 90)
    graph = HGraph.of(spark, 90, random_hedges(80, 130, 5, directed=True))  # ten nodes have no pin
    graph = HGraph(spark.createDataFrame([(v, rng.randrange(1, 4)) for v in range(90)], "v bigint, size bigint"), graph.edges, graph.pins)
    held, rows = blocks.Held(graph, graph.pins.count()), lambda df: sorted(map(tuple, df.collect()))
    size, tracker = 90, spark.sparkContext.statusTracker()
    for level in range(3):
        groups, smaller, want = coarsen.grouped(graph, limits, size)
        spark.sparkContext.setJobGroup(f"near-{level}", "")
        at, n, figures = coarsen.grouped_near(held, limits)
        new = held.coarse(at)
        spark.sparkContext.setJobGroup("", "")
        assert len(tracker.getJobIdsForGroup(f"near-{level}")) <= 6  # two actions and a footer; adaptive execution makes a job of each shuffle
        ids = new.ids[at].tolist()
        assert (n, figures) == (smaller, want) and rows(groups.select("v", "g")) == list(zip(held.ids.tolist(), ids))
        graph = coarsen.coarse_graph(graph, groups)
        near = new.graph(graph.edges)
        assert rows(near.nodes) == rows(graph.nodes.select("v", "size")) and new.n_pins == graph.pins.count()
        assert rows(near.pins) == rows(graph.pins.select("e", "v", "is_src"))
        fresh = blocks.Held(graph, new.n_pins)
        assert new.inbound.tolist() == fresh.inbound.tolist() and new.bare.tolist() == fresh.bare.tolist()
        held, size = new, n
    bare = blocks.Held(HGraph(graph.nodes, graph.edges, graph.pins.limit(0)), 0)
    assert coarsen.grouped_near(bare, limits)[1] == coarsen.grouped(HGraph(graph.nodes, graph.edges, graph.pins.limit(0)), limits, size)[1]


@pytest.mark.parametrize("inbound", [4, 10**6])
def test_rounds_that_count_in_matrices_equal_those_that_sort(spark, inbound, monkeypatch):
    rng, found = random.Random(2), []
    graph = HGraph.of(spark, 40, random_hedges(40, 90, 6, directed=True))
    graph = HGraph(spark.createDataFrame([(v, rng.randrange(1, 6)) for v in range(40)], "v bigint, size bigint"), graph.edges, graph.pins)
    held, parts = blocks.Held(graph, graph.pins.count()), np.array([v % 4 for v in range(40)])
    for most in (1 << 23, 0):
        plain = blocks._read(held.blocks.rows.collect()[0]["data"])
        monkeypatch.setattr(blocks, "DENSE", most)
        loads = np.bincount(parts, weights=held.size).astype(np.int64)
        out = blocks.proposed(plain, parts, held.size, loads, 38, 2, True, coarsen.SCALE)
        dst, rank = np.full(40, -1), np.full(40, -1)
        dst[out[0]], rank[out[0]] = out[1], np.arange(len(out[0]))
        own = blocks._read(held.blocks.own.collect()[0]["data"])
        found.append([x.tolist() for x in (*out, *blocks.changed(own, parts, dst, rank, len(out[0]), 4))])
    assert found[0] == found[1] and found[0][0]
    limits = Constraints(40, inbound, 4)
    wanted = refine.refined(graph, parts_df(spark, parts.tolist()), limits, 3)
    for most in (1 << 23, 0):  # with sums by node and without
        monkeypatch.setattr(blocks, "DENSE", most)
        assert refine.refined(None, parts, limits, 3, held=held).tolist() == [r.p for r in sorted(wanted.collect())]


def test_edges_of_a_table_are_those_with_two_nodes(spark):
    rows = spark.createDataFrame([(1, 5, 0), (1, 5, 1), (2, 5, 0), (2, 6, 1), (3, None, 0), (3, 7, 1), (4, None, 0), (None, 5, 0), (None, 6, 1)], "h int, n int, o int")
    graph = relational.from_table(rows, "h", "n", spark.range(9), order=["o", "n"])
    assert {r.e for r in graph.edges.collect()} == {r.e for r in graph.pins.collect()} - {None} == {2, 3}


def test_sequential_parts_without_a_bound_on_inbound_read_no_pins_in_rows(spark, monkeypatch):
    graph = HGraph.of(spark, 30, random_hedges(30, 60, 5))
    n_in = graph.pins.where("NOT is_src").count()
    near = {bound: sorted(map(tuple, metrics.sequential_parts(graph, Constraints(7, bound, 5)).collect())) for bound in (n_in - 1, n_in)}
    assert near[n_in - 1] == near[n_in] == [(v, v // 7) for v in range(30)]
    with pytest.raises(GraphError):
        metrics.sequential_parts(graph, Constraints(7, n_in, 4))
    monkeypatch.setattr(metrics, "window_ends", None)
    assert metrics.sequential_parts(graph, Constraints(7, n_in, 5)).count() == 30


def test_packing_and_starts(spark):
    rows = spark.createDataFrame([(0, 5, 1), (1, 2, 9), (2, 2, 1), (3, 4, 1)], "id bigint, size bigint, inbound bigint")
    got = {r.id: r.pack for r in initial.packed(rows, Constraints(6, 10, 9)).collect()}
    assert got == {2: 1, 1: 1, 3: 3, 0: 0}
    rng = random.Random(7)
    rows = [(v, rng.randrange(1, 40), rng.randrange(0, 12)) for v in range(150)]
    for below in (None, 20):
        want, held, size, inbound = {}, [], 0, 0
        for v, s, i in sorted((r for r in rows if below is None or r[1] < below), key=lambda r: (r[1], r[2], r[0])):
            if held and (size + s > 50 or inbound + i > 30):
                want |= {x: min(held) for x in held}
                held, size, inbound = [], 0, 0
            held, size, inbound = [*held, v], size + s, inbound + i
        want |= {x: min(held) for x in held} | {v: v for v, s, _ in rows if below is not None and s >= below}
        assert {r.id: r.pack for r in initial.packed(spark.createDataFrame(rows, "id bigint, size bigint, inbound bigint"), Constraints(50, 30, 9), below).collect()} == want
    assert initial.packed(spark.createDataFrame([], "id bigint, size bigint, inbound bigint"), Constraints(5, 3, 9)).count() == 0


def test_layout_equals_best_fit_one_by_one():
    rng = random.Random(5)
    for _ in range(300):
        k, capacity = rng.randrange(1, 6), rng.randrange(4, 30)
        sizes = [rng.randrange(0 if rng.random() < 0.1 else 1, 10) for _ in range(rng.randrange(0, 25))]
        load, fits = [0] * k, True
        for s in sorted(sizes, reverse=True):
            room = [p for p in range(k) if load[p] + s <= capacity]
            if not (fits := bool(room)):
                break
            load[max(room, key=lambda p: (load[p], -p))] += s
        got = initial.layout({s: sizes.count(s) for s in set(sizes)}, k, capacity)
        assert (got is not None) == fits
        if fits:
            held = [0] * k
            for size, first, upto, p in got:
                held[p] += size * (upto - first)
            assert held == load
            for size in set(sizes):
                assert sorted(v for s, first, upto, _ in got if s == size for v in range(first, upto)) == list(range(sizes.count(size)))


def brute_jacobi(hedges, sizes, part, k, capacity, rounds, patience):
    """Cost (weight times parts touched) and parts of the best state."""
    cost = lambda part: sum(w * len({part[v] for v in vs}) for vs, w in hedges)
    best, seen, at = (cost(part), part), {tuple(part)}, 0
    for step in range(1, rounds + 1):
        wanted, load = {p: [] for p in range(k)}, [sum(s for v, s in enumerate(sizes) if part[v] == p) for p in range(k)]
        for v, src in enumerate(part):
            gain = lambda p: sum(w * ((sum(part[u] == src for u in vs) == 1) - (p not in {part[u] for u in vs})) for vs, w in hedges if v in vs)  # noqa: B023, E731
            g, p = max((gain(p), p) for p in range(k) if p != src)
            if g > 0:
                wanted[p].append((-g, v))
        part = list(part)
        for p, moves in wanted.items():
            for _, v in sorted(moves):
                load[p] += sizes[v]
                if load[p] > capacity:
                    break
                part[v] = p
        if tuple(part) in seen:
            break
        seen.add(tuple(part))
        if cost(part) < best[0]:
            best, at = (cost(part), part), step
        if step - at >= patience:
            break
    return best


@pytest.mark.parametrize("patience", [1, 9])
def test_starts_equal_a_walk_of_each(spark, patience):
    n, k, rng = 18, 3, random.Random(11)
    hedges = [(sorted(set(s + d)), w) for s, d, w in random_hedges(n, 24, 4)]
    sizes = [rng.randrange(1, 4) for _ in range(n)]
    capacity = -(-sum(sizes) * 5 // (4 * k))
    pins = spark.createDataFrame([(e, v, w) for e, (vs, w) in enumerate(hedges) for v in vs], "e bigint, v bigint, w bigint")
    nodes = spark.createDataFrame(list(enumerate(sizes)), "v bigint, size bigint")
    tried = initial.Starts(pins, nodes, k, Constraints(capacity, 2**31 - 1, k), 5, 86)

    def state():
        out = [[None] * n for _ in range(5)]
        for r in tried.nodes.collect():
            assert sizes[r.v % n] == r["size"] and r.p // k == r.v // n
            out[r.v // n][r.v % n] = r.p % k
        return out

    load = lambda part: max(sum(s for v, s in enumerate(sizes) if part[v] == p) for p in range(k))
    cost = lambda part: sum(w * len({part[v] for v in vs}) for vs, w in hedges)
    first = state()
    assert all(load(part) <= capacity for part in first) and len({tuple(part) for part in first}) > 1
    tried.jacobi(6, patience)
    want = [brute_jacobi(hedges, sizes, part, k, capacity, 6, patience) for part in first]
    assert [tried.cost[s] for s in range(5)] == [c for c, _ in want] and state() == [part for _, part in want]
    tried.single_moves(20)
    last = state()
    assert [cost(part) for part in last] == [tried.cost[s] for s in range(5)]
    assert all(load(part) <= capacity and cost(part) <= c for part, (c, _) in zip(last, want))
    assert sum(map(cost, last)) < sum(map(cost, first))
    best = {r.v: r.p for r in tried.best().collect()}
    assert len(best) == n and cost(best) == min(tried.cost.values())


def test_starts_in_blocks_equal_starts_as_tables(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_PINS", 60)  # several blocks
    n, k, rng = 24, 3, random.Random(5)
    pins = spark.createDataFrame([(e, v, w) for e, (s, d, w) in enumerate(random_hedges(n, 40, 9)) for v in s + d], "e bigint, v bigint, w bigint")
    sizes = [rng.randrange(1, 4) for _ in range(n)]
    nodes = spark.createDataFrame([(v, sizes[v]) for v in range(n)], "v bigint, size bigint")
    limits, states = Constraints(-(-sum(sizes) * 6 // (5 * k)), 2**31 - 1, k), []
    for kind in (initial.Starts, initial.NearStarts):
        tried = kind(pins, nodes, k, limits, 4, 86, 200)
        tried.jacobi(6, 2)
        costs = dict(tried.cost)
        tried.single_moves(20)
        states.append((costs, tried.cost, sorted(map(tuple, tried.best().collect()))))
    assert states[0] == states[1] and states[0][0] != states[0][1]


def test_kway_starts_of_small_and_empty_graphs(spark):
    graph = HGraph.of(spark, 8, [([0], [1, 2, 3], 9), ([4], [5, 6, 7], 9), ([3], [4], 1)])
    limits = Constraints(5, 2**31 - 1, 2)
    parts = {r.v: r.p for r in initial.kway_initial(graph, 2, limits, starts=8).collect()}
    assert sorted(parts) == list(range(8)) and max(list(parts.values()).count(p) for p in (0, 1)) <= 5
    alone = HGraph(graph.nodes, graph.edges.limit(0), graph.pins.limit(0))
    assert initial.kway_initial(alone, 2, limits, starts=2).count() == 8
    assert initial.kway_initial(HGraph(graph.nodes.limit(0), alone.edges, alone.pins), 2, limits, starts=2).count() == 0
    with pytest.raises(GraphError, match="no start"):
        initial.kway_initial(graph, 2, Constraints(3, 2**31 - 1, 2), starts=2)


@pytest.mark.parametrize("chunk", [1, 9, 1 << 16])
def test_sequential_parts_equal_a_walk(spark, chunk):
    hedges = random_hedges(60, 90, 14)
    graph = HGraph.of(spark, 60, hedges)
    inbound = [{e for e, (_, d, _) in enumerate(hedges) if v in d} for v in range(60)]
    for size, most in ((7, 12), (60, 9), (5, 90), (60, 1)):
        want, held, n, p = [], set(), 0, 0
        for v in range(60):
            n, held = n + 1, held | inbound[v]
            if n > size or len(held) > most:
                if v:
                    p += 1
                n, held = 1, inbound[v]
            want.append(p)
        got = {r.v: r.p for r in metrics.sequential_parts(graph, Constraints(size, most, 99), chunk).collect()}
        assert [got[v] for v in range(60)] == want
    with pytest.raises(GraphError, match="parts are needed"):
        metrics.sequential_parts(graph, Constraints(7, 12, 3))


def test_partition_plans(spark):
    hedges = random_hedges(12, 20, 8)
    graph, limits = HGraph.of(spark, 12, hedges), Constraints(4, 30, 12)
    parts = partition(graph, limits, candidates=2, repeats=1)
    row = metrics.validity(graph, parts, limits).first()
    assert row.valid and parts.count() == 12
    report = grade(graph, parts, limits)
    assert report["partitioning"]["connectivity"] == report["quotient"]["connectivity"]
    two = partition(graph, k=2, eps=0.1, repeats=1, starts=4)
    assert metrics.validity(graph, two, Constraints.kway(12, 2, 0.1)).first().valid
    assert partition(HGraph.of(spark, 0, PATH4[1]).with_pins(graph.pins.limit(0)), limits).count() == 0
    with pytest.raises(GraphError):
        partition(graph, limits, k=2)


def test_partition_of_the_basket_graph(spark):
    graph, figures = relational.basket(spark, SF, directed=True), []
    limits = Constraints.kway(graph.nodes.count(), 4, 0.1)
    parts = partition(graph, k=4, eps=0.1, kway_nodes=graph.nodes.count() // 2, repeats=3, starts=4, figures=figures)
    assert metrics.validity(graph, parts, limits).first().valid and parts.count() == graph.nodes.count()
    cost = lambda p: metrics.cut_metrics(graph, p).first().connectivity
    assert cost(parts) < cost(metrics.sequential_parts(graph, limits))
    assert all(f["groups"] < f["nodes"] for f in figures if "groups" in f) and {"groups", "step"} <= {k for f in figures for k in f}


def test_checked_partition_reads_the_written_graph(spark, monkeypatch):
    looked = []
    plain = queries.metrics.sequential_parts
    monkeypatch.setattr(queries.metrics, "sequential_parts", lambda graph, limits: looked.append(graph) or plain(graph, limits))
    row = queries.QUERIES["partition_incc_checked"](spark, SF).first()
    assert row.n_nodes == row.n_distinct == 200 and row.valid
    assert all(hasattr(df, "stored_path") for df in (looked[0].nodes, looked[0].edges, looked[0].pins))


def test_checked_partition_tells_of_too_many_parts(spark, monkeypatch):
    """The parts in id order need more than max_parts: the row says whether the partition is valid, it is no error."""
    graph = relational.basket(spark, SF, directed=True)
    parts = graph.nodes.select("v", F.floor(F.col("v") / 50).cast("bigint").alias("p"))
    for most, valid in ((3, False), (4, True)):
        made = graph, Constraints(50, 1200, most), parts
        monkeypatch.setattr(queries, "_partitioned", lambda *_, made=made: made)
        row = queries.QUERIES["partition_incc_checked"](spark, SF).first()
        assert (row.n_nodes, row.n_distinct, row.valid) == (200, 200, valid)


def test_placement_queries_take_64_parts_and_the_defaults(spark, monkeypatch):
    calls = []
    note = lambda graph, *hw, **given: calls.append((graph, hw, given)) or graph.nodes
    monkeypatch.setattr(queries.ordering, "locality_order", note)
    monkeypatch.setattr(queries.placement, "place", note)
    for name in ("locality_order", "place"):
        queries.QUERIES[name](spark, SF)
    assert [graph.nodes.count() for graph, _, _ in calls] == [64, 64]
    assert [(hw, given) for _, hw, given in calls] == [((), {}), ((queries.HW,), {})]


def brute_snake(n, w, h):
    return [(x, y if x % 2 == 0 else h - 1 - y) for x in range(w) for y in range(h)][:n]


@pytest.mark.parametrize("n, w, h", [(1, 3, 3), (7, 4, 4), (40, 8, 9), (64, 8, 8), (100, 100, 2)])
def test_curves(spark, n, w, h):
    region = curves.dyadic_region(n, w, h)
    assert region[0] * region[1] >= n and region[0] <= w and region[1] <= h
    for name in curves.CURVES:
        cells = [(r.x, r.y) for r in curves.curve(spark, name, n, w, h).orderBy("idx").collect()]
        assert len(set(cells)) == len(cells) == n and all(0 <= x < w and 0 <= y < h for x, y in cells)
    assert [(r.x, r.y) for r in curves.snake(spark, n, w, h).orderBy("idx").collect()] == brute_snake(n, *region)
    cells = [(r.x, r.y) for r in curves.hilbert(spark, 64, 8, 8).orderBy("idx").collect()]
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(cells, cells[1:]))


def test_squareish_region():
    assert curves.squareish_region(10, 5, 5) == (3, 4) and curves.squareish_region(0, 5, 5) == (0, 0)
    with pytest.raises(GraphError):
        curves.squareish_region(30, 5, 5)


def test_geometry():
    rng = random.Random(9)
    for _ in range(200):
        pts = [(rng.randrange(7), rng.randrange(7)) for _ in range(rng.randrange(1, 6))]
        corners = geometry.hull(pts)

        def inside(q):
            if len(corners) == 1:
                return q == corners[0]
            if len(corners) == 2:
                (a, b), (c, d) = corners
                return (c - a) * (q[1] - b) == (d - b) * (q[0] - a) and min(a, c) <= q[0] <= max(a, c) and min(b, d) <= q[1] <= max(b, d)
            return all((b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0]) >= 0 for a, b in zip(corners, corners[1:] + corners[:1]))

        assert geometry.hull_points(pts) == sum(inside((x, y)) for x in range(7) for y in range(7))
        uniq, total = sorted(set(pts)), 0  # Kruskal
        root = {p: p for p in uniq}
        find = lambda p: p if root[p] == p else find(root[p])
        for d, a, b in sorted((abs(a[0] - b[0]) + abs(a[1] - b[1]), a, b) for a, b in itertools.combinations(uniq, 2)):
            if find(a) != find(b):
                root[find(a)] = find(b)
                total += d
        assert geometry.tree_span(pts) == total


def test_transit_and_congestion(spark):
    for dx, dy in itertools.product(range(4), range(4)):
        p = hardware.transit(dx, dy)
        assert p.sum() == pytest.approx(dx + dy + 1) and p[dx, dy] == pytest.approx(1)
    graph = HGraph.of(spark, 4, [([0], [1, 2, 3], 2.0)])
    at = spark.createDataFrame([(0, 0, 0), (1, 2, 0), (2, 0, 2), (3, 2, 2)], "v bigint, x int, y int")
    hw = hardware.Hardware("tiny", 9, 9, 3, 3, 1.0, 2.0, 1.0, 0.5)
    row = hardware.all_metrics(graph.pins, graph.edges, at, hw).first()
    assert row.valid and row.energy == 2 * sum((m + 1) + 2 * m for m in (2, 2, 4)) and row.max_latency == 5 + 2
    assert row.congestion == pytest.approx(2 * (3 + 3 + 5) / 9) and row.ar_mean == 9 and row.tree_span == 12 and row.max_distance == 8
    bad = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, 9, 0)], "v bigint, x int, y int")
    check = hardware.placement_validity(bad, hw).first()
    assert (check.n_placed, check.n_outside, check.n_shared, check.valid) == (3, 1, 1, False)


def test_orders(spark):
    graph = HGraph.of(spark, *PATH4)
    assert {r.v: r.idx for r in ordering.feed_forward_order(graph).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    hedges = random_hedges(13, 25, 10)
    graph = HGraph.of(spark, 13, hedges)
    order = ordering.locality_order(graph, repeats=1)
    assert sorted(r.idx for r in order.collect()) == list(range(13))
    parts = parts_df(spark, [v % 4 for v in range(13)])
    cost = lambda p: sum(r.cost for r in ordering.split_cost(graph.pins, graph.edges, p).collect())
    moves = ordering.paired_moves(ordering.label_gains(graph.pins, graph.edges, parts))
    swaps = {(r.h, r.k): r.gain for r in ordering.pair_cascade(graph.pins, graph.edges, parts, moves).collect()}
    done = parts
    for upto in sorted({k for _, k in swaps}):
        new = parts.join(moves.where(F.col("k") <= upto).select("v", "dst"), "v", "left").select("v", F.coalesce("dst", "p").alias("p"))
        assert cost(done) - cost(new) == pytest.approx(sum(g for (_, k), g in swaps.items() if k == upto))
        done = new


def walk_one_by_one(n, hedges):
    """Plain feed-forward order: nodes by place."""
    inbound = [sum(v in d for _, d, _ in hedges) for v in range(n)]
    priority, order = [0.0] * n, []
    while len(order) < n:
        left = [v for v in range(n) if v not in order]
        fewest = min(inbound[v] for v in left)
        for v in left:
            priority[v] = float("inf") if inbound[v] == fewest else 0.0
        while ready := [v for v in left if v not in order and priority[v] > 0]:
            v = min(ready, key=lambda u: (-priority[u], u))
            order.append(v)
            for s, d, w in hedges:
                for u in s + d if v in s else ():
                    priority[u] += w
    return order


def test_feed_forward_order_has_no_bound_on_pins(spark, monkeypatch):
    monkeypatch.setattr(ordering, "MOST_WALK_PINS", 1, raising=False)
    # two components that a seed reaches, a cycle that none reaches, and nodes without pins
    hedges = [([0], [1, 2], 3.0), ([1], [3, 4], 1.0), ([3], [4, 2], 4.0), ([0], [5, 6], 2.0), ([5], [7], 5.0), ([6, 7], [8], 1.0), ([9], [10, 11], 2.0), ([10], [9], 2.0), ([11], [9, 10], 1.0)]
    got = {r.v: r.idx for r in ordering.feed_forward_order(HGraph.of(spark, 14, hedges)).collect()}
    assert sorted(got, key=got.get) == walk_one_by_one(14, hedges) and sorted(got.values()) == list(range(14))


def test_walk_of_a_component_holds_little_beside_its_pins(monkeypatch):
    """Nodes that are raised again and again leave few rows in the heap, whatever batches they come in."""
    n, rng = 300, random.Random(4)
    hedges = [(s, sorted(set(rng.sample(range(n), 5)) - {s}), rng.randrange(1, 50)) for s in (rng.randrange(n) for _ in range(6000))]
    names = [3 * v + 7 for v in range(n)]
    rows = [(0, 0, names[v], names[v], v < 3, float(v + 1) if v < 3 else None) for v in range(n)]
    rows += [(0, 1, e, names[v], v == s, float(w)) for e, (s, d, w) in enumerate(hedges) for v in [*d, s]]
    kinds = dict(root=pa.int64(), kind=pa.int32(), e=pa.int64(), v=pa.int64(), is_src=pa.bool_(), w=pa.float64())
    batch = lambda some: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*some), kinds.values())], list(kinds))
    lengths = []
    push = lambda heap, x: lengths.append(len(heap)) or heapq.heappush(heap, x)
    monkeypatch.setattr(walks, "heapq", types.SimpleNamespace(heappush=push, heappop=heapq.heappop, heapify=heapq.heapify))
    monkeypatch.setattr(walks, "ROWS", 70)
    got = [x for b in walks.walked(batch(rows[i : i + 977]) for i in range(0, len(rows), 977)) for x in zip(*(b.column(c).to_pylist() for c in ("nth", "v")))]
    priority, placed = {v: v + 1.0 for v in range(3)}, []
    while priority:
        i = min(priority, key=lambda v: (-priority[v], v))
        del priority[i]
        placed.append(i)
        for s, d, w in hedges:
            if s == i:
                for u in d:
                    if u not in placed:
                        priority[u] = priority.get(u, 0.0) + w
    assert got == [(k, names[v]) for k, v in enumerate(placed)] and len(placed) > 250
    assert sum(len(d) for _, d, _ in hedges) > 20_000 and max(lengths) < 2 * n + 1024 + n


def test_bisection_of_few_nodes_equals_that_of_tables(spark, monkeypatch):
    graph = HGraph.of(spark, 13, random_hedges(13, 25, 10))
    parts_by_level = lambda: [{r.v: r.p for r in level.collect()} for level in ordering.bisected(graph, 2)]
    monkeypatch.setattr(ordering, "FEW_NODES", 0, raising=False)
    slow = parts_by_level()
    monkeypatch.setattr(ordering, "FEW_NODES", 13)
    monkeypatch.setattr(ordering, "label_gains", lambda *given: pytest.fail("joins all pins in each repeat"))
    assert parts_by_level() == slow


def pair_cost(hedges, at):
    return sum(w * sum(abs(at[a][0] - at[b][0]) + abs(at[a][1] - at[b][1]) for a, b in itertools.combinations(s + d, 2)) for s, d, w in hedges)


def test_swaps_are_claimed_from_the_best_down(spark):
    rng = random.Random(3)
    side = 7
    at = {v: (v % side, v // side) for v in rng.sample(range(side * side), 30)}
    node_at = {c: v for v, c in at.items()}
    rows = []
    for v, (x, y) in at.items():
        for rank, (d, dx, dy) in enumerate((("left", -1, 0), ("right", 1, 0), ("up", 0, -1), ("down", 0, 1))):
            if 0 <= x + dx < side and 0 <= y + dy < side and rng.random() < 0.8:
                rows.append((v, rank, node_at.get((x + dx, y + dy)), d, rng.randrange(1, 5)))
    step = {"left": (-1, 0), "right": (1, 0), "up": (0, -1), "down": (0, 1)}
    score = {}
    for v, _, u, d, s in rows:
        ends = (at[v], (at[v][0] + step[d][0], at[v][1] + step[d][1]))
        lo, hi = (v, None) if u is None else (min(u, v), max(u, v))
        key = (lo, hi, ends if v == lo else ends[::-1])
        score[key] = max(score.get(key, 0), s)
    used, want = set(), set()
    for (lo, hi, ends), s in sorted(score.items(), key=lambda r: (-r[1], r[0][0], -1 if r[0][1] is None else r[0][1], [(-x, -y) for x, y in r[0][2]])):
        if not used & set(ends):
            used |= set(ends)
            want.add((lo, hi, *ends[1], s))
    swaps = spark.createDataFrame(rows, "v bigint, rank int, u bigint, dir string, score bigint")
    cells = spark.createDataFrame([(v, *c) for v, c in at.items()], "v bigint, x int, y int")
    assert set(map(tuple, placement.exclusive(swaps, cells).collect())) == want
    assert placement.exclusive(swaps.limit(0), cells).count() == 0


def test_swaps_replay(spark):
    hedges = random_hedges(10, 20, 11)
    graph = HGraph.of(spark, 10, hedges)
    hw = hardware.Hardware("tiny", 99, 99, 4, 4, 1.0, 1.0, 1.0, 1.0)
    at = placement.on_curve(graph, ordering.locality_order(graph, repeats=0), hw, "snak")
    force = placement.forces(graph.pins, graph.edges, at)
    wanted = placement.tensions(force, at, hw, 4)
    swaps = placement.exclusive(wanted, at)
    ranked = spark.createDataFrame([(*r, k) for k, r in enumerate(sorted(swaps.collect(), key=lambda r: (-r.score, r.lo)))], "lo bigint, hi bigint, x int, y int, score bigint, rank bigint")
    gains = {r["rank"]: r.gain for r in placement.swap_cascade(graph.pins, graph.edges, at, ranked).collect()}
    now = {r.v: (r.x, r.y) for r in at.collect()}
    for r in ranked.orderBy("rank").collect():
        before = pair_cost(hedges, now)
        now = {v: (r.x, r.y) if v == r.lo else now[r.lo] if v == r.hi else c for v, c in now.items()}
        assert gains.get(r["rank"], 0) == before - pair_cost(hedges, now)
    assert {r.v: (r.x, r.y) for r in placement.swapped(at, ranked).collect()} == now
    better = placement.refined(graph, at, hw, iterations=2)
    end = {r.v: (r.x, r.y) for r in better.collect()}
    assert len(set(end.values())) == 10 and pair_cost(hedges, end) <= pair_cost(hedges, {r.v: (r.x, r.y) for r in at.collect()})
    with pytest.raises(GraphError):
        placement.on_curve(graph, ordering.feed_forward_order(graph), hardware.Hardware("t", 1, 1, 3, 3, 1, 1, 1, 1))


def as_lists(graph):
    out = {}
    for r in graph.pins.collect():
        out.setdefault(r.e, ([], []))[0 if r.is_src else 1].append(r.v)
    w = {r.e: r.w for r in graph.edges.collect()}
    return sorted((e, sorted(s), sorted(d), w[e]) for e, (s, d) in out.items())


def whole(folder):
    """The parts of a written folder in the order of their names."""
    return b"".join((folder / n).read_bytes() for n in sorted(x.name for x in folder.iterdir()) if n == "header" or n.startswith("part-"))


def test_graph_files(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    graph = HGraph.of(spark, 9, random_hedges(9, 12, 12))
    for kind in ("snn", "axh"):
        files.write_hypergraph(graph, at(f"g.{kind}"))
        assert as_lists(files.read_hypergraph(spark, at(f"g.{kind}"))) == as_lists(graph)
    raw = whole(tmp_path / "g.snn")
    assert struct.unpack_from("<II", raw) == (9, 12)
    (tmp_path / "one.snn").write_bytes(raw)  # a single file holds the same bytes
    assert as_lists(files.read_hypergraph(spark, at("one.snn"))) == as_lists(graph)
    for name, cut in (("cut", raw[:-6]), ("short", raw[:-8])):
        (tmp_path / f"{name}.snn").write_bytes(cut)
        with pytest.raises(Exception, match="ends inside"):
            files.read_hypergraph(spark, at(f"{name}.snn"))
    many = HGraph.of(spark, 4, [([0, 1], [2, 3], 0.5)])
    files.write_axh(many, at("m.axh"))
    assert as_lists(files.read_axh(spark, at("m.axh"))) == as_lists(many)
    assert files.write_snn(many, at("m.snn")) == 1
    with pytest.raises(GraphError, match="source"):
        files.write_axh(HGraph.of(spark, 2, [([], [0, 1], 1)]), at("n.axh"))
    with pytest.raises(GraphError, match="unknown graph format"):
        files.read_hypergraph(spark, at("g.txt"))


def test_binary_files_are_read_and_written_by_many_tasks(spark, tmp_path):
    path, hedges = f"file://{tmp_path}/g.axh", random_hedges(40, 300, 15)
    files.write_axh(HGraph.of(spark, 40, hedges), path)
    parts = [x.name for x in (tmp_path / "g.axh").iterdir()]
    assert len(parts) > 2 and "header" in parts and not any(p.startswith("_") for p in parts)
    rows, records, header = binary.read(spark, path, "axh", range_bytes=500)
    assert (records, header) == (300, (40, 300)) and rows.rdd.getNumPartitions() > len(parts)
    (tmp_path / "one.axh").write_bytes(whole(tmp_path / "g.axh"))
    one = binary.read(spark, f"file://{tmp_path}/one.axh", "axh", range_bytes=500)[0]
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, rows.collect()))
    assert sorted({(r.e, r.w) for r in rows.collect()}) == [(e, h[2]) for e, h in enumerate(hedges)]


def test_binary_files_of_long_records_and_no_records(spark, tmp_path, monkeypatch):
    graph = HGraph.of(spark, 3000, [([0], list(range(1, 3000)), 2.5), ([1], [2], 1.0)])
    files.write_snn(graph, f"file://{tmp_path}/g.snn")
    monkeypatch.setattr(binary, "WALK_WORDS", 16)
    assert as_lists(files.read_snn(spark, f"file://{tmp_path}/g.snn")) == as_lists(graph)
    empty = HGraph.of(spark, 4, [([0], [1], 1.0)])
    empty = HGraph(empty.nodes, empty.edges.limit(0), empty.pins.limit(0))
    files.write_axh(empty, f"file://{tmp_path}/n.axh")
    back = files.read_axh(spark, f"file://{tmp_path}/n.axh")
    assert back.nodes.count() == 4 and back.edges.count() == back.pins.count() == 0


def test_hmetis_files(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    (tmp_path / "a.hgr").write_text("% c\n\n3 4 1\n2.5 1 2 3\n% x\n1 4\n3 3  4\n9 9 9\n")
    graph = files.read_hypergraph(spark, at("a.hgr"))
    assert as_lists(graph) == [(0, [], [0, 1, 2], 2.5), (1, [], [2, 3], 3.0)] and graph.nodes.count() == 4
    files.write_hypergraph(graph, at("b.hgr"))
    assert whole(tmp_path / "b.hgr").decode() == "2 4 01\n2560 1 2 3\n3072 3 4\n"
    files.write_hmetis(HGraph.of(spark, 2, [([], [0, 1], 1)]), at("c.hgr"))
    assert whole(tmp_path / "c.hgr").decode() == "1 2\n1 2\n"
    (tmp_path / "d.hgr").write_text("1 2\n1 3\n")
    with pytest.raises(GraphError, match="outside"):
        files.read_hypergraph(spark, at("d.hgr"))


def test_result_files(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    parts = parts_df(spark, [3, 0, 2, 1, 0])
    files.write_partitioning(parts, at("p.txt"))
    assert whole(tmp_path / "p.txt").decode() == "3\n0\n2\n1\n0\n"
    assert sorted(map(tuple, files.read_partitioning(spark, at("p.txt"), 5).collect())) == sorted(map(tuple, parts.collect()))
    with pytest.raises(GraphError):
        files.read_partitioning(spark, at("p.txt"), 4)
    (tmp_path / "q.txt").write_text("1\nx\n")
    with pytest.raises(GraphError):
        files.read_partitioning(spark, at("q.txt"), 2)
    cells = spark.createDataFrame([(0, 1, 2), (1, -3, 4)], "v bigint, x int, y int")
    files.write_placement(cells, at("c.bin"))
    assert sorted(map(tuple, files.read_placement(spark, at("c.bin")).collect())) == [(0, 1, 2), (1, -3, 4)]


def test_scaled_graphs(spark):
    graph = HGraph.of(spark, 20, random_hedges(20, 30, 13, directed=False))
    big = scaled(graph, 3)
    assert big.nodes.count() == 60 and big.edges.count() == 90 and sorted(map(tuple, big.pins.collect())) == sorted(map(tuple, scaled(graph, 3).pins.collect()))
    assert big.pins.groupBy("e").count().where("count < 2").count() == 0


def test_streamed_metrics_go_on_after_a_restart(spark, tmp_path):
    hedges = random_hedges(12, 20, 14)
    graph, part = HGraph.of(spark, 12, hedges), [v % 3 for v in range(12)]
    where = f"file://{tmp_path}/pins"
    stream = lambda: spark.readStream.schema(graph.pins.schema).option("maxFilesPerTrigger", 1).parquet(where)
    early, late = graph.pins.where("e < 8 OR v % 2 = 0"), graph.pins.where("e >= 8 AND v % 2 = 1")
    for pins in (early, late):
        pins.repartition(2).write.mode("append").parquet(where)
        query, state = watch(stream(), graph, parts_df(spark, part), f"file://{tmp_path}/ck")
        assert query.awaitTermination(200)
    row = state.metrics().first()
    assert (row.connectivity, row.cut_net, row.soed) == brute_cut(hedges, part)


@pytest.mark.parametrize("block, places", [(1 << 16, None), (7, None), (7, 500), (500, 500)])
def test_running_sums_of_a_hot_key(spark, block, places):
    rng = random.Random(3)
    rows = [(7 if rng.random() < 0.9 else rng.randrange(5), k, rng.randrange(-3, 4)) for k in range(500)]
    df = spark.createDataFrame(rows, "p bigint, r bigint, d bigint")
    got = running_sums(df, ["p"], "r", {"s": "d"}, block, places).collect()
    total, want, every = {}, {}, 0
    for p, r, d in rows:
        total[p] = total.get(p, 0) + d
        want[p, r] = total[p]
    assert {(x.p, x.r): x.s for x in got} == want and set(got[0].asDict()) == {"p", "r", "d", "s"}
    for r in sorted(running_sums(df, [], "r", {"s": "d"}, block, places).collect(), key=lambda r: r.r):
        every += r.d
        assert r.s == every


@pytest.mark.parametrize("large, largest", [(2048, 4096), (3, 1), (1, 0), (2, 100)])
def test_pairs_in_blocks(spark, large, largest):
    graph = HGraph.of(spark, 15, [*random_hedges(15, 12, 5), (list(range(3)), list(range(3, 15)), 1)])
    got = sorted((r.e, r.v, r.u, r.v_dst, r.u_dst) for r in structure.pairs(graph.pins, large, largest).collect())
    pins = graph.pins.collect()
    assert got == sorted((a.e, a.v, b.v, not a.is_src, not b.is_src) for a in pins for b in pins if a.e == b.e and a.v != b.v)


@pytest.mark.parametrize("marked", (1, 3))
def test_neighbourhoods_of_large_hyperedges_are_marked(spark, monkeypatch, marked):
    hedges = random_hedges(30, 12, 7) + [([], list(range(5, 25)), 1.0), ([29], [], 1.0)]
    graph, truth = HGraph.of(spark, 31, hedges), {}
    for s, d, _ in hedges:
        for v in s + d:
            truth.setdefault(v, set()).update(u for u in s + d if u != v)
    for name, value in (("MARKED_PINS", marked), ("MARKED_NODES", 8), ("MARKED_IDS", 16), ("HOT_PINS", 5), ("MATRIX_PINS", 9)):
        monkeypatch.setattr(structure, name, value, raising=False)
    calls, plain = [], structure.pairs
    monkeypatch.setattr(structure, "pairs", lambda pins, **given: calls.append(pins.agg(F.max(F.expr("e"))).first()[0]) or plain(pins, **given))
    got = {r.v: r.n_neighbours for r in structure.neighbourhood_sizes(graph.pins).collect()}
    assert got == {v: len(us) for v, us in truth.items() if us}
    assert len(hedges) - 2 not in calls  # the largest hyperedge makes no rows of pairs


def test_neighbourhoods_of_large_hyperedges_derive_pins_once(spark, monkeypatch):
    """What derives the pins is shuffled once; a null node is no neighbour."""
    monkeypatch.setattr(structure, "MARKED_PINS", 3)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(0, v) for v in range(9)] + [(0, None)] + [(1, v) for v in (8, 9)]
    pins = spark.createDataFrame(rows, "e bigint, v bigint").repartition(2).mapInArrow(counted, "e bigint, v bigint").withColumn("is_src", F.lit(False))
    got = {r.v: r.n_neighbours for r in structure.neighbourhood_sizes(pins).collect()}
    assert got == {**{v: 8 for v in range(8)}, 8: 9, 9: 1} and seen.value == len(rows)


def test_refined_placement_joins_pins_once(spark, monkeypatch):
    graph, calls, plain = HGraph.of(spark, 6, random_hedges(6, 8, 3)), [], placement.pairs
    monkeypatch.setattr(placement, "pairs", lambda *given, **named: calls.append(1) or plain(*given, **named))
    at = spark.createDataFrame([(v, v % 3, v // 3) for v in range(6)], "v bigint, x int, y int")
    out = placement.refined(graph, at, hardware.Hardware("t", 3, 2, 3, 3, 1, 1, 1, 1), iterations=1)
    assert len(calls) == 1 and sorted((r.x, r.y) for r in out.collect()) == [(x, y) for x in range(3) for y in range(2)]


def test_chains_and_cycles(spark):
    chain, loop = list(range(20, 0, -1)), [30, 31, 37, 32, 33]
    links = [*zip(chain, chain[1:]), *zip(loop, [*loop[1:], loop[0]]), (50, 51)]
    got = {r.v: (r.head, r.depth) for r in refine._chains(spark.createDataFrame(links, "v bigint, next bigint")).collect()}
    cut = [32, 33, 30, 31, 37]  # the link after the highest id goes
    want = {v: (20, k) for k, v in enumerate(chain)} | {v: (32, k) for k, v in enumerate(cut)} | {50: (50, 0), 51: (50, 1)}
    assert got == want


def test_best_valid_prefix(spark):
    rows = spark.createDataFrame([(0, 5, 1, 0), (1, 3, 0, 0), (2, 9, 0, 1), (3, 3, 0, 0), (4, -1, 0, 0)], "rank bigint, gain bigint, excess bigint, broken bigint")
    assert refine.best_valid_prefix(rows).first().rank == 1
    assert refine.best_valid_prefix(rows, start_excess=-1).first().rank == 0
    assert refine.best_valid_prefix(rows, start_broken=5).first() is None


def test_fit_takes_the_greedy_step(spark):
    graph = HGraph.of(spark, 4, [([0], [1, 2], 1), ([0], [1], 1), ([1], [3], 1)])
    row = metrics.fit(graph, Constraints(2, 2, 2)).first()
    assert (row.n_nodes, row.max_inbound, row.n_sequential, row.fits) == (4, 2, 2, True)
    assert not metrics.fit(graph, Constraints(2, 1, 9)).first().fits
    scattered = HGraph.of(spark, 4, [([3], [0], 1), ([3], [1], 1), ([0], [2], 1), ([0], [3], 1)])
    row = metrics.fit(scattered, Constraints(2, 1, 3)).first()  # each node alone fits, two never do
    assert (row.n_sequential, row.fits) == (4, False) and metrics.fit(scattered, Constraints(2, 1, 3), greedy=False).first().fits


def test_scaling_needs_two_nodes(spark):
    with pytest.raises(GraphError):
        scaled(HGraph.of(spark, 1, [([], [0], 1)]), 3, most_rounds=2)


def test_transit_equals_path_counts():
    for dx, dy in itertools.product(range(6), range(6)):
        p = [[0.0] * (dy + 1) for _ in range(dx + 1)]
        p[0][0] = 1.0
        for a, b in itertools.product(range(dx + 1), range(dy + 1)):
            for x, y in ((a + 1, b), (a, b + 1)):
                if x <= dx and y <= dy:
                    p[x][y] += p[a][b] * (0.5 if a < dx and b < dy else 1.0)
        assert hardware.transit(dx, dy) == pytest.approx(np.array(p))


def test_scattered_rows_fill_their_bins(spark):
    rng = random.Random(2)
    values = [rng.uniform(-1, 11) for _ in range(300)] + [5.0] * 20
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k bigint, x double").repartition(5)
    rows = sorted(structure.scattered(df, "x", 4, 0.0, 10.0).collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(len(values))) and sorted(r.k for r in rows) == list(range(len(values)))
    assert [r.bin for r in rows] == sorted(min(max(int(v * 4 // 10), 0), 3) for v in values)
    assert structure.scattered(df.limit(0), "x", 4, 0.0, 10.0).count() == 0


def test_asymmetric_candidates(spark):
    make = lambda rows: spark.createDataFrame(rows, "v bigint, rank int, u bigint, score bigint")
    assert coarsen.asymmetric(make([(1, 0, 2, 5), (2, 0, 3, 6), (3, 0, 2, 6)])).count() == 0
    assert [tuple(r) for r in coarsen.asymmetric(make([(1, 0, 2, 5), (2, 0, 3, 4), (3, 0, 2, 4)])).collect()] == [(1, 0, 2, 5)]
