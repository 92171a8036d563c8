"""Lattice hardware: presets, placement validity, and energy, latency, congestion and locality metrics."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import hull_points, tree_span
from ..schema import GraphError
from .metrics import Constraints


@dataclass(frozen=True)
class Hardware:
    name: str
    neurons_per_core: int
    synapses_per_core: int
    width: int
    height: int
    energy_routing: float
    energy_wire: float
    latency_routing: float
    latency_wire: float

    def __post_init__(self):
        if min(self.neurons_per_core, self.synapses_per_core, self.width, self.height) <= 0:
            raise GraphError("hardware sizes must be positive")
        if min(self.energy_routing, self.energy_wire, self.latency_routing, self.latency_wire) < 0:
            raise GraphError("costs must not be negative")

    @property
    def cores(self) -> int:
        return self.width * self.height

    @property
    def constraints(self) -> Constraints:
        return Constraints(self.neurons_per_core, self.synapses_per_core, self.cores, self.name)


# Neurons and synapses per core, lattice, energy of routing and wire, latency of routing and wire.
HARDWARE = {
    "loihi": Hardware("loihi", 1024, 4096, 16, 8, 1.7, 3.5, 2.1, 5.3),
    "loihi64": Hardware("loihi64", 1024, 4096, 64, 64, 1.7, 3.5, 2.1, 5.3),
    "loihi84": Hardware("loihi84", 4096, 65536, 84, 84, 1.0, 0.1, 1.0, 0.01),
    "loihi1024": Hardware("loihi1024", 4096, 65536, 1024, 1024, 1.0, 0.1, 1.0, 0.01),
    "truenorth": Hardware("truenorth", 256, 256, 64, 64, 1.7, 3.5, 2.1, 5.3),
}


def placement_validity(placement: DataFrame, hw: Hardware) -> DataFrame:
    """One row: n_placed, n_outside, n_shared (cells with two or more nodes), valid."""
    inside = F.col("x").between(0, hw.width - 1) & F.col("y").between(0, hw.height - 1)
    per_cell = placement.groupBy("x", "y").agg(F.count("*").alias("n"), F.first((~inside).cast("bigint")).alias("out"))
    row = per_cell.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_placed"), F.coalesce(F.sum(F.col("n") * F.col("out")), F.lit(0)).alias("n_outside"), F.count(F.when(F.col("n") > 1, 1)).alias("n_shared"))
    return row.withColumn("valid", (F.col("n_outside") == 0) & (F.col("n_shared") == 0))


def routes(pins: DataFrame, edges: DataFrame, placement: DataFrame) -> DataFrame:
    """(e, w, s, d, sx, sy, dx, dy) for each source and destination of a hyperedge."""
    at = pins.join(placement, "v")
    src = at.where("is_src").select("e", F.col("v").alias("s"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    dst = at.where("NOT is_src").select("e", F.col("v").alias("d"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    return src.join(dst, "e").join(edges, "e")


def distance() -> F:
    return F.abs(F.col("sx") - F.col("dx")) + F.abs(F.col("sy") - F.col("dy"))


def energy(routed: DataFrame, hw: Hardware) -> DataFrame:
    m = distance()
    return routed.agg(F.coalesce(F.sum(F.col("w") * ((m + 1) * hw.energy_routing + m * hw.energy_wire)), F.lit(0.0)).alias("energy"))


def latency(routed: DataFrame, pins: DataFrame, edges: DataFrame, hw: Hardware) -> DataFrame:
    """One row: avg_latency and max_latency. The divisor counts pins - 1 once for each source."""
    m = distance()
    one = (m + 1) * hw.latency_routing + m * hw.latency_wire
    sums = routed.agg(F.sum(F.col("w") * one).alias("total"), F.coalesce(F.max(one), F.lit(0.0)).alias("max_latency"))
    sizes = pins.groupBy("e").agg(F.count("*").alias("n"), F.sum(F.col("is_src").cast("bigint")).alias("s")).join(edges, "e")
    divisor = sizes.agg(F.sum(F.col("w") * (F.col("n") - 1) * F.col("s")).alias("d"))
    avg = F.when(F.col("d") > 0, F.col("total") / F.col("d")).otherwise(0.0)
    return sums.join(divisor).select(F.coalesce(avg, F.lit(0.0)).alias("avg_latency"), "max_latency")  # one row each


def average_congestion(routed: DataFrame, hw: Hardware) -> DataFrame:
    """One row: congestion (each route passes distance + 1 cells) and congestion_ref (routes to the left or up count their own axis not at all)."""
    x = F.when(F.col("sx") <= F.col("dx"), F.col("dx") - F.col("sx")).otherwise(0)
    y = F.when(F.col("sy") <= F.col("dy"), F.col("dy") - F.col("sy")).otherwise(0)
    mean = lambda cells, name: (F.coalesce(F.sum(F.col("w") * cells), F.lit(0)) / F.lit(float(hw.cores))).alias(name)
    return routed.agg(mean(distance() + 1, "congestion"), mean(1 + x + y, "congestion_ref"))


def transit(dx: int, dy: int) -> np.ndarray:
    """[a, b]: chance that a monotone route over dx by dy steps passes (a, b); at each free choice both axes are equally likely.

    Inside, C(a + b, a) / 2^(a + b), as running products; a border cell sums what enters its border up to it.
    """
    p = np.ones((dx + 1, dy + 1))
    if not dx or not dy:
        return p
    a, b = np.arange(dx)[:, None], np.arange(1, dy)[None, :]
    p[:dx, 0] = 0.5 ** np.arange(dx)
    p[:dx, 1:dy] = p[:dx, :1] * np.cumprod((a + b) / (2 * b), axis=1)
    p[dx, :dy] = np.cumsum(0.5 * p[dx - 1, :dy])
    p[:dx, dy] = np.cumsum(0.5 * p[:dx, dy - 1])
    return p


def cell_congestion(routed: DataFrame) -> DataFrame:
    """(x, y, load, load_ref): expected weight through each cell; load_ref leaves out the last row and column of each route's box.

    Routes of equal ends are summed first, so Python sees each pair of cells once and adds one box for it to
    a grid of the lattice's size.
    """
    pairs = routed.groupBy("sx", "sy", "dx", "dy").agg(F.sum("w").cast("double").alias("w"))

    def spread(batches):
        boxes = lru_cache(maxsize=4096)(transit)
        grid = np.zeros((2, 0, 0))
        for rows in batches:
            sx, sy, dx, dy = (rows[c].to_numpy() for c in ("sx", "sy", "dx", "dy"))
            top = [max([grid.shape[k + 1], *(int(c.max()) + 1 for c in ends if len(c))]) for k, ends in enumerate(((sx, dx), (sy, dy)))]
            grid = np.pad(grid, ((0, 0), (0, top[0] - grid.shape[1]), (0, top[1] - grid.shape[2])))
            for x0, y0, x1, y1, w in zip(sx.tolist(), sy.tolist(), dx.tolist(), dy.tolist(), rows["w"].tolist()):
                box = w * boxes(abs(x1 - x0), abs(y1 - y0))[:: 1 if x1 >= x0 else -1, :: 1 if y1 >= y0 else -1]
                x, y = min(x0, x1), min(y0, y1)
                grid[0, x : x + box.shape[0], y : y + box.shape[1]] += box
                grid[1, x : x + box.shape[0] - 1, y : y + box.shape[1] - 1] += box[:-1, :-1]
        x, y = np.nonzero(grid[0])
        yield pd.DataFrame({"x": x.astype("int32"), "y": y.astype("int32"), "load": grid[0, x, y], "load_ref": grid[1, x, y]})

    return pairs.mapInPandas(spread, "x int, y int, load double, load_ref double").groupBy("x", "y").agg(F.sum("load").alias("load"), F.sum("load_ref").alias("load_ref"))


def max_congestion(routed: DataFrame) -> DataFrame:
    """One row: max_congestion, and max_congestion_ref without the last row and column of each route."""
    most = lambda c, name: F.coalesce(F.max(c), F.lit(0.0)).alias(name)
    return cell_congestion(routed).agg(most("load", "max_congestion"), most("load_ref", "max_congestion_ref"))


def _cells_of(pins: DataFrame, placement: DataFrame) -> DataFrame:
    return pins.join(placement, "v").groupBy("e").agg(F.collect_set(F.struct("x", "y")).alias("cells"))


def hull_sizes(pins: DataFrame, placement: DataFrame) -> DataFrame:
    """(e, cells): lattice points in the convex hull of each hyperedge's pins."""
    at = _cells_of(pins, placement)

    def count(batches):
        for rows in batches:
            yield pd.DataFrame({"e": rows["e"], "cells": [hull_points([(c["x"], c["y"]) for c in cs]) for cs in rows["cells"]]})

    return at.mapInPandas(count, "e bigint, cells bigint")


def locality(pins: DataFrame, edges: DataFrame, placement: DataFrame) -> DataFrame:
    """One row: mean and geometric mean of hull sizes, flat and weighted."""
    sized = hull_sizes(pins, placement).join(edges, "e")
    t, w = F.col("cells"), F.col("w")
    return sized.agg(F.avg(t).alias("ar_mean"), F.exp(F.avg(F.log(t))).alias("geo_mean"), (F.sum(t * w) / F.sum(w)).alias("ar_mean_weighted"), F.exp(F.sum(F.log(t) * w) / F.sum(w)).alias("geo_mean_weighted"))


def max_source_distance(routed: DataFrame) -> DataFrame:
    """One row: sum over hyperedges and sources of w * farthest destination."""
    far = routed.groupBy("e", "s").agg(F.max(distance()).alias("m"), F.first("w").alias("w"))
    return far.agg(F.coalesce(F.sum(F.col("w") * F.col("m")), F.lit(0)).alias("max_distance"))


def tree_spans(pins: DataFrame, placement: DataFrame) -> DataFrame:
    """(e, span): length of a minimum spanning tree over each hyperedge's pins."""
    at = _cells_of(pins, placement)

    def span(batches):
        for rows in batches:
            yield pd.DataFrame({"e": rows["e"], "span": [tree_span([(c["x"], c["y"]) for c in cs]) for cs in rows["cells"]]})

    return at.mapInPandas(span, "e bigint, span bigint")


def weighted_tree_span(pins: DataFrame, edges: DataFrame, placement: DataFrame) -> DataFrame:
    return tree_spans(pins, placement).join(edges, "e").agg(F.coalesce(F.sum(F.col("w") * F.col("span")), F.lit(0)).alias("tree_span"))


def all_metrics(pins: DataFrame, edges: DataFrame, placement: DataFrame, hw: Hardware) -> DataFrame:
    """One row with every placement metric."""
    from ..tables import stored

    routed = stored(routes(pins, edges, placement), "routes")
    tables = (energy(routed, hw), latency(routed, pins, edges, hw), average_congestion(routed, hw), max_congestion(routed), locality(pins, edges, placement), max_source_distance(routed), weighted_tree_span(pins, edges, placement))
    out = placement_validity(placement, hw).select("valid")
    for t in tables:
        out = out.join(t)  # one row each
    return out


def expected_path(dx: int, dy: int) -> float:
    """Cells that a route passes, by the closed form C(i+j, i) / 2^(i+j) inside and rests on the borders; for tests."""
    inside = sum(math.comb(a + b, a) / 2 ** (a + b) for a in range(dx) for b in range(dy))
    return inside + (dx + dy + 1 - inside)
