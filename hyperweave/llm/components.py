"""Connected components of an edge table by alternating large-star and small-star steps.

Each round is a few shuffles of the edges and is written to the shared folder; nothing but two
numbers a round reaches the driver. A star's centre meets its leaves through map-side minima, which
are written, and an equi-join: with a table on each side, adaptive execution broadcasts small minima
and else splits the rows of a large star over tasks. Tables go as soon as their successor is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of u moves to the least of u and its neighbours. Small: every lesser or equal one does."""
    pairs = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = written(least.select("u", F.least("u", "m").alias("m")), "minima")
    if large:
        moved = pairs.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = written(moved.where("u > v").distinct(), "star")
    discard(least)
    return out


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``edges`` (u, v: BIGINT, in any order) to (node, root): one row per node that has an edge, root the least node reachable.

    Rows with nulls and loops are left out; repeated edges count once; no edges give no rows.
    """
    links = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = written(links, "links")
    digest = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = digest(links)
    for _ in range(rounds):
        if not before[0]:
            break
        large = _stars(links, True)
        discard(links)
        links = _stars(large, False)
        discard(large)
        after = digest(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
