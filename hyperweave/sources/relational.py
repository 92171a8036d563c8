"""Hypergraphs from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import HGraph
from ..tables import prefix_sums


def from_table(rows: DataFrame, hedge: str, node: str, nodes: DataFrame, weight=None, order: list[str] | None = None) -> HGraph:
    """A hyperedge per value of ``hedge`` over the distinct values of ``node``.

    ``weight``: an aggregate over the hyperedge's rows (1 if none). With ``order`` the first node by
    these columns is the source and hyperedges of one pin are left out; else all pins are destinations.
    """
    weight = F.lit(1).cast("bigint") if weight is None else weight
    edges = rows.groupBy(F.col(hedge).alias("e")).agg(weight.alias("w"))
    if order is None:
        pins = rows.select(F.col(hedge).alias("e"), F.col(node).alias("v")).distinct().withColumn("is_src", F.lit(False))
        return HGraph(nodes, edges, pins)
    first = rows.groupBy(F.col(hedge).alias("e"), F.col(node).alias("v")).agg(F.min(F.struct(*order)).alias("at"))
    w = Window.partitionBy("e")
    pins = first.withColumn("least", F.min(F.struct("at", "v")).over(w)).withColumn("n", F.count("*").over(w)).where("n > 1").select("e", "v", (F.col("v") == F.col("least.v")).alias("is_src"))
    two = (F.min(node) < F.max(node)) | (F.count(node) > 0) & (F.count(node) < F.count("*"))  # a null counts as a node
    edges = rows.where(F.col(hedge).isNotNull()).groupBy(F.col(hedge).alias("e")).agg(weight.alias("w"), two.alias("two")).where("two").drop("two")
    return HGraph(nodes, edges, pins)


def _nodes(table: DataFrame, key: str) -> DataFrame:
    return table.select(F.col(key).cast("bigint").alias("v"), F.lit(1).cast("bigint").alias("size"))


def basket(spark: SparkSession, sf_dir: str, directed: bool = False) -> HGraph:
    """Orders as hyperedges over parts; weight = total quantity (integer)."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    parts = _nodes(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")
    weight = F.sum("l_quantity").cast("bigint")
    return from_table(lines, "l_orderkey", "l_partkey", parts, weight, ["l_linenumber", "l_partkey"] if directed else None)


def supply(spark: SparkSession, sf_dir: str) -> HGraph:
    """Suppliers as few, very large hyperedges over parts."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_quantity")
    return from_table(lines, "l_suppkey", "l_partkey", _nodes(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey"), F.sum("l_quantity").cast("bigint"))


def user_events(spark: SparkSession, sf_dir: str) -> HGraph:
    """Users as hyperedges over event types, numbered in the order of their names."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type")
    ids = prefix_sums(events.select("event_type").distinct(), ["event_type"], {}).withColumnRenamed("row", "v")
    rows = events.join(ids, "event_type")
    return from_table(rows, "user_id", "v", ids.select("v", F.lit(1).cast("bigint").alias("size")), F.count("*"))
