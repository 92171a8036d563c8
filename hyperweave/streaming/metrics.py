"""Cut metrics over a stream of pins.

State is the count of pins by (hyperedge, part), kept in Spark's state store under the query's checkpoint. Each
epoch writes the counts that it changed beside the checkpoint, under its own number: a repeated epoch replaces its file, and a query that
is started again on the checkpoint goes on from the last finished one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import HGraph

COUNTS = "e bigint, p bigint, n bigint, epoch bigint"


@dataclass(frozen=True)
class CutStream:
    """Metrics of all pins that the query has taken so far, also of runs before a restart."""

    spark: SparkSession
    edges: DataFrame
    folder: str

    def write(self, changed: DataFrame, epoch: int) -> None:
        changed.select("e", "p", "n", F.lit(epoch).cast("bigint").alias("epoch")).write.mode("overwrite").parquet(f"{self.folder}/epoch-{epoch:012d}")

    def counts(self) -> DataFrame:
        """(e, p, n): the last written count of each hyperedge and part."""
        rows = self.spark.read.schema(COUNTS).option("recursiveFileLookup", "true").parquet(self.folder)
        return rows.groupBy("e", "p").agg(F.max_by("n", "epoch").alias("n"))

    def metrics(self) -> DataFrame:
        """One row: connectivity, cut_net, soed."""
        spread = self.counts().groupBy("e").agg(F.count("*").alias("l"), F.sum("n").alias("n")).join(self.edges, "e")
        over = F.col("l") - 1
        return spread.agg(F.sum(F.col("w") * over).alias("connectivity"), F.coalesce(F.sum(F.when(over > 0, F.col("w"))), F.lit(0)).alias("cut_net"), F.sum(F.col("w") * over * F.col("n")).alias("soed"))


def watch(pins: DataFrame, graph: HGraph, parts: DataFrame, checkpoint: str, trigger: dict | None = None) -> tuple[StreamingQuery, CutStream]:
    """Start a query over streaming pins(e, v, is_src). ``checkpoint`` also holds the counts, in its folder ``counts``."""
    state = CutStream(pins.sparkSession, graph.edges, f"{checkpoint.rstrip('/')}/counts")
    counts = pins.select("e", "v").join(parts, "v").groupBy("e", "p").agg(F.count("*").alias("n"))
    query = counts.writeStream.outputMode("update").foreachBatch(state.write).option("checkpointLocation", f"{checkpoint.rstrip('/')}/query").trigger(**(trigger or {"availableNow": True})).start()
    return query, state
