"""Cut points of long plans: tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Places of a dense order that one task sums up (``running_sums``).
BLOCK = 1 << 16
#: Rows of the largest table of a loop for each shuffle partition (``sized``).
ROWS_A_TASK = 50_000


def shared_dir(spark: SparkSession) -> str:
    """Folder from ``spark.checkpoint.dir``; only a local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="hyperweave-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` and return a reader: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def observed(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, dict]:
    """``stored``, with aggregates of the rows that the writing job takes on its way; no job of their own."""
    seen = Observation()
    back = stored(df.observe(seen, *[c.alias(k) for k, c in figures.items()]), name)
    return back, seen.get


class Log:
    """A table that grows by written parts; ``rows`` reads all of them at once."""

    def __init__(self, first: DataFrame, name: str):
        self.spark, self.schema, self.name, self.paths = first.sparkSession, first.schema, name, []
        self.add(first)

    def add(self, df: DataFrame) -> DataFrame:
        return self.observed(df)[0]

    def observed(self, df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
        """``add``, with aggregates of the rows; these may use columns of ``df`` that the log leaves out."""
        seen = Observation()
        seen_df = df.observe(seen, *[c.alias(k) for k, c in figures.items()]) if figures else df
        part = stored(seen_df.select(*self.schema.names), self.name)
        self.paths.append(part.stored_path)
        return part, seen.get if figures else {}

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


@contextmanager
def sized(spark: SparkSession, rows: int):
    """As many shuffle partitions as ``rows`` need, and no more than the session has; small levels of a loop get few tasks."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, max(1, min(int(before), -(-rows // ROWS_A_TASK))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add ``row`` (0-based place in ``order``) and running sums {new: column}, without a one-task window.

    Rows are range-partitioned by ``order`` (which must be unique), each partition is summed, and
    the few partition totals, one row each, give the offsets.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(parts, *order).withColumn("part_", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("part_").agg(F.count("*").alias("n_"), *[F.sum(c).alias(f"{k}_total_") for k, c in sums.items()])
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = totals.select("part_", zero("n_").alias("row_"), *[zero(f"{k}_total_").alias(f"{k}_offset_") for k in sums])
    within = Window.partitionBy("part_").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(offsets), "part_")  # one row for each shuffle partition
    out = out.withColumn("row", F.row_number().over(within) - 1 + F.col("row_"))
    for k, c in sums.items():
        out = out.withColumn(k, F.sum(c).over(upto) + F.col(f"{k}_offset_"))
    return out.drop("part_", "row_", *[f"{k}_offset_" for k in sums])


def running_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, str], block: int = BLOCK, places: int | None = None) -> DataFrame:
    """Add running sums {new: column} over the rows with the same ``keys``, by ``order``: a dense BIGINT from 0, unique in a key.

    A key may hold most of the rows, and there may be no key at all: each ``block`` of the order is summed apart, then the totals of the
    blocks, one row for each key and block. ``places``, if known, bounds the order: a single block needs no totals.
    """
    blocked = df.withColumn("block_", F.floor(F.col(order) / block))
    within = Window.partitionBy(*keys, "block_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inner = blocked.withColumns({k: F.sum(c).over(within) for k, c in sums.items()})
    if places is not None and places <= block:
        return inner.drop("block_")
    totals = blocked.groupBy(*keys, "block_").agg(*[F.sum(c).alias(f"{k}_total_") for k, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "block_", *[F.coalesce(F.sum(f"{k}_total_").over(before), F.lit(0)).alias(f"{k}_offset_") for k in sums])
    out = inner.join(offsets, [*keys, "block_"])
    return out.select(*df.columns, *[(F.col(k) + F.col(f"{k}_offset_")).alias(k) for k in sums])


def run_starts(following: DataFrame) -> DataFrame:
    """(row, at, run) from following(row, to): rows 0, 1, .. fall into runs, the first at row 0, and a run that
    starts at a row is followed by one at ``to`` (null: by none). ``at`` is the row where it starts a run, else null.

    Starts are marked by pointer doubling from row 0, one written table a step; a running count of them numbers the runs.
    """
    state = following.select("row", "to", (F.col("row") == 0).alias("on"))
    while True:
        further = state.select(F.col("row").alias("to"), F.col("to").alias("to2"))
        marked = state.where("on AND to IS NOT NULL").select(F.col("to").alias("row"), F.lit(True).alias("hit"))
        step = state.join(further, "to", "left").join(marked, "row", "left")
        state, seen = observed(step.select("row", F.col("to2").alias("to"), (F.col("on") | F.col("hit").isNotNull()).alias("on")), "runs", left=F.count_if(F.col("on") & F.col("to").isNotNull()))
        if not seen["left"]:
            break
    one = state.select("row", F.col("on").cast("bigint").alias("one"), F.when(F.col("on"), F.col("row")).alias("at"))
    return running_sums(one, [], "row", {"run": "one"}).select("row", "at", (F.col("run") - 1).alias("run"))
