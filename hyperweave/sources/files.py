"""Hypergraph, partitioning and placement files.

Text formats are read and written with Spark's text source; a line's number comes from (file, block, order of
reading) by a distributed prefix count. Binary formats have records of varying length: ``binary`` finds ranges of whole
records and reads and writes them by tasks. What is written is a folder of parts; in the order of their names they are the bytes of the
single-file format, and every reader takes such a folder or a single file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EDGES, GraphError, HGraph, validate
from ..tables import observed, prefix_sums, stored
from . import binary


def _write_lines(lines: DataFrame, path: str, header: str | None = None) -> None:
    """Write lines(n, value) in order of n, after the header, as parts."""
    if header is not None:
        head = lines.sparkSession.createDataFrame([(-1, header)], "n bigint, value string")
        lines = head.unionByName(lines.select("n", "value"))
    binary.ordered(lines.select("n", "value"), "n").select("value").write.mode("overwrite").text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): lines in file order, n from 0."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    raw = stored(raw, "lines")
    return prefix_sums(raw, ["f", "b", "i"], {}).select(F.col("row").alias("n"), "value")


def read_hmetis(spark: SparkSession, path: str) -> HGraph:
    """.hgr: '%' comments, header 'E V [fmt]', then one hyperedge a line, ids from 1, a weight first if fmt is 1 or 11.

    All pins are destinations; hyperedges of one pin are skipped; vertex weights (fmt 10, 11) are not
    used. Hyperedges are numbered in file order without the skipped ones.
    """
    lines = stored(_lines(spark, path).withColumn("t", F.trim(F.regexp_replace("value", r"\s+", " "))).where("t <> '' AND NOT startswith(t, '%')"), "hgr")
    first = lines.orderBy("n").first()
    if first is None:
        raise GraphError("no header")
    head = [int(x) for x in first.t.split(" ")]
    if len(head) not in (2, 3) or len(head) == 3 and head[2] not in (0, 1, 10, 11):
        raise GraphError(f"bad header {first.t!r}")
    n_edges, n_nodes, weighted = head[0], head[1], len(head) == 3 and head[2] in (1, 11)
    body = prefix_sums(lines.where(F.col("n") > first.n).select("n", "t"), ["n"], {}).where(F.col("row") < n_edges)
    tokens = F.split("t", " ")
    ids = F.slice(tokens, 2, F.size(tokens)) if weighted else tokens
    rows = body.select("n", F.transform(ids, lambda x: x.cast("bigint") - 1).alias("vs"), (F.element_at(tokens, 1).cast("double") if weighted else F.lit(1.0)).alias("w"))
    rows = stored(rows, "hgr")
    found = rows.agg(F.count("*").alias("n"), F.min(F.array_min("vs")).alias("low"), F.max(F.array_max("vs")).alias("high")).first()
    if found.n != n_edges:
        raise GraphError(f"{found.n} of {n_edges} hyperedges")
    if found.n and not 0 <= found.low <= found.high < n_nodes:
        raise GraphError("a pin is outside of 1..V")
    kept = stored(prefix_sums(rows.where("size(vs) > 1"), ["n"], {}).select(F.col("row").alias("e"), "vs", "w"), "hgr")
    nodes = spark.range(n_nodes).select(F.col("id").alias("v"), F.lit(1).cast("bigint").alias("size"))
    return HGraph(nodes, kept.select("e", "w"), kept.select("e", F.explode("vs").alias("v"), F.lit(False).alias("is_src")).distinct())


def write_hmetis(graph: HGraph, path: str, scale: int = 1024) -> None:
    """.hgr with weights as int(w * scale) if any weight is not 1 (reading does not undo the scale). A line must fit a row."""
    weighted = graph.edges.where("w <> 1").limit(1).count() > 0
    lists = graph.pins.groupBy("e").agg(F.array_sort(F.collect_set(F.col("v") + 1)).alias("vs")).join(graph.edges, "e")
    text = F.concat_ws(" ", F.transform("vs", lambda v: v.cast("string")))
    text = F.concat_ws(" ", F.floor(F.col("w") * scale).cast("bigint").cast("string"), text) if weighted else text
    _write_lines(lists.select(F.col("e").alias("n"), text.alias("value")), path, f"{graph.edges.count()} {graph.nodes.count()}{' 01' if weighted else ''}")


def _read_binary(spark: SparkSession, path: str, kind: str) -> HGraph:
    rows, records, (n_nodes, n_edges) = binary.read(spark, path, kind)
    if records != n_edges:
        raise GraphError(f"the file ends inside a hyperedge, or holds {records} of {n_edges}")
    rows = stored(rows, "binary")
    nodes = spark.range(n_nodes).select(F.col("id").alias("v"), F.lit(1).cast("bigint").alias("size"))
    return HGraph(nodes, rows.where("k = 0").select("e", "w"), rows.select("e", "v", "is_src"))


def read_snn(spark: SparkSession, path: str) -> HGraph:
    """.snn: u32 nodes, u32 edges, then per hyperedge u32 destinations, u32 source, u32 destination ids, f32 weight."""
    return _read_binary(spark, path, "snn")


def read_axh(spark: SparkSession, path: str) -> HGraph:
    """.axh: u32 nodes, u32 edges, then per hyperedge u32 pins, u32 sources, u32 pin ids (sources first), f32 weight."""
    return _read_binary(spark, path, "axh")


def _write_binary(graph: HGraph, path: str, kind: str) -> int:
    """Write the graph; returns how many hyperedges have more than one source."""
    share = 1 / F.col("n_pins")  # of a hyperedge, for each of its pins
    rows, seen = observed(binary.hedge_rows(graph), "hedges", bare=F.count_if(F.col("n_src") == 0), hedges=F.sum(share), many=F.sum(F.when(F.col("n_src") > 1, share)))
    if seen["bare"]:
        raise GraphError("a hyperedge has no source")
    binary.write(binary.ordered(rows, "e", F.desc("is_src"), "v").drop("is_src"), path, kind, (graph.nodes.count(), round(seen["hedges"] or 0)))
    return round(seen["many"] or 0)


def write_snn(graph: HGraph, path: str) -> int:
    """.snn; sources after the first become destinations. Returns how many hyperedges that touched."""
    return _write_binary(graph, path, "snn")


def write_axh(graph: HGraph, path: str) -> None:
    _write_binary(graph, path, "axh")


_READERS = {"hgr": read_hmetis, "snn": read_snn, "axh": read_axh}
_WRITERS = {"hgr": write_hmetis, "snn": write_snn, "axh": write_axh}


def _format(path: str, known: dict):
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in known:
        raise GraphError(f"unknown graph format {kind!r}; known: {', '.join(known)}")
    return known[kind]


def read_hypergraph(spark: SparkSession, path: str, check: bool = True) -> HGraph:
    """By the extension of ``path``."""
    graph = _format(path, _READERS)(spark, path)
    return validate(graph) if check else graph


def write_hypergraph(graph: HGraph, path: str) -> None:
    _format(path, _WRITERS)(graph, path)


def write_partitioning(parts: DataFrame, path: str) -> None:
    """One part id a line, in node order."""
    _write_lines(parts.select(F.col("v").alias("n"), F.col("p").cast("string").alias("value")), path)


def read_partitioning(spark: SparkSession, path: str, n_nodes: int) -> DataFrame:
    """parts(v, p); every line must be an unsigned 32-bit number, and their count that of the nodes."""
    lines = stored(_lines(spark, path).select("n", F.trim("value").alias("t")), "parts")
    found = lines.agg(F.count("*").alias("n"), F.count(F.when(~F.col("t").rlike(r"^[0-9]{1,10}$"), 1)).alias("bad")).first()
    if found.bad or found.n != n_nodes:
        raise GraphError(f"{found.n} lines for {n_nodes} nodes, {found.bad} of them no number")
    parts = lines.select(F.col("n").alias("v"), F.col("t").cast("bigint").alias("p"))
    if parts.where(F.col("p") >= 1 << 32).limit(1).count():
        raise GraphError("a part id needs more than 32 bits")
    return parts


def write_placement(placement: DataFrame, path: str) -> None:
    """u64 count, then i32 x, i32 y in node order."""
    rows = binary.ordered(placement.select("v", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")), "v")
    binary.write(rows, path, "bin", (placement.count(),))


def read_placement(spark: SparkSession, path: str) -> DataFrame:
    """placement(v, x, y)."""
    rows, records, (n,) = binary.read(spark, path, "bin")
    if records != n:
        raise GraphError("the file's length does not match its count")
    return rows


def edges_table(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, EDGES)
