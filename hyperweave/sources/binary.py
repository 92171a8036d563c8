"""Binary graph and placement files as a Spark data source: ranges of records are read, and parts written, by tasks.

A file starts with a header; then follow records of 32-bit little-endian words, whose length their first word tells (placements:
two words each). Written, it is a folder of parts, of which the first holds the header alone: the parts in the order of their
names are the bytes of the single-file format, and the reader takes a folder or a single file. Paths are those that
``pyarrow.fs`` can open on the driver and on executors.
"""

from __future__ import annotations

import json
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..schema import GraphError

FORMAT = "hyperweave"
#: Bytes that one read task takes, some; a record is never cut.
RANGE_BYTES = 32 << 20
#: Words that a task holds of a file while it looks for the ends of records.
WALK_WORDS = 1 << 22
PINS = "e bigint, k bigint, v bigint, is_src boolean, w double"
CELLS = "v bigint, x int, y int"


@dataclass(frozen=True)
class Kind:
    """Header, fixed words of a record (0: the first word counts more of them), words before the counted ones, and after."""

    header: str
    fixed: int = 0
    before: int = 0
    after: int = 0


KINDS = {
    "snn": Kind("<II", before=2, after=1),  # destinations, source, destination ids, weight
    "axh": Kind("<II", before=2, after=1),  # pins, sources, pin ids (sources first), weight
    "bin": Kind("<Q", fixed=2),  # x, y
}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the file, or of a folder's parts in order."""
    store, at = _open(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    if info.type != fs.FileType.Directory:
        raise GraphError(f"no file {path}")
    parts = sorted((x.path, x.size) for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and (x.base_name == "header" or x.base_name.startswith("part-")))
    if not parts or not parts[0][0].endswith("/header"):
        raise GraphError(f"{path} has no header")
    return parts


def record_ranges(words, kind: Kind, range_bytes: int):
    """(first word, words, records) of ranges of whole records; ``words(at, n)`` reads up to n words."""
    at = start = records = 0
    block, base = words(0, WALK_WORDS), 0
    while True:
        if at - base >= len(block):
            block, base = words(at, WALK_WORDS), at
            if not len(block):
                break
        size = kind.fixed or kind.before + int(block[at - base]) + kind.after
        at, records = at + size, records + 1
        if 4 * (at - start) >= range_bytes:
            yield start, at - start, records
            start, records = at, 0
    if records:
        yield start, at - start, records


def index(spark: SparkSession, path: str, kind_name: str, range_bytes: int = RANGE_BYTES) -> tuple[int, tuple, list[tuple]]:
    """(records, header, ranges): the ranges (file, byte, bytes, first record) of a file or folder.

    Each part is walked by one task, which reads it a block at a time and keeps the ends of ranges only.
    """
    kind, parts = KINDS[kind_name], files_of(path)
    head = struct.calcsize(kind.header)
    store, first = _open(path)[0], parts[0][0]
    with store.open_input_file(first) as file:
        raw = file.read(head)
    if len(raw) < head:
        raise GraphError("no header")

    def walk(batches):
        for batch in batches:
            for order, name, size, skip in zip(*(c.to_pylist() for c in batch.columns)):
                if (size - skip) % 4 or kind.fixed and (size - skip) % (4 * kind.fixed):
                    raise GraphError("the file ends inside a record")
                with _open(path)[0].open_input_file(name) as source:
                    read = lambda at, n: np.frombuffer(source.read_at(min(4 * n, max(size - skip - 4 * at, 0)), skip + 4 * at), "<u4")
                    found = list(record_ranges(read, kind, range_bytes))
                if found and 4 * (found[-1][0] + found[-1][1]) > size - skip:
                    raise GraphError("the file ends inside a hyperedge")
                columns = [[order] * len(found), [name] * len(found), [skip + 4 * a for a, _, _ in found], [4 * n for _, n, _ in found], [r for _, _, r in found]]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["o", "name", "at", "size", "records"])

    rows = [(k, name, size, head if k == 0 else 0) for k, (name, size) in enumerate(parts)]
    listed = spark.createDataFrame(rows, "o int, name string, size bigint, skip bigint").repartition(len(rows), "o")
    found = listed.mapInArrow(walk, "o int, name string, at bigint, size bigint, records bigint").orderBy("o", "at").collect()  # a row for each read task
    ranges, records = [], 0
    for r in found:
        ranges.append((r.name, r.at, r["size"], records))
        records += r.records
    return records, struct.unpack(kind.header, raw), ranges


class Range(InputPartition):
    def __init__(self, file: str, at: int, size: int, record: int):
        self.file, self.at, self.size, self.record = file, at, size, record


def pin_rows(words: np.ndarray, record: int, n_nodes: int, many_sources: bool, starts: list[int]) -> pa.RecordBatch:
    """PINS of the records that start at the given words."""
    at = np.array(starts, np.int64)
    counted = words[at].astype(np.int64)
    n_pins = counted if many_sources else counted + 1
    n_src = words[at + 1].astype(np.int64) if many_sources else np.ones(len(at), np.int64)
    if many_sources and ((n_src < 1) | (n_pins < n_src)).any():
        raise GraphError("a hyperedge needs a source and at least as many pins")
    first = at + (2 if many_sources else 1)
    weight = words[first + n_pins].view("<f4").astype(np.float64)
    k = np.arange(int(n_pins.sum())) - np.repeat(np.cumsum(n_pins) - n_pins, n_pins)
    v = words[np.repeat(first, n_pins) + k].astype(np.int64)
    if len(v) and int(v.max()) >= n_nodes:
        raise GraphError("a pin is not a node")
    columns = [np.repeat(record + np.arange(len(at)), n_pins), k, v, k < np.repeat(n_src, n_pins), np.repeat(weight, n_pins)]
    return pa.record_batch([pa.array(c) for c in columns], ["e", "k", "v", "is_src", "w"])


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind, self.nodes = options["path"], options["kind"], int(options.get("nodes", 0))
        self.ranges = json.loads(options["ranges"])

    def partitions(self):
        return [Range(*r) for r in self.ranges]

    def read(self, part: Range | None):
        if part is None:  # a file without records
            return
        kind = KINDS[self.kind]
        with _open(self.path)[0].open_input_file(part.file) as file:
            words = np.frombuffer(file.read_at(part.size, part.at), "<u4")
        if kind.fixed:
            xy = words.view("<i4").reshape(-1, 2)
            yield pa.record_batch([pa.array(part.record + np.arange(len(xy))), pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["v", "x", "y"])
            return
        at, record, starts, held = 0, part.record, [], 0
        while at < len(words):
            size = kind.before + int(words[at]) + kind.after
            starts.append(at)
            at, held = at + size, held + size
            if held > 1 << 16 or at >= len(words):
                yield pin_rows(words, record, self.nodes, self.kind == "axh", starts)
                record, starts, held = record + len(starts), [], 0


class Written(WriterCommitMessage):
    def __init__(self, name: str, part: int, rows: int):
        self.name, self.part, self.rows = name, part, rows


class Writer(DataSourceArrowWriter):
    """Each task writes one part under a name of its own; the commit gives the parts of the tasks that count their places and then writes the header."""

    def __init__(self, options):
        self.path, self.kind, self.header = options["path"], options["kind"], json.loads(options["header"])
        self.folder = f"_parts-{uuid.uuid4().hex}"

    def write(self, batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, at = _open(self.path)
        name, rows = f"{at}/{self.folder}/{uuid.uuid4().hex}", 0
        store.create_dir(f"{at}/{self.folder}", recursive=True)
        with store.open_output_stream(name) as out:
            if KINDS[self.kind].fixed:
                for b in batches:
                    rows += b.num_rows
                    out.write(np.stack([b.column("x").to_numpy(), b.column("y").to_numpy()], 1).astype("<i4").tobytes())
            else:
                rows = self._hedges(batches, out)
        return Written(name, part, rows)

    def _hedges(self, batches, out) -> int:
        """Rows (e, v, n_pins, n_src, w) by e, sources first: a record's first words before its first pin, the weight after its last."""
        last, seen, total = None, 0, 0
        many = self.kind == "axh"
        for b in batches:
            if not b.num_rows:
                continue
            e, v, n_pins, n_src, w = (b.column(c).to_numpy() for c in ("e", "v", "n_pins", "n_src", "w"))
            starts = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
            k = np.arange(len(e)) - np.repeat(starts, np.diff(np.append(starts, len(e))))
            if e[0] == last:
                k[: starts[1] if len(starts) > 1 else len(e)] += seen
            first, end = k == 0, k == n_pins - 1
            lead = 2 if many else 1
            place = np.arange(len(e)) + lead * np.cumsum(first) + np.cumsum(end) - end
            words = np.zeros(len(e) + lead * int(first.sum()) + int(end.sum()), "<u4")
            words[place] = v
            words[place[first] - lead] = n_pins[first] - (0 if many else 1)
            if many:
                words[place[first] - 1] = n_src[first]
            words[place[end] + 1] = w[end].astype("<f4").view("<u4")
            out.write(words.tobytes())
            last, seen, total = e[-1], int(k[-1]) + 1, total + len(e)
        return total

    def commit(self, messages):
        store, at = _open(self.path)
        for m in messages:
            if m is not None and m.rows:
                store.move(m.name, f"{at}/part-{m.part:08d}")
        store.create_dir(at, recursive=True)
        if store.get_file_info(f"{at}/{self.folder}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/{self.folder}")
        with store.open_output_stream(f"{at}/header") as out:
            out.write(struct.pack(KINDS[self.kind].header, *self.header))

    def abort(self, messages):
        store, at = _open(self.path)
        if store.get_file_info(f"{at}/{self.folder}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/{self.folder}")


class GraphFiles(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return CELLS if KINDS[self.options["kind"]].fixed else PINS

    def reader(self, schema):
        return Reader(dict(self.options))

    def writer(self, schema, overwrite):
        return Writer(dict(self.options))


def read(spark: SparkSession, path: str, kind: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, int, tuple]:
    """(rows, records, header): PINS, or CELLS of a placement file."""
    spark.dataSource.register(GraphFiles)
    records, header, ranges = index(spark, path, kind, range_bytes)
    rows = spark.read.format(FORMAT).options(path=path, kind=kind, nodes=header[0], ranges=json.dumps(ranges)).load()
    return rows, records, header


def write(rows: DataFrame, path: str, kind: str, header: tuple) -> None:
    """Write rows that are range-partitioned and sorted by their place; a file or folder at ``path`` is replaced."""
    spark = rows.sparkSession
    spark.dataSource.register(GraphFiles)
    store, at = _open(path)
    there = store.get_file_info(at).type
    if there == fs.FileType.Directory:
        store.delete_dir(at)
    elif there == fs.FileType.File:
        store.delete_file(at)
    rows.write.format(FORMAT).mode("append").options(path=path, kind=kind, header=json.dumps(header)).save()


def ordered(df: DataFrame, key: str, *within) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, key).sortWithinPartitions(key, *within)


def hedge_rows(graph) -> DataFrame:
    """(e, v, n_pins, n_src, w, is_src)."""
    sizes = graph.pins.groupBy("e").agg(F.count("*").alias("n_pins"), F.sum(F.col("is_src").cast("bigint")).alias("n_src"))
    return graph.pins.join(sizes, "e").join(graph.edges, "e").select("e", "v", "n_pins", "n_src", F.col("w").cast("double").alias("w"), "is_src")
