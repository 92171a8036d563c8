"""SimHash near-dedup (10) by a segment-popcount embedding.

A fingerprint is embedded as the bit counts of its segments. One changed bit moves one count of a
segmentation by one, so the Manhattan distance of two embeddings is a lower bound of the Hamming
distance. The grid: the 64 bits form m groups, each embedded by the counts of its two-bit segments in
two segmentations, one shifted by a bit. Two fingerprints within Hamming distance r <= m - 1 agree in
the coordinates of at least m - r groups, so cells keyed by each choice of m - r groups hold all
linked pairs (a range join whose cells have width one in a subset of the coordinates). Pairs in a
cell are then filtered by the Manhattan distance of their eight-bit segment counts and verified by
the Hamming distance.

Only different fingerprints enter the grid, so exact copies are one point. A cell yields no pairs but
a spanning forest of its links: searches run breadth-first and each search drops what it has
reached. A cell of more than ``cell_rows`` points is split into blocks; each pair of blocks is one
unit of work, so that no task must hold a cell. All links of the forest go to ``components``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, own, table, utf8_rows, written
from .components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
CELL_ROWS = 8192
CHUNK_SHINGLES = 1 << 17


# fingerprints


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of the ASCII-lower-cased text, repeats included."""
    words = text.lower().split()
    if not words:
        return []
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends[:-size] if size < len(ends) else ends[:0]).tolist()
    return [digest(line[a:b], SEED) for a, b in zip([0, *starts], (ends[size - 1 :] - 1).tolist())]


def majority(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half the hashes (0 for none)."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), CHUNK_SHINGLES):
        part = hashes[a : a + CHUNK_SHINGLES]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    return majority(np.array(shingle_hashes(text, size), np.dtype("<u8")))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """Add BIGINT ``out`` (the 64 bits as a signed number). Null and wordless texts get 0; a very long text is read whole; an empty table stays empty."""

    @F.arrow_udf("long")
    def prints(batch: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t or b"", shingle) for t in utf8_rows(batch)], np.uint64).view(np.int64), pa.int64())

    return df.withColumn(free_name(df, out), prints.asNondeterministic()(own(df, text)))


# grid


def groups_of(m: int) -> list[list[int]]:
    """The 64 bits in m groups of neighbours."""
    return [bits.tolist() for bits in np.array_split(np.arange(64), m)]


def mask(bits) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def pair_counts(fp: Column, shifted: bool) -> Column:
    """Bit counts of the two-bit segments of each 64-bit value, two bits each: bits (0,1), (2,3) .. or (1,2), (3,4) .. ."""
    low, high = (F.shiftrightunsigned(fp, k).bitwiseAND(F.lit(0x5555555555555555)) for k in (int(shifted), int(shifted) + 1))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def choices(m: int, radius: int) -> list[tuple[int, int]]:
    """For each choice of m - radius groups the masks of their segments in both segmentations (of segments within the groups)."""
    groups = groups_of(m)
    out = []
    for chosen in combinations(groups, m - radius):
        plain = [b for g in chosen for a in range(0, 64, 2) if a in g and a + 1 in g for b in (a, a + 1)]
        shifted = [b - 1 for g in chosen for a in range(1, 63, 2) if a in g and a + 1 in g for b in (a, a + 1)]
        out.append((mask(plain), mask(shifted)))
    return out


def groups_for(points: int, radius: int = RADIUS, per_point: float = 32.0) -> int:
    """Least m for which random fingerprints meet fewer than ``per_point`` others in their cells."""
    for m in range(radius + 2, 17):
        bits = 64 * (m - radius) / m
        if len(list(combinations(range(m), radius))) * points / 2.0 ** (0.95 * bits) <= per_point:
            return m
    return 16


def cells(points: DataFrame, m: int, radius: int) -> DataFrame:
    """(cell, fp) for each choice of groups."""
    a, b = pair_counts(F.col("fp"), False), pair_counts(F.col("fp"), True)
    keys = [F.xxhash64(F.lit(k), F.col("a").bitwiseAND(F.lit(p)), F.col("b").bitwiseAND(F.lit(s))) for k, (p, s) in enumerate(choices(m, radius))]
    return points.select("fp", a.alias("a"), b.alias("b")).select("fp", F.explode(F.array(*keys)).alias("cell"))


def byte_counts(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint8)).reshape(-1, 8).astype(np.int8)


def near(one: np.uint64, counts: np.ndarray, others: np.ndarray, other_counts: np.ndarray, radius: int) -> np.ndarray:
    """Which others are within the radius: Manhattan bound on the segment counts, then the Hamming distance."""
    hit = np.abs(other_counts - counts).sum(axis=1, dtype=np.int64) <= radius
    at = np.flatnonzero(hit)
    hit[at] = np.bitwise_count(others[at] ^ one) <= radius
    return hit


def forest(fps: np.ndarray, left: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that connect what links connect. ``left``: a mask; only links between both sides count then."""
    counts, out = byte_counts(fps), []
    alive = np.arange(len(fps))
    while len(alive):
        queue, alive = [alive[0]], alive[1:]
        while queue and len(alive):
            one = queue.pop()
            hit = near(fps[one], counts[one], fps[alive], counts[alive], radius)
            if left is not None:
                hit &= left[alive] != left[one]
            reached = alive[hit]
            out += [(int(fps[one]), int(x)) for x in fps[reached]]
            queue += reached.tolist()
            alive = alive[~hit]
    return out


def small_links(cell: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All links inside sorted small cells, by comparing each row with the row d places on."""
    counts, us, vs, d = byte_counts(fps), [], [], 1
    at = np.arange(len(fps) - 1)
    while len(at):
        at = at[at + d < len(fps)]
        at = at[cell[at] == cell[at + d]]
        hit = at[np.abs(counts[at] - counts[at + d]).sum(axis=1, dtype=np.int64) <= radius]
        hit = hit[np.bitwise_count(fps[hit] ^ fps[hit + d]) <= radius]
        us.append(fps[hit])
        vs.append(fps[hit + d])
        d += 1
    return (np.concatenate(us), np.concatenate(vs)) if us else (fps[:0], fps[:0])


SMALL = 24


def _links_of_cells(batches, radius: int):
    """Rows (unit, side, fp), sorted by unit, to links (u, v)."""
    kept: list[pa.Table] = []

    def links(tables: list[pa.Table]):
        rows = pa.concat_tables(tables)
        unit = rows["unit"].to_numpy()
        side, fps = rows["side"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])) if len(unit) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(unit)))
        small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes) & (side == 2)
        us, vs = small_links(unit[small], fps[small], radius)
        us, vs = [us.view(np.int64)], [vs.view(np.int64)]
        for a, n in zip(starts.tolist(), sizes.tolist()):
            if n > SMALL or n > 1 and side[a] != 2:
                found = np.array(forest(fps[a : a + n], None if side[a] == 2 else side[a : a + n] == 1, radius), np.uint64).reshape(-1, 2)
                us.append(found[:, 0].copy().view(np.int64))
                vs.append(found[:, 1].copy().view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        unit = batch.column("unit").to_numpy()
        last = int(np.searchsorted(-(unit[::-1] == unit[-1]).astype(np.int8), 0, "left"))  # rows of the last unit
        if last < len(unit):
            yield links([*kept, rows.slice(0, len(unit) - last)])
            kept = [rows.slice(len(unit) - last)]
        elif kept and kept[-1]["unit"][-1].as_py() != int(unit[0]):
            yield links(kept)
            kept = [rows]
        else:
            kept.append(rows)
    if kept:
        yield links(kept)


def links(points: DataFrame, m: int, radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (u, v) that connect the same distinct fingerprints as all links within ``radius`` do."""
    grid = cells(points, m, radius)
    sizes = grid.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows).select("cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("blocks"))
    marked = grid.join(sizes, "cell", "left")
    plain = marked.where("blocks IS NULL").select(F.col("cell").alias("unit"), F.lit(2).cast("tinyint").alias("side"), "fp")
    # block i of a large cell: alone once (side 2), with each other block once (sides 0 and 1)
    block = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long")).cast("int")
    large = marked.where("blocks IS NOT NULL").select("cell", "fp", "blocks", block.alias("i")).select("cell", "fp", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    side = F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1).cast("tinyint")
    large = large.select(F.xxhash64("cell", F.least("i", "j"), F.greatest("i", "j")).alias("unit"), side.alias("side"), "fp")
    units = plain.unionByName(large)
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = units.repartition(parts, "unit").sortWithinPartitions("unit")
    return units.mapInArrow(lambda batches: _links_of_cells(batches, radius), "u long, v long").distinct()


def near_classes(df: DataFrame, id_: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``near_copies`` with ``class``: one fingerprint that stands for all of a component (least ids may be equal where ids repeat)."""
    prints = written(fingerprints(df.select(own(df, id_).alias("id"), own(df, text).alias("text")), "text", "fp", shingle).drop("text"), "prints")
    points = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "points")
    m = groups_for(points.count(), radius)
    roots = components(links(points.select("fp"), m, radius, cell_rows))
    points = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    of_root = points.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("least"))
    points = written(points.join(of_root, "root", "left").select("fp", F.coalesce("least", "first").alias("component"), F.coalesce("root", "fp").alias("class")), "classes")
    return prints.join(points, "fp").select("id", "fp", "component", "class")


def near_copies(df: DataFrame, id_: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, fp, component) for each row of ``df``: component is the least id reachable over links within ``radius``.

    Rows of equal fingerprints are one point. Null and wordless texts have fingerprint 0. A row
    with a null id is linked like any other, but is never the least one (null if there is no other);
    repeated rows and ids stay as rows. An empty table gives an empty one. Texts are not shuffled.
    """
    return near_classes(df, id_, text, shingle, radius, cell_rows).drop("class")


def first_copies(df: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each component: the one with the least id.

    Rows with a null id stay only where no row of their component has an id (one of them then, by
    fingerprint). An id may be repeated with other texts: its rows stand for each component of which it is
    the least id, one row for each (that of the least fingerprint).
    """
    rows = written(near_classes(df, id_, text), "copies")
    held = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("component").alias("c"), F.count("*").alias("n"))
    gone = held.where("id <> c OR n > 1").select(F.col("id").alias(id_))
    # rows of repeated ids are chosen by id and fingerprint, apart, so that texts of other rows don't move for it
    name = free_name(df, "fp")
    first = rows.where("id = component").groupBy("class", "id").agg(F.min("fp").alias("fp"))
    twice = written(first.join(held.where("n > 1").select("id"), "id", "left_semi").select(F.col("id").alias(id_), F.col("fp").alias(name)), "repeated")
    kept = df.where(own(df, id_).isNotNull())
    again = fingerprints(kept.join(twice.select(id_).distinct(), id_, "left_semi"), text, name).join(twice, [id_, name], "left_semi").dropDuplicates([id_, name])
    once = kept.join(gone, id_, "left_anti").unionByName(again.select(*[own(again, c) for c in df.columns]))
    lone = rows.where("id IS NULL AND component IS NULL").select("fp").distinct()
    nameless = fingerprints(df.where(own(df, id_).isNull()), text, name)
    nameless = nameless.join(lone.withColumnRenamed("fp", name), name, "left_semi").dropDuplicates([name])
    return once.unionByName(nameless.select(*[own(nameless, c) for c in df.columns])).select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def op10_simhash_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = near_copies(docs)
    return rows.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
