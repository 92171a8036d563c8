"""Periodic run detection (13): power-of-two names of word sequences give every repeated period.

Level k names the sequence of 2^k words at each position by the pair of names of its two halves
(Karp, Miller and Rosenberg), so equal names are equal sequences, with no hash in between. A position
whose sequence occurs nowhere else in its text keeps a name of its own, and only the others are named
again on the next level, so a text without repeats needs two or three levels. Common extensions of two
positions are read off the names from the highest level down.

Of a run with period q the positions i whose word stands again at i + q are at least
``(min_exponent - 1) * q`` in a row, so one of them lies on the grid of that step. Grid pairs with equal words are
extended to both sides; a run found again with a multiple of its period covers the same words and is dropped.

All rows of an Arrow batch are cut to chunks of ``CHUNK_BYTES``; a longer text makes a chunk of its own. Symbols
carry the number of their text, so nothing is extended into the next one.
"""

from __future__ import annotations

import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, own, table, utf8_rows
from .quality import chunks, coded, slices

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Grid pairs that are looked at together.
PAIRS = 1 << 20
RUNS = "runs: array<struct<start: long, length: long, period: long>>, collapsed: string"
_KIND = pa.struct([("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


def names(symbols: np.ndarray) -> list[np.ndarray]:
    """Level k: a name for each sequence of 2^k symbols; levels end before the first one without two equal names.

    Shorter ends of ``symbols`` and sequences that occur once have names of their own.
    """
    n = len(symbols)
    level = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    out, half = [], 1
    while True:
        counts = np.bincount(level, minlength=1)
        live = np.flatnonzero(counts[level] > 1)
        if not len(live):
            return out
        out.append(level.astype(np.int32 if n < 1 << 30 else np.int64))
        live = live[live + half < n]
        pair = level[live] * (int(level.max()) + 1) + level[live + half]
        known, inverse = np.unique(pair, return_inverse=True)
        level = np.full(n, -1, np.int64)
        level[live] = inverse
        alone = np.flatnonzero(level < 0)
        level[alone] = len(known) + np.arange(len(alone))
        half *= 2


def forward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words agree from i and j (i < j) on."""
    start, i, j = i, i.copy(), j.copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero(j < len(levels[k]))
        same = inside[levels[k][i[inside]] == levels[k][j[inside]]]
        i[same] += 1 << k
        j[same] += 1 << k
    return i - start


def backward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words agree before i and j (i < j)."""
    start, i, j = i, i.copy(), j.copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero(i >= 1 << k)
        same = inside[levels[k][i[inside] - (1 << k)] == levels[k][j[inside] - (1 << k)]]
        i[same] -= 1 << k
        j[same] -= 1 << k
    return start - i


def grid(first: np.ndarray, longest: int, min_length: int, min_exponent: int):
    """Pairs (i, i + q) of equal symbols with i on the grid of q, for every period q, in blocks of some PAIRS."""
    n, q, top = len(first), 1, longest // min_exponent
    while q <= top:
        step = max((min_exponent - 1) * q, min_length - q)
        if n // step > 64:  # one period with many grid points
            left = first[: n - q : step]
            at = np.flatnonzero(left == first[q::step][: len(left)])
            for a in range(0, len(at), PAIRS):
                i = at[a : a + PAIRS] * step
                yield i, i + q, np.full(len(i), q)
            q += 1
            continue
        periods = np.arange(q, min(top, q + PAIRS // 64) + 1)
        steps = np.maximum((min_exponent - 1) * periods, min_length - periods)
        points = np.maximum(-(-(n - periods) // steps), 0)
        period, width = np.repeat(periods, points), np.repeat(steps, points)
        i = (np.arange(len(period)) - np.repeat(np.cumsum(points) - points, points)) * width
        same = first[i] == first[i + period]
        yield i[same], i[same] + period[same], period[same]
        q = int(periods[-1]) + 1


def maximal_runs(symbols: np.ndarray, longest: int, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (start, length, period) by start, then period; ``longest`` bounds the length of a text in ``symbols``."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has two periods and two words at least")
    levels, found = names(symbols), [np.zeros((0, 3), np.int64)]
    if levels:
        for i, j, q in grid(levels[0], longest, min_length, min_exponent):
            if len(i):
                ahead = forward(levels, i, j)
                start = i - backward(levels, i, j)
                length = i + ahead + q - start
                long = length >= np.maximum(min_length, min_exponent * q)
                found.append(np.unique(np.stack([start[long], length[long], q[long]], 1), axis=0))
    rows = np.unique(np.concatenate(found), axis=0)  # by start, length, period
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)  # the same words again have a multiple of the period
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words are in no run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def collapsed(text: bytes, keep: np.ndarray) -> bytes:
    out, at = [], 0
    for part in slices(text):
        words = part.split()
        if some := list(compress(words, keep[at : at + len(words)].tolist())):
            out.append(b" ".join(some))
        at += len(words)
    return b" ".join(out)


def measure(texts: list[bytes], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[np.ndarray, bytes]]:
    """(runs, text without the repeats) for each text."""
    flat, counts, n_ids = coded(texts)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    symbols = flat + np.repeat(np.arange(len(texts), dtype=np.int64) * max(n_ids, 1), counts)
    runs = maximal_runs(symbols, int(counts.max(initial=0)), min_length, min_exponent) if len(symbols) else np.zeros((0, 3), np.int64)
    cuts = np.searchsorted(runs[:, 0], bounds)
    out = []
    for k, text in enumerate(texts):
        own_runs = runs[cuts[k] : cuts[k + 1]] - [bounds[k], 0, 0]
        out.append((own_runs, collapsed(text, kept_words(int(counts[k]), own_runs))))
    return out


def find_runs(df: DataFrame, text: str = "text", out: str = "periodic", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Add struct ``out`` with RUNS: maximal runs by start, then period, and the text without their repeats.

    A run is a stretch of words with smallest period q, of ``max(min_length, min_exponent * q)`` words or more, that
    no neighbouring word extends. ``collapsed`` joins the words that no run holds after its first period by one space.
    Null and empty texts have no words: no runs, an empty string. Runs may overlap and share a start; both
    stay. Repeated rows get the same result, an empty table stays empty, other columns pass through, ``out`` gets
    underscores where the name is taken. A very long text is read whole, with eight bytes a word and
    four for each level (their number is the logarithm of its longest repeat).
    """

    @F.arrow_udf(f"struct<{RUNS}>")
    def found(batch: pa.Array) -> pa.Array:
        rows = [r for part in chunks([t or b"" for t in utf8_rows(batch)]) for r in measure(part, min_length, min_exponent)]
        starts = np.cumsum([0, *(len(r) for r, _ in rows)])
        runs = np.concatenate([np.zeros((0, 3), np.int64), *(r for r, _ in rows)])
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in range(3)], fields=list(_KIND[0].type.value_type)))
        return pa.StructArray.from_arrays([lists, pa.array([t for _, t in rows], pa.binary()).cast(pa.string())], fields=list(_KIND))

    return df.withColumn(free_name(df, out), found.asNondeterministic()(own(df, text)))


def rewritten(text: bytes, key: str | None) -> bytes:
    """The words of ``text`` as the query's contract plants periods in a tenth of all texts; the others stay as they are."""
    if key is None or (h := zlib.crc32(key.encode())) % 10:
        return text
    words, g = text.split(), h // 10
    n = len(words)
    if not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join([*words[:a], *(words[a + i % p] for i in range(n - a))])


def op13_periodic_runs(spark, sf_dir):
    @F.arrow_udf("string")
    def planted(texts: pa.Array, keys: pa.Array) -> pa.Array:
        rows = zip(utf8_rows(texts), keys.to_pylist())
        return pa.array([rewritten(t or b"", k) for t, k in rows], pa.binary()).cast(pa.string())

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text", planted.asNondeterministic()("text", F.col("doc_id").cast("string")))
    runs = F.col("periodic.runs")
    best = F.get(F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 0)
    lines = F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    told = find_runs(docs).select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("periodic.collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("best.l"), F.col("best.p")
    return told.select(
        "doc_id",
        "n_runs",
        F.col("best.s").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
