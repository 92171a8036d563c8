"""Quality rules (7): suffix arrays find the repeated word sequences of each text.

All rows of an Arrow batch go through one suffix-array construction. Every symbol carries the
number of its text, so no match leaves a text, and each text ends in a symbol of its own.
Prefix doubling sorts only suffixes that are not yet alone in their group, so texts without
repeats drop out after two or three rounds. Batches are cut to ``CHUNK_BYTES``, a longer text
makes a chunk of its own; nothing is truncated. LCP values of a chunk of up to ``LEVEL_WORDS`` words come
from the ranks of all rounds; those of a longer one from Kasai's rule (the same values, slower, but
with the last ranks only), so a text of 100 MB takes about 1 GB.

The unit of a repeat is the word. A word at position i lies in a maximal repeat that starts at i
exactly when one of the two LCP values beside suffix i reaches the minimum length, and the longest
such repeat is the larger of the two, so the union over all LCP intervals is the union of
``[i, i + max(lcp_left, lcp_right))``.
"""

from __future__ import annotations

import io
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, own, utf8_rows

CHUNK_BYTES, LEVEL_WORDS = 1 << 20, 1 << 20
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
DIGEST = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, covered_words long, longest_repeat long, kept boolean"
_LINE_WORD = re.compile(rb"[^\x20\x09-\x0D]")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


@dataclass(frozen=True)
class RepetitionLimits:
    """Limits of the verdict; lengths are in words."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_repeat: int = 8
    max_covered_fraction: float = 0.4
    max_longest_repeat: int = 400


def suffix_groups(symbols: np.ndarray, all_levels: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``symbols`` and, for each doubling level k, the rank of every suffix by its first 2^k symbols.

    Symbols must be such that equal suffixes cannot exist (each text ends in a unique symbol). Without
    ``all_levels`` only the last ranks are kept: the places in the suffix array.
    """
    n = len(symbols)
    kind = np.int32 if n < 1 << 31 else np.int64
    sa = np.argsort(symbols).astype(kind)
    new = np.empty(n, bool)
    new[:1] = True
    ordered = symbols[sa]
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    del ordered
    starts = np.flatnonzero(new).astype(kind)
    rank = np.empty(n, kind)
    rank[sa] = np.repeat(starts, np.diff(np.append(starts, kind(n))))
    levels, step = [rank], 1
    while True:
        # slots of the array whose group still has two or more suffixes
        sizes = np.diff(np.append(starts, kind(n)))
        slots = np.flatnonzero(np.repeat(sizes > 1, sizes)).astype(kind)
        del starts, sizes
        if not len(slots):
            return sa, levels
        old = levels[-1]
        suffixes = sa[slots]
        key = old[suffixes].astype(np.int64)
        key *= n
        key += old[suffixes + step]
        by = np.argsort(key).astype(kind)
        sa[slots] = suffixes[by]
        key = key[by]
        del suffixes, by
        split = np.empty(len(slots), bool)
        split[:1] = True
        np.not_equal(key[1:], key[:-1], out=split[1:])
        del key
        heads = slots[split]
        rank = old.copy() if all_levels else old
        rank[sa[slots]] = np.repeat(heads, np.diff(np.append(np.flatnonzero(split), len(slots))))
        new[heads] = True
        del slots, split, heads
        starts = np.flatnonzero(new).astype(kind)
        levels = [*levels, rank] if all_levels else [rank]
        step *= 2


def kasai_lcp(symbols: np.ndarray, sa: np.ndarray, place: np.ndarray) -> np.ndarray:
    """``neighbour_lcp`` from the symbols and each suffix's place in the array: a suffix shares with the one before it at least what the last text position shared, less one."""
    out = np.zeros(len(sa), np.int32)
    s, a, p, lcp = map(memoryview, (symbols, sa, place, out))
    n, h = len(sa), 0
    for i in range(n):
        at = p[i]
        if at:
            j = a[at - 1]
            top = n - max(i, j)
            while h < top and s[i + h] == s[j + h]:
                h += 1
            lcp[at] = h
            h -= h > 0
        else:
            h = 0
    return out


def neighbour_lcp(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP of each suffix in the array with the one before it (0 for the first)."""
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    left, right = sa[:-1].copy(), sa[1:].copy()
    at = np.arange(1, n)
    live = levels[0][left] == levels[0][right]
    left, right, at = left[live], right[live], at[live]
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][left] == levels[k][right]
        jump = same.astype(np.int64) << k
        lcp[at] += jump
        left += jump
        right += jump
    return lcp


def covered(reach: np.ndarray) -> np.ndarray:
    """Which positions lie in one of the spans [i, i + reach[i])."""
    n = len(reach)
    starts = np.flatnonzero(reach)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + reach[starts], -1)
    return np.cumsum(edge[:n]) > 0


def slices(text: bytes):
    """Parts of CHUNK_BYTES or a little more that end in a space, so that no word is cut."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + CHUNK_BYTES) if len(text) - at > CHUNK_BYTES else None
        end = space.end() if space else len(text)
        yield text[at:end] if at or end < len(text) else text
        at = end


def coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """Word numbers of all texts in a row, words of each text, and how many different words there are."""
    ids: dict[bytes, int] = {}
    parts, counts = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        for part in slices(text):
            words = part.split()
            counts[k] += len(words)
            parts.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), counts, len(ids)


def repeated_lines(text: bytes) -> int:
    if len(text) <= CHUNK_BYTES:
        lines = [x for x in text.split(b"\n") if _LINE_WORD.search(x)]
        return len(lines) - len(set(lines))
    seen: set[bytes] = set()
    n = 0
    for line in io.BytesIO(text):
        if _LINE_WORD.search(line):
            line = line.removesuffix(b"\n")
            n += line in seen
            seen.add(line)
    return n


def code_points(text: bytes) -> int:
    return sum(len(part.decode("utf-8", "replace")) for part in slices(text))


def measure(texts: list[bytes], limits: RepetitionLimits) -> list[tuple]:
    """DIGEST rows for some texts, by one suffix array over all of them."""
    flat, counts, n_ids = coded(texts)
    total = len(flat)
    covered_by = repeat_by = longest_by = np.zeros(len(texts), np.int64)
    if total:
        bounds = np.concatenate([[0], np.cumsum(counts + 1)])
        symbols = np.empty(total + len(texts), np.int64 if len(texts) * (n_ids + 1) >= 1 << 31 else np.int32)
        is_end = np.zeros(len(symbols), bool)
        is_end[bounds[1:] - 1] = True
        symbols[~is_end] = flat
        symbols[is_end] = n_ids
        del flat, is_end
        if len(texts) > 1:
            symbols += np.repeat(np.arange(len(texts), dtype=symbols.dtype) * (n_ids + 1), counts + 1)
        some = len(symbols) <= LEVEL_WORDS
        sa, levels = suffix_groups(symbols, some)
        lcp = neighbour_lcp(sa, levels) if some else kasai_lcp(symbols, sa, levels[-1])
        del symbols, levels
        reach = np.empty(len(sa), lcp.dtype)
        reach[sa] = np.maximum(lcp, np.append(lcp[1:], lcp.dtype.type(0)))
        del sa, lcp
        per_text = lambda hit: np.add.reduceat(hit.astype(np.int64), bounds[:-1])
        repeat_by = per_text(covered(np.where(reach >= 3, 3, 0)))
        covered_by = per_text(covered(np.where(reach >= limits.min_repeat, reach, 0)))
        longest_by = np.maximum.reduceat(reach, bounds[:-1])
    out = []
    for k, text in enumerate(texts):
        n, repeats = int(counts[k]), int(repeat_by[k])
        chars = code_points(text) - sum(text.count(s) for s in map(bytes, zip(SPACES)))
        failed = n < limits.min_words or 100 * repeats > limits.max_repeat_percent * n
        kept = not failed and covered_by[k] <= limits.max_covered_fraction * n and longest_by[k] <= limits.max_longest_repeat
        out.append((n, chars, sum(text.count(s) for s in map(bytes, zip(SYMBOLS))), repeated_lines(text), repeats, failed, int(covered_by[k]), int(longest_by[k]), bool(kept)))
    return out


def chunks(texts: list[bytes]):
    """Runs of rows of CHUNK_BYTES at most, or of one row."""
    part: list[bytes] = []
    size = 0
    for text in texts:
        if part and size + len(text) > CHUNK_BYTES:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def quality(df: DataFrame, text: str = "text", out: str = "quality", limits: RepetitionLimits = RepetitionLimits()) -> DataFrame:
    """Add a struct column ``out`` with DIGEST.

    A null or empty text has no words (so it fails the minimum length); ties do not occur, repeated
    rows are measured alike, an empty table stays empty, other columns pass through untouched. A very
    long text is measured whole, in some ten times its size of memory. If ``out`` is taken, the struct's name gets underscores at its end.
    """
    kinds = [x.strip().split(" ") for x in DIGEST.split(",")]
    types = {"long": pa.int64(), "boolean": pa.bool_()}

    @F.arrow_udf(f"struct<{', '.join(f'{n}: {t}' for n, t in kinds)}>")
    def digest(batch: pa.Array) -> pa.Array:
        rows = [r for part in chunks([t or b"" for t in utf8_rows(batch)]) for r in measure(part, limits)]
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, kinds)], [n for n, _ in kinds])

    return df.withColumn(free_name(df, out), digest.asNondeterministic()(own(df, text)))


def good_rows(df: DataFrame, text: str = "text", limits: RepetitionLimits = RepetitionLimits()) -> DataFrame:
    """The rows whose text is kept, with the columns they had."""
    name = free_name(df, "quality")
    return quality(df, text, name, limits).where(F.col(f"{name}.kept")).drop(name)


def op7_quality_rules(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).select("doc_id", *[f"quality.{x.strip().split(' ')[0]}" for x in DIGEST.split(",")])
