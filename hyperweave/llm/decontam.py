"""Benchmark decontamination (9): a generalised suffix automaton of test items meets every text.

Words of the items are symbols. A text streams through the automaton, which tracks the longest
suffix of the words so far that occurs in some item. Only runs of words in which each word is
known and each neighbouring pair occurs in an item are streamed: any occurrence of a window lies
inside one such run, so nothing is lost and unrelated text costs one dictionary look-up a word.

Items are dealt to blocks of some ``block_chars`` characters (or one item). Tasks build the matcher of each block and
write it; a block at a time goes to the workers, by a broadcast that is dropped before the next one. The first block's
hits are a column; those of each further block are written by the digest of the text, so that the texts
themselves are only read.
"""

from __future__ import annotations

import pickle
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, own, table, utf8_rows, written

WINDOW = 13
BLOCK_CHARS = 4 << 20
#: A-Z to a-z; ASCII that is no letter or digit to a space; all other bytes stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
HITS = "n_words: long, spans: array<struct<start: long, end: long>>, items: array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """Of several word sequences (ids >= 0); keeps, per state, the length of its longest string and its suffix link.

    Most states have one edge: it lies in two arrays. Further edges are in ``more`` while the automaton
    grows, and in sorted arrays (state * words + word, target) after ``freeze``.
    """

    def __init__(self, sequences):
        self.word, self.next = array("i", [-1]), array("i", [-1])
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        self.keys, self.targets, self.n_words = array("q"), array("i"), 1
        for words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w)

    def freeze(self, n_words: int) -> None:
        self.n_words = max(n_words, 1)
        edges = sorted((state * self.n_words + w, t) for state, held in self.more.items() for w, t in held.items())
        self.keys, self.targets = array("q", (k for k, _ in edges)), array("i", (t for _, t in edges))
        self.more = {}

    def _edge(self, state: int, w: int) -> int:
        """Where ``w`` leads, or -1."""
        if self.word[state] == w:
            return self.next[state]
        held = self.more.get(state)
        return held.get(w, -1) if held else -1

    def _put(self, state: int, w: int, target: int) -> None:
        if self.word[state] in (-1, w):
            self.word[state], self.next[state] = w, target
        else:
            self.more.setdefault(state, {})[w] = target

    def _extend(self, last: int, w: int) -> int:
        link, length = self.link, self.length
        if (q := self._edge(last, w)) >= 0:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = self._state(-1, -1, length[last] + 1, 0)
        p = last
        while p >= 0 and self._edge(p, w) < 0:
            self._put(p, w, cur)
            p = link[p]
        if p >= 0:
            q = self._edge(p, w)
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _state(self, word: int, target: int, length: int, link: int) -> int:
        self.word.append(word)
        self.next.append(target)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        new = self._state(self.word[q], self.next[q], self.length[p] + 1, self.link[q])
        if q in self.more:
            self.more[new] = dict(self.more[q])
        self.link[q] = new
        while p >= 0 and self._edge(p, w) == q:
            self._put(p, w, new)
            p = self.link[p]
        return new

    def of_length(self, size: int) -> array:
        """For each state with strings of ``size`` words or more, the state of their last ``size`` words; 0 for the others."""
        link, length = self.link, self.length
        out = array("i", bytes(4 * len(link)))
        for state in np.argsort(np.array(length), kind="stable").tolist()[1:]:
            if length[state] >= size:
                out[state] = out[link[state]] or state
        return out

    def matches(self, words):
        """(state, length of the longest match) after each word; the automaton is frozen."""
        word, nxt, link, length, keys, targets, n_words = self.word, self.next, self.link, self.length, self.keys, self.targets, self.n_words
        state = size = 0
        for w in words:
            while True:
                if word[state] == w:
                    state, size = nxt[state], size + 1
                    break
                at = bisect_left(keys, key := state * n_words + w)
                if at < len(keys) and keys[at] == key:
                    state, size = targets[at], size + 1
                    break
                if not state:
                    break
                state = link[state]
                size = length[state]
            yield state, size


class Holders:
    """Item numbers by state, as two sorted arrays; ``size`` is carried along for items shorter than a window."""

    def __init__(self, rows: list[tuple[int, int, int]] | array, width: int = 2):
        table = np.unique(np.array(rows, np.int64).reshape(-1, width), axis=0)
        self.state, self.item = array("i", table[:, 0].tolist()), array("i", table[:, 1].tolist())
        self.size = array("i", table[:, 2].tolist()) if width == 3 else None

    def of(self, state: int) -> range:
        a = bisect_left(self.state, state)
        b = a
        while b < len(self.state) and self.state[b] == state:
            b += 1
        return range(a, b)


class Matcher:
    """One block of items: finds the spans of words under any occurrence of a window, and the items they come from.

    All that grows with the items is in arrays, besides one dictionary entry for each different word.
    """

    def __init__(self, items, window: int = WINDOW):
        self.window, self.names, self.ids = window, [], {}
        coded, bounds = array("i"), [0]
        for name, text in items:
            if words := words_of(text):
                self.names.append(name)
                coded.extend(self.ids.setdefault(w, len(self.ids)) for w in words)
                bounds.append(len(coded))
        flat, ends = np.array(coded, np.int64), np.array(bounds[1:], np.int64)
        sizes = np.diff(bounds)
        self.shortest = int(min(sizes.min(), window)) if len(sizes) else 0
        inner = np.ones(max(len(flat) - 1, 0), bool)
        inner[ends[:-1] - 1] = False
        self.pairs = np.unique((flat[:-1] * (len(self.ids) + 1) + flat[1:])[inner])
        self.automaton = auto = SuffixAutomaton(coded[a:b] for a, b in zip(bounds, bounds[1:]))
        auto.freeze(len(self.ids))
        self.whole = auto.of_length(window)
        full, short = array("q"), array("q")  # (state of a whole window, item); (state of an item below one window, item, length)
        for item, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if b - a < window:
                state = [s for s, _ in auto.matches(coded[a:b])][-1]
                short.extend((state, item, b - a))
            else:
                seen = {self.whole[state] for state, size in auto.matches(coded[a:b]) if size >= window}
                for state in seen:
                    full.extend((state, item))
        self.full, self.short = Holders(full), Holders(short, 3)
        # the nearest state on the way to the root, itself included, that is a short item
        self.to_short = array("i", bytes(4 * len(auto.link))) if len(short) else None
        if len(short):
            ends_here = set(self.short.state)
            for state in np.argsort(np.array(auto.length), kind="stable").tolist()[1:]:
                self.to_short[state] = state if state in ends_here else self.to_short[auto.link[state]]

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Disjoint spans in order, and the items whose windows occur."""
        if not self.shortest or len(words) < self.shortest:
            return [], set()
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = ids >= 0
        joined = known[1:] & known[:-1]
        at = np.flatnonzero(joined)
        keys = ids[at] * (len(self.ids) + 1) + ids[at + 1]
        where = np.searchsorted(self.pairs, keys)
        joined[at] = (where < len(self.pairs)) & (self.pairs[np.minimum(where, len(self.pairs) - 1)] == keys) if len(self.pairs) else False
        first = known & np.append(True, ~joined)
        starts = np.flatnonzero(first)
        ends = np.flatnonzero(known & np.append(~joined, True)) + 1
        long = ends - starts >= self.shortest
        out: list[tuple[int, int]] = []
        items: set = set()
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            self._stream(ids[a:b].tolist(), a, out, items)
        return union(out), {self.names[k] for k in items} - {None}

    def _stream(self, ids: list[int], offset: int, out: list, items: set) -> None:
        auto, window, whole, to_short, spans, windows, ends = self.automaton, self.window, self.whole, self.to_short, [], set(), set()
        for k, (state, size) in enumerate(auto.matches(ids), offset + 1):
            if size >= window:
                windows.add(whole[state])
                spans.append((k - window, k))
            v = to_short[state] if to_short else 0
            while v:
                at = self.short.of(v)
                for j in at:
                    if self.short.size[j] <= size:
                        spans.append((k - self.short.size[j], k))
                        ends.add(j)
                v = to_short[auto.link[v]]
        items.update(self.short.item[j] for j in ends)
        for state in windows:
            items.update(self.full.item[j] for j in self.full.of(state))
        out += union(spans)


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same positions; touching spans become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def matchers(items: DataFrame, item: str, text: str, window: int, block_chars: int) -> DataFrame:
    """(block, matcher), written: pickled matchers over disjoint parts of the items, each built by a task; texts that are null have no window."""
    rows = items.select(own(items, item).cast("string").alias("item"), own(items, text).alias("text")).where(F.col("text").isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    block = F.pmod(F.xxhash64("item", "text"), F.lit(max(1, -(-total // block_chars))))

    def build(part: pa.Table) -> pa.Table:
        names = part.column("item").to_pylist()
        made = Matcher(zip(names, utf8_rows(part.column("text"))), window)
        return pa.table({"block": [part.column("block")[0].as_py()], "matcher": pa.array([pickle.dumps(made, -1)], pa.binary())})

    return written(rows.withColumn("block", block).groupBy("block").applyInArrow(build, "block long, matcher binary"), "matchers")


def find_hits(df: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "hits", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Add struct ``out`` with HITS: words, disjoint word spans under a window, sorted item ids.

    Null texts have no words; null items and items without words have no window; items with a null id count as hits but
    are not listed; repeated rows and items count once per row and once per id; empty tables give no hits. A very
    long text or item is read whole, in time that grows with its words. Other columns pass through, ``out`` gets underscores where the
    name is taken.
    """
    spark, out = df.sparkSession, free_name(df, out)
    made = matchers(items, item, item_text, window, block_chars)
    blocks = [r.block for r in made.select("block").orderBy("block").collect()]  # a row for each block
    if not blocks:
        return df.withColumn(out, _hit_udf(spark.sparkContext.broadcast(pickle.dumps(Matcher([], window))))(own(df, text)))
    load = lambda k: spark.sparkContext.broadcast(bytes(made.where(F.col("block") == k).first().matcher))
    hits, digest = [], F.md5(own(df, text))
    for k in blocks[1:]:
        shared = load(k)
        some = df.select(digest.alias("text"), _hit_udf(shared)(own(df, text)).alias("found")).where(F.size("found.spans") > 0)
        hits.append(written(some.groupBy("text").agg(F.any_value("found").alias("found")), "block-hits"))
        shared.destroy()
    found = df.withColumn(out, _hit_udf(load(blocks[0]))(own(df, text)))
    if not hits:
        return found
    key, more = free_name(found, "digest"), free_name(found, "more")
    rest = hits[0]
    for h in hits[1:]:
        rest = rest.unionByName(h)
    rest = written(rest.groupBy(F.col("text").alias(key)).agg(F.collect_list("found").alias(more)), "more-hits")  # at most one a block
    for h in hits:
        discard(h)
    joined = found.withColumn(key, F.md5(own(found, text))).join(rest, key, "left")
    return joined.select(*[(_union_udf()(F.col(out), F.col(more)) if c == out else own(joined, c)).alias(c) for c in found.columns])


_KIND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
_matcher: list = [None, None]


def _loaded(shared) -> Matcher:
    """The matcher of a broadcast; a worker keeps the last one."""
    if _matcher[0] is not shared.value:
        _matcher[:] = [shared.value, pickle.loads(shared.value)]
    return _matcher[1]


def _hit_udf(shared):
    """An Arrow UDF for one block of items."""

    def row(matcher: Matcher, text: bytes | None) -> dict:
        words = words_of(text or b"")
        spans, ids = matcher.spans(words)
        return {"n_words": len(words), "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted(ids)}

    def hits(batch: pa.Array) -> pa.Array:
        matcher = _loaded(shared)
        return pa.array([row(matcher, t) for t in utf8_rows(batch)], _KIND)

    return F.arrow_udf(hits, f"struct<{HITS}>").asNondeterministic()


def _union_udf():
    """An Arrow UDF that adds the hits of further blocks (null: none) to those of the first."""

    def both(first: dict, more: list | None) -> dict:
        every = [first, *(more or [])]
        spans = union([(s["start"], s["end"]) for h in every for s in h["spans"]])
        return {"n_words": first["n_words"], "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted({x for h in every for x in h["items"]})}

    def joined(first: pa.Array, more: pa.Array) -> pa.Array:
        return pa.array([both(a, b) for a, b in zip(first.to_pylist(), more.to_pylist())], _KIND)

    return F.arrow_udf(joined, f"struct<{HITS}>").asNondeterministic()


def verdicts(df: DataFrame, hits: str = "hits", least_length: int = 1, least_percent: int = 5) -> DataFrame:
    """Add n_words, n_hit, n_items, items_sha256 and contaminated, from the struct ``hits`` that ``find_hits`` added.

    A text is contaminated if a span has ``least_length`` words or more and the spans cover
    ``least_percent`` of its words or more. Added columns get underscores where a name is taken.
    """
    found = own(df, hits)
    n_hit = hit_words(found["spans"])
    longest = F.coalesce(F.array_max(F.transform(found["spans"], lambda s: s["end"] - s["start"])), F.lit(0))
    contaminated = (n_hit > 0) & (longest >= least_length) & (100 * n_hit >= least_percent * found["n_words"])
    new = {"n_words": found["n_words"], "n_hit": n_hit, "n_items": F.size(found["items"]).cast("long"), "items_sha256": F.sha2(F.array_join(found["items"], ","), 256), "contaminated": contaminated}
    return df.select(*[own(df, c) for c in df.columns], *[c.alias(free_name(df, n)) for n, c in new.items()])


def hit_words(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def without_spans(text: str, spans: list[tuple[int, int]], longer_than: int = WINDOW) -> str:
    """``text`` without the words of each span of ``longer_than`` words or more (and what stands between those words)."""
    data = text.encode()
    folded, places, at = data.translate(_FOLD), [], 0
    for w in folded.split():
        at = folded.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    done, parts = 0, []
    for a, b in spans:
        if b - a >= longer_than:
            parts.append(data[done : places[a][0]])
            done = places[b - 1][1]
    return b"".join([*parts, data[done:]]).decode()


def trimmed_rows(df: DataFrame, items: DataFrame, text: str = "text", longer_than: int = WINDOW, most_percent: int = 5, window: int = WINDOW) -> DataFrame:
    """All rows, with benchmark spans cut from the text: those of ``longer_than`` words or more, and all where they cover ``most_percent`` of the words or more.

    Null texts stay null; a text without such a span stays as it is.
    """
    name = free_name(df, "hits")

    @F.arrow_udf("string")
    def cut(batch: pa.Array, spans: pa.Array, least: pa.Array) -> pa.Array:
        rows = zip(utf8_rows(batch), spans.to_pylist(), least.to_pylist())
        return pa.array([t if t is None or not s else without_spans(bytes(t).decode(), [(x["start"], x["end"]) for x in s], n).encode() for t, s, n in rows], pa.binary()).cast(pa.string())

    found = find_hits(df, items, text, out=name, window=window)
    hits = F.col(name)
    least = F.when(100 * hit_words(hits["spans"]) >= most_percent * hits["n_words"], 1).otherwise(longer_than).cast("int")
    cuts = cut.asNondeterministic()(own(found, text), hits["spans"], least)
    return found.select(*[cuts.alias(c) if c == text else own(found, c) for c in df.columns])


def clean_rows(df: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text is not contaminated, with the columns they had."""
    name = free_name(df, "hits")
    found = find_hits(df, items, text, out=name)
    n_hit = hit_words(F.col(name)["spans"])
    return found.where((n_hit == 0) | (20 * n_hit < F.col(name)["n_words"])).drop(name)


def op9_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return verdicts(find_hits(docs, table(spark, sf_dir, "benchmark"))).drop("text", "hits")
