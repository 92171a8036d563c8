"""Secret scans (8), native: corpus-wide ownership of each candidate value.

Candidates come from JVM regular expressions; offsets are running sums of the lengths of matches
(``regexp_extract_all``) and of the gaps between them (``split`` by the same pattern). Each
candidate's hash is then counted over the distinct repositories and owners that hold it: values that
many owners share are copied examples, random-looking values of a single owner are live.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, own, table, written

#: kind, pattern, group that holds the value, least length of the value, literal that each match holds.
#: The first three are the base kinds. No pattern matches the empty string, and each reads a run of one
#: class a bounded number of times: jwt starts at the start of a run only and gives nothing of it back.
PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, None),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    ("hex", r"[0-9a-f]{24,}", 0, 24, None),
    ("forge", r"gh[oprsu]_[A-Za-z0-9]{36,}", 0, 40, "gh"),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, "xox"),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 29, "eyJ"),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 27, "-----BEGIN "),
)
KINDS = tuple(p[0] for p in PATTERNS)
BASE = KINDS[:3]
SPANS = "array<struct<start: bigint, rank: int, kind: string, end: bigint, hash: string, random: boolean>>"
#: A value of one owner is live-looking from this many different characters on.
LIVE_CHARS = 8
VALUE_CHARS = string.ascii_letters + string.digits + "+/_.=- "
#: Matches of a text that one running sum goes over.
BLOCK = 256
#: A value that holds more than one in so many of all spans is heavy, so fewer values than this are; their
#: verdicts are broadcast. The spans of any other value are few enough for one task.
HEAVY_VALUES = 4096


def _matches(text: Column, pattern: str, literal: str | None) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found if literal is None else F.when(text.contains(literal), found).otherwise(F.array().cast("array<string>"))


def _random(value: Column) -> Column:
    """Whether the value has LIVE_CHARS different characters of those that patterns allow in values."""
    return F.aggregate(F.split(F.lit(VALUE_CHARS), ""), F.lit(0), lambda n, c: n + F.contains(value, c).cast("int")) >= LIVE_CHARS


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once (lambdas compute what they mention each time)."""
    return F.transform(F.array(value), use)[0]


def _group_of(whole: Column, pattern: str, group: int) -> Column:
    """A group of each match; a match by itself gives the same groups, as no pattern looks ahead."""
    return F.transform(whole, lambda w: F.regexp_extract(w, pattern, group))


def _located(text: Column, whole: Column, value: Column, kind: str, pattern: str, least: int) -> Column:
    """SPANS of one kind from its matches; 0-based code points, end exclusive.

    Running sums go block by block: an array that grows by one costs its length each time, so one sum
    over all matches would be quadratic in them.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value"))
    none = F.array().cast(SPANS)

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        end = start + F.length(part["whole"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), F.sha2(part["value"], 256).alias("hash"), _random(part["value"]).alias("random"))
        keep = F.when(F.length(part["value"]) >= least, F.array(span)).otherwise(none)
        return F.struct(F.coalesce(end, state["at"]).alias("at"), F.concat(state["spans"], F.coalesce(keep, none)).alias("spans"))

    def length(block: Column) -> Column:
        return F.aggregate(block, F.lit(0).cast("bigint"), lambda n, part: n + part["gap"] + F.coalesce(F.length(part["whole"]), F.lit(0)))

    def spans(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("spans")), step)["spans"]

    def in_blocks(all_parts: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_parts) - 1) / BLOCK).cast("int")), lambda k: F.slice(all_parts, k * BLOCK + 1, BLOCK))
        return _let(blocks, lambda bs: F.flatten(F.zip_with(bs, starts(bs), lambda block, at: F.when(block.isNull(), none).otherwise(spans(block, at)))))

    def starts(blocks: Column) -> Column:
        return F.aggregate(blocks, F.array(zero), lambda all_, block: F.concat(all_, F.array(F.element_at(all_, -1) + length(block))))

    zero = F.lit(0).cast("bigint")
    found = _let(parts, lambda p: F.when(F.size(p) > BLOCK, in_blocks(p)).otherwise(spans(p, zero)))
    return F.when(F.size(whole) > 0, found).otherwise(none)


def candidates(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Replace ``text`` by array ``out`` of SPANS, sorted by start, then kind. Row by row, no shuffle.

    Null and empty texts give an empty array; other columns pass through; ``out`` gets underscores
    at its end where the name is taken.
    """
    out, cell = free_name(df, out), free_name(df, "matches")
    value = F.coalesce(own(df, text), F.lit(""))
    rest = [own(df, c) for c in df.columns if c != text]
    names = [free_name(df, f"matches_{kind}") for kind in KINDS]
    found = df.select(*rest, value.alias(cell), *[_matches(value, p, literal).alias(n) for n, (_, p, _, _, literal) in zip(names, PATTERNS)])
    arrays = []
    for name, (kind, pattern, group, least, _) in zip(names, PATTERNS):
        whole = F.col(name)
        held = _group_of(whole, pattern, group) if group else whole
        arrays.append(_located(F.col(cell), whole, held, kind, pattern, least))
    return found.select(*[own(found, c) for c in df.columns if c != text], F.sort_array(F.concat(*arrays)).alias(out))


def ownership(found: DataFrame, owner: str, repository: str, spans: str = "secrets", examples_from: int = 3, repositories_from: int = 100) -> DataFrame:
    """One row per candidate hash: n_spans, n_repositories, n_owners, verdict ('copied', 'live' or 'unclear').

    A value of ``examples_from`` owners or ``repositories_from`` repositories (of one owner, too) is copied.
    Null owners and repositories count as one of their own. (hash, repository, owner) rows are made
    distinct map-side first, so a value that everyone copies does not meet in one task.
    """
    who = lambda name: F.coalesce(own(found, name).cast("string"), F.lit(""))
    rows = found.select(who(owner).alias("owner"), who(repository).alias("repository"), F.explode(own(found, spans)).alias("s"))
    held = rows.groupBy(F.col("s.hash").alias("hash"), "owner", "repository").agg(F.max("s.random").alias("random"), F.count("*").alias("n"))
    counts = held.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.max("random").alias("random")).groupBy("hash").agg(F.sum("n").alias("n_spans"), F.count("*").alias("n_owners"), F.max("random").alias("random"))
    repositories = held.select("hash", "repository").distinct().groupBy("hash").agg(F.count("*").alias("n_repositories"))
    verdict = F.when((F.col("n_owners") >= examples_from) | (F.col("n_repositories") >= repositories_from), "copied").when((F.col("n_owners") == 1) & F.col("random"), "live").otherwise("unclear")
    return counts.join(repositories, "hash").select("hash", "n_spans", "n_repositories", "n_owners", verdict.alias("verdict"))


def judged(df: DataFrame, text: str, owner: str, repository: str, examples_from: int = 3, repositories_from: int = 100, heavy_values: int = HEAVY_VALUES) -> DataFrame:
    """Each row of ``df`` without its text, with arrays ``secrets`` (SPANS) and ``verdicts`` (verdict, n_owners, n_repositories; same order).

    Rows without candidates, null texts among them, get empty arrays; an empty table stays empty; a very long
    text is read whole and its spans are one row's array; repeated rows are judged one by one; the two arrays get
    underscores where a name is taken. Candidates are found once and written to the shared folder;
    texts are never shuffled. Verdicts of values with more than 1 / ``heavy_values`` of all spans come
    by a broadcast of fewer than ``heavy_values`` rows, the others by a join on the hash.
    """
    spans, verdicts, row = free_name(df, "secrets"), free_name(df, "verdicts"), free_name(df, "row_id")
    found = written(candidates(df, text, spans).withColumn(row, F.monotonically_increasing_id()), "secrets")
    flat = found.where(F.size(own(found, spans)) > 0).select(own(found, row).alias("row"), F.posexplode(own(found, spans)).alias("at", "s")).select("row", "at", F.col("s.hash").alias("hash"))
    owned = written(ownership(found, owner, repository, spans, examples_from, repositories_from), "owned")
    bar = (owned.agg(F.sum("n_spans")).first()[0] or 0) / heavy_values
    said = F.struct("verdict", "n_owners", "n_repositories").alias("v")
    heavy = F.broadcast(owned.where(F.col("n_spans") > bar).select("hash", said))
    light = owned.where(F.col("n_spans") <= bar).select("hash", said)
    each = flat.join(heavy, "hash").unionByName(flat.join(heavy.select("hash"), "hash", "left_anti").join(light, "hash"))
    each = each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias(verdicts))
    out = found.join(each, own(found, row) == own(each, "row"), "left")
    in_order = F.coalesce(F.transform(own(each, verdicts), lambda s: s["v"]), F.array().cast("array<struct<verdict: string, n_owners: bigint, n_repositories: bigint>>"))
    return out.select(*[own(found, c) for c in found.columns if c != row], in_order.alias(verdicts))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = judged(docs, "text", owner="source", repository="doc_id")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    said = lambda v: F.size(F.filter("verdicts", lambda x: x["verdict"] == v)).cast("long")
    holders = F.array_join(F.transform("verdicts", lambda x: F.concat_ws(":", x["n_owners"], x["n_repositories"])), ",")
    return rows.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), said("live").alias("n_live"), said("copied").alias("n_copied"), holders.alias("holders"))
