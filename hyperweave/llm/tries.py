"""Conversation prefix trie (11): mergeable partial tries, merged by hash keys, then rolled up bottom-up.

A node is a sequence of first turns. Its key is a digest of sums: each turn adds two 60-bit numbers, hashed from its
place and content, so the keys of all prefixes are running sums over range partitions, and a conversation that
holds most of the rows is spread like any other. Partitions combine their own nodes; the partial tables are merged
by (lane, key) with fewer lanes each time, so that no task meets a node's rows of all partitions at once. Ends are
kept as sorted pieces of ``PIECE`` ids. Sums over subtrees take one round for each doubling of the depth.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import prefix_sums
from .common import discard, own, table, written

#: Lanes of the merges of partial tries: from this many to one.
LANES = (64, 8, 1)
#: Conversation ids in one piece of a list of ends.
PIECE = 4096
PERIOD, MOST_SHARED = 5, 9


def turn_rows(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, at, digest, bytes), written: each turn with its place from 0, the digest of role and text, and the text's UTF-8 bytes.

    Turns go by (turn, role, text), null turns first; null roles and texts are empty; repeated rows are repeated
    turns; rows without a conversation id are left out. Extra columns are not read.
    """
    rows = df.select(own(df, conv).alias("conv"), own(df, turn).alias("turn"), F.coalesce(own(df, role), F.lit("")).alias("role"), F.coalesce(own(df, text), F.lit("")).alias("text")).where("conv IS NOT NULL")
    digest = F.md5(F.concat(F.octet_length("role"), F.lit(":"), "role", "text"))
    flat = prefix_sums(rows, ["conv", "turn", "role", "text"], {}).select("conv", "row", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    flat = written(flat, "turns")
    first = flat.groupBy("conv").agg(F.min("row").alias("first"))
    return flat.join(first, "conv").select("conv", (F.col("row") - F.col("first")).alias("at"), "digest", "bytes")


def prefix_rows(turns: DataFrame) -> DataFrame:
    """``turns`` (conv, depth from 1, digest, bytes, last) with the keys of the prefix that ends here and of the one before."""
    salted = F.md5(F.concat("depth", F.lit(":"), "digest"))
    part = lambda at: F.conv(F.substring(salted, at, 15), 16, 10).cast("decimal(20,0)")
    terms = turns.select("conv", "depth", "bytes", "last", part(1).alias("a"), part(16).alias("b"))
    sums = prefix_sums(terms, ["conv", "depth"], {"sum_a": "a", "sum_b": "b"})
    before = sums.groupBy("conv").agg(F.min_by(F.struct((F.col("sum_a") - F.col("a")).alias("a"), (F.col("sum_b") - F.col("b")).alias("b")), "depth").alias("before"))
    a, b = F.col("sum_a") - F.col("before.a"), F.col("sum_b") - F.col("before.b")
    return sums.join(before, "conv").select("conv", "depth", "bytes", "last", key_of(F.col("depth"), a, b).alias("key"), key_of(F.col("depth") - 1, a - F.col("a"), b - F.col("b")).alias("parent"))


def key_of(depth: Column, a: Column, b: Column) -> Column:
    plain = lambda c: c.cast("decimal(38,0)").cast("string")
    return F.md5(F.concat_ws(",", depth.cast("string"), plain(a), plain(b)))


def root_key() -> Column:
    return key_of(F.lit(0), F.lit(0), F.lit(0))


def merged(nodes: DataFrame, lanes=LANES) -> DataFrame:
    """One row per key from (key, parent, depth, bytes, conv_id, n_convs): each partition combines its rows first, then groups of lanes are merged."""
    nodes = nodes.withColumn("lane", F.spark_partition_id())
    for n in lanes:
        lane = F.pmod("lane", F.lit(n)).alias("lane")
        nodes = nodes.groupBy(lane, "key").agg(*[F.any_value(c).alias(c) for c in ("parent", "depth", "bytes")], F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    return nodes.drop("lane")


def end_digests(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """(key, ends_sha256) from (key, conv): SHA-256 of the ids in numeric order, comma-joined.

    Sorted ids become text pieces in parallel. SHA-256 reads one byte after the other, so the pieces of one list
    pass through one task, which holds one of them at a time.
    """
    ranked = written(prefix_sums(ends, ["key", "conv"], {}), "ends")
    first = ranked.groupBy("key").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    cut = ranked.join(first, "key").withColumn("piece", F.floor((F.col("row") - F.col("first")) / piece))
    pieces = cut.groupBy("key", "piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"), F.first("n").alias("n"))
    pieces = written(pieces, "pieces")
    short = pieces.where(F.col("n") <= piece).select("key", F.sha2("ids", 256).alias("ends_sha256"))

    def chained(batches):
        key, sha = None, hashlib.sha256()
        for batch in batches:
            for k, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if key is not None:
                        yield pa.record_batch([[key], [sha.hexdigest()]], ["key", "ends_sha256"])
                    key, sha = k, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
        if key is not None:
            yield pa.record_batch([[key], [sha.hexdigest()]], ["key", "ends_sha256"])

    long = pieces.where(F.col("n") > piece).repartition("key").sortWithinPartitions("key", "piece").select("key", "ids")
    return short.unionByName(long.mapInArrow(chained, "key string, ends_sha256 string"))


def rolled_up(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """``nodes`` (key, parent, ...) with each of ``sums`` added up over the node's subtree.

    In round k a node holds the sum over descendants fewer than 2^k levels down and its 2^k-th ancestor, to which it adds that sum.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    state, last = nodes.withColumn("up", F.col("parent")), None
    for _ in range(deepest.bit_length()):
        more = state.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(*[F.sum(c).alias(f"{c}_more") for c in sums])
        further = state.where("up IS NOT NULL").select(F.col("key").alias("up"), F.col("up").alias("further"))
        step = state.join(more, "key", "left").join(further, "up", "left")
        step = step.select(*nodes.columns[: -len(sums)], *[(F.col(c) + F.coalesce(f"{c}_more", F.lit(0))).alias(c) for c in sums], F.col("further").alias("up"))
        state = written(step, "rollup")
        if last is not None:
            discard(last)
        last = state
    return state.drop("up")


def trie(turns: DataFrame, convs: DataFrame, piece: int = PIECE) -> DataFrame:
    """The node table of the conversations in ``convs`` (conv, n) with ``turns`` (conv, depth from 1 to n, digest, bytes).

    One row per node, the textless root (depth 0) included: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. Conversations without turns are members of the root only; equal
    conversations share all nodes; no conversations give no rows. A conversation may hold most of all turns, a node
    most of all conversations.
    """
    last = turns.join(convs, "conv").withColumn("last", F.col("depth") == F.col("n"))
    rows = written(prefix_rows(last), "prefixes")
    root = convs.select(root_key().alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), F.col("conv").alias("conv_id"))
    members = rows.select("key", "parent", "depth", "bytes", F.col("conv").alias("conv_id")).unionByName(root)
    nodes = written(merged(members.withColumn("n_convs", F.lit(1).cast("long"))), "nodes")
    above = nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    own_conv = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    told = nodes.join(above, "key", "left").join(own_conv, "parent", "left")
    told = told.select("key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    told = rolled_up(written(told, "trie"), ["n_leaves", "saved_tokens"])
    ends = rows.where("last").select("key", "conv").unionByName(convs.where("n = 0").select(root_key().alias("key"), "conv"))
    out = told.join(end_digests(ends, piece), "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``trie`` of a table of turns, ordered as in ``turn_rows``."""
    rows = turn_rows(df, conv, turn, role, text)
    return trie(rows.select("conv", (F.col("at") + 1).alias("depth"), "digest", "bytes"), rows.groupBy("conv").agg(F.count("*").alias("n")))


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) as the query's contract rebuilds them: h turns of conversation c - c % 5, then c's own after its first h."""
    shared = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(MOST_SHARED))
    sizes = rows.groupBy("conv").agg(F.count("*").alias("own"))
    heads = rows.where(F.col("at") < MOST_SHARED - 1).withColumnRenamed("conv", "base")
    there = heads.groupBy("base").agg(F.count("*").alias("there"))
    convs = sizes.select("conv", "own", shared.alias("h"), (F.col("conv") - F.col("conv") % PERIOD).alias("base")).join(there, "base", "left")
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = written(convs.select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "convs")
    first = heads.join(convs, "base").where("at < taken").select("conv", (F.col("at") + 1).alias("depth"), "digest", "bytes")
    rest = rows.join(convs, "conv").where("at >= h").select("conv", (F.col("taken") + F.col("at") - F.col("h") + 1).alias("depth"), "digest", "bytes")
    return first.unionByName(rest), convs.select("conv", "n")


def op11_prefix_trie(spark, sf_dir):
    return trie(*rebuilt(turn_rows(table(spark, sf_dir, "conversations"))))


SQL = """
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
 turns AS (
  SELECT conv_id AS c, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said, strlen(coalesce(text, '')) AS bytes,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
 hashed AS (
  SELECT c, c - c % 5 AS base,
   xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1]), 4294967295), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM turns), crc),
 parts AS (
  SELECT h.c, 0 AS part, t.k, t.said, t.bytes FROM hashed h JOIN turns t ON t.c = h.base AND t.k <= h.h
  UNION ALL SELECT h.c, 1, t.k, t.said, t.bytes FROM hashed h JOIN turns t ON t.c = h.c AND t.k > h.h),
 seqs AS (
  SELECT h.c, coalesce(list(p.said ORDER BY part, k) FILTER (p.said IS NOT NULL), []) AS said, coalesce(list(p.bytes ORDER BY part, k) FILTER (p.said IS NOT NULL), []) AS bytes
  FROM hashed h LEFT JOIN parts p ON p.c = h.c GROUP BY h.c),
 paths AS (SELECT *, unnest(range(0, len(said) + 1)) AS d FROM seqs),
 nodes AS (
  SELECT said[1:d] AS path, d, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE max(bytes[d]) END AS bytes,
   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(said) = d), '')) AS ends
  FROM paths GROUP BY said[1:d], d),
 kids AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
 full_ AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.d = n.d AND k.path = n.path),
 up AS (SELECT path[1:a] AS path, a AS d, (n_children = 0)::BIGINT AS leaf, (n_convs - 1) * bytes AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_)),
 sums AS (SELECT path, d, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY ALL)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM full_ n JOIN sums s ON s.d = n.d AND s.path = n.path LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]
"""
