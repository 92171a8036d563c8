"""Sharding (1), native: a permutation-filled lookup table.

Each shard has a permutation of the slots of a table of prime size, from two hashes of its name. The
shards take turns (in order of their names; a shard of weight w takes w turns a round) and each claims
its first slot that is still free. A row's place is one hash and one look-up. Leaving or joining
shards move few slots. The table depends on the list of shards alone, never on rows: its size is a
parameter and so is the bound of what is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, hex60, own, table

SHARDS, SLOTS, MOST_SLOTS = 32, 4093, 1 << 22


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def number_of(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """The shard (its number in ``shards``) of each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need names, each its own")
    if not is_prime(slots) or slots > MOST_SLOTS or slots < len(shards):
        raise ValueError(f"the number of slots must be a prime from the number of shards to {MOST_SLOTS}")
    weights = weights or {}
    turns = [k for k, s in enumerate(shards) for _ in range(weights.get(s, 1))]
    if not turns:
        raise ValueError("all weights are 0")
    at = [number_of("offset-" + s) % slots for s in shards]
    skip = [number_of("skip-" + s) % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while True:
        for k in turns:
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                return owner


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """(slot, shard, shard_name), one row per slot."""
    rows = [(slot, k, shards[k]) for slot, k in enumerate(fill(shards, slots, weights))]
    return spark.createDataFrame(rows, "slot int, shard int, shard_name string")


def shard(df: DataFrame, key: str, shards: list[str] | None = None, slots: int = SLOTS, weights: dict[str, int] | None = None, spread: int = 1, spread_by: str | None = None) -> DataFrame:
    """Add slot, shard and shard_name (with underscores where a name is taken). No shuffle.

    Equal keys share a slot, repeated rows too; null keys share the slot of the string 'null'; an
    empty table stays empty. A hot key is dealt over ``spread`` slots by the hash of column ``spread_by``.
    """
    names = [free_name(df, n) for n in ("slot", "shard", "shard_name")]
    text = F.coalesce(own(df, key).cast("string"), F.lit("null"))
    if spread > 1:
        text = F.concat_ws("#", text, F.pmod(hex60(F.coalesce(own(df, spread_by).cast("string"), F.lit("null"))), F.lit(spread)))
    places = lookup(df.sparkSession, shards or [f"shard-{k:04d}" for k in range(SHARDS)], slots, weights).toDF(*names)
    placed = df.withColumn(names[0], F.pmod(hex60(text), F.lit(slots)).cast("int")).join(F.broadcast(places), names[0])
    return placed.select(*[own(placed, c) for c in df.columns], *names)


def op1_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return shard(docs, "doc_id")


SQL = f"""
WITH RECURSIVE shards AS (
  SELECT k AS shard, 'shard-' || lpad(k::VARCHAR, 4, '0') AS shard_name FROM range(0, {SHARDS}) t(k)),
 walks AS (
  SELECT shard, shard_name, ('0x' || substr(md5('offset-' || shard_name), 1, 15))::BIGINT % {SLOTS} AS first,
   ('0x' || substr(md5('skip-' || shard_name), 1, 15))::BIGINT % {SLOTS - 1} + 1 AS skip FROM shards),
 orders AS (
  SELECT list([(first + j * skip) % {SLOTS} for j in range(0, {SLOTS})] ORDER BY shard) AS slots FROM walks),
 turns(step, owner) AS (
  SELECT 0, [-1 for j in range(0, {SLOTS})]
  UNION ALL
  SELECT step + 1, owner[:pick] || [step % {SHARDS}] || owner[pick + 2:]
  FROM (SELECT step, owner, [s for s in slots[step % {SHARDS} + 1] if owner[s + 1] < 0][1] AS pick FROM turns, orders WHERE step < {SLOTS})),
 places AS (
  SELECT unnest(range(0, {SLOTS})) AS slot, unnest(owner) AS shard FROM turns WHERE step = {SLOTS})
SELECT doc_id, source, n_chars, p.slot::INTEGER AS slot, p.shard::INTEGER AS shard, s.shard_name
FROM (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents) d
JOIN places p USING (slot) JOIN shards s ON s.shard = p.shard
"""
