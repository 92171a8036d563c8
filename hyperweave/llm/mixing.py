"""Mixing (4): Poisson replication to target weights.

Each source has a mean rate = target share / present share; a document's count is the inverse of the
Poisson distribution at a number seeded by its id, so it is the same in every run and plan. Rates
above ``PART`` are drawn as a sum of several equal Poisson counts, so that exp(-rate) never
underflows. Copies are then dealt out by a hash of (id, copy) and sorted by it: a global shuffle
without a sampling pass, in which a hot source is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import free_name, hex60, own, table, written

PART = 64.0
#: A table of rates is broadcast up to so many sources; of a larger one only the sources that hold more
#: than one in so many of all rows are, and the rest is joined by a shuffle.
BROADCAST_SOURCES = 20_000


def rates(df: DataFrame, source: str = "source", weights: dict | None = None, power: float = 0.5, scale: float = 1.0) -> DataFrame:
    """(source, n, share, rate): rows and share of rows of each source, and mean copies of a document of it.

    Target shares are ``weights`` (missing sources: 0), or else proportional to size ** power. The
    expected size of the mix is ``scale`` times the input. Null is a source of its own (weights[None]).
    """
    sizes = df.groupBy(own(df, source).alias("source")).agg(F.count("*").cast("double").alias("n"))
    if weights is None:
        sizes = sizes.withColumn("aim", F.pow("n", F.lit(power)))
    else:
        fields = StructType([StructField("named", df.schema[source].dataType), StructField("aim", DoubleType())])
        wanted = df.sparkSession.createDataFrame([(name, float(w)) for name, w in weights.items()], fields)
        sizes = sizes.join(wanted, F.col("source").eqNullSafe(F.col("named")), "left").select("source", "n", F.coalesce("aim", F.lit(0.0)).alias("aim"))
    total = sizes.agg(F.sum("n").alias("all_n"), F.sum("aim").alias("all_aim"))  # one row
    share = F.col("n") / F.col("all_n")
    rate = F.when(F.col("all_aim") > 0, F.lit(scale) * (F.col("aim") / F.col("all_aim")) * (F.col("all_n") / F.col("n"))).otherwise(0.0)
    return sizes.join(F.broadcast(total)).select("source", "n", share.alias("share"), rate.alias("rate"))


def cumulative(rate):
    """P(X <= 0), P(X <= 1), .. of a Poisson count, up to where the rest is far below 2^-60."""

    def step(s, k):
        term = s["term"] * rate / k
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"), F.concat(s["all"], F.array(s["sum"] + term)).alias("all"))

    first = F.exp(-rate)
    terms = F.sequence(F.lit(1), (F.lit(40) + 4 * rate).cast("int"))
    return F.aggregate(terms, F.struct(first.alias("term"), first.alias("sum"), F.array(first).alias("all")), step)["all"]


def mix(df: DataFrame, id_: str = "doc_id", source: str = "source", weights: dict | None = None, power: float = 0.5, scale: float = 1.0, seed: int = 0, order: bool = False, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """Rows of ``df``, each as often as its draw says, in a global random order.

    Null ids draw like an id of their own, null sources are one source; repeated rows draw the same
    count; a source of weight 0 goes; equal order keys are copies of repeated rows, in any order. An
    empty table stays empty. Extra columns and texts of any length pass through. ``order`` adds copy
    (from 0) and order_key.
    """
    src, cdf, parts, copy, key = (free_name(df, n) for n in ("mix_source", "mix_cdf", "mix_parts", "copy", "order_key"))
    known = rates(df, source, weights, power, scale).where("rate > 0").withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    known = known.select(F.col("source").alias(src), F.col("share"), cumulative(F.col("rate") / F.col("parts")).alias(cdf), F.col("parts").alias(parts))
    same = own(df, source).eqNullSafe(F.col(src))
    if known.count() <= broadcast_sources:
        drawn = df.join(F.broadcast(known.drop("share")), same)
    else:  # sources of more than 1 / broadcast_sources of all rows are fewer than that; the rows of any other fit a task
        known = written(known, "rates")
        heavy = F.broadcast(known.where(F.col("share") * broadcast_sources > 1).drop("share"))
        light = known.where(F.col("share") * broadcast_sources <= 1).drop("share")
        drawn = df.join(heavy, same).unionByName(df.join(heavy.select(src), same, "left_anti").join(light, same))
    ident = F.coalesce(own(df, id_).cast("string"), F.lit("null"))
    uniform = lambda k: hex60(F.concat_ws(":", F.lit(str(seed)), ident, k)) / F.lit(float(1 << 60))
    numbers = drawn.withColumn(parts, F.transform(F.sequence(F.lit(1), F.col(parts)), uniform))
    n = F.aggregate(parts, F.lit(0), lambda total, u: total + F.size(F.filter(cdf, lambda p: p <= u)))
    copies = numbers.withColumn(parts, n).where(F.col(parts) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))
    copies = copies.withColumn(key, hex60(F.concat_ws(":", F.lit(f"order-{seed}"), ident, F.col(copy)))).drop(src, cdf, parts)
    dealt = copies.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)
    return dealt if order else dealt.drop(copy, key)


def op4_poisson_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), order=True)


SQL = """
WITH sizes AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
 rates AS (SELECT source, (sqrt(n) / sum(sqrt(n)) OVER ()) * (sum(n) OVER () / n) AS rate FROM sizes),
 terms AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM rates, range(0, 60) t(k)),
 draws AS (SELECT *, ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null') || ':1'), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS u FROM documents),
 counts AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM terms t WHERE t.source IS NOT DISTINCT FROM d.source AND t.cdf <= d.u) AS c FROM draws d)
SELECT doc_id, text, lang, source, n_chars, k::INTEGER AS copy,
 ('0x' || substr(md5('order-0:' || coalesce(doc_id::VARCHAR, 'null') || ':' || k), 1, 15))::BIGINT AS order_key
FROM (SELECT *, unnest(range(0, c)) AS k FROM counts)
"""
