"""Operation metrics: counts, errors, rates and nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Metered operations, and samples that percentiles look back on.
OPERATIONS = ("PUT", "DELETE", "GET", "SCAN", "SNAPSHOT", "WRITE")
RECENT = 16_384


def summary(samples: DataFrame, operations: tuple[str, ...] = OPERATIONS, seconds: float = 1.0, last: int = RECENT, part: int = 1 << 20) -> DataFrame:
    """Per operation (op, latency, failed, ordinal): count, errors, rate, mean, least and most of all samples, p50, p95, p99 of its ``last`` ones; all 0 where unused.

    ``percentile_disc`` is the nearest rank; it sees the bounded recent samples only.
    """
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY latency)")
    got = samples.groupBy("op").agg(
        F.count("*").alias("count"), F.sum(F.col("failed").cast("long")).alias("errors"),
        F.avg("latency").alias("mean"), F.min("latency").alias("least"), F.max("latency").alias("most"),
    )
    ranks = recent(samples, last, part=part).groupBy("op").agg(q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"))
    every = samples.sparkSession.createDataFrame([(x,) for x in operations], "op string")
    out = every.join(got, "op", "left").join(ranks, "op", "left").fillna(0)
    return out.withColumn("per_second", F.col("count") / F.lit(seconds))


def recent(samples: DataFrame, last: int = RECENT, order: str = "ordinal", part: int = 1 << 20) -> DataFrame:
    """The last samples of each operation.

    Ordinals are cut into ranges; whole ranges are counted from the end, and only the one that the limit falls in is ranked.
    """
    cut = samples.withColumn("__r", F.floor(F.col(order) / part))
    n = cut.groupBy("op", "__r").agg(F.count("*").alias("__n"))
    after = F.sum("__n").over(W.partitionBy("op").orderBy(F.desc("__r")).rowsBetween(W.unboundedPreceding, -1))
    due = n.select("op", "__r", F.coalesce(after, F.lit(0)).alias("__after")).filter(F.col("__after") < last)
    ranked = cut.join(due, ["op", "__r"]).withColumn("__i", F.row_number().over(W.partitionBy("op", "__r").orderBy(F.desc(order))))
    return ranked.filter(F.col("__i") + F.col("__after") <= last).drop("__r", "__after", "__i")


def interval(samples: DataFrame, start: int, end: int, order: str = "ordinal") -> DataFrame:
    """Samples since a reset and before the next."""
    return samples.filter((F.col(order) >= start) & (F.col(order) < end))
