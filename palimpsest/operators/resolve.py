"""Version resolution: what a log of versions shows at a sequence.

A log has the columns ``k`` (key), ``seq``, ``op`` (1 value, 2 tombstone) and ``v``; more columns may stand beside them.
Filters on keys reach the scan through the resolution, as they are on its grouping key.  Filters on ``op`` or ``v`` must come
after it; the one on ``seq`` comes before on purpose.  An empty value is a value.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VALUE, TOMBSTONE = 1, 2


def newest(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """The newest version of each key, tombstones too: one partial aggregate and one shuffle of at most a row for each key and task.

    The maximum of a struct led by ``seq`` decides, so no sort of all versions is needed; with equal sequences the larger op, then value, wins.
    """
    seen = log if as_of is None else log.filter(F.col("seq") <= as_of)
    rest = [c for c in log.columns if c not in ("k", "seq")]
    top = seen.groupBy("k").agg(F.max(F.struct("seq", *rest)).alias("top"))
    return top.select("k", *[F.col(f"top.{c}").alias(c) for c in ["seq", *rest]]).select(log.columns)


def newest_by_window(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """``newest`` by a window, for values that have no order (maps)."""
    seen = log if as_of is None else log.filter(F.col("seq") <= as_of)
    place = F.row_number().over(W.partitionBy("k").orderBy(F.desc("seq")))
    return seen.withColumn("__rn", place).filter("__rn = 1").drop("__rn")


def as_of(log: DataFrame, seq: int | None = None) -> DataFrame:
    """Live rows at a sequence (the latest without one): newest versions that are no tombstones."""
    return newest(log, seq).filter(F.col("op") == VALUE)


def get(log: DataFrame, key: object, seq: int | None = None) -> DataFrame:
    """The row of one key, or none."""
    return as_of(log.filter(F.col("k") == F.lit(key)), seq)


def scan(log: DataFrame, start: object, end: object, seq: int | None = None) -> DataFrame:
    """Live rows with start <= key < end, by key; start above end is an error."""
    if start > end:
        raise ValueError("scan start is above its end")
    return as_of(log.filter((F.col("k") >= F.lit(start)) & (F.col("k") < F.lit(end))), seq).orderBy("k")


def scan_all(log: DataFrame, seq: int | None = None) -> DataFrame:
    """All live rows by key."""
    return as_of(log, seq).orderBy("k")


def cursor(rows: DataFrame) -> Iterator[Row]:
    """Rows one after the other, a partition at a time."""
    return rows.toLocalIterator(prefetchPartitions=True)


def all_versions(log: DataFrame) -> DataFrame:
    """Every version in the total order: key, then newest first, then op."""
    return log.orderBy("k", F.desc("seq"), "op")


def distinct_keys(log: DataFrame) -> DataFrame:
    """Keys that have any version, by key."""
    return log.select("k").distinct().orderBy("k")


def tombstoned(log: DataFrame, seq: int | None = None) -> DataFrame:
    """Keys whose newest version is a tombstone."""
    return newest(log, seq).filter(F.col("op") == TOMBSTONE).select("k", "seq")


def retained_versions(log: DataFrame) -> DataFrame:
    """Number of versions of each key."""
    return log.groupBy("k").agg(F.count("*").alias("versions"))


def high_water(log: DataFrame) -> DataFrame:
    """Last visible sequence, 0 for an empty log."""
    return log.agg(F.coalesce(F.max("seq"), F.lit(0).cast("long")).alias("last_seq"))


def union(*logs: DataFrame) -> DataFrame:
    """Versions of several sources (memory, files) as one log."""
    return reduce(lambda a, b: a.unionByName(b), logs)


def duplicate_versions(log: DataFrame) -> DataFrame:
    """Identities (key, sequence, op) that stand more than once, and how many different values they have."""
    n = F.count("*").alias("copies")
    values = F.count_distinct(F.struct(F.col("v").isNull().alias("n"), "v")).cast("long").alias("different_values")
    return log.groupBy("k", "seq", "op").agg(n, values).filter("copies > 1")


def collapse(log: DataFrame, seq: int, start: object | None = None, end: object | None = None) -> DataFrame:
    """What a merged iterator shows at a snapshot within half-open bounds; open where a bound is absent."""
    bounds: list[Column] = []
    if start is not None:
        bounds.append(F.col("k") >= F.lit(start))
    if end is not None:
        bounds.append(F.col("k") < F.lit(end))
    return as_of(log.filter(reduce(lambda a, b: a & b, bounds)) if bounds else log, seq).orderBy("k")


def snapshot_registry(registered: DataFrame) -> DataFrame:
    """Oldest and newest registered sequence (-1 without any) and how many are active."""
    return registered.agg(
        F.coalesce(F.min("seq"), F.lit(-1).cast("long")).alias("oldest"),
        F.coalesce(F.max("seq"), F.lit(-1).cast("long")).alias("newest"),
        F.count("seq").alias("active"),
    )


def consistent(logs: dict[str, DataFrame], seq: int) -> dict[str, DataFrame]:
    """Views of several collections at one sequence."""
    return {name: as_of(log, seq) for name, log in logs.items()}
