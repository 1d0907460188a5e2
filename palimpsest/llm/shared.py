"""Plan helpers of the training-data operators: checkpoints, bounded bit filters, components."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a bit filter: 8 MB whatever the input.  A fuller filter lets more rows pass; it never drops one that is due.
FILTER_BITS = 26


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's ``spark.checkpoint.dir``; a folder of this machine only where driver and executors are one process, as in tests."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "checkpoints"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, which outlives lost executors.

    What was shuffled for it goes once it is written: the plan is made anew under the setting that has Spark remove a query's shuffle
    files when it ends.  Older checkpoints go when nothing refers to them and the driver's heap is collected, which is asked for here.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    spark.sparkContext._jvm.System.gc()
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_CLEANUP, before)


def bit_planes(keys: DataFrame, key: str, plane: str | Column, planes: int, bits: int = FILTER_BITS) -> list[np.ndarray]:
    """For each plane the set bits of its longs, folded to ``2 ** bits`` bits; built on the executors, ``planes << bits - 3`` bytes at the driver."""
    low = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    parts = (
        keys.select(low.alias("b"), (F.col(plane) if isinstance(plane, str) else plane).alias("plane"))
        .groupBy("plane", F.shiftright("b", 15).alias("part"))
        .agg(F.bitmap_construct_agg(F.col("b").bitwiseAND(F.lit(32767))).alias("bits"))
    )
    out = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(planes)]
    for row in parts.toLocalIterator():
        out[row.plane][row.part << 12 : (row.part + 1) << 12] = np.frombuffer(row.bits, np.uint8)
    return out


def bit_filter(keys: DataFrame, key: str) -> np.ndarray:
    """The set bits of a column of longs, folded to ``2 ** FILTER_BITS`` bits: 8 MB at the driver."""
    return bit_planes(keys, key, F.lit(0), 1)[0]


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in a bit filter."""
    low = keys.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1


def may_be_in(docs: DataFrame, bits: np.ndarray) -> Callable[[str], Column]:
    """A test of a column of longs against a bit filter of ids: false only for ids that are not there, so that the others alone need a join; null is 0."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def may(x: pd.Series) -> pd.Series:
        return pd.Series(passes(shared.value, x.fillna(0).to_numpy(np.int64)))

    return lambda column: may(F.coalesce(column, F.lit(0)))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of (a, b) edges; the component is its smallest node.

    Alternates the large-star and small-star steps until the edges stand still.  Each step is a
    partial minimum and a join, so no neighbourhood is gathered anywhere; the edges of each round
    are checkpointed.
    """
    edges = checkpoint(edges.select("a", "b").filter("a <> b").distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpoint(small.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("b", "a"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def crc_mod(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of a doc_id written in decimal, modulo a number; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))) % modulus
