"""Bloom filters over the keys of many files, held as rows of 64 bits so that no task holds a whole filter.

Images on Parquet have the format's own Bloom filters (``sources.store``); these serve files that have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and bits that a key sets.
BITS_PER_KEY, PROBES = 10, 7


def _probed(keys: DataFrame, sizes: DataFrame) -> DataFrame:
    """``keys`` (file, k) with ``word`` and ``mask`` of each probe: two hashes, the second in steps."""
    first, second = F.pmod(F.xxhash64("k"), F.col("bits")), F.pmod(F.xxhash64(F.lit(PROBES), "k"), F.col("bits"))
    at: Column = F.transform(F.array(*[F.lit(i).cast("long") for i in range(PROBES)]), lambda i: F.pmod(F.col("__a") + i * F.col("__b"), F.col("bits")))
    spread = keys.join(sizes, "file").withColumns({"__a": first, "__b": second}).select("file", "k", F.explode(at).alias("__at"))
    return spread.select("file", "k", F.expr("__at div 64").alias("word"), F.expr("shiftleft(1L, int(__at % 64))").alias("mask"))


def sizes(keys: DataFrame) -> DataFrame:
    """(file, bits): ten bits for each key of a file, at least 64."""
    return keys.groupBy("file").agg(F.greatest(F.lit(64).cast("long"), F.count("*") * BITS_PER_KEY).alias("bits"))


def build(keys: DataFrame, bits: DataFrame) -> DataFrame:
    """The filters of ``keys`` (file, k): (file, word, mask); partial results are combined before the shuffle."""
    return _probed(keys, bits).groupBy("file", "word").agg(F.bit_or("mask").alias("mask"))


def may_contain(asked: DataFrame, filters: DataFrame, bits: DataFrame) -> DataFrame:
    """``asked`` (file, k), repeats once, with ``maybe``: false only where the file does not hold the key."""
    have = filters.select("file", "word", F.col("mask").alias("__have"))
    hit = F.coalesce(F.col("__have").bitwiseAND(F.col("mask")) != 0, F.lit(False))
    known = _probed(asked, bits).join(have, ["file", "word"], "left").groupBy("file", "k").agg(F.bool_and(hit).alias("maybe"))
    return asked.distinct().join(known, ["file", "k"], "left").fillna(False, ["maybe"])
