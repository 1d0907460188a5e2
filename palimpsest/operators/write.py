"""Writes: batches, their limits and sequences, replay of a log's tail, and admission under pressure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Operations and encoded bytes of a batch, bytes of a key and of a value.
MAX_OPERATIONS, MAX_BATCH_BYTES, MAX_KEY_BYTES, MAX_VALUE_BYTES = 10_000, 32 << 20, 65_536, 16 << 20
#: Encoded size of a batch and of an operation besides its key and value.
BATCH_HEADER, OPERATION_HEADER = 24, 12

GIB = 1 << 30


def _bytes(c: Column) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def batch_report(ops: DataFrame, key: str = "k", value: str = "v", batch: str = "batch_id") -> DataFrame:
    """Per batch: operations, encoded bytes, and the first limit that it breaks (``OK`` if none)."""
    size = F.sum(_bytes(F.col(key)) + _bytes(F.col(value)) + OPERATION_HEADER) + BATCH_HEADER
    out = ops.groupBy(batch).agg(
        F.count("*").alias("operations"), size.cast("long").alias("encoded_bytes"),
        F.max(_bytes(F.col(key))).alias("__k"), F.max(_bytes(F.col(value))).alias("__v"),
    )
    verdict = (
        F.when(F.col("operations") > MAX_OPERATIONS, "TOO_MANY_OPERATIONS").when(F.col("__k") > MAX_KEY_BYTES, "KEY_TOO_LARGE")
        .when(F.col("__v") > MAX_VALUE_BYTES, "VALUE_TOO_LARGE").when(F.col("encoded_bytes") > MAX_BATCH_BYTES, "BATCH_TOO_LARGE").otherwise("OK")
    )
    return out.withColumn("status", verdict).drop("__k", "__v")


#: Batches of one range, within which they are put in order; between ranges one row of each is.
RANGE_BATCHES = 1 << 16


def assign_sequences(ops: DataFrame, after: int, batch: str = "batch_id", ordinal: str = "ordinal", width: int = RANGE_BATCHES) -> DataFrame:
    """``ops`` with contiguous sequences after ``after``, by batch (a whole number), then ordinal.

    Batches are cut into ranges of numbers: their sizes are summed within each range side by side, and the ranges' sums, one row each, in
    one order; operations are numbered within their batch.
    """
    sizes = ops.groupBy(F.col(batch).alias("__b")).agg(F.count("*").alias("__n")).withColumn("__r", F.floor(F.col("__b") / width))
    earlier = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.groupBy("__r").agg(F.sum("__n").alias("__n")).select("__r", earlier(W.orderBy("__r")).alias("__base"))
    starts = sizes.withColumn("__own", earlier(W.partitionBy("__r").orderBy("__b"))).join(ranges, "__r").select("__b", (F.col("__base") + F.col("__own")).alias("__before"))
    place = F.row_number().over(W.partitionBy(batch).orderBy(ordinal))
    out = ops.join(starts, F.col(batch) == F.col("__b")).withColumn("seq", F.lit(after) + F.col("__before") + place)
    return out.drop("__b", "__before")


def last_per_batch(ops: DataFrame, batch: str = "batch_id", ordinal: str = "ordinal") -> DataFrame:
    """Of several operations of a batch on one key, the last: the one that readers will see."""
    rest = [c for c in ops.columns if c not in (batch, "k", ordinal)]
    top = ops.groupBy(batch, "k").agg(F.max(F.struct(ordinal, *rest)).alias("t"))
    return top.select(batch, "k", *[F.col(f"t.{c}").alias(c) for c in [ordinal, *rest]])


def union_collections(collections: dict[str, DataFrame]) -> DataFrame:
    """Mutations of several collections as one batch frame with a ``collection`` column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("collection", F.lit(name)) for name, df in collections.items()])


def batch_result(ops: DataFrame, typed: bool, batch: str = "batch_id") -> DataFrame:
    """Per batch: operations, first and last sequence and status; a batch of no operations (null ``k`` and ``seq``) succeeds raw and is rejected typed."""
    out = ops.groupBy(batch).agg(F.count("seq").alias("operations"), F.coalesce(F.min("seq"), F.lit(0)).alias("first_seq"), F.coalesce(F.max("seq"), F.lit(0)).alias("last_seq"))
    empty = F.lit("REJECTED_EMPTY_BATCH" if typed else "SUCCEEDED")
    return out.withColumn("status", F.when(F.col("operations") == 0, empty).otherwise("APPLIED" if typed else "SUCCEEDED"))


def replay(base: DataFrame, tail: DataFrame, watermark: int) -> DataFrame:
    """A base image and the operations logged after its watermark as one log."""
    return base.unionByName(tail.filter(F.col("seq") > watermark))


def sequence_gaps(log: DataFrame, width: int = 1 << 20) -> DataFrame:
    """(after_seq, next_seq) wherever a sequence does not follow on the one before; repeats show as well.

    Sequences are cut into ranges: gaps are found within each side by side, and between the ranges from one row for each.
    """
    cut = log.select("seq", F.floor(F.col("seq") / width).alias("range"))
    inner = cut.withColumn("before", F.lag("seq").over(W.partitionBy("range").orderBy("seq")))
    inner = inner.filter("seq <> before + 1").select(F.col("before").alias("after_seq"), F.col("seq").alias("next_seq"))
    ends = cut.groupBy("range").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    outer = ends.select(F.lag("high").over(W.orderBy("range")).alias("after_seq"), F.col("low").alias("next_seq"))
    return inner.union(outer.filter("next_seq <> after_seq + 1"))


def plan_check(batches: DataFrame) -> DataFrame:
    """Batches (batch_id, first_seq, last_seq) with whether each continues the one before and has 1 to 10,000 operations."""
    cut = batches.withColumn("__r", F.floor(F.col("batch_id") / RANGE_BATCHES))
    ends = cut.groupBy("__r").agg(F.max(F.struct("batch_id", "last_seq"))["last_seq"].alias("__end"))
    ends = ends.select("__r", F.lag("__end").over(W.orderBy("__r")).alias("__end"))  # one row for each range
    before = F.coalesce(F.lag("last_seq").over(W.partitionBy("__r").orderBy("batch_id")), "__end")
    n = F.col("last_seq") - F.col("first_seq") + 1
    return cut.join(ends, "__r").select("batch_id", n.alias("operations"), F.coalesce(F.col("first_seq") == before + 1, F.lit(True)).alias("contiguous"), n.between(1, MAX_OPERATIONS).alias("size_ok"))


def _ratio(value: Column, start: Column, stop: Column) -> Column:
    share = (value - start).cast("double") / F.nullif((stop - start).cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0))))


#: Fixed values: (column, where writes slow down, where they stop, reason).
PRESSURE_STEPS = (
    ("immutable_memtables", 2, 4, "IMMUTABLE_MEMTABLES"),
    ("wal_bytes", GIB // 2, 2 * GIB, "WAL_BYTES"),
    ("l0_files", 12, 20, "LEVEL_ZERO_FILES"),
    ("debt_bytes", 2 * GIB, 8 * GIB, "COMPACTION_DEBT"),
)
#: Fixed values: (least bytes, percent of the disk) that must be free to write at speed, and at all.
DISK_SLOW, DISK_STOP = (10 * GIB, 15), (2 * GIB, 5)


def write_pressure(inputs: DataFrame) -> DataFrame:
    """Measurements with ``state``, ``reasons``, ``severity`` and ``delay_micros``.

    FAILED outranks STOPPED_RETRYABLE, which outranks SLOWDOWN.  Only a slowdown has a delay: it grows with the square of the worst measure's
    way from its slow to its stop mark, from 0.1 to 10 ms.
    """
    c = F.col
    free_at = lambda mark: F.greatest(F.lit(mark[0]), F.call_function("div", c("total_disk") * mark[1], F.lit(100)))
    slow, stop = free_at(DISK_SLOW), free_at(DISK_STOP)
    stopped = ~c("native_ok") | c("paused") | (c("disk_ok") & (c("usable_disk") < stop))
    severity = [F.when(c("disk_ok"), 1 - _ratio(c("usable_disk"), stop, slow)).otherwise(0.0)]
    reasons = []
    for name, low, high, reason in PRESSURE_STEPS:
        stopped = stopped | (c(name) >= high)
        severity.append(_ratio(c(name), F.lit(low), F.lit(high)))
        reasons.append(F.when(c(name) >= low, reason))
        if name == "immutable_memtables":
            reasons.append(F.when(~c("native_ok"), "NATIVE_CAPACITY"))
    reasons += [F.when(c("disk_ok") & (c("usable_disk") < slow), "DISK_SPACE"), F.when(c("failed"), "BACKGROUND_FAILURE"), F.when(c("paused"), "ADMINISTRATIVE_PAUSE")]
    out = inputs.withColumn("reasons", F.array_join(F.array_compact(F.array(*reasons)), ","))
    state = F.when(c("failed"), "FAILED").when(stopped, "STOPPED_RETRYABLE").when(c("reasons") == "", "NORMAL").otherwise("SLOWDOWN")
    out = out.withColumn("state", state)
    worst = F.when(c("state") == "NORMAL", 0.0).when(c("state") == "SLOWDOWN", F.greatest(*severity)).otherwise(1.0)
    out = out.withColumn("severity", worst)
    delay = F.least(F.lit(10_000), F.floor(100 + c("severity") * c("severity") * 9_900 + 0.5)).cast("long")
    return out.withColumn("delay_micros", F.when(c("state") == "SLOWDOWN", delay).otherwise(F.lit(0).cast("long")))
