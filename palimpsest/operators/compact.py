"""Compaction: which versions may go, which files overlap, and which level is due.

A manifest has the columns ``file_number``, ``level``, ``file_size``, ``lo``, ``hi`` (smallest and largest key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.resolve import TOMBSTONE

MIB = 1 << 20
#: Bytes of level 1 and how much larger each level is; bytes of an output file by level 1 to 6.
LEVEL_1_TARGET, LEVEL_MULTIPLIER = 512 * MIB, 10
FILE_TARGETS = {1: 64 * MIB, 2: 64 * MIB, 3: 128 * MIB, 4: 256 * MIB, 5: 512 * MIB, 6: 512 * MIB}
#: Files of level 0 that make it due, urgent, and stop writes.
L0_TRIGGER, L0_URGENT, L0_STOP = 4, 12, 20
#: Fixed value: bytes of an entry besides key and value.
ENTRY_OVERHEAD = 32


def target_bytes(level: int) -> int:
    """Bytes that a level from 1 may hold."""
    return LEVEL_1_TARGET * LEVEL_MULTIPLIER ** (level - 1)


def _with_boundary(log: DataFrame, oldest: int) -> DataFrame:
    """``log`` with ``__boundary``: whether a version is its key's newest at or below the oldest snapshot; null above it.

    The boundary sequence of each key is a partial maximum joined back, so no task sorts all versions of a hot key and a skewed key is split.
    """
    top = log.filter(F.col("seq") <= oldest).groupBy("k").agg(F.max("seq").alias("__top")).withColumnRenamed("k", "__k")
    at = F.when(F.col("seq") <= oldest, F.col("seq") == F.col("__top"))
    return log.join(top, F.col("k") == F.col("__k"), "left").withColumn("__boundary", at).drop("__k", "__top")


def mark_retained(log: DataFrame, oldest: int, base: Column | bool = True) -> DataFrame:
    """``log`` with ``retained``: newer than the oldest snapshot, or its key's newest of the rest; there a tombstone goes where ``base`` (nothing deeper has the key) holds."""
    goes = (F.col("op") == TOMBSTONE) & (F.lit(base) if isinstance(base, bool) else base)
    marked = _with_boundary(log, oldest)
    return marked.withColumn("retained", F.col("__boundary").isNull() | (F.col("__boundary") & ~goes)).drop("__boundary")


def retain(log: DataFrame, oldest: int, base: Column | bool = True) -> DataFrame:
    """Versions that compaction keeps; every snapshot from ``oldest`` on reads the same as before."""
    return mark_retained(log, oldest, base).filter("retained").drop("retained")


def drop_counts(log: DataFrame, oldest: int, base: Column | bool = True) -> DataFrame:
    """How many versions compaction keeps; how many it drops behind a newer one (``dropped_versions``, old tombstones too), and how many tombstones that are a key's boundary."""
    goes = (F.col("op") == TOMBSTONE) & (F.lit(base) if isinstance(base, bool) else base)
    kept, n = F.col("__boundary").isNull() | (F.col("__boundary") & ~goes), lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    behind = F.coalesce(~F.col("__boundary"), F.lit(False))
    tombs = F.coalesce(F.col("__boundary"), F.lit(False)) & goes
    return _with_boundary(log, oldest).agg(n(kept).alias("kept"), n(behind).alias("dropped_versions"), n(tombs).alias("dropped_tombstones"))


def _place(key: Column, kind: str) -> Column:
    """A number that never falls as keys rise: numbers themselves, else the first seven bytes."""
    if kind in ("string", "binary"):
        return F.conv(F.rpad(F.hex(F.substring(key.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("double")
    return key.cast("double")


def base_level(keys: DataFrame, manifest: DataFrame, output_level: int) -> DataFrame:
    """``keys`` (k) with ``base``: no file of a level below the output covers the key.

    The key space is cut into as many ranges as there are files.  Within a range the files' spans are merged to disjoint ones, so each
    key meets its range's spans by an equal join and at most one of them; only one row of bounds comes to the driver.
    """
    kind = dict(keys.dtypes)["k"]
    deeper = manifest.filter(F.col("level") > output_level).select("lo", "hi", _place(F.col("lo"), kind).alias("a"), _place(F.col("hi"), kind).alias("z"))
    low, high, files = deeper.agg(F.min("a"), F.max("z"), F.count("*")).first()
    if not files:
        return keys.withColumn("base", F.lit(True))
    width = max((high - low) / files, 1e-9)
    cell = lambda x: F.floor((x - F.lit(low)) / F.lit(width)).cast("long")
    spread = deeper.withColumn("__cell", F.explode(F.sequence(cell(F.col("a")), cell(F.col("z")))))
    w = W.partitionBy("__cell").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    head = spread.withColumn("__head", F.when(reach.isNull() | (F.col("lo") > reach), F.col("lo")))
    spans = head.withColumn("__lo", F.last("__head", ignorenulls=True).over(w)).groupBy("__cell", "__lo").agg(F.max("hi").alias("__hi"))
    spans = spans.withColumnRenamed("__cell", "__at")
    found = keys.withColumn("__cell", cell(_place(F.col("k"), kind)))
    inside = (F.col("__cell") == F.col("__at")) & (F.col("k") >= F.col("__lo")) & (F.col("k") <= F.col("__hi"))
    return found.join(spans, inside, "left").withColumn("base", F.col("__at").isNull()).drop("__cell", "__at", "__lo", "__hi")


def overlaps(manifest: DataFrame, smallest: object, largest: object, level: int) -> DataFrame:
    """Files of a level that a closed key range touches."""
    return manifest.filter((F.col("level") == level) & (F.col("lo") <= F.lit(largest)) & (F.col("hi") >= F.lit(smallest)))


def overlap_groups(manifest: DataFrame) -> DataFrame:
    """``manifest`` with ``overlap_group``: files of a level whose ranges touch, directly or through others, share the group's first key.

    Sorted by first key, a new group begins where no earlier file reaches: one window for each level.
    """
    w = W.partitionBy("level").orderBy("lo", "file_number")
    reach = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    head = manifest.withColumn("__head", F.when(reach.isNull() | (F.col("lo") > reach), F.col("lo")))
    return head.withColumn("overlap_group", F.last("__head", ignorenulls=True).over(w)).drop("__head")


def overlap_pairs(manifest: DataFrame) -> DataFrame:
    """Pairs of files of one level with touching ranges, found within their overlap groups."""
    g = overlap_groups(manifest).select("level", "overlap_group", "file_number", "lo", "hi")
    b = g.select("level", "overlap_group", F.col("file_number").alias("other_file"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    near = g.join(b, ["level", "overlap_group"]).filter("file_number < other_file AND lo <= hi_b AND lo_b <= hi")
    return near.select("level", "file_number", "other_file")


def closure(manifest: DataFrame, level: int, smallest: object, largest: object) -> tuple[object, object]:
    """The key range that grows until no file of ``level`` or the next touches it without lying inside.  Each round is one aggregate."""
    files = manifest.filter(F.col("level").isin(level, level + 1)).select("lo", "hi")
    while True:
        got = files.filter((F.col("lo") <= F.lit(largest)) & (F.col("hi") >= F.lit(smallest))).agg(F.min("lo"), F.max("hi")).first()
        low = smallest if got[0] is None else min(smallest, got[0])
        high = largest if got[1] is None else max(largest, got[1])
        if (low, high) == (smallest, largest):
            return low, high
        smallest, largest = low, high


def dedup(log: DataFrame) -> DataFrame:
    """Equal versions as one; ``conflict`` where one identity has different values, which is corruption.  One shuffle of partial results."""
    mixed = (F.min("v") != F.max("v")) | ((F.count("v") > 0) & (F.count("v") < F.count("*")))
    return log.groupBy("k", "seq", "op").agg(F.min("v").alias("v"), F.coalesce(mixed, F.lit(False)).alias("conflict"))


def cut_outputs(log: DataFrame, target: int, size: Column, partition: Column) -> DataFrame:
    """``log`` with ``file``: entries in key order, cut where a file would pass ``target`` and the key changes.

    The cut is greedy, so it runs in order within each ``partition`` of the keyspace (a range of keys): memory is that of one range.
    ``size`` is that of key and value.  A key's versions are never parted.  Each cut is found by a binary search over running sizes of keys.
    """
    schema = log.withColumns({"part": partition, "file": F.lit(0).cast("long")}).schema
    columns = schema.names

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values(["k", "seq"], ascending=[True, False], kind="stable")
        sizes = pdf["__size"].to_numpy()
        heads = np.flatnonzero((pdf["k"] != pdf["k"].shift()).to_numpy())
        before = np.cumsum(sizes) - sizes
        begin, with_first = before[heads], before[heads] + sizes[heads]  # both rise from key to key
        file, at = np.zeros(len(heads), np.int64), 0
        while (cut := max(at + 1, int(np.searchsorted(with_first, begin[at] + target, "right")))) < len(heads):
            file[cut:] += 1
            at = cut
        return pdf.assign(file=np.repeat(file, np.diff(np.append(heads, len(pdf)))))[columns]

    sized = log.withColumns({"part": partition, "__size": size.cast("long") + ENTRY_OVERHEAD})
    return sized.groupBy("part").applyInPandas(run, schema)


def levels(manifest: DataFrame) -> DataFrame:
    """Files and bytes of levels 0 to 6, those without files too."""
    spark = manifest.sparkSession
    have = manifest.groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size").cast("long").alias("bytes"))
    every = spark.range(7).select(F.col("id").cast("int").alias("level"))
    return every.join(have, "level", "left").select("level", F.coalesce("files", F.lit(0).cast("long")).alias("files"), F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"))


def _target() -> Column:
    out = F.lit(None).cast("long")
    for level in range(1, 7):
        out = F.when(F.col("level") == level, F.lit(target_bytes(level)).cast("long")).otherwise(out)
    return out


def scores(manifest: DataFrame) -> DataFrame:
    """How full levels 0 to 5 are: files against 4 for level 0, bytes against the target for the others."""
    score = F.when(F.col("level") == 0, F.col("files") / float(L0_TRIGGER)).otherwise(F.col("bytes").cast("double") / _target())
    return levels(manifest).filter("level <= 5").select("level", "files", "bytes", score.alias("score"))


def debt(manifest: DataFrame, with_level_0: bool) -> DataFrame:
    """Bytes above the targets of levels 1 to 5; the library's form adds level 0's files above 4 at their mean size."""
    over = F.greatest(F.lit(0).cast("long"), F.col("bytes") - _target())
    first = F.when(F.col("files") > L0_TRIGGER, (F.col("files") - L0_TRIGGER) * F.expr("bytes div files")).otherwise(0).cast("long")
    each = F.when(F.col("level") == 0, first if with_level_0 else F.lit(0).cast("long")).when(F.col("level") <= 5, over).otherwise(0)
    return levels(manifest).agg(F.sum(each).cast("long").alias("debt_bytes"))


def trigger(manifest: DataFrame) -> DataFrame:
    """The level that the engine compacts: 0 at 4 files, else the first above its target; no row if none is due."""
    due = ((F.col("level") == 0) & (F.col("files") >= L0_TRIGGER)) | (F.col("level").between(1, 5) & (F.col("bytes") > _target()))
    return levels(manifest).filter(due).orderBy("level").limit(1).select("level")


def pick_level(manifest: DataFrame) -> DataFrame:
    """The level to compact and why: level 0 at 12 files, else the highest score from 1 on, the lower level in a tie."""
    s = scores(manifest).filter("score >= 1").withColumn("urgent", (F.col("level") == 0) & (F.col("files") >= L0_URGENT))
    reason = F.when(F.col("urgent") & (F.col("files") >= L0_STOP), "WRITE_STOP").when(F.col("urgent"), "URGENT_L0").otherwise("SCORE")
    return s.orderBy(F.desc("urgent"), F.desc("score"), "level").limit(1).select("level", "score", reason.alias("reason"))


def pick_files(manifest: DataFrame, level: int, pointer: object | None = None) -> dict[str, object]:
    """Inputs at ``level``, what they meet at the next, and that range's files one further (grandparents), as file numbers.

    Level 0 starts from its oldest file and takes in all that overlaps.  A deeper level starts behind its pointer (round robin) and takes in
    more of its own files if no further output is touched and the bytes stay within twice the first plan's, or 512 MiB.
    """
    own = manifest.filter(F.col("level") == level)
    numbers = lambda df: [r.file_number for r in df.select("file_number").orderBy("file_number").collect()]  # noqa: E731  files of one plan
    size = lambda *dfs: sum(df.agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0] for df in dfs)
    if level == 0:
        seed = own.orderBy("file_number").first()
        if seed is None:
            return {"inputs": [], "outputs": [], "grandparents": []}
        low, high = closure(manifest, 0, seed.lo, seed.hi)
        inputs, outputs = overlaps(manifest, low, high, 0), overlaps(manifest, low, high, 1)
    else:
        behind = own if pointer is None else own.filter(F.col("hi") > F.lit(pointer))
        seed = behind.orderBy("lo").first() or own.orderBy("lo").first()
        if seed is None:
            return {"inputs": [], "outputs": [], "grandparents": []}
        low, high = seed.lo, seed.hi
        inputs, outputs = own.filter(F.col("file_number") == seed.file_number), overlaps(manifest, low, high, level + 1)
        span = outputs.agg(F.min("lo"), F.max("hi")).first()
        if span[0] is not None:
            wide = min(low, span[0]), max(high, span[1])
            more, met = overlaps(manifest, *wide, level), overlaps(manifest, *wide, level + 1)
            if numbers(met) == numbers(outputs) and size(more, met) <= max(512 * MIB, 2 * size(inputs, outputs)):
                inputs, (low, high) = more, wide
    return {"inputs": numbers(inputs), "outputs": numbers(outputs), "grandparents": numbers(overlaps(manifest, low, high, level + 2))}


def invariant_violations(manifest: DataFrame) -> DataFrame:
    """Files of level 1 and below that begin within their level's file before them."""
    before = F.lag("hi").over(W.partitionBy("level").orderBy("lo", "file_number"))
    return manifest.filter("level >= 1").withColumn("before_hi", before).filter("before_hi >= lo").select("level", "file_number", "lo", "before_hi")
