"""Manifest: edits to live files, and checks of files against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def live_files(edits: DataFrame) -> DataFrame:
    """Files after all edits (edit_number, action ADD or DELETE, file_number, ...): each file's latest action decides, a deletion within an edit after an addition."""
    rest = [c for c in edits.columns if c not in ("file_number", "edit_number", "action")]
    order = F.struct("edit_number", (F.col("action") == "DELETE").alias("gone"), *rest)
    top = edits.groupBy("file_number").agg(F.max(order).alias("t")).filter("NOT t.gone")
    return top.select("file_number", *[F.col(f"t.{c}").alias(c) for c in rest])


def edit_gaps(edits: DataFrame) -> DataFrame:
    """Edit numbers that do not follow on the one before."""
    numbers = edits.select("edit_number").distinct()
    before = F.lag("edit_number").over(W.orderBy("edit_number"))
    return numbers.withColumn("before", before).filter("edit_number <> before + 1")


def recoverable(edits: DataFrame) -> DataFrame:
    """Edits before the first broken one (``valid`` false): the tail after it is cut."""
    first = edits.agg(F.min(F.when(~F.col("valid"), F.col("edit_number"))).alias("bad"))
    return edits.join(F.broadcast(first), F.col("bad").isNull() | (F.col("edit_number") < F.col("bad"))).drop("bad")  # one row


def files_of_level(manifest: DataFrame, level: int) -> DataFrame:
    """Files of a level: newest first at level 0, by key elsewhere."""
    own = manifest.filter(F.col("level") == level)
    return own.orderBy(F.desc("file_number")) if level == 0 else own.orderBy("lo")


def verify_inventory(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Referenced files (file_number, file_size) against a listing (file_number, size): OK, MISSING or SIZE_MISMATCH."""
    status = F.when(F.col("size").isNull(), "MISSING").when(F.col("size") != F.col("file_size"), "SIZE_MISMATCH").otherwise("OK")
    return manifest.join(listing, "file_number", "left").select("file_number", "file_size", status.alias("status"))


def current(manifests: DataFrame) -> DataFrame:
    """The newest complete manifest (manifest_number, complete, digest); ``ambiguous`` when the two newest complete ones differ in content."""
    top = manifests.filter("complete").orderBy(F.desc("manifest_number")).limit(2)
    return top.agg(F.max("manifest_number").alias("manifest_number"), (F.count_distinct("digest") > 1).alias("ambiguous"))
