"""Offline inspection: reports, verification, salvage, repair of a log's tail, display."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import keys as K
from palimpsest.operators import compact, resolve


def level_report(manifest: DataFrame) -> DataFrame:
    """Files, bytes, oldest and newest file of each level in use."""
    return manifest.groupBy("level").agg(
        F.count("*").alias("files"), F.sum("file_size").cast("long").alias("bytes"),
        F.min("file_number").alias("oldest_file"), F.max("file_number").alias("newest_file"),
    )


def verify(log: DataFrame, manifest_row: dict[str, object], level: str = "FULL") -> DataFrame:
    """A table's rows against its manifest entry; FULL also counts identities that stand more than once."""
    facts = log.agg(F.count("*").alias("entries"), F.min("seq").alias("smallest_seq"), F.max("seq").alias("largest_seq"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    for name, want in manifest_row.items():
        facts = facts.withColumn(f"{name}_ok", F.col(name).eqNullSafe(F.lit(want)))
    if level != "FULL":
        return facts
    return facts.join(F.broadcast(resolve.duplicate_versions(log).agg(F.count("*").alias("duplicates"))))  # one row each


def order_violations(log: DataFrame, file: str = "file", position: str = "position") -> DataFrame:
    """Entries of a file that do not stand behind the one before: keys ascend, sequences of a key descend."""
    w = W.partitionBy(file).orderBy(position)
    pk, ps = F.lag("k").over(w), F.lag("seq").over(w)
    return log.withColumns({"pk": pk, "ps": ps}).filter("pk > k OR (pk = k AND ps <= seq)").drop("pk", "ps")


def verify_tables(entries: DataFrame, manifest: DataFrame, position: str = "position") -> DataFrame:
    """(file, problem) of tables whose entries (file, position, k, seq, size) differ from their manifest rows.

    A manifest row has file, entries, bytes, smallest_seq, largest_seq, lo and hi.  A file is bounded, so its order is checked in one window.
    """
    facts = entries.groupBy("file").agg(
        F.count("*").alias("entries"), F.sum("size").cast("long").alias("bytes"), F.min("seq").alias("smallest_seq"),
        F.max("seq").alias("largest_seq"), F.min("k").alias("lo"), F.max("k").alias("hi"),
    )
    names = {"entries": "ENTRIES", "bytes": "BYTES", "smallest_seq": "SEQUENCES", "largest_seq": "SEQUENCES", "lo": "KEYS", "hi": "KEYS"}
    both = manifest.alias("m").join(facts.alias("f"), F.col("m.file") == F.col("f.file"), "full")
    wrong = F.array_distinct(F.array_compact(F.array(*[F.when(~F.col(f"m.{c}").eqNullSafe(F.col(f"f.{c}")), label) for c, label in names.items()])))
    label = F.when(F.col("f.file").isNull(), F.array(F.lit("MISSING"))).when(F.col("m.file").isNull(), F.array(F.lit("UNREFERENCED"))).otherwise(wrong)
    listed = both.select(F.coalesce("m.file", "f.file").alias("file"), F.explode(label).alias("problem"))
    return listed.union(order_violations(entries, position=position).select("file", F.lit("ORDER").alias("problem")).distinct())


def report_json(report: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("report"))


def valid_prefix(entries: DataFrame, order: str = "position", by: str = "segment") -> DataFrame:
    """Entries of each segment before its first broken one (``valid`` false)."""
    first = entries.filter(~F.col("valid")).groupBy(by).agg(F.min(order).alias("__bad"))
    return entries.join(first, by, "left").filter(F.col("__bad").isNull() | (F.col(order) < F.col("__bad"))).drop("__bad")


def repair_plan(entries: DataFrame, order: str = "position", by: str = "segment") -> DataFrame:
    """Per segment: its entries, how many stay, how many go, and the first broken one; TRUNCATE where any goes, else NONE."""
    bad = F.min(F.when(~F.col("valid"), F.col(order)))
    at = entries.groupBy(by).agg(F.count("*").alias("entries"), bad.alias("first_bad"))
    kept = valid_prefix(entries, order, by).groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__kept"))
    n = F.coalesce("__kept", F.lit(0).cast("long"))
    action = F.when(F.col("entries") > n, "TRUNCATE").otherwise("NONE")
    return at.join(kept, F.col(by) == F.col("__by"), "left").select(by, "entries", n.alias("kept"), (F.col("entries") - n).alias("removed"), "first_bad", action.alias("action"))


def repair_tail(entries: DataFrame, backup: str, confirmed: int, order: str = "position", by: str = "segment") -> DataFrame:
    """``valid_prefix``, after all entries were written to ``backup``; raises unless as many go as were ``confirmed`` from the plan."""
    goes = repair_plan(entries, order, by).agg(F.coalesce(F.sum("removed"), F.lit(0))).first()[0]
    if goes != confirmed:
        raise ValueError(f"{goes} entries would go, {confirmed} were confirmed")
    entries.write.mode("errorifexists").parquet(backup)
    return valid_prefix(entries.sparkSession.read.schema(entries.schema).parquet(backup), order, by)


def salvage(log: DataFrame, history: bool = False) -> DataFrame:
    """What can be saved: each identity once, ``conflict`` where its values differ; the latest state, tombstones too, or all valid history."""
    once = compact.dedup(log)
    if history:
        return once
    return resolve.newest(once)


def workbench_rows(rows: DataFrame, metadata_prefix: bytes, key: str = "k", value: str = "v") -> DataFrame:
    """Rows for display: rows whose key begins with ``metadata_prefix`` go; key text, its group and field, and bytes of the value."""
    marked = F.substring(F.col(key).cast("binary"), 1, len(metadata_prefix)) == F.lit(bytearray(metadata_prefix))
    shown = rows.filter(~marked).withColumn("display", K.display_key(F.col(key).cast("binary")))
    return shown.withColumns({"group": K.key_group(F.col("display")), "field": K.key_field(F.col("display")), "value_bytes": F.octet_length(F.col(value))})
