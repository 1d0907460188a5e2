"""Relational queries over resolved collections: lookups, feeds, integrity and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def where_sorted(rows: DataFrame, column: str, value: object, by: str) -> DataFrame:
    """Rows with a value, in order of a column."""
    return rows.filter(F.col(column) == F.lit(value)).orderBy(by)


def lookup(edges: DataFrame, source: str, rows: DataFrame, key: str) -> DataFrame:
    """Rows that edges point to, one for each edge; an edge that points nowhere raises when it is read (``dangling`` lists them)."""
    joined = edges.join(rows, edges[source] == rows[key], "left")
    absent = F.raise_error(F.concat(F.lit("no row for "), edges[source].cast("string"))).cast("boolean")
    return joined.filter(F.when(rows[key].isNull(), absent).otherwise(F.lit(True)))


def dangling(edges: DataFrame, source: str, rows: DataFrame, key: str) -> DataFrame:
    """Edges whose target is absent."""
    return edges.join(rows, edges[source] == rows[key], "left_anti")


def feed(posts: DataFrame, author: str, followed: DataFrame, member: str, newest: str) -> DataFrame:
    """Posts whose author is followed, newest first; following twice shows a post once."""
    return posts.join(followed, posts[author] == followed[member], "left_semi").orderBy(F.desc(newest))


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that are not unique, with their count."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def deletable(rows: DataFrame, key: str, *references: tuple[DataFrame, str]) -> DataFrame:
    """Rows that nothing refers to."""
    for other, column in references:
        rows = rows.join(other.select(F.col(column).alias("__ref")), F.col(key) == F.col("__ref"), "left_anti")
    return rows


def counters(edges: DataFrame, target: str) -> DataFrame:
    """Number of edges to each target: the count that an atomic counter must show."""
    return edges.groupBy(target).agg(F.count("*").alias("n"))


def counter_mismatches(rows: DataFrame, key: str, stored: str, edges: DataFrame, target: str) -> DataFrame:
    """Rows whose stored counter differs from the edges; never below 0."""
    n = counters(edges, target).select(F.col(target).alias("__t"), "n")
    out = rows.join(n, F.col(key) == F.col("__t"), "left").withColumn("actual", F.greatest(F.lit(0).cast("long"), F.coalesce("n", F.lit(0).cast("long"))))
    return out.filter(F.col(stored) != F.col("actual")).select(key, stored, "actual")


def seed_if_empty(rows: DataFrame, defaults: DataFrame) -> DataFrame:
    """The rows, or the defaults where there are none."""
    return defaults if rows.isEmpty() else rows
