"""Typed schemas: fields known by stable ids, compatible upgrades, reading older versions, collection registry.

A field frame has ``field_id``, ``name``, ``type``, ``byte_bound``, ``optional``, ``max_entries``, ``detail``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: ids below are reserved.
FIRST_FIELD_ID = 16
CAPABILITIES = ("POINT_READ", "POINT_WRITE", "RANGE_SCAN", "SNAPSHOT_READ")


def compatibility(older: DataFrame, newer: DataFrame) -> DataFrame:
    """(field_id, problem) of each field that makes an upgrade incompatible; a field shows the first of its problems."""
    names = ("type", "byte_bound", "optional", "max_entries", "detail")
    a = older.select("field_id", *[F.col(c).alias(f"old_{c}") for c in names], F.lit(True).alias("in_old"))
    b = newer.select("field_id", *[F.col(c).alias(f"new_{c}") for c in names], F.lit(True).alias("in_new"))
    problem = (
        F.when(F.col("in_new").isNull(), "REMOVED")
        .when(F.col("in_old").isNull(), F.when(~F.col("new_optional"), "NEW_REQUIRED"))
        .when(F.col("old_type") != F.col("new_type"), "TYPE_CHANGED")
        .when(~F.coalesce("old_detail", F.lit("")).eqNullSafe(F.coalesce("new_detail", F.lit(""))), "IDENTITY_CHANGED")
        .when(F.col("new_byte_bound") < F.col("old_byte_bound"), "BOUND_TIGHTENED")
        .when(F.col("new_max_entries") < F.col("old_max_entries"), "ENTRIES_TIGHTENED")
        .when(F.col("old_optional") & ~F.col("new_optional"), "BECAME_REQUIRED")
    )
    return a.join(b, "field_id", "full").select("field_id", problem.alias("problem")).filter("problem IS NOT NULL")


def upgrade_problems(older: DataFrame, newer: DataFrame, versions: tuple[int, int], identities: tuple[str, str] = ("", "")) -> DataFrame:
    """``compatibility`` with the rules of the schema as a whole, shown as field 0: its identity stays, its version rises."""
    whole = [(0, "IDENTITY_CHANGED")] * (identities[0] != identities[1]) + [(0, "VERSION_NOT_INCREASED")] * (versions[1] <= versions[0])
    return compatibility(older, newer).union(older.sparkSession.createDataFrame(whole, "field_id int, problem string"))


def field(field_id: int, name: str, kind: T.DataType, optional: bool = False, **more: object) -> T.StructField:
    """A Spark field that carries its stable id."""
    if field_id < FIRST_FIELD_ID:
        raise ValueError(f"field ids begin at {FIRST_FIELD_ID}")
    return T.StructField(name, kind, True, {"field_id": field_id, "optional": optional, **more})


def read_as(rows: DataFrame, stored: T.StructType, wanted: T.StructType) -> DataFrame:
    """Rows of one schema read as another: fields by id, so renames are free; unknown ones are left, absent optional ones are null, an absent required one is an error."""
    by_id = {f.metadata["field_id"]: f for f in stored.fields}
    out = []
    for f in wanted.fields:
        old = by_id.get(f.metadata["field_id"])
        if old is None and not f.metadata.get("optional"):
            raise ValueError(f"field {f.metadata['field_id']} is required and not stored")
        out.append((F.lit(None).cast(f.dataType) if old is None else F.col(old.name)).alias(f.name, metadata=f.metadata))
    return rows.select(*out)


def next_field_ids(fields: DataFrame, retired: DataFrame, proposed: DataFrame) -> DataFrame:
    """Free ids for ``proposed`` fields (name), by name, above all ids in use and retired."""
    used = fields.select("field_id").union(retired.select("field_id"))
    top = used.agg(F.greatest(F.lit(FIRST_FIELD_ID - 1), F.coalesce(F.max("field_id"), F.lit(0))).alias("top"))
    place = F.row_number().over(_by_name())
    return proposed.withColumn("place", place).join(F.broadcast(top)).select("name", (F.col("top") + F.col("place")).alias("field_id"))  # one row


def _by_name():
    from pyspark.sql import Window

    return Window.orderBy("name")  # a schema's few fields


def minimum_writer(rows: DataFrame, by: str = "collection") -> DataFrame:
    """The highest schema version written to each collection: older writers are refused."""
    return rows.groupBy(by).agg(F.max("schema_version").alias("minimum_writer_version"))


def register(registry: DataFrame, request: DataFrame, incompatible: DataFrame | None = None) -> DataFrame:
    """Requests (collection_id, key_codec, schema_id, fingerprint, schema_version) with CREATED, UNCHANGED, UPGRADE or CONFLICT.

    One id keeps its key codec and schema; one version keeps its fingerprint; an older version is a conflict, and so is an upgrade
    of a collection in ``incompatible`` (collection_id), whose fields ``compatibility`` refuses.
    """
    old = registry.select("collection_id", *[F.col(c).alias(f"o_{c}") for c in ("key_codec", "schema_id", "fingerprint", "schema_version")])
    c = F.col
    status = (
        F.when(c("o_schema_id").isNull(), "CREATED")
        .when((c("key_codec") != c("o_key_codec")) | (c("schema_id") != c("o_schema_id")) | (c("schema_version") < c("o_schema_version")), "CONFLICT")
        .when(c("schema_version") > c("o_schema_version"), "UPGRADE")
        .when(c("fingerprint") != c("o_fingerprint"), "CONFLICT").otherwise("UNCHANGED")
    )
    out = request.join(old, "collection_id", "left").select(*request.columns, status.alias("status"))
    if incompatible is None:
        return out
    bad = incompatible.select("collection_id", F.lit(True).alias("__bad")).distinct()
    refused = (F.col("status") == "UPGRADE") & F.col("__bad")
    return out.join(bad, "collection_id", "left").withColumn("status", F.when(refused, "CONFLICT").otherwise(F.col("status"))).select(out.columns)


def define(spark, collection_id: str, name: str, ordered_keys: bool, capabilities: tuple[str, ...] = CAPABILITIES) -> DataFrame:
    """A registry row; range scans need ordered keys, names at most 128 bytes."""
    if set(capabilities) - set(CAPABILITIES):
        raise ValueError("unknown capability")
    if "RANGE_SCAN" in capabilities and not ordered_keys:
        raise ValueError("RANGE_SCAN needs an ordered key codec")
    if not name or len(name.encode()) > 128:
        raise ValueError("a collection name has 1 to 128 bytes")
    return spark.createDataFrame([(collection_id, name, list(capabilities))], "collection_id string, name string, capabilities array<string>")


def require(registry: DataFrame, name: str, capability: str) -> None:
    """Raises unless the collection has the capability."""
    if registry.filter((F.col("name") == name) & F.array_contains("capabilities", capability)).isEmpty():
        raise PermissionError(f"collection {name} lacks {capability}")
