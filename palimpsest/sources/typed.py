"""Typed collections over a version log: keys of one collection side by side, records read by field id.

A record is stored as one text: a JSON object from field ids to values, in the order of the ids, absent values left out.
Renaming a field changes nothing that is stored, and a field that an older writer did not know reads as absent.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import keys
from palimpsest.operators import resolve, schema


def encode_record(fields: T.StructType) -> Column:
    """The stored form of a record whose fields are columns."""
    by_id = sorted(fields.fields, key=lambda f: f.metadata["field_id"])
    return F.to_json(F.struct(*[F.col(f.name).alias(str(f.metadata["field_id"])) for f in by_id]), {"ignoreNullFields": "true"})


def decode_record(stored: Column, fields: T.StructType) -> Column:
    """A struct of the wanted fields; a required one that is not stored raises."""
    raw = F.from_json(stored, T.StructType([T.StructField(str(f.metadata["field_id"]), f.dataType) for f in fields.fields]))
    out = []
    for f in fields.fields:
        value = raw[str(f.metadata["field_id"])]
        if not f.metadata.get("optional"):
            absent = F.raise_error(F.lit(f"required field {f.metadata['field_id']} is not stored")).cast(f.dataType)
            value = F.when(stored.isNull(), F.lit(None).cast(f.dataType)).when(value.isNull(), absent).otherwise(value)
        out.append(value.alias(f.name))
    return F.struct(*out)


@dataclass(frozen=True)
class Collection:
    """A named collection: how its user keys are coded (``encode``, ``decode``), and its fields by stable ids."""

    name: str
    fields: T.StructType
    key: str = "key"
    codec_version: int = 1
    encode: object = keys.string_key
    decode: object = lambda raw: raw.cast("string")

    def _head(self) -> bytes:
        return bytes([keys.TYPED_KEY_TAG]) + keys.collection_id(self.name).bytes + self.codec_version.to_bytes(2, "big")

    def to_log(self, rows: DataFrame) -> DataFrame:
        """``rows`` (key, fields; optional batch_id, ordinal, op) as mutations (k, op, v): a tombstone has no record."""
        rest = [c for c in ("batch_id", "ordinal", "seq") if c in rows.columns]
        op = F.col("op") if "op" in rows.columns else F.lit(resolve.VALUE)
        k = keys.typed_key(keys.collection_id(self.name), self.codec_version, self.encode(F.col(self.key)))
        v = F.when(op == resolve.VALUE, encode_record(self.fields))
        return rows.select(*rest, k.alias("k"), op.alias("op"), v.alias("v"))

    def _own(self, log: DataFrame) -> DataFrame:
        low, high = keys.collection_range(keys.collection_id(self.name))
        return log.filter((F.col("k") >= F.lit(bytearray(low))) & (F.col("k") < F.lit(bytearray(high))))

    def _shown(self, live: DataFrame, fields: T.StructType | None) -> DataFrame:
        user = self.decode(F.substring(F.col("k"), keys.TYPED_KEY_HEAD + 1, 1 << 30))
        return live.select(user.alias(self.key), "seq", decode_record(F.col("v"), fields or self.fields).alias("r")).select(self.key, "seq", "r.*")

    def get(self, log: DataFrame, key: object, seq: int | None = None, fields: T.StructType | None = None) -> DataFrame:
        """The record of one key at a sequence, or none; the key filter reaches the scan."""
        k = F.concat(F.lit(bytearray(self._head())), self.encode(F.lit(key)))
        return self._shown(resolve.as_of(log.filter(F.col("k") == k), seq), fields)

    def scan_all(self, log: DataFrame, seq: int | None = None, fields: T.StructType | None = None) -> DataFrame:
        """All records of the collection at a sequence; one key range of the log is read.  ``fields`` reads an older or newer form."""
        return self._shown(resolve.as_of(self._own(log), seq), fields)


def snapshot(collections: list[Collection], log: DataFrame, seq: int) -> dict[str, DataFrame]:
    """Several collections of one log at one sequence."""
    return {c.name: c.scan_all(log, seq) for c in collections}


def batch(parts: list[tuple[Collection, DataFrame]]) -> DataFrame:
    """Mutations of several collections as one atomic batch for ``append``: their ``ordinal`` must be unique within a batch."""
    return reduce(lambda a, b: a.unionByName(b), [c.to_log(rows) for c, rows in parts])


def registry_row(spark, collection: Collection, ordered: bool = True) -> DataFrame:
    """The collection's row in the registry."""
    return schema.define(spark, str(keys.collection_id(collection.name)), collection.name, ordered)
