"""Codecs that users may add: how keys and values become bytes and back, and a registry that checks their descriptors."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import keys

KEY, VALUE = "key", "value"


@dataclass(frozen=True)
class Codec:
    """A named, versioned pair of column functions; an ordered key codec keeps the order of keys in that of their bytes."""

    name: str
    version: int
    encode: Callable[[Column], Column] = field(compare=False)
    decode: Callable[[Column], Column] = field(compare=False)
    kind: str = KEY
    ordered: bool = False
    maximum_bytes: int = 65_536

    def __post_init__(self) -> None:
        if self.kind not in (KEY, VALUE) or not self.name or not 0 < self.version < 1 << 16 or self.maximum_bytes < 1:
            raise ValueError("a codec has a name, a version from 1 to 65535, a kind and a limit of at least one byte")
        if self.ordered and self.kind != KEY:
            raise ValueError("only key codecs are ordered")

    def fingerprint(self) -> str:
        """SHA-256 of the descriptor."""
        told = {"name": self.name, "version": self.version, "kind": self.kind, "ordered": self.ordered, "maximum_bytes": self.maximum_bytes}
        return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()

    def encoded(self, value: Column) -> Column:
        """The bytes of a value; too many raise, absent stays absent."""
        raw = self.encode(value)
        over = F.raise_error(F.lit(f"{self.name}: more than {self.maximum_bytes} bytes")).cast("binary")
        return F.when(F.octet_length(raw) > self.maximum_bytes, over).otherwise(raw)


class Registry:
    """Codecs by name and version."""

    def __init__(self, *codecs: Codec) -> None:
        self._codecs: dict[tuple[str, int], Codec] = {}
        for c in codecs:
            self.register(c)

    def register(self, codec: Codec) -> Codec:
        """Adds a codec; one name and version keep one descriptor."""
        held = self._codecs.setdefault((codec.name, codec.version), codec)
        if held.fingerprint() != codec.fingerprint():
            raise ValueError(f"codec {codec.name} {codec.version} is registered with another descriptor")
        return held

    def find(self, name: str, version: int, fingerprint: str | None = None) -> Codec:
        """The codec of a name and version; raises if there is none, or its descriptor is not the expected one."""
        codec = self._codecs.get((name, version))
        if codec is None:
            raise LookupError(f"no codec {name} {version}")
        if fingerprint is not None and codec.fingerprint() != fingerprint:
            raise ValueError(f"codec {name} {version} has another descriptor")
        return codec


def round_trip_failures(rows: DataFrame, column: str, codec: Codec) -> DataFrame:
    """Rows whose value does not come back from its bytes."""
    back = codec.decode(codec.encoded(F.col(column))).cast(rows.schema[column].dataType)
    return rows.filter(~back.eqNullSafe(F.col(column)))


LONG = Codec("long", 1, keys.long_key, keys.long_from_key, ordered=True, maximum_bytes=8)
STRING = Codec("string", 1, keys.string_key, lambda raw: raw.cast("string"), ordered=True)
UUID = Codec("uuid", 1, keys.uuid_key, lambda raw: keys.uuid_text(F.lower(F.hex(raw))), ordered=True, maximum_bytes=16)
TEXT = Codec("text", 1, keys.string_key, lambda raw: raw.cast("string"), kind=VALUE, maximum_bytes=16 << 20)
BUILT_IN = Registry(LONG, STRING, UUID, TEXT)
