"""Order-preserving keys, collection identities and display forms, as column expressions."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: first byte of every typed key.
TYPED_KEY_TAG = 0x40
#: Fixed value: bytes of a typed key before the user's: tag, collection, codec version.
TYPED_KEY_HEAD = 19


def long_key(k: Column) -> Column:
    """8 bytes, big-endian, sign bit flipped: unsigned byte order is the numbers' order."""
    return F.unhex(F.lpad(F.hex(k.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def long_from_key(b: Column) -> Column:
    """The number of a ``long_key``."""
    high = F.conv(F.hex(F.substring(b, 1, 4)), 16, 10).cast("long")
    low = F.conv(F.hex(F.substring(b, 5, 4)), 16, 10).cast("long")
    return F.shiftleft(high.bitwiseXOR(F.lit(1 << 31)), 32).bitwiseOR(low)


def string_key(s: Column) -> Column:
    """UTF-8 bytes; byte order, which is Spark's own order of strings."""
    return F.encode(s, "UTF-8")


def uuid_key(s: Column) -> Column:
    """16 bytes of a UUID's text form."""
    return F.unhex(F.replace(s, F.lit("-"), F.lit("")))


def collection_id(name: str, namespace: bytes = b"") -> uuid.UUID:
    """Name-based (MD5, version 3) identity of a collection."""
    raw = bytearray(hashlib.md5(namespace + name.encode("utf-8"), usedforsecurity=False).digest())
    raw[6], raw[8] = raw[6] & 0x0F | 0x30, raw[8] & 0x3F | 0x80
    return uuid.UUID(bytes=bytes(raw))


def typed_key(collection: uuid.UUID, version: int, user_key: Column) -> Column:
    """Tag, collection, codec version (two bytes) and user key: one flat keyspace, collections side by side."""
    head = bytes([TYPED_KEY_TAG]) + collection.bytes + version.to_bytes(2, "big")
    return F.concat(F.lit(bytearray(head)), user_key)


def collection_range(collection: uuid.UUID) -> tuple[bytes, bytes]:
    """First key of a collection and the first behind it."""
    start = bytes([TYPED_KEY_TAG]) + collection.bytes
    return start, (int.from_bytes(start, "big") + 1).to_bytes(len(start), "big")


def zigzag(k: Column) -> Column:
    """Zig-zag form of a long: the order in which sets of whole numbers are stored (0, -1, 1, -2, ...)."""
    return F.shiftleft(k, 1).bitwiseXOR(F.shiftright(k, 63))


def canonical_set(values: Column) -> Column:
    """A set of longs in its stored order, without duplicates."""
    pairs = F.transform(F.array_distinct(values), lambda v: F.struct(F.length(F.hex(zigzag(v))).alias("l"), F.hex(zigzag(v)).alias("z"), v.alias("v")))
    return F.transform(F.array_sort(pairs), lambda p: p["v"])


def uuid_text(h: Column) -> Column:
    """32 hexadecimal digits in the form of a UUID; null for null."""
    return F.when(h.isNotNull(), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def display_key(raw: Column) -> Column:
    """A typed key as ``collection/<uuid>/<user key>``; any other, and the user's, as ``display_bytes``."""
    typed = (F.octet_length(raw) >= TYPED_KEY_HEAD) & (F.hex(F.substring(raw, 1, 1)) == f"{TYPED_KEY_TAG:02X}")
    owner, user = uuid_text(F.lower(F.hex(F.substring(raw, 2, 16)))), F.substring(raw, TYPED_KEY_HEAD + 1, 1 << 30)
    return F.when(typed, F.concat(F.lit("collection/"), owner, F.lit("/"), display_bytes(user))).otherwise(display_bytes(raw))


def display_bytes(raw: Column) -> Column:
    """16 bytes as a UUID, text without control characters as it is, else hexadecimal."""
    h = F.lower(F.hex(raw))
    as_uuid = uuid_text(h)
    valid = F.is_valid_utf8(raw.cast("string"))
    text = F.when(valid, raw.cast("string"))
    plain = valid & ~text.rlike(r"[\x00-\x1F\x7F-\x9F]")
    return F.when(F.octet_length(raw) == 16, as_uuid).when(plain, text).otherwise(h)


def key_group(key: Column) -> Column:
    """What stands before the last slash; ``(root)`` without one."""
    return F.when(F.contains(key, F.lit("/")), F.regexp_extract(key, r"(?s)^(.*)/[^/]*$", 1)).otherwise(F.lit("(root)"))


def key_field(key: Column) -> Column:
    """What stands behind the last slash; the whole key without one."""
    return F.regexp_extract(key, r"(?s)([^/]*)$", 1)


def escape(text: Column) -> Column:
    """Backslash, line feed, carriage return and tab escaped, for values edited as text."""
    for raw, safe in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    """What ``escape`` was given: pairs are read from the left, so an escaped backslash stays one."""
    hold = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    for raw, safe in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        hold = F.replace(hold, F.lit(safe), F.lit(raw))
    return F.replace(hold, F.lit("\x00"), F.lit("\\"))


def composite_key(*parts: Column) -> Column:
    """Parts joined by a slash."""
    return F.concat_ws("/", *parts)
