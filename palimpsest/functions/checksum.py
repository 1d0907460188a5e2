"""Masked CRC-32C of bytes as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The reversed Castagnoli polynomial, and what masking adds after a rotation by 15 bits.
POLYNOMIAL, MASK_DELTA, MASK_ROTATION = 0x82F63B78, 0xA282EAD8, 15
_ALL = 0xFFFFFFFF


def _remainder(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ (POLYNOMIAL if byte & 1 else 0)
    return byte


def crc32c(raw: Column) -> Column:
    """CRC-32C of a binary as a long from 0; null for null.  One table step for each byte, in the JVM."""
    table = F.array(*[F.lit(_remainder(n)).cast("long") for n in range(256)])
    pairs = F.regexp_extract_all(F.hex(raw), F.lit(".."), F.lit(0))

    def step(crc: Column, pair: Column) -> Column:
        low = crc.bitwiseXOR(F.conv(pair, 16, 10).cast("long")).bitwiseAND(F.lit(255))
        return F.shiftright(crc, 8).bitwiseXOR(F.element_at(table, (low + 1).cast("int")))

    return F.aggregate(pairs, F.lit(_ALL).cast("long"), step).bitwiseXOR(F.lit(_ALL).cast("long"))


def mask(crc: Column) -> Column:
    """The form in which a checksum is stored: rotated right, then raised by a constant, modulo 2^32."""
    turned = F.shiftright(crc, MASK_ROTATION).bitwiseOR(F.shiftleft(crc, 32 - MASK_ROTATION).bitwiseAND(F.lit(_ALL).cast("long")))
    return (turned + F.lit(MASK_DELTA).cast("long")).bitwiseAND(F.lit(_ALL).cast("long"))


def unmask(stored: Column) -> Column:
    """What ``mask`` was given."""
    turned = (stored - F.lit(MASK_DELTA).cast("long")).bitwiseAND(F.lit(_ALL).cast("long"))
    return F.shiftright(turned, 32 - MASK_ROTATION).bitwiseOR(F.shiftleft(turned, MASK_ROTATION).bitwiseAND(F.lit(_ALL).cast("long")))


def masked_crc32c(raw: Column) -> Column:
    """Masked CRC-32C of a binary."""
    return mask(crc32c(raw))
