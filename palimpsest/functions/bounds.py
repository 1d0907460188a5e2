"""Field types and the checks that a stored value must pass, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scalar type of a schema field and the Spark type that holds it.  Values finer than a microsecond and
#: numbers beyond 38 digits do not fit Spark's types: nanoseconds of a day are a long, large numbers are bytes.
SPARK_TYPES: dict[str, T.DataType] = {
    "boolean": T.BooleanType(), "byte": T.ByteType(), "short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(),
    "char": T.IntegerType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "uuid": T.BinaryType(),
    "instant": T.TimestampType(), "date": T.DateType(), "time": T.LongType(), "datetime": T.TimestampNTZType(),
    "duration": T.DayTimeIntervalType(), "biginteger": T.BinaryType(), "bigdecimal": T.DecimalType(38, 18), "bytes": T.BinaryType(),
}

#: Default limits of a container: encoded bytes and entries.
CONTAINER_BYTES, CONTAINER_ENTRIES = 1 << 20, 1024


def within_bytes(value: Column, limit: int) -> Column:
    """Whether a text or binary is at most so many bytes long; absent values are."""
    return F.coalesce(F.octet_length(value) <= limit, F.lit(True))


def within_entries(value: Column, limit: int = CONTAINER_ENTRIES) -> Column:
    """Whether an array or map has at most so many entries; absent ones have."""
    return F.coalesce(F.cardinality(value) <= limit, F.lit(True))


def no_null_items(value: Column) -> Column:
    """Whether an array has no null items."""
    return F.coalesce(~F.exists(value, lambda x: x.isNull()), F.lit(True))


def is_char(value: Column) -> Column:
    """Whether a number is a 16-bit character."""
    return F.coalesce(value.between(0, 65535), F.lit(True))


def is_nanos_of_day(value: Column) -> Column:
    """Whether a number is nanoseconds of a day."""
    return F.coalesce((value >= 0) & (value < 86_400_000_000_000), F.lit(True))


def enum_label(value: Column, labels: dict[int, str]) -> Column:
    """The label of a stable enum id; an unknown id raises."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    found = F.element_at(table, value)
    wrong = F.raise_error(F.concat(F.lit("unknown enum id "), value.cast("string"))).cast("string")
    return F.when(value.isNull(), F.lit(None).cast("string")).when(found.isNull(), wrong).otherwise(found)
