"""Record sizes of a compact row encoding: zig-zag varints, 8-byte doubles, length-prefixed strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def varint_size(value: Column) -> Column:
    v = value.cast("bigint")
    zigzag = F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))
    steps = [(F.shiftrightunsigned(zigzag, 7 * k) != 0).cast("int") for k in range(1, 10)]
    return reduce(lambda a, b: a + b, steps, F.lit(1))


def field_size(name: str, kind: T.DataType) -> Column:
    c = F.col(name)
    if isinstance(kind, T.StringType | T.BinaryType):
        return varint_size(F.octet_length(c)) + F.octet_length(c)
    if isinstance(kind, T.DoubleType):
        return F.lit(8)
    if isinstance(kind, T.FloatType):
        return F.lit(4)
    if isinstance(kind, T.BooleanType):
        return F.lit(1)
    if isinstance(kind, T.IntegralType):
        return varint_size(c)
    return varint_size(F.octet_length(c.cast("string"))) + F.octet_length(c.cast("string"))


def record_size(schema: T.StructType, overhead: int = 0) -> Column:
    """Encoded bytes of a row plus a fixed overhead; a null field counts as nothing."""
    return (reduce(lambda a, b: a + b, [F.coalesce(field_size(f.name, f.dataType), F.lit(0)) for f in schema.fields]) + overhead).cast("bigint")


def ceil_log2(x: int) -> int:
    return max(0, x - 1).bit_length()


def bucket_count(total_bytes: int, target_bytes: int) -> int:
    """The power of two that is 1 + total // target or the next above."""
    return 1 << ceil_log2(1 + total_bytes // target_bytes)
