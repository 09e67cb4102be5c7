"""Seed-0 Murmur3 (x86, 32 bit) of order-preserving key bytes, as Column expressions inside code generation."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = 0xFFFFFFFF


def _let(value: Column, use) -> Column:
    """use(value) with value computed once: nested bit operations would double the expression at each step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _mul(a: Column, k: int) -> Column:
    """a * k mod 2**32 in halves, so that no 64-bit product overflows."""
    high = (F.shiftrightunsigned(a, 16) * k).bitwiseAND(F.lit(0xFFFF))
    return (a.bitwiseAND(F.lit(0xFFFF)) * k + F.shiftleft(high, 16)).bitwiseAND(F.lit(MASK))


def _rotl(a: Column, n: int) -> Column:
    return F.shiftleft(a, n).bitwiseOR(F.shiftrightunsigned(a, 32 - n)).bitwiseAND(F.lit(MASK))


def _fold(h: Column, by: int) -> Column:
    return h.bitwiseXOR(F.shiftrightunsigned(h, by))


def _generated(swapped: Column) -> Column | None:
    """The engine's own hash expression with seed 0, which is compiled; None where the session does not give access."""
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    if sc is None or not hasattr(swapped, "_jc"):
        return None
    try:
        utils = sc._jvm.org.apache.spark.sql.classic.ExpressionUtils
        inner = sc._jvm.PythonUtils.toSeq([utils.expression(swapped._jc)])
        return Column(utils.column(sc._jvm.org.apache.spark.sql.catalyst.expressions.Murmur3Hash(inner, 0)))
    except Exception as e:  # another engine version: the portable form gives the same numbers, only slower
        logging.getLogger(__name__).warning("the compiled hash is not reachable (%s); using the portable one", e)
        return None


def hash32_portable(swapped: Column) -> Column:
    """The same hash from public functions only."""
    h = _let(swapped.cast("bigint").bitwiseAND(F.lit(MASK)), lambda x: _mul(x, 0xCC9E2D51))
    h = _let(_let(h, lambda x: _rotl(x, 15)), lambda x: _mul(x, 0x1B873593))
    h = _let(h, lambda x: (_rotl(x, 13) * 5 + 0xE6546B64).bitwiseAND(F.lit(MASK)).bitwiseXOR(F.lit(4)))
    h = _let(_let(h, lambda x: _fold(x, 16)), lambda x: _mul(x, 0x85EBCA6B))
    h = _let(_let(h, lambda x: _fold(x, 13)), lambda x: _mul(x, 0xC2B2AE35))
    return _let(_let(h, lambda x: _fold(x, 16)), lambda x: F.when(x >= 2**31, x - 2**32).otherwise(x)).cast("int")


def unsigned_key(key: Column) -> Column:
    """The 32-bit key as an unsigned number: the order of its big-endian bytes."""
    return key.cast("bigint").bitwiseAND(F.lit(MASK))


def encode_key(key: Column) -> Column:
    """Order-preserving bytes of a 32-bit key."""
    return F.unhex(F.lpad(F.hex(unsigned_key(key)), 8, "0"))


def hash32(key: Column) -> Column:
    """Signed 32-bit hash of a 32-bit key; null for a null key."""
    x = unsigned_key(key)
    swapped = (
        F.shiftrightunsigned(x, 24)
        .bitwiseOR(F.shiftrightunsigned(x, 8).bitwiseAND(F.lit(0xFF00)))
        .bitwiseOR(F.shiftleft(x, 8).bitwiseAND(F.lit(0xFF0000)))
        .bitwiseOR(F.shiftleft(x, 24).bitwiseAND(F.lit(0xFF000000)))
    )
    signed = F.when(swapped >= 2**31, swapped - 2**32).otherwise(swapped).cast("int")
    made = _generated(signed)
    return F.when(key.isNotNull(), made if made is not None else hash32_portable(signed))


def bucket_id(key: Column, n: int) -> Column:
    """Floor-modulo of the signed hash; null keys, which never match, go to bucket 0."""
    return F.coalesce(F.pmod(hash32(key), F.lit(n)), F.lit(0)).cast("int")


def _block(h: Column, k: Column) -> Column:
    """One four-byte block, as a number, mixed into h."""
    k = _let(_let(k, lambda x: _mul(x, 0xCC9E2D51)), lambda x: _mul(_rotl(x, 15), 0x1B873593))
    return _let(h.bitwiseXOR(k), lambda x: (_rotl(x, 13) * 5 + 0xE6546B64).bitwiseAND(F.lit(MASK)))


def hash_bytes(raw: Column) -> Column:
    """Signed seed-0 hash of any bytes; null for null."""
    digits = F.hex(raw)
    number = lambda x: F.conv(F.concat(*[F.substring(x, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("bigint")  # noqa: E731  little-endian
    blocks = F.floor(F.octet_length(raw) / 4).cast("int")

    def whole(x: Column) -> Column:
        """x: the digits. Body block by block, then the tail, which is not rotated, then the length and the last mixing."""
        body = F.aggregate(
            F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>")), F.lit(0).cast("bigint"), lambda h, i: _block(h, number(F.substr(x, i * 8 + 1, F.lit(8))))
        )
        tail = number(F.rpad(F.substr(x, blocks * 8 + 1, F.lit(8)), 8, "0"))
        k = _let(_let(tail, lambda v: _mul(v, 0xCC9E2D51)), lambda v: _mul(_rotl(v, 15), 0x1B873593))
        h = _let(body, lambda v: v.bitwiseXOR(k).bitwiseXOR(F.octet_length(raw).cast("bigint")))
        h = _let(_let(h, lambda v: _fold(v, 16)), lambda v: _mul(v, 0x85EBCA6B))
        h = _let(_let(h, lambda v: _fold(v, 13)), lambda v: _mul(v, 0xC2B2AE35))
        return _let(_let(h, lambda v: _fold(v, 16)), lambda v: F.when(v >= 2**31, v - 2**32).otherwise(v))

    return F.when(raw.isNotNull(), _let(digits, whole)).cast("int")


def encode_typed(key: Column, kind: T.DataType) -> Column:
    """Order-preserving bytes by type: 4 or 8 big-endian bytes of whole numbers (unsigned order), UTF-8 of text."""
    if isinstance(kind, T.LongType):
        return F.unhex(F.lpad(F.hex(key), 16, "0"))
    if isinstance(kind, T.IntegralType):
        return encode_key(key)
    if isinstance(kind, T.DateType):
        return encode_key(F.datediff(key, F.lit("1970-01-01").cast("date")))
    if isinstance(kind, T.StringType):
        return F.encode(key, "UTF-8")
    if isinstance(kind, T.BinaryType):
        return key
    raise TypeError(f"Hashing failed: no order-preserving bytes for {kind.simpleString()}")


def _hash_blocks(raw: Column) -> Column:
    """hash_bytes of bytes whose number is a multiple of 4, by the compiled expression where it can be reached."""
    made = _generated(raw)
    return F.when(raw.isNotNull(), made) if made is not None else hash_bytes(raw)


def hash_typed(key: Column, kind: T.DataType) -> Column:
    """Signed seed-0 hash of a key's bytes; null for null."""
    if isinstance(kind, T.LongType):
        return _hash_blocks(encode_typed(key, kind))
    if isinstance(kind, T.IntegralType):
        return hash32(key)
    return hash_bytes(encode_typed(key, kind))


#: Hashes by name, from (columns, types) to a whole number; a layout's manifest names the one it was written with.
HASHERS: dict[str, Callable[[list[Column], list[T.DataType]], Column]] = {}


def register_hasher(name: str, hasher: Callable[[list[Column], list[T.DataType]], Column]) -> None:
    """Make a hash of one's own known to writers and readers."""
    HASHERS[name] = hasher


def _murmur3(keys: list[Column], kinds: list[T.DataType]) -> Column:
    """The seed-0 hash of one key; of several, of the bytes of their hashes one after the other."""
    hashes = [hash_typed(k, t) for k, t in zip(keys, kinds, strict=True)]
    return hashes[0] if len(hashes) == 1 else _hash_blocks(F.concat(*[encode_key(h) for h in hashes]))


register_hasher("murmur3", _murmur3)
register_hasher("identity", lambda keys, kinds: reduce(lambda a, b: a + b, [k.cast("bigint") for k in keys]))


def bucket_of(schema: T.StructType, keys: list[str], n: int, hasher: str = "murmur3") -> Column:
    """The bucket of a row by its key columns; rows with a null key, which never match, are in bucket 0."""
    hashed = HASHERS[hasher]([F.col(k) for k in keys], [schema[k].dataType for k in keys])
    return F.coalesce(F.pmod(hashed, F.lit(n)), F.lit(0)).cast("int")
