"""Binary records: the compact row encoding of Avro (zig-zag varints, length-prefixed bytes, little-endian floats)."""

from __future__ import annotations

import datetime
import decimal
import io
import struct
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Encoder = Callable[[bytearray, object], None]
Decoder = Callable[[io.BytesIO], object]

EPOCH = datetime.date(1970, 1, 1)
INSTANT = datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)


def put_long(out: bytearray, v: int) -> None:
    v = (v << 1) ^ (v >> 63)
    while v > 0x7F:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)


def get_long(raw: io.BytesIO) -> int:
    shift = v = 0
    while True:
        b = raw.read(1)
        if not b:
            raise EOFError("a record ends inside a number")
        v |= (b[0] & 0x7F) << shift
        if b[0] < 0x80:
            return (v >> 1) ^ -(v & 1)
        shift += 7


def put_bytes(out: bytearray, v: bytes) -> None:
    put_long(out, len(v))
    out += v


def micros(v: datetime.datetime) -> int:
    v = v.replace(tzinfo=datetime.UTC) if v.tzinfo is None else v
    return (v - INSTANT) // datetime.timedelta(microseconds=1)


def record_schema(kind: T.DataType, name: str = "record", nullable: bool = False) -> str | list | dict:
    """The JSON schema of a Spark type."""
    simple = {T.BooleanType: "boolean", T.IntegerType: "int", T.ShortType: "int", T.ByteType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.BinaryType: "bytes", T.StringType: "string"}
    if nullable:
        return ["null", record_schema(kind, name)]
    if type(kind) in simple:
        return simple[type(kind)]
    if isinstance(kind, T.DateType):
        return {"type": "int", "logicalType": "date"}
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return {"type": "long", "logicalType": "timestamp-micros"}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": record_schema(kind.elementType, name + "_item", kind.containsNull)}
    if isinstance(kind, T.MapType):
        return {"type": "map", "values": record_schema(kind.valueType, name + "_value", kind.valueContainsNull)}
    if isinstance(kind, T.StructType):
        return {"type": "record", "name": name, "fields": [{"name": f.name, "type": record_schema(f.dataType, f"{name}_{f.name}", f.nullable)} for f in kind.fields]}
    raise TypeError(f"no record encoding for {kind.simpleString()}")


def encoder(schema: str | list | dict) -> Encoder:
    """A function that appends a value by its JSON schema."""
    if isinstance(schema, list):
        at, (kind,) = schema.index("null"), [x for x in schema if x != "null"]
        inner = encoder(kind)

        def union(out: bytearray, v: object) -> None:
            put_long(out, at if v is None else 1 - at)
            if v is not None:
                inner(out, v)

        return union
    kind = schema["type"] if isinstance(schema, dict) else schema
    logical = schema.get("logicalType") if isinstance(schema, dict) else None
    if kind == "record":
        fields = [(f["name"], encoder(f["type"])) for f in schema["fields"]]

        def record(out: bytearray, v: object) -> None:
            for name, put in fields:
                put(out, v[name])

        return record
    if kind == "array":
        item = encoder(schema["items"])

        def array(out: bytearray, v: object) -> None:
            if len(v):
                put_long(out, len(v))
                for x in v:
                    item(out, x)
            out.append(0)

        return array
    if kind == "map":
        value = encoder(schema["values"])

        def mapping(out: bytearray, v: object) -> None:
            pairs = list(v.items()) if isinstance(v, dict) else list(v)
            if pairs:
                put_long(out, len(pairs))
                for k, x in pairs:
                    put_bytes(out, k.encode())
                    value(out, x)
            out.append(0)

        return mapping
    if kind == "enum":
        return lambda out, v: put_long(out, schema["symbols"].index(v))
    if kind == "fixed":
        return lambda out, v: out.extend(v)
    if logical == "date":
        return lambda out, v: put_long(out, (v - EPOCH).days)
    if logical == "timestamp-micros":
        return lambda out, v: put_long(out, micros(v))
    if logical == "timestamp-millis":
        return lambda out, v: put_long(out, micros(v) // 1000)
    if logical == "decimal":
        return lambda out, v: put_bytes(out, (n := int(v.scaleb(schema.get("scale", 0)))).to_bytes((n.bit_length() + 8) // 8, "big", signed=True))
    return {
        "null": lambda out, v: None, "boolean": lambda out, v: out.append(bool(v)), "int": put_long, "long": put_long, "bytes": lambda out, v: put_bytes(out, bytes(v)),
        "float": lambda out, v: out.extend(struct.pack("<f", v)), "double": lambda out, v: out.extend(struct.pack("<d", v)), "string": lambda out, v: put_bytes(out, v.encode("utf-8")),
    }[kind]


def decoder(schema: str | list | dict) -> Decoder:
    """A function that reads a value by its JSON schema."""
    if isinstance(schema, list):
        kinds = [decoder(x) for x in schema]
        return lambda raw: kinds[get_long(raw)](raw)
    kind = schema["type"] if isinstance(schema, dict) else schema
    logical = schema.get("logicalType") if isinstance(schema, dict) else None
    if kind == "record":
        fields = [(f["name"], decoder(f["type"])) for f in schema["fields"]]
        return lambda raw: {name: get(raw) for name, get in fields}
    if kind in ("array", "map"):
        item = decoder(schema["items" if kind == "array" else "values"])

        def blocks(raw: io.BytesIO) -> list:
            out = []
            while n := get_long(raw):
                if n < 0:
                    n = -n
                    get_long(raw)  # the bytes of the block, for those who skip it
                for _ in range(n):
                    out.append(item(raw) if kind == "array" else (raw.read(get_long(raw)).decode(), item(raw)))
            return out

        return blocks
    if kind == "enum":
        return lambda raw: schema["symbols"][get_long(raw)]
    if kind == "fixed":
        return lambda raw: raw.read(schema["size"])
    if logical == "date":
        return lambda raw: EPOCH + datetime.timedelta(days=get_long(raw))
    if logical in ("timestamp-micros", "timestamp-millis"):
        scale = 1 if logical == "timestamp-micros" else 1000
        return lambda raw: INSTANT + datetime.timedelta(microseconds=get_long(raw) * scale)
    if logical == "decimal":
        return lambda raw: decimal.Decimal(int.from_bytes(raw.read(get_long(raw)), "big", signed=True)).scaleb(-schema.get("scale", 0))
    return {
        "null": lambda raw: None, "boolean": lambda raw: raw.read(1) == b"\x01", "int": get_long, "long": get_long, "bytes": lambda raw: raw.read(get_long(raw)),
        "float": lambda raw: struct.unpack("<f", raw.read(4))[0], "double": lambda raw: struct.unpack("<d", raw.read(8))[0], "string": lambda raw: raw.read(get_long(raw)).decode("utf-8"),
    }[kind]


def to_record(df: DataFrame, columns: list[str], out: str = "record", required: bool = False) -> DataFrame:
    """df with the encoded bytes of the given columns; a column that may be null has a mark of that, unless all are required."""
    import pyarrow as pa

    kind = T.StructType([T.StructField(c, df.schema[c].dataType, df.schema[c].nullable and not required) for c in columns])
    put = encoder(record_schema(kind))

    @F.pandas_udf("binary")
    def encoded(rows):  # a data frame: one column a field
        import pandas as pd

        made = []
        table = pa.Table.from_pandas(rows, preserve_index=False).to_pylist()
        for r in table:
            buffer = bytearray()
            put(buffer, {c: None if isinstance(r[c], float) and r[c] != r[c] and not isinstance(kind[c].dataType, T.FloatType | T.DoubleType) else r[c] for c in columns})
            made.append(bytes(buffer))
        return pd.Series(made)

    return df.withColumn(out, encoded(F.struct(*columns)))


def from_record(df: DataFrame, record: Column, schema: T.StructType) -> DataFrame:
    """The rows that the bytes of a column hold."""
    import pyarrow as pa

    get = decoder(record_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for b in batches:
            yield from pa.Table.from_pylist([get(io.BytesIO(x)) for x in b["__bl_raw"].to_pylist()], schema=target).to_batches()

    return df.select(record.alias("__bl_raw")).mapInArrow(run, schema)
