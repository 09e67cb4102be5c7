"""Schemas from a JSON record schema file or from the footer of data files."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import types as T

#: The primitive types of record schemas, and the logical types that change them.
PRIMITIVE = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType(), "null": T.NullType()}
LOGICAL = {"date": T.DateType(), "timestamp-millis": T.TimestampType(), "timestamp-micros": T.TimestampType(), "uuid": T.StringType()}


def spark_type(schema: str | list | dict, named: dict[str, T.DataType] | None = None) -> tuple[T.DataType, bool]:
    """(type, nullable) of a record schema, parsed from JSON."""
    named = {} if named is None else named
    if isinstance(schema, list):
        kinds = [x for x in schema if x != "null"]
        if len(kinds) > 1:
            raise ValueError(f"a union of several types has no column type: {schema}")
        return (spark_type(kinds[0], named)[0] if kinds else T.NullType()), "null" in schema
    if isinstance(schema, str):
        if schema not in PRIMITIVE and schema not in named:
            raise ValueError(f"unknown type {schema}")
        return named.get(schema) or PRIMITIVE[schema], False
    kind = schema["type"]
    if kind == "record":
        out = T.StructType()
        for f in schema["fields"]:
            of, nullable = spark_type(f["type"], named)
            out = out.add(f["name"], of, nullable)
        named[schema["name"]] = out
        return out, False
    if kind == "enum":
        named[schema["name"]] = T.StringType()
        return T.StringType(), False
    if kind == "fixed":
        named[schema["name"]] = T.BinaryType()
        return T.BinaryType(), False
    if kind == "array":
        of, nullable = spark_type(schema["items"], named)
        return T.ArrayType(of, nullable), False
    if kind == "map":
        of, nullable = spark_type(schema["values"], named)
        return T.MapType(T.StringType(), of, nullable), False
    if schema.get("logicalType") == "decimal":
        return T.DecimalType(schema["precision"], schema.get("scale", 0)), False
    return LOGICAL.get(schema.get("logicalType"), None) or spark_type(kind, named)[0], False


def parse_schema(text: str) -> T.StructType:
    """The columns of a record schema in JSON, or of Spark's own schema JSON."""
    parsed = json.loads(text)
    if isinstance(parsed, dict) and parsed.get("type") == "struct":
        return T.StructType.fromJson(parsed)
    kind, _ = spark_type(parsed)
    if not isinstance(kind, T.StructType):
        raise ValueError("the schema is not of a record")
    return kind


def load_schema(spark: SparkSession, schema_file: str | None = None, like: str | None = None) -> T.StructType:
    """The schema of a schema file, else that in the files of `like`."""
    if schema_file:
        return parse_schema("\n".join(r[0] for r in spark.read.text(schema_file, wholetext=True).collect()))
    if like:
        return read_table(spark, like).schema
    raise ValueError("no schema given: name a schema file, or data files that hold one")


def format_of(path: str) -> str:
    return "bucketloom_avro" if path.rstrip("/").endswith(".avro") else "parquet"


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, kind: str | None = None) -> "DataFrame":  # noqa: F821
    """Files of a glob: Parquet, or Avro containers if the path says so (`*.avro`) or kind is "avro"."""
    kind = {"avro": "bucketloom_avro"}.get(kind or "", kind) or format_of(path)
    if kind == "bucketloom_avro":
        from bucketloom.sources.avro import AvroSource

        spark.dataSource.register(AvroSource)
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema is not None else reader).load(path)
