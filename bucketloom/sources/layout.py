"""Bucketed tables on disk.

Two layouts: catalogue tables bucketed by Spark's own hash, whose joins need no exchange, and a directory layout
(bucket_id=/shard_id=, one sorted file a pair, bucket by the seed-0 hash) with a manifest that states the number of
buckets, so that empty trailing buckets cannot mislead a join. Each file's footer holds the key and the number of buckets
too, as metadata of the key column. A writer whose shards are small lets neighbours of a bucket share a file (`packed`): it
lies under its first shard's number, and each row holds its own.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from bucketloom.functions.hashing import bucket_of, encode_typed
from bucketloom.sources.workspace import fresh_path

#: Bytes of a row group: what a reader of two sorted files holds of each.
ROW_GROUP = 16 << 20
#: The column of a packed layout's files that holds a row's shard.
SHARD = "__bl_shard"


@dataclass(frozen=True)
class Manifest:
    path: str
    keys: list[str]
    num_buckets: int
    shards: dict[str, int]
    schema: str
    hasher: str = "murmur3"
    packed: bool = False

    @property
    def key(self) -> str:
        return self.keys[0]

    @property
    def columns(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))


def file_name(bucket: int, shard: int, suffix: str = "parquet") -> str:
    return f"part-b{bucket:05d}-s{shard:05d}.{suffix}"


def parse_file_name(name: str) -> tuple[int, int]:
    m = re.search(r"part-b(\d{5,})-s(\d{5,})", name)
    if not m:
        raise ValueError(f"no bucket and shard in the name of {name}")
    return int(m[1]), int(m[2])


def parsed_names(name: Column) -> tuple[Column, Column]:
    """(bucket, shard) from a column of file names; null where there is none."""
    part = lambda i: F.try_element_at(F.regexp_extract_all(name, F.lit(r"part-b(\d{5,})-s(\d{5,})"), F.lit(i)), F.lit(1)).cast("int")
    return part(1), part(2)


def write_catalogue(df: DataFrame, key: str, n: int) -> DataFrame:
    """One sorted file a bucket; later joins on key read matching buckets with no exchange. `drop_catalogue` ends it."""
    path = fresh_path(df.sparkSession, "buckets")
    name = "bl_" + path.rsplit("-", 1)[1]
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def drop_catalogue(spark: SparkSession) -> int:
    """Forget all tables that `write_catalogue` made in this catalogue; their files stay in the shared folder. How many there were."""
    names = [t.name for t in spark.catalog.listTables() if re.fullmatch(r"bl_[0-9a-f]{32}", t.name)]
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return len(names)


def key_list(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def write_manifest(spark: SparkSession, m: Manifest) -> Manifest:
    spark.createDataFrame([(json.dumps(asdict(m)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{m.path}.manifest")
    return m


def placed(df: DataFrame, keys: list[str], n: int, hasher: str, shard: Column | None) -> DataFrame:
    """df with bucket_id and shard_id, and the header in the first key column."""
    header = {"keys": ",".join(keys), "num_buckets": n, "hash": hasher}
    t = df.withColumn("bucket_id", bucket_of(df.schema, keys, n, hasher)).withColumn("shard_id", shard if shard is not None else F.lit(0))
    return t.withMetadata(keys[0], header)


def sort_key(schema: StructType, keys: list[str]) -> list[Column]:
    return [encode_typed(F.col(k), schema[k].dataType) for k in keys]


def write_directory(df: DataFrame, key: str | list[str], n: int, shard: Column | None = None, shards: dict[int, int] | None = None, hasher: str = "murmur3", path: str | None = None, first: Column | None = None) -> Manifest:
    """df by (bucket_id, shard_id), sorted by the bytes of its keys, one file a pair, with a manifest. first: of bucket_id
    and shard_id, the first of the shards that share a file; a file is sorted by key whatever shards it holds."""
    keys = key_list(key)
    path = path or fresh_path(df.sparkSession, "layout")
    t = placed(df, keys, n, hasher, shard)
    if first is not None:
        t = t.withColumn(SHARD, F.col("shard_id")).withColumn("shard_id", first)
    t = t.repartition("bucket_id", "shard_id").sortWithinPartitions("bucket_id", "shard_id", *sort_key(df.schema, keys))
    t.write.option("parquet.block.size", ROW_GROUP).partitionBy("bucket_id", "shard_id").parquet(path)
    return write_manifest(df.sparkSession, Manifest(path, keys, n, {str(b): s for b, s in (shards or {}).items()}, df.schema.json(), hasher, first is not None))


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    return Manifest(**json.loads(spark.read.text(f"{path}.manifest").first()[0]))


def read_directory(spark: SparkSession, m: Manifest) -> DataFrame:
    columns = m.columns.add(SHARD, IntegerType()) if m.packed else m.columns
    t = spark.read.schema(columns.add("bucket_id", IntegerType()).add("shard_id", IntegerType())).parquet(m.path)
    return t.withColumn("shard_id", F.col(SHARD)).drop(SHARD) if m.packed else t


def files(spark: SparkSession, m: Manifest) -> DataFrame:
    """(path, bucket_id, shard_id, name, length) of the files that are there; name is the layout's own name of a file. In a
    packed layout shard_id is a file's first shard."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(m.path).select("path", "length")
    part = lambda name: F.regexp_extract("path", rf"/{name}=(\d+)/", 1).cast("int").alias(name)
    return found.select("path", part("bucket_id"), part("shard_id"), F.format_string("part-b%05d-s%05d.parquet", part("bucket_id"), part("shard_id")).alias("name"), "length")


def read_header(spark: SparkSession, m: Manifest) -> dict:
    """What the footers of a layout say of it: keys, num_buckets, hash."""
    for f in spark.read.parquet(m.path).schema.fields:
        if "num_buckets" in f.metadata:
            return dict(f.metadata)
    raise ValueError(f"no bucket header in the files of {m.path}")
