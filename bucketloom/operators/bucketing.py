"""Writers: fixed buckets, buckets and shards by size, shards by count threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketloom.functions.hashing import bucket_of
from bucketloom.functions.sizes import bucket_count, record_size
from bucketloom.operators.sharding import scattered
from bucketloom.operators.sizing import shards_by_eps, shards_by_size
from bucketloom.sources.layout import Manifest, key_list, write_directory

MB = 1 << 20


def keyed(df: DataFrame, key: Column, name: str = "join_key") -> DataFrame:
    """df with the value of a key expression as a column, for the writers."""
    return df.withColumn(name, key)


def _per_bucket(shards: dict[int, int]) -> Column:
    return F.get(F.split(F.lit(",".join(str(shards[b]) for b in range(len(shards)))), ",").cast("array<int>"), F.col("bucket_id"))


def write_fixed(df: DataFrame, key: str | list[str], n: int, hasher: str = "murmur3", path: str | None = None) -> Manifest:
    return write_directory(df, key, n, hasher=hasher, path=path)


def write_by_size(df: DataFrame, key: str | list[str], target_mb: float = 256, overhead: int = 104, hasher: str = "murmur3", path: str | None = None) -> Manifest:
    """Two small passes (total bytes; bytes a bucket), then one exchange by (bucket, shard)."""
    size, target = record_size(df.schema, overhead), int(target_mb * MB)
    n = bucket_count(df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0], target)
    shards = {r["bucket_id"]: r["shards"] for r in shards_by_size(df, bucket_of(df.schema, key_list(key), n, hasher), size, n, target).collect()}
    return write_directory(df, key, n, scattered(_per_bucket(shards), df), shards, hasher, path)


def write_by_threshold(df: DataFrame, key: str | list[str], eps: float, target_mb: float = 256, overhead: int = 88, hasher: str = "murmur3", path: str | None = None) -> Manifest:
    """Shards that even out counts to within eps are small where eps is: buckets that differ by more than eps get some
    1 / eps shards each. So shards of a bucket share a file, up to target_mb a file (shards in equal runs, at least one a file)."""
    size, target = record_size(df.schema, overhead), int(target_mb * MB)
    n = bucket_count(df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0], target)
    found = df.groupBy(bucket_of(df.schema, key_list(key), n, hasher).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).collect()
    shards = dict(enumerate(shards_by_eps({r["b"]: r["n"] for r in found}, n, eps)))
    file_counts = {b: 1 for b in shards} | {r["b"]: min(shards[r["b"]], 1 + r["bytes"] // target) for r in found}
    s, f = _per_bucket(shards).cast("bigint"), _per_bucket(file_counts)
    first = F.ceil(F.floor(F.col("shard_id") * f / s) * s / f).cast("int")
    return write_directory(df, key, n, scattered(_per_bucket(shards), df), shards, hasher, path, first)
