"""How many buckets, and how many shards each: by bytes, or by a threshold on counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_bytes(df: DataFrame, bucket: Column, size: Column) -> DataFrame:
    return df.groupBy(bucket.alias("bucket_id")).agg(F.sum(size).cast("bigint").alias("bytes"))


def shards_by_size(df: DataFrame, bucket: Column, size: Column, n: int, target: int) -> DataFrame:
    """(bucket_id, shards): 1 + bytes // target, and 1 for an empty bucket."""
    found = bucket_bytes(df, bucket, size)
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket_id"))
    shards = (F.lit(1) + F.floor(F.coalesce("bytes", F.lit(0)) / target)).cast("int")
    return every.join(found, "bucket_id", "left").select("bucket_id", shards.alias("shards"))


def shards_by_eps(counts: dict[int, int], n: int, eps: float) -> list[int]:
    """Shards from record counts: while a bucket's share a shard is over (1 + eps) times the mean, it gets one more.

    A bucket never gets more shards than it has records, and the threshold never falls under 1, so this ends.
    """
    shards, total = [1] * n, sum(counts.values())
    while True:
        threshold = max(1, int((1 + eps) * total / sum(shards)))
        more = [b for b in range(n) if counts.get(b, 0) / shards[b] > threshold and shards[b] < counts[b]]
        if not more:
            return shards
        for b in more:
            shards[b] += 1
