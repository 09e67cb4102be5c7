"""A stream into a bucket layout: each micro-batch adds one sorted file to each bucket that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bucketloom.sources.layout import ROW_GROUP, Manifest, key_list, placed, sort_key, write_manifest


def append_buckets(stream: DataFrame, key: str | list[str], n: int, path: str, checkpoint: str, hasher: str = "murmur3") -> tuple[StreamingQuery, Manifest]:
    """The shard of a row is its batch, so a batch that is replayed overwrites its own shards and nothing else. The layout
    is one that `read_directory` and the joins read, at any time between batches."""
    keys = key_list(key)
    m = write_manifest(stream.sparkSession, Manifest(path, keys, n, {}, stream.schema.json(), hasher))

    def write(batch: DataFrame, epoch: int) -> None:
        t = placed(batch, keys, n, hasher, F.lit(epoch).cast("int")).repartition(n, "bucket_id").sortWithinPartitions("bucket_id", *sort_key(stream.schema, keys))
        t.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.block.size", ROW_GROUP).partitionBy("bucket_id", "shard_id").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), m
