"""Which shard of its bucket a row goes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def round_robin(bucket: str, shards: Column, *order: str) -> Column:
    """In turn over the rows of a bucket in order: shard sizes differ by one at most. Gathers a bucket in a task; for
    buckets that do not fit one, `scattered`."""
    return F.pmod(F.row_number().over(Window.partitionBy(bucket).orderBy(*order)) - 1, shards).cast("int")


def scattered(shards: Column, rows: DataFrame) -> Column:
    """In turn over the rows of a read task, from a start of the task's own: no sort, no gathering of a hot bucket, equal
    rows spread like others. A lost task that reads its split again gives every row the same shard."""
    turn = F.monotonically_increasing_id()
    start = F.xxhash64(F.spark_partition_id())
    return F.pmod(turn + F.pmod(start, F.lit(1 << 20)), shards).cast("int")


def random_shard(shards: Column, seed: int) -> Column:
    return F.floor(F.rand(seed) * shards).cast("int")
