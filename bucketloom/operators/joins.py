"""Joins: plain, bucketed, by congruent buckets, co-groups; and the planner of bucket pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bucketloom.functions.hashing import encode_typed
from bucketloom.sources.layout import Manifest, read_directory, write_catalogue
from bucketloom.sources.pairs import join_pairs


def plain_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    return left.join(right, left[left_key] == right[right_key], how)


def bucketed_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, n_left: int, n_right: int | None = None, how: str = "inner") -> DataFrame:
    """Both sides written as sorted buckets, then merged. Counts that divide each other need no exchange either
    (coalesced bucket reads); the setting is read when the plan runs, so it is left on."""
    spark = left.sparkSession
    spark.conf.set("spark.sql.bucketing.coalesceBucketsInJoin.enabled", "true")
    a, b = write_catalogue(left, left_key, n_left), write_catalogue(right, right_key, n_right or n_left)
    return a.join(b.hint("merge"), a[left_key] == b[right_key], how)


def congruent_join(spark: SparkSession, left: Manifest, right: Manifest) -> DataFrame:
    """Inner join of two layouts of any bucket and shard counts, file by file: neither side is shuffled or sorted again."""
    return join_pairs(spark, left, right)


def resolve_bucketing(left: DataFrame, right: DataFrame, n_left: int, n_right: int) -> DataFrame:
    """Pairs of (bucket_id, shard_id) files that can hold equal keys. Both sides are file lists, one row a file."""
    g = math.gcd(n_left, n_right)
    a = left.select(F.col("bucket_id").alias("l_bucket"), F.col("shard_id").alias("l_shard"))
    b = right.select(F.col("bucket_id").alias("r_bucket"), F.col("shard_id").alias("r_shard"))
    return a.join(b, F.pmod("l_bucket", F.lit(g)) == F.pmod("r_bucket", F.lit(g)))


def cogroup(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_agg: list[Column], right_agg: list[Column]) -> DataFrame:
    """Full-outer co-groups on rows: each side grouped first (map-side sums apply), then one join a key."""
    a = left.groupBy(F.col(left_key).alias("key")).agg(*left_agg)
    b = right.groupBy(F.col(right_key).alias("r_key")).agg(*right_agg)
    return a.join(b, F.col("key") == F.col("r_key"), "full").withColumn("key", F.coalesce("key", "r_key")).drop("r_key")


def cogroup_layouts(spark: SparkSession, left: Manifest, right: Manifest, left_agg: list[Column], right_agg: list[Column]) -> DataFrame:
    """Co-groups of two layouts. A key's rows can lie in several shards and, with unequal counts, in several pairs of
    buckets, so groups are made of rows, not of file pairs: files are sorted by key, so each task sums its keys first."""
    return cogroup(read_directory(spark, left), read_directory(spark, right), left.key, right.key, left_agg, right_agg)


def cogroup_rows(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(key, lefts, rights) with whole rows, empty where a side has none; for keys whose groups fit a task."""
    rows = lambda df: F.collect_list(F.struct(*df.columns))
    c = cogroup(left, right, left_key, right_key, [rows(left).alias("lefts")], [rows(right).alias("rights")])
    return c.select("key", F.coalesce("lefts", F.array().cast(c.schema["lefts"].dataType)).alias("lefts"), F.coalesce("rights", F.array().cast(c.schema["rights"].dataType)).alias("rights"))


def unsorted_rows(layout: DataFrame, key: str) -> DataFrame:
    """(file, violations) of files whose keys fall, by the unsigned order of their bytes, in a layout as it was read.

    Each task compares neighbours where they lie; only the first and last key of each piece of a file meet in a second step."""
    import pyarrow as pa

    pieces = layout.where(F.col(key).isNotNull()).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), encode_typed(F.col(key), layout.schema[key].dataType).alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        held: dict[tuple[str, int], list] = {}  # the pieces of this task
        for b in batches:
            if not b.num_rows:
                continue
            file = pc.dictionary_encode(b["file"]).indices.to_numpy(zero_copy_only=False)
            edge = np.flatnonzero((np.diff(file) != 0) | (np.diff(b["block"].to_numpy(zero_copy_only=False)) != 0)) + 1
            for at, to in zip([0, *edge.tolist()], [*edge.tolist(), b.num_rows], strict=True):
                k = b["k"].slice(at, to - at)
                bad = int(pc.sum(pc.less(k[1:], k[:-1])).as_py() or 0)
                name = (b["file"][at].as_py(), b["block"][at].as_py())
                if name in held:
                    first, last, n = held[name]
                    held[name] = [first, k[-1].as_py(), n + bad + (k[0].as_py() < last)]
                else:
                    held[name] = [k[0].as_py(), k[-1].as_py(), bad]
        rows = [(*name, *v) for name, v in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64()))], ["file", "block", "low", "high", "n"])

    found = pieces.mapInArrow(run, "file string, block bigint, low binary, high binary, n bigint")
    across = F.lag("high").over(Window.partitionBy("file").orderBy("block"))
    told = found.withColumn("n", F.col("n") + F.coalesce((F.col("low") < across).cast("bigint"), F.lit(0)))
    return told.groupBy("file").agg(F.sum("n").alias("violations")).where("violations > 0")


def validate_sorted(layout: DataFrame, key: str) -> None:
    if not unsorted_rows(layout, key).isEmpty():
        raise ValueError("Data is not sorted")
