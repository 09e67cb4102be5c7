"""Generators of key tables, Zipf-distributed events and skewed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Copies of a key that one row makes; a hotter key is cut into such chunks before it is spread over tasks.
CHUNK = 100_000


def keys(spark: SparkSession, key_space: float, block: int = 5000) -> DataFrame:
    """Ids 0.. in whole blocks, each with a random key."""
    n = -(-int(key_space) // block) * block
    return spark.range(n).select(F.col("id").cast("int"), F.expr("uuid()").alias("key"))


def zipf_frequencies(spark: SparkSession, count: float, num_keys: int, shape: float, fanout: int = 1) -> DataFrame:
    """(rank, adj): how often each of a key's fanout copies appears."""
    ranks = spark.range(num_keys).withColumnRenamed("id", "rank")
    weight = 1 / F.pow(F.col("rank") + 1, F.lit(shape))
    whole = ranks.agg(F.sum(weight).alias("h"))
    freq = F.lit(float(count)) * weight / F.col("h")
    return ranks.crossJoin(F.broadcast(whole)).select("rank", F.floor(freq / fanout + 0.5).cast("bigint").alias("adj"))


def repeated(df: DataFrame, n: str, *spread: str) -> DataFrame:
    """Each row of df as often as its column n says, in chunks of CHUNK that are dealt over tasks; column `i` counts from 0."""
    chunks = F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(n) - 1) / CHUNK))).otherwise(F.array().cast("array<bigint>"))
    cut = df.withColumn("__chunk", F.explode(chunks)).repartition(*spread, "__chunk")
    last = F.least(F.lit(CHUNK).cast("bigint"), F.col(n) - F.col("__chunk") * CHUNK) - 1
    return cut.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).withColumn("i", F.col("__chunk") * CHUNK + F.col("__at")).drop("__chunk", "__at")


def payload_bytes(n: int, seed: int, *of: Column) -> Column:
    """n bytes that depend on the seed and the given columns only: digests of (seed, columns, counter), cut to length."""
    part = lambda k: F.sha2(F.concat_ws(":", F.lit(f"{seed}:{k}"), *[c.cast("string") for c in of]), 256)
    return F.unhex(F.substring(F.concat(F.lit(""), *[part(k) for k in range(-(-n // 32))]), 1, 2 * n))


def events(spark: SparkSession, count: float, key_space: float, num_keys: float, shape: float = 0.0, fanout: int = 1, payload: int = 96, seed: int = 0) -> DataFrame:
    """Zipf events: one key in each gap of the key space, the lowest hottest, with a payload of random bytes."""
    gap = int(key_space) // int(num_keys)
    if gap < 1:
        raise ValueError("more keys than the key space holds")
    table = zipf_frequencies(spark, count, int(num_keys), shape, fanout)
    placed = table.select((F.col("rank") * gap + F.floor(F.rand(seed) * gap)).cast("int").alias("id"), "adj")
    copies = placed.select("id", "adj", F.explode(F.sequence(F.lit(1), F.lit(fanout))).alias("copy"))
    return repeated(copies, "adj", "id", "copy").select("id", payload_bytes(payload, seed, F.col("id"), F.col("copy"), F.col("i")).alias("payload"))


def partition_n_over_k(n: int, k: int, weights: list[float] | None = None) -> list[int]:
    """n split into k whole parts, even or by weights; the first indices take the remainder."""
    if weights is None:
        return [n // k + (i < n % k) for i in range(k)]
    total = sum(weights)
    parts = [int(n * w / total) for w in weights]
    return [p + (i < n - sum(parts)) for i, p in enumerate(parts)]


def hex_key(bucket: Column, buckets: int, seed: Column, bits: int = 31) -> Column:
    """A zero-padded hex key that the identity partitioner puts into its bucket."""
    key = F.pmod(bucket + buckets * seed, F.lit(1 << bits))
    return F.lpad(F.lower(F.hex(key)), -(-bits // 4), "0")


def script_records(spark: SparkSession, count: int, bits: int = 31, buckets: int = 1, skew: float = 0.0, hot: float = 0.0, seed: int = 0) -> DataFrame:
    """Records with partition skew (Zipf over buckets) and data skew (a share of a bucket's rows has the bucket's one hot key)."""
    if bits < 1 or buckets < 1 or buckets & (buckets - 1) or buckets > 1 << bits or not 0 <= hot <= 1 or skew < 0:
        raise ValueError("bits of 1 or more, buckets a power of two within the bits, 0 <= hot <= 1, skew >= 0")
    rows = partition_n_over_k(count, buckets, [1 / (i + 1) ** skew for i in range(buckets)])
    table = spark.createDataFrame(list(enumerate(rows)), "bucket long, n long")
    span = (1 << bits) // buckets
    draw = lambda *of: F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 30)) / F.lit(float(1 << 30))
    spot = F.when(draw(F.lit("hot"), F.col("bucket"), F.col("i")) < hot, F.lit(None)).otherwise(F.col("i"))
    at = F.pmod(F.xxhash64(F.lit(seed), F.lit("key"), F.col("bucket"), spot), F.lit(span))
    return repeated(table, "n", "bucket").select(hex_key(F.col("bucket"), buckets, at, bits).alias("id"))


def random_order(df: DataFrame, seed: int) -> DataFrame:
    """df in a random order that the seed and its rows decide."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns)


def read_hex_csv(spark: SparkSession, path: str, column: int = 0) -> DataFrame:
    """(key): one column of quoted hex numbers of a CSV without a header."""
    name = f"_c{column}"
    return spark.read.csv(path, quote='"').select(F.conv(F.trim(F.col(name)), 16, 10).cast("bigint").alias("key"))
