"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Row numbers 0..n-1 are permuted by an alternating Feistel network on Z_a x Z_b, the smallest near-square grid with
a * b >= n. Results beyond n - 1 are walked along their cycle until they fall below n, so the map is a bijection of
0..n-1. A permuted number p goes to shard p mod s, slot p div s: shard sizes differ by one row at most, slots have no
gaps, and anyone who knows (n, seed) can compute both ways where a row lies.

Defined results: null texts count as empty (size 8, CRC 0); null and repeated ids are rows like any other, ordered by
(doc_id, CRC, size); fully equal rows share the places that are theirs in any order; an empty table gives no rows;
extra columns are ignored by the query and kept by `shard`, those named row_number, shard or slot as input_row_number and
so on; texts of any length count whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketloom.llm.common import documents, out_of_the_way, row_numbers, stash

ROUNDS = 6
#: Steps of the inlined walk. A step is needed with probability under 1 / sqrt(n); a row that needs more fails loudly.
WALK = 64


def grid(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n and a * b - n < a."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def feistel(x: Column, n: int, seed: int) -> Column:
    """One application on 0..a*b-1. Even rounds move the first coordinate by a hash of the second, odd ones the reverse."""
    a, b = grid(n)
    left = x % F.lit(a).cast("long")
    right = F.floor((x - left) / F.lit(a)).cast("long")
    for r in range(ROUNDS):
        if r % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed).cast("long"), F.lit(r), right), F.lit(a).cast("long")), F.lit(a).cast("long"))
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed).cast("long"), F.lit(r), left), F.lit(b).cast("long")), F.lit(b).cast("long"))
    return right * F.lit(a).cast("long") + left


def permuted(x: Column, n: int, seed: int) -> Column:
    """The permutation of 0..n-1."""
    a, b = grid(n)
    once, limit = feistel(x, n, seed), F.lit(n).cast("long")
    steps = min(a * b - n, WALK)
    if steps == 0:
        return once
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), once, lambda y, _: F.when(y < limit, y).otherwise(feistel(y, n, seed)))
    return F.when(once < limit, once).when(walked < limit, walked).otherwise(F.raise_error(F.lit("cycle walk too long: choose another seed")))


def shard(rows: DataFrame, keys: list[str], n_shards: int, seed: int = 20_24) -> DataFrame:
    """rows with row_number, shard and slot. keys give the reproducible order; they should tell rows apart."""
    moved = out_of_the_way(rows, ["row_number", "shard", "slot"])
    keys = [moved.columns[rows.columns.index(k)] for k in keys]
    numbered, n = row_numbers(moved, keys, "row_number")
    return (
        numbered.withColumn("__bl_p", permuted(F.col("row_number"), n, seed))
        .withColumn("shard", (F.col("__bl_p") % n_shards).cast("int"))
        .withColumn("slot", F.floor(F.col("__bl_p") / n_shards).cast("long"))
        .drop("__bl_p")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    narrow = documents(spark, sf_dir).select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = shard(stash(narrow, "sizes"), ["doc_id", "text_crc32", "size"], 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
