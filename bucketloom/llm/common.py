"""What the training-data operators share: inputs, shared-folder tables, ranks, filters."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A block of Spark's bitmap functions covers this many positions (4 KiB).
BITMAP_BLOCK = 32768


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor reaches. A local master does without: its executor has
    the driver's disk, so a fresh local folder serves."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="bucketloom-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


#: Rows of a few numbers that one task writes.
ROWS_A_FILE = 200_000
#: Documents that one task reads where it writes little for each, or nothing but their texts.
TEXTS_A_TASK = 50_000

#: Hadoop's local file system without checksum files beside the tables. Without its native library Hadoop starts a
#: process for each mode that it sets, some for a file, its checksum file and its folder; until such a process runs its
#: program it has all of the executor's memory a second time. Parquet's own checksums of pages are verified instead.
#: A file system of another scheme does not look at this.
PLAIN_LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
VERIFIED = {"parquet.page.verify-checksum.enabled": "true"}


def stash(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), rows: int | None = None, a_file: int = ROWS_A_FILE) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, runs once.

    rows: a bound of df's rows, if one is known; there is then a task, and so a file, for each core or each a_file of
    them, whichever are more, where a small table would else become a file for each shuffle partition."""
    spark = df.sparkSession
    df = df if rows is None else df.coalesce(max(spark.sparkContext.defaultParallelism, math.ceil(rows / a_file)))
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    local = {} if spark._jsc.hadoopConfiguration().get("fs.file.impl") else PLAIN_LOCAL  # one that the caller named stays
    df.write.options(compression="zstd", **local, **{"parquet.page.write-checksum.enabled": "true"}).partitionBy(*partition_by).parquet(path)
    return spark.read.options(**VERIFIED).schema(df.schema).parquet(path)


def drop_stashes(spark: SparkSession) -> None:
    """Delete all stashed tables of this application; results that still read them must be written first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z, every other character as it is; pure-ASCII rows take the byte-wise fast path."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def checked_broadcast(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """df under a broadcast hint if it has max_rows rows or fewer (measured), else df as it is."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if small else df), small


def out_of_the_way(df: DataFrame, names: list[str]) -> DataFrame:
    """df whose columns of these names, which an operator gives to its own, are called input_<name> instead."""
    taken = {c.lower() for c in (*df.columns, *names)}
    out = []
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            new = f"input_{c}"
            while new.lower() in taken:
                new = f"input_{new}"
            taken.add(new.lower())
            out.append(new)
        else:
            out.append(c)
    return df.toDF(*out)


#: Tables of so many narrow rows at most are broadcast (some 30 MB); their rows are counted first.
BROADCAST_ROWS = 500_000
#: Rows that one task numbers, within these bounds a 256th of all.
LEAST_NUMBERED, MOST_NUMBERED = 2_000, 1_000_000


def a_bucket(total: int) -> int:
    """How many rows a numbering bucket holds on average."""
    return min(MOST_NUMBERED, max(LEAST_NUMBERED, total // 256))


def row_numbers(df: DataFrame, keys: list[str], out: str) -> tuple[DataFrame, int]:
    """Gapless global row numbers from 0 and the number of rows.

    The order is (hash bucket of the keys, keys), so it depends on the rows alone, never on partitions. The number of
    buckets follows the rows, each is numbered by itself and shifted by the counts before it, which stay in a table."""
    total = df.count()
    numbered = group_ranks(df.withColumn("__bl_one", F.lit(0)), "__bl_one", keys, out, total)
    return numbered.drop("__bl_one"), total


def group_ranks(df: DataFrame, group: str, keys: list[str], out: str, total: int | None = None) -> DataFrame:
    """Gapless ranks from 0 inside each group, in the order (hash bucket of the keys, keys). A group has a bucket for
    each `a_bucket` of its rows, so a hot group is numbered by many tasks."""
    total = df.count() if total is None else total
    sizes = stash(df.groupBy(F.col(group).alias("__bl_g")).agg(F.ceil(F.count(F.lit(1)) / a_bucket(total)).cast("int").alias("__bl_buckets")), "group-sizes")
    many = sizes.where("__bl_buckets > 1")  # a 256th of all rows or more each, or of LEAST_NUMBERED rows: a bounded table
    t = df.join(F.broadcast(many), F.col(group).eqNullSafe(F.col("__bl_g")), "left").drop("__bl_g")
    t = t.withColumn("__bl_bucket", F.pmod(F.xxhash64(*keys), F.coalesce("__bl_buckets", F.lit(1))).cast("int")).drop("__bl_buckets")
    counts = t.groupBy(F.col(group).alias("__bl_group"), F.col("__bl_bucket").alias("__bl_b")).agg(F.count(F.lit(1)).alias("__bl_n"))
    before = Window.partitionBy("__bl_group").orderBy("__bl_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__bl_start", F.coalesce(F.sum("__bl_n").over(before), F.lit(0))).where("__bl_b > 0").drop("__bl_n")
    starts, _ = checked_broadcast(stash(starts, "starts"), BROADCAST_ROWS)
    w = Window.partitionBy(group, "__bl_bucket").orderBy(*keys)
    ranked = t.withColumn("__bl_rank", F.row_number().over(w)).join(starts, F.col(group).eqNullSafe(F.col("__bl_group")) & (F.col("__bl_bucket") == F.col("__bl_b")), "left")
    return ranked.withColumn(out, F.coalesce("__bl_start", F.lit(0)) + F.col("__bl_rank") - 1).drop("__bl_bucket", "__bl_rank", "__bl_group", "__bl_b", "__bl_start")


def bit_position(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(1 << bits))


def bitmap_of(df: DataFrame, key: Column, bits: int) -> DataFrame:
    """A Bloom-like filter with one hash: blocks (block, bitmap) of 4 KiB, at most 2**bits / 32768 rows whatever df holds."""
    pos = bit_position(key, bits)
    at = df.select(F.floor(pos / BITMAP_BLOCK).cast("long").alias("block"), (pos % BITMAP_BLOCK).alias("bit"))
    return at.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def _bit_is_set(key: Column, bits: int) -> Column:
    bit = bit_position(key, bits) % BITMAP_BLOCK
    byte = F.conv(F.hex(F.substring("__bl_bitmap", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.get(F.lit([1 << i for i in range(8)]), (bit % 8).cast("int"))) != 0


def _with_blocks(df: DataFrame, key: Column, blocks: DataFrame, bits: int, how: str) -> DataFrame:
    """The broadcast has a fixed bound: 2**bits bits."""
    held = blocks.select(F.col("block").alias("__bl_block"), F.col("bitmap").alias("__bl_bitmap"))
    return df.join(F.broadcast(held), F.floor(bit_position(key, bits) / BITMAP_BLOCK).cast("long") == F.col("__bl_block"), how)


def may_hold(df: DataFrame, key: Column, blocks: DataFrame, bits: int) -> DataFrame:
    """Rows of df whose key may be in the filter (false positives only)."""
    return _with_blocks(df, key, blocks, bits, "inner").where(_bit_is_set(key, bits)).drop("__bl_block", "__bl_bitmap")


#: Bits of the largest filter that is broadcast (16 MB); beyond it rows go to the join unfiltered.
MOST_BITS = 27


def filter_bits(n: int) -> int | None:
    """Bits of a filter for n keys, 32 or more a key; None if it would let most keys pass."""
    bits = max(16, (max(1, n) * 32 - 1).bit_length())
    return bits if bits <= MOST_BITS else MOST_BITS if n < 1 << (MOST_BITS - 1) else None


def filtered(df: DataFrame, key: Column, listed: DataFrame, listed_key: Column, n: int) -> DataFrame:
    """Rows of df whose key may be among the n keys of listed."""
    bits = filter_bits(n)
    return df if bits is None else may_hold(df, key, bitmap_of(listed, listed_key, bits), bits)


def lookup(df: DataFrame, key: str, listed: DataFrame, listed_key: str, n: int, spread: str) -> DataFrame:
    """Inner join of df with listed, which has n rows, one a key. A list of BROADCAST_ROWS or fewer is broadcast and df
    stays where it is; with a longer one df is filtered first, and hot keys are salted by `spread`."""
    if n <= BROADCAST_ROWS:
        return df.join(F.broadcast(listed), F.col(key) == F.col(listed_key))
    return skew_join(filtered(df, F.col(key), listed, F.col(listed_key), n), key, spread, listed, listed_key)


def equal_columns(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])


def flagged(rows: DataFrame, listed: DataFrame, listed_on: list[str], rows_on: list[str], listed_key: Column, rows_key: Column) -> DataFrame:
    """rows with __bl_listed: whether their columns are in listed (null-safe), which has a row a key. A short list is
    broadcast; with a long one only the rows that pass its filter are shuffled, all others go straight through."""
    names = [f"__bl_l{i}" for i in range(len(listed_on))]
    n = listed.count()
    found = listed.select(*[F.col(c).alias(x) for c, x in zip(listed_on, names, strict=True)], F.lit(True).alias("__bl_found"))
    same = equal_columns(rows_on, names)
    told = lambda t: t.withColumn("__bl_listed", F.col("__bl_found").isNotNull()).drop("__bl_found", *names)
    if n <= BROADCAST_ROWS:
        return told(rows.join(F.broadcast(found), same, "left"))
    bits = filter_bits(n)
    if bits is None:
        return told(rows.join(found, same, "left"))
    blocks = stash(bitmap_of(listed, listed_key, bits), "filter")
    marked = _with_blocks(rows, rows_key, blocks, bits, "left").withColumn("__bl_maybe", F.coalesce(_bit_is_set(rows_key, bits), F.lit(False))).drop("__bl_block", "__bl_bitmap")
    through = marked.where(~F.col("__bl_maybe")).drop("__bl_maybe").withColumn("__bl_listed", F.lit(False))
    return through.unionByName(told(marked.where(F.col("__bl_maybe")).drop("__bl_maybe").join(found, same, "left")))


def drop_listed(rows: DataFrame, listed: DataFrame, listed_on: list[str], rows_on: list[str], listed_key: Column, rows_key: Column) -> DataFrame:
    """rows that are not listed (null-safe)."""
    return flagged(rows, listed, listed_on, rows_on, listed_key, rows_key).where(~F.col("__bl_listed")).drop("__bl_listed")


def one_of_listed(rows: DataFrame, listed: DataFrame, listed_on: list[str], rows_on: list[str], listed_key: Column, rows_key: Column) -> DataFrame:
    """rows, of which those that are listed are brought down to one for each of their keys; map tasks do most of it."""
    marked = flagged(rows, listed, listed_on, rows_on, listed_key, rows_key)
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    once = marked.where(F.col("__bl_listed")).groupBy(*[F.col(c).alias(f"__bl_k{i}") for i, c in enumerate(rows_on)]).agg(F.first(whole).alias("__bl_row")).select("__bl_row.*")
    return marked.where(~F.col("__bl_listed")).drop("__bl_listed").unionByName(once)


#: A key with fewer rows than this is nobody's burden.
LIGHT = 500


def skew_join(left: DataFrame, on: str, spread: str, right: DataFrame, right_on: str, sized: DataFrame | None = None) -> DataFrame:
    """Inner join of left with right, which has one row a key. Keys with more than a thousandth of left's rows (fewer
    than a thousand keys), if LIGHT rows or more, are spread over as many salts as they hold thousandths, and right's
    rows for them repeated. sized: a table with left's keys that is cheaper to count."""
    by_key = (sized if sized is not None else left).groupBy(F.col(on).alias("__bl_key")).agg(F.count(F.lit(1)).alias("__bl_n"))
    most, total = by_key.agg(F.max("__bl_n"), F.sum("__bl_n")).first()
    if most is None or most < LIGHT or most * 1000 <= total:
        return left.join(right, F.col(on) == F.col(right_on))
    heavy = by_key.where((F.col("__bl_n") * 1000 > total) & (F.col("__bl_n") >= LIGHT))
    heavy = F.broadcast(stash(heavy.select("__bl_key", F.ceil(F.col("__bl_n") * 1000 / F.lit(total)).cast("int").alias("__bl_salts")), "heavy", rows=1000))
    salts = F.coalesce("__bl_salts", F.lit(1))
    a = left.join(heavy, F.col(on) == F.col("__bl_key"), "left").withColumn("__bl_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("__bl_key", "__bl_salts")
    b = right.join(heavy, F.col(right_on) == F.col("__bl_key"), "left").withColumn("__bl_salt_r", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__bl_key", "__bl_salts")
    return a.join(b, (F.col(on) == F.col(right_on)) & (F.col("__bl_salt") == F.col("__bl_salt_r"))).drop("__bl_salt", "__bl_salt_r")


def _pointed(df: DataFrame, on: str, spread: str, pointers: DataFrame, n: int, sized: DataFrame | None = None) -> DataFrame:
    """df with the root (p_root) of its column `on` among n pointers."""
    to = pointers.select(F.col("node").alias("p_node"), F.col("root").alias("p_root"))
    if n <= BROADCAST_ROWS:
        return df.join(F.broadcast(to), F.col(on) == F.col("p_node")).drop("p_node")
    return skew_join(df, on, spread, to, "p_node", sized).drop("p_node")


def components(links: DataFrame, n_links: int | None = None) -> DataFrame:
    """(node, root) for every node of links (a, b), root the smallest node of its component. n_links: a bound of their number, if known.

    Each turn points every node at its smallest neighbour's smallest neighbour and contracts the links to those ends,
    so stars vanish in one turn and chains shrink to a third at least. The smallest node of a component always points
    at itself, so it is the one that is left. Everything stays in tables; the driver sees counts only.
    """
    edges = stash(links.select("a", "b").where("a <> b").distinct(), "edges", rows=n_links)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    first, most = True, 0
    while n := edges.count():
        most = most or 2 * n
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "pointers", rows=2 * n)
        up = stash(_pointed(up, "root", "node", up, 2 * n).select("node", F.col("p_root").alias("root")), "pointers", rows=2 * n)
        if first:
            roots, first = up, False
        else:
            moved = roots.join(F.broadcast(up.select(F.col("node").alias("p_node"), F.col("root").alias("p_root"))), F.col("root") == F.col("p_node"), "left") if 2 * n <= BROADCAST_ROWS else None
            if moved is not None:
                moved = moved.select("node", F.coalesce("p_root", "root").alias("root"))
            else:
                known = up.select(F.col("node").alias("k"))
                moved = _pointed(roots, "root", "node", up, 2 * n).select("node", F.col("p_root").alias("root")).unionByName(roots.join(known, F.col("root") == F.col("k"), "left_anti"))
            roots = stash(moved, "roots", rows=most)
        one = _pointed(edges, "a", "b", up, 2 * n).select(F.col("p_root").alias("a"), "b")
        two = _pointed(one, "b", "a", up, 2 * n, sized=edges).select("a", F.col("p_root").alias("b"))
        edges = stash(two.where("a <> b").distinct(), "edges", rows=n)
    return roots


#: Bytes of rows in a batch that a Python worker gets.
BATCH_BYTES = "4m"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Texts and sets can be long, so what runs here gives rows that carry them to Python in batches of BATCH_BYTES: the
    executor and the worker hold a batch or two each."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release_memory() -> None:
    """Give freed memory back to the system: Spark keeps Python workers, so what one task freed would count in the next."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
