"""Queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from bucketloom.functions import records
from bucketloom.functions.hashing import bucket_id, bucket_of, encode_key, hash32, hash_bytes, hash_typed, unsigned_key
from bucketloom.functions.sizes import bucket_count, record_size
from bucketloom.operators import joins, sharding, sizing
from bucketloom.operators.bucketing import keyed, write_by_size, write_by_threshold, write_fixed
from bucketloom.sources import avro, datagen, schemas, workers
from bucketloom.sources.layout import file_name, files, parsed_names, read_directory, read_header
from bucketloom.sources.pairs import join_pairs
from bucketloom.sources.workspace import fresh_path
from bucketloom.streaming.append import append_buckets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")


def sized_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")


JOINED = ["l_orderkey", "l_linenumber", "l_quantity", "o_orderpriority"]
JOIN_SQL = "SELECT l_orderkey, l_linenumber, l_quantity, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
MUL = "(((({a}) & 65535) * {k} + ((((({a}) >> 16) * {k}) & 65535) << 16)) & 4294967295)"
ROT = "(((({a}) << {n}) | (({a}) >> (32 - {n}))) & 4294967295)"


def murmur_sql(source: str, key: str, columns: str) -> str:
    """A CTE chain ending in `hashed`: columns and h, the signed hash of the 32-bit key."""
    mul = lambda a, k: MUL.format(a=a, k=f"{k}::BIGINT")
    rot = lambda a, n: ROT.format(a=a, n=n)
    return f"""WITH m0 AS (SELECT {columns}, {key}::BIGINT & 4294967295 AS x FROM {source}),
m1 AS (SELECT *, (x >> 24) | ((x >> 8) & 65280) | ((x << 8) & 16711680) | ((x << 24) & 4278190080) AS s FROM m0),
m2 AS (SELECT *, {mul('s', 3432918353)} AS k1 FROM m1),
m3 AS (SELECT *, {rot('k1', 15)} AS k2 FROM m2),
m4 AS (SELECT *, {mul('k2', 461845907)} AS k3 FROM m3),
m5 AS (SELECT *, xor(({rot('k3', 13)} * 5 + 3864292196) & 4294967295, 4) AS h0 FROM m4),
m6 AS (SELECT *, xor(h0, h0 >> 16) AS h1 FROM m5),
m7 AS (SELECT *, {mul('h1', 2246822507)} AS h2 FROM m6),
m8 AS (SELECT *, xor(h2, h2 >> 13) AS h3 FROM m7),
m9 AS (SELECT *, {mul('h3', 3266489909)} AS h4 FROM m8),
hashed AS (SELECT {columns}, CASE WHEN xor(h4, h4 >> 16) >= 2147483648 THEN xor(h4, h4 >> 16) - 4294967296 ELSE xor(h4, h4 >> 16) END AS h FROM m9)
"""


def floor_mod(a: str, n: int) -> str:
    return f"((({a}) % {n} + {n}) % {n})"


def varint_sql(v: str) -> str:
    z = f"xor(({v})::BIGINT << 1, ({v})::BIGINT >> 63)"
    return "(1 + " + " + ".join(f"({z} >= {1 << (7 * k)})::BIGINT" for k in range(1, 9)) + ")"


def text_size_sql(c: str) -> str:
    return f"({varint_sql(f'octet_length(encode({c}))')} + octet_length(encode({c})))"


EVENT_SIZE = f"({varint_sql('event_id')} + {varint_sql('user_id')} + {text_size_sql('event_type')} + 8 + {text_size_sql('props')})"
TARGET = 100_000


def flagship(spark, sf_dir):
    j = joins.bucketed_join(lineitem(spark, sf_dir), orders(spark, sf_dir), "l_orderkey", "o_orderkey", 8)
    return j.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").cast("bigint").alias("quantity"))


query("flagship", "SELECT o_orderpriority, count(*) AS n_lines, sum(l_quantity)::BIGINT AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")(flagship)


@query("join_inner_plain", JOIN_SQL)
def _(spark, sf_dir):
    return joins.plain_join(lineitem(spark, sf_dir), orders(spark, sf_dir), "l_orderkey", "o_orderkey").select(*JOINED)


@query("smb_join_fixed", JOIN_SQL)
def _(spark, sf_dir):
    return joins.bucketed_join(lineitem(spark, sf_dir), orders(spark, sf_dir), "l_orderkey", "o_orderkey", 8).select(*JOINED)


@query("smb_join_coalesced", JOIN_SQL)
def _(spark, sf_dir):
    return joins.bucketed_join(lineitem(spark, sf_dir), orders(spark, sf_dir), "l_orderkey", "o_orderkey", 8, 4).select(*JOINED)


@query("smb_join_gcd", JOIN_SQL)
def _(spark, sf_dir):
    return joins.congruent_join(spark, write_fixed(lineitem(spark, sf_dir), "l_orderkey", 6), write_fixed(orders(spark, sf_dir), "o_orderkey", 4)).select(*JOINED)


@query("smb_join_skewadj", JOIN_SQL)
def _(spark, sf_dir):
    a, b = write_by_size(lineitem(spark, sf_dir), "l_orderkey", 1), write_by_size(orders(spark, sf_dir), "o_orderkey", 0.25)
    return joins.congruent_join(spark, a, b).select(*JOINED)


@query("smb_join_auto", JOIN_SQL)
def _(spark, sf_dir):
    a, b = write_by_threshold(lineitem(spark, sf_dir), "l_orderkey", 0.01, 1), write_by_threshold(orders(spark, sf_dir), "o_orderkey", 0.05, 0.25)
    return joins.congruent_join(spark, a, b).select(*JOINED)


@query("smb_join_pairs", JOIN_SQL)
def _(spark, sf_dir):
    return join_pairs(spark, write_fixed(lineitem(spark, sf_dir), "l_orderkey", 6), write_fixed(orders(spark, sf_dir), "o_orderkey", 4)).select(*JOINED)


@query("smb_join_events_customer", "SELECT event_id, user_id, c_name FROM events JOIN customer ON user_id = c_custkey")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return joins.bucketed_join(e, c, "user_id", "c_custkey", 4).select("event_id", "user_id", "c_name")


@query(
    "smb_cogroup",
    "SELECT coalesce(l_orderkey, o_orderkey) AS key, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right FROM (SELECT l_orderkey, count(*) AS n_left FROM lineitem GROUP BY 1) "
    "FULL JOIN (SELECT o_orderkey, count(*) AS n_right FROM orders GROUP BY 1) ON l_orderkey = o_orderkey",
)
def _(spark, sf_dir):
    n = lambda name: [F.count(F.lit(1)).alias(name)]
    c = joins.cogroup(lineitem(spark, sf_dir), orders(spark, sf_dir), "l_orderkey", "o_orderkey", n("n_left"), n("n_right"))
    return c.select("key", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))


def outer(how: str, columns: list[str]):
    return lambda spark, sf_dir: joins.bucketed_join(orders(spark, sf_dir), lineitem(spark, sf_dir), "o_orderkey", "l_orderkey", 8, how=how).select(*columns)


query("smb_left_outer", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")(outer("left", ["o_orderkey", "l_linenumber"]))
query("smb_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")(outer("left_semi", ["o_orderkey"]))
query("smb_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")(outer("left_anti", ["o_orderkey"]))


def assigned(n: int):
    return lambda spark, sf_dir: orders(spark, sf_dir).select("o_orderkey", hash32(F.col("o_orderkey")).alias("h"), bucket_id(F.col("o_orderkey"), n).alias("bucket_id"))


for _name, _n in (("bucket_assign", 8), ("bucket_assign_nonpow2", 6)):
    query(_name, murmur_sql("orders", "o_orderkey", "o_orderkey") + f"SELECT o_orderkey, h::INTEGER AS h, {floor_mod('h', _n)}::INTEGER AS bucket_id FROM hashed")(assigned(_n))


@query("bucket_histogram", murmur_sql("lineitem", "l_orderkey", "l_orderkey") + f"SELECT {floor_mod('h', 8)}::INTEGER AS bucket_id, count(*) AS n FROM hashed GROUP BY 1")
def _(spark, sf_dir):
    return lineitem(spark, sf_dir).groupBy(bucket_id(F.col("l_orderkey"), 8).alias("bucket_id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@query("record_sizes", f"SELECT event_id, ({EVENT_SIZE} + 88)::BIGINT AS bytes FROM events")
def _(spark, sf_dir):
    e = sized_events(spark, sf_dir)
    return e.select("event_id", record_size(e.schema, 88).alias("bytes"))


COUNT_SQL = f"(SELECT 1::BIGINT << ceil(log2(1 + sum({EVENT_SIZE} + 104)::BIGINT // {TARGET}))::INTEGER FROM events)"


@query("num_buckets", f"SELECT sum({EVENT_SIZE} + 104)::BIGINT AS bytes, {COUNT_SQL}::INTEGER AS num_buckets FROM events")
def _(spark, sf_dir):
    e = sized_events(spark, sf_dir)
    total = e.agg(F.coalesce(F.sum(record_size(e.schema, 104)), F.lit(0)).cast("bigint").alias("bytes")).first()["bytes"]
    return spark.createDataFrame([(total, bucket_count(total, TARGET))], "bytes bigint, num_buckets int")


SIZES_SQL = murmur_sql("events", "user_id", "event_id, user_id, event_type, value, props")


@query("bucket_bytes", SIZES_SQL + f"SELECT {floor_mod('h', 16)}::INTEGER AS bucket_id, sum({EVENT_SIZE} + 104)::BIGINT AS bytes FROM hashed GROUP BY 1")
def _(spark, sf_dir):
    e = sized_events(spark, sf_dir)
    return sizing.bucket_bytes(e, bucket_id(F.col("user_id"), 16), record_size(e.schema, 104))


@query(
    "shards_by_size",
    SIZES_SQL + f", b AS (SELECT {floor_mod('h', 16)} AS bucket, sum({EVENT_SIZE} + 104)::BIGINT AS bytes FROM hashed GROUP BY 1) "
    f"SELECT i::INTEGER AS bucket_id, (1 + coalesce(bytes, 0) // {TARGET})::INTEGER AS shards FROM range(16) r(i) LEFT JOIN b ON i = bucket",
)
def _(spark, sf_dir):
    e = sized_events(spark, sf_dir)
    return sizing.shards_by_size(e, bucket_id(F.col("user_id"), 16), record_size(e.schema, 104), 16, TARGET)


EPS_SQL = (
    "WITH RECURSIVE " + murmur_sql("events", "user_id", "event_id").removeprefix("WITH ") + f""", c AS (SELECT {floor_mod('h', 16)} AS bucket, count(*) AS n FROM hashed GROUP BY 1),
every AS (SELECT i AS bucket, coalesce(n, 0) AS n FROM range(16) r(i) LEFT JOIN c ON i = bucket),
start AS (SELECT list(n ORDER BY bucket) AS n, list(1::BIGINT ORDER BY bucket) AS s, sum(n)::BIGINT AS total FROM every),
turn AS (
  SELECT n, s, total, true AS more FROM start
  UNION ALL
  SELECT n, t, total, t <> s FROM (
    SELECT n, s, total, [s[i] + (CASE WHEN n[i] / s[i] > greatest(1, floor(1.1::DOUBLE * total / list_sum(s))) AND s[i] < n[i] THEN 1 ELSE 0 END) FOR i IN range(1, 17)] AS t FROM turn WHERE more)
)
SELECT (i - 1)::INTEGER AS bucket_id, s[i]::INTEGER AS shards FROM turn, range(1, 17) r(i) WHERE NOT more"""
)


@query("shards_by_eps", EPS_SQL)
def _(spark, sf_dir):
    counts = {r[0]: r[1] for r in table(spark, sf_dir, "events").groupBy(bucket_id(F.col("user_id"), 16)).count().collect()}
    return spark.createDataFrame(list(enumerate(sizing.shards_by_eps(counts, 16, 0.1))), "bucket_id int, shards int")


@query(
    "shard_round_robin",
    murmur_sql("events", "user_id", "event_id, user_id") + f", b AS (SELECT event_id, user_id, {floor_mod('h', 8)}::INTEGER AS bucket_id FROM hashed) "
    "SELECT event_id, bucket_id, ((row_number() OVER (PARTITION BY bucket_id ORDER BY user_id, event_id) - 1) % 3)::INTEGER AS shard_id FROM b",
)
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", bucket_id(F.col("user_id"), 8).alias("bucket_id"))
    return e.select("event_id", "bucket_id", sharding.round_robin("bucket_id", F.lit(3), "user_id", "event_id").alias("shard_id"))


@query("resolve_bucketing", "SELECT l.i::INTEGER AS l_bucket, 0 AS l_shard, r.i::INTEGER AS r_bucket, 0 AS r_shard FROM range(6) l(i), range(4) r(i) WHERE l.i % 2 = r.i % 2")
def _(spark, sf_dir):
    a, b = write_fixed(lineitem(spark, sf_dir), "l_orderkey", 6), write_fixed(orders(spark, sf_dir), "o_orderkey", 4)
    return joins.resolve_bucketing(files(spark, a), files(spark, b), a.num_buckets, b.num_buckets)


@query("sorted_within_bucket", "SELECT 0::BIGINT AS violations")
def _(spark, sf_dir):
    m = write_fixed(lineitem(spark, sf_dir), "l_orderkey", 8)
    return joins.unsorted_rows(read_directory(spark, m), "l_orderkey").agg(F.coalesce(F.sum("violations"), F.lit(0)).alias("violations"))


@query(
    "unsigned_key_order",
    "WITH k AS (SELECT CASE WHEN o_orderkey % 2 = 1 THEN -o_orderkey ELSE o_orderkey END AS key FROM orders) SELECT key, key & 4294967295 AS unsigned_key, printf('%08X', (key & 4294967295)::BIGINT) AS encoded FROM k",
)
def _(spark, sf_dir):
    key = F.when(F.col("o_orderkey") % 2 == 1, -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    k = orders(spark, sf_dir).select(key.alias("key"))
    return k.select("key", unsigned_key(F.col("key")).alias("unsigned_key"), F.hex(encode_key(F.col("key"))).alias("encoded")).orderBy(encode_key(F.col("key")))


@query(
    "partition_n_over_k",
    "SELECT i::INTEGER AS part, (1003 // 7 + (i < 1003 % 7)::INTEGER)::INTEGER AS even, (floor(1000 * (i + 1) / 28.0) + (i < 1000 - (SELECT sum(floor(1000 * (j + 1) / 28.0)) FROM range(7) q(j)))::INTEGER)::INTEGER AS weighted FROM range(7) r(i)",
)
def _(spark, sf_dir):
    rows = list(zip(range(7), datagen.partition_n_over_k(1003, 7), datagen.partition_n_over_k(1000, 7, [1, 2, 3, 4, 5, 6, 7]), strict=True))
    return spark.createDataFrame(rows, "part int, even int, weighted int")


ZIPF_SQL = "WITH h AS (SELECT sum(1.0::DOUBLE / (i + 1)) AS h FROM range(100) r(i)) SELECT i AS rank, floor(100000.0::DOUBLE / (i + 1) / h / 4 + 0.5)::BIGINT AS adj FROM range(100) r(i), h"


@query("zipf_frequencies", ZIPF_SQL)
def _(spark, sf_dir):
    return datagen.zipf_frequencies(spark, 1e5, 100, 1.0, 4)


@query("gen_keys", "SELECT i::INTEGER AS id FROM range(15000) r(i)")
def _(spark, sf_dir):
    return datagen.keys(spark, 12_345).select("id")


@query("gen_events_counts", f"SELECT rank, (4 * adj)::BIGINT AS n FROM ({ZIPF_SQL})")
def _(spark, sf_dir):
    e = datagen.events(spark, 1e5, 10_000, 100, 1.0, 4)
    return e.groupBy(F.floor(F.col("id") / 100).cast("bigint").alias("rank")).agg(F.count(F.lit(1)).alias("n"))


@query("hex_keys", "SELECT i AS bucket, printf('%08x', ((i + 16 * 12345) % 2147483648)::BIGINT) AS id, i AS parsed FROM range(16) r(i)")
def _(spark, sf_dir):
    t = spark.range(16).select(F.col("id").alias("bucket"), datagen.hex_key(F.col("id"), 16, F.lit(12345).cast("bigint")).alias("id"))
    return t.withColumn("parsed", F.pmod(F.conv("id", 16, 10).cast("bigint"), F.lit(16).cast("bigint")))


@query("file_names", "SELECT b.i::INTEGER AS bucket_id, s.i::INTEGER AS shard_id, printf('part-b%05d-s%05d.avro', b.i, s.i) AS name FROM range(4) b(i), range(3) s(i)")
def _(spark, sf_dir):
    return spark.createDataFrame([(b, s, file_name(b, s, "avro")) for b in range(4) for s in range(3)], "bucket_id int, shard_id int, name string")


@query("reshuffle_identity", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type").repartition(16).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("flatten", "SELECT l_orderkey, l_linenumber FROM lineitem")
def _(spark, sf_dir):
    grouped = lineitem(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("lines"))
    return grouped.select("l_orderkey", F.explode("lines").alias("l_linenumber"))


@query("zipf_top", "SELECT i AS rank, floor(6000000000.0::DOUBLE / (i + 1) / (SELECT sum(1.0::DOUBLE / (j + 1)) FROM range(100000) q(j)) + 0.5)::BIGINT AS adj FROM range(8) r(i)")
def _(spark, sf_dir):
    return datagen.zipf_frequencies(spark, 6e9, 100_000, 1.0).orderBy("rank").limit(8)


@query("write_by_size_counts", "SELECT count(*) AS n FROM lineitem")
def _(spark, sf_dir):
    return read_directory(spark, write_by_size(lineitem(spark, sf_dir), "l_orderkey", 1)).agg(F.count(F.lit(1)).alias("n"))


# joins of layouts by other keys than 32-bit numbers

WIDE_SQL = (
    "WITH l AS (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey + 4294967296 * (l_linenumber % 3) END AS k, l_orderkey, l_linenumber FROM lineitem), "
    "o AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderkey + 4294967296 * (o_orderkey % 2) END AS j, o_orderkey FROM orders) SELECT k, l_linenumber, o_orderkey FROM l JOIN o ON k = j"
)


@query("smb_join_wide_keys", WIDE_SQL)
def _(spark, sf_dir):
    """Keys beyond 32 bits that agree in the low ones, and nulls on both sides."""
    big = F.lit(1 << 32)
    a = lineitem(spark, sf_dir).select(F.when(F.col("l_linenumber") != 7, F.col("l_orderkey") + big * (F.col("l_linenumber") % 3)).alias("k"), "l_linenumber")
    b = orders(spark, sf_dir).select(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderkey") + big * (F.col("o_orderkey") % 2)).alias("j"), "o_orderkey")
    return join_pairs(spark, write_fixed(a, "k", 6), write_fixed(b, "j", 4)).select("k", "l_linenumber", "o_orderkey")


@query("smb_join_text_keys", "SELECT 'é' || l_orderkey AS k, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(spark, sf_dir):
    a = lineitem(spark, sf_dir).select(F.concat(F.lit("é"), F.col("l_orderkey").cast("string")).alias("k"), "l_linenumber")
    b = orders(spark, sf_dir).select(F.concat(F.lit("é"), F.col("o_orderkey").cast("string")).alias("j"), "o_orderpriority")
    return join_pairs(spark, write_fixed(a, "k", 5), write_fixed(b, "j", 3)).select("k", "l_linenumber", "o_orderpriority")


@query(
    "smb_join_composite_keys",
    "SELECT a.event_id, a.user_id, a.event_type, n FROM events a JOIN (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.event_type = b.event_type",
)
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    n = e.where("event_id % 3 = 0").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return join_pairs(spark, write_fixed(e, ["user_id", "event_type"], 4), write_fixed(n, ["user_id", "event_type"], 6)).select("event_id", "user_id", "event_type", "n")


@query("smb_join_expression_key", "SELECT l_orderkey * 2 + 1 AS join_key, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey * 2 + 1 = o_orderkey")
def _(spark, sf_dir):
    a = keyed(lineitem(spark, sf_dir), F.col("l_orderkey") * 2 + 1)
    return join_pairs(spark, write_fixed(a, "join_key", 4), write_fixed(orders(spark, sf_dir), "o_orderkey", 2)).select("join_key", "l_linenumber", "o_orderpriority")


@query("smb_join_custom_hash", JOIN_SQL)
def _(spark, sf_dir):
    a, b = (write_fixed(t(spark, sf_dir), k, n, hasher="identity") for t, k, n in ((lineitem, "l_orderkey", 6), (orders, "o_orderkey", 9)))
    return join_pairs(spark, a, b).select(*JOINED)


@query("bucket_custom_hash", "SELECT o_orderkey, (o_orderkey % 7)::INTEGER AS bucket_id FROM orders")
def _(spark, sf_dir):
    o = orders(spark, sf_dir)
    return o.select("o_orderkey", bucket_of(o.schema, ["o_orderkey"], 7, "identity").alias("bucket_id"))


LONG_HASH_SQL = """WITH t AS (SELECT o_orderkey, printf('%016x', o_orderkey::BIGINT) AS x FROM orders),
b AS (SELECT o_orderkey, [('0x' || substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2))::BIGINT, ('0x' || substr(x, 15, 2) || substr(x, 13, 2) || substr(x, 11, 2) || substr(x, 9, 2))::BIGINT] AS k FROM t),
"""


def block_sql(h: str, k: str) -> tuple[str, str, str]:
    """The steps of one block: the number before, after the first product, and the new state."""
    mul = lambda a, m: MUL.format(a=a, k=f"{m}::BIGINT")
    rot = lambda a, n: ROT.format(a=a, n=n)
    return mul(k, 3432918353), mul(rot("p", 15), 461845907), f"(({rot(f'xor({h}, q)', 13)} * 5 + 3864292196) & 4294967295)"


def long_hash_sql() -> str:
    mul = lambda a, m: MUL.format(a=a, k=f"{m}::BIGINT")
    one, two = block_sql("0::BIGINT", "k[1]"), block_sql("h", "k[2]")
    return LONG_HASH_SQL + f"""a1 AS (SELECT *, {one[0]} AS p FROM b), a2 AS (SELECT * EXCLUDE (p), {one[1]} AS q FROM a1), a3 AS (SELECT o_orderkey, k, {one[2]} AS h FROM a2),
c1 AS (SELECT *, {two[0]} AS p FROM a3), c2 AS (SELECT * EXCLUDE (p), {two[1]} AS q FROM c1), c3 AS (SELECT o_orderkey, xor({two[2]}, 8) AS h FROM c2),
f1 AS (SELECT o_orderkey, xor(h, h >> 16) AS h FROM c3), f2 AS (SELECT o_orderkey, {mul('h', 2246822507)} AS h FROM f1), f3 AS (SELECT o_orderkey, xor(h, h >> 13) AS h FROM f2),
f4 AS (SELECT o_orderkey, {mul('h', 3266489909)} AS h FROM f3), f5 AS (SELECT o_orderkey, xor(h, h >> 16) AS h FROM f4)
SELECT o_orderkey, (CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)::INTEGER AS h FROM f5"""


@query("hash_wide_keys", long_hash_sql())
def _(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", hash_typed(F.col("o_orderkey"), T.LongType()).alias("h"))


@query("hash_bytes_portable", long_hash_sql())
def _(spark, sf_dir):
    key = F.col("o_orderkey")
    return orders(spark, sf_dir).select("o_orderkey", hash_bytes(F.unhex(F.lpad(F.hex(key), 16, "0"))).alias("h"))


# co-groups

@query(
    "cogroup_rows",
    "SELECT coalesce(l_orderkey, o_orderkey) AS key, coalesce(n, 0)::INTEGER AS n_left, (o_orderkey IS NOT NULL)::INTEGER AS n_right, coalesce(lines, 0)::BIGINT AS lines "
    "FROM (SELECT l_orderkey, count(*) AS n, sum(l_linenumber) AS lines FROM lineitem GROUP BY 1) FULL JOIN orders ON l_orderkey = o_orderkey",
)
def _(spark, sf_dir):
    c = joins.cogroup_rows(lineitem(spark, sf_dir), orders(spark, sf_dir), "l_orderkey", "o_orderkey")
    lines = F.aggregate("lefts", F.lit(0).cast("bigint"), lambda acc, x: acc + x["l_linenumber"])
    return c.select("key", F.size("lefts").alias("n_left"), F.size("rights").alias("n_right"), lines.alias("lines"))


@query("smb_cogroup_layouts", ORACLES["smb_cogroup"])
def _(spark, sf_dir):
    """From layouts with shards and unequal bucket counts, where a key's rows lie in several pairs of files."""
    a, b = write_by_size(lineitem(spark, sf_dir), "l_orderkey", 0.5), write_fixed(orders(spark, sf_dir), "o_orderkey", 3)
    n = lambda name: [F.count(F.lit(1)).alias(name)]
    c = joins.cogroup_layouts(spark, a, b, n("n_left"), n("n_right"))
    return c.select("key", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))


# layouts: headers, names, formats, streams

@query("layout_header", "SELECT 'l_orderkey' AS keys, 6 AS num_buckets, 'murmur3' AS hash")
def _(spark, sf_dir):
    h = read_header(spark, write_fixed(lineitem(spark, sf_dir), "l_orderkey", 6))
    return spark.createDataFrame([(h["keys"], h["num_buckets"], h["hash"])], "keys string, num_buckets int, hash string")


@query("layout_file_names", murmur_sql("events", "user_id", "event_id") + f"SELECT DISTINCT {floor_mod('h', 8)}::INTEGER AS bucket_id, 0 AS shard_id, printf('part-b%05d-s%05d.parquet', {floor_mod('h', 8)}::INTEGER, 0) AS name FROM hashed")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("int").alias("user_id"), "event_id")
    f = files(spark, write_fixed(e, "user_id", 8))
    b, s = parsed_names(F.col("name"))
    return f.select(b.alias("bucket_id"), s.alias("shard_id"), "name")


@query("avro_round_trip", "SELECT event_id, user_id, event_type, value, props, ts FROM events")
def _(spark, sf_dir):
    path = fresh_path(spark, "avro")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", "ts")
    avro.write_avro(e, path)
    return schemas.read_table(spark, path, kind="avro").select(*e.columns)


@query("avro_layout", murmur_sql("events", "user_id", "event_id") + f"SELECT printf('part-b%05d-s00000.avro', b) AS file, b AS bucket_id, 0 AS shard_id FROM (SELECT DISTINCT {floor_mod('h', 8)}::INTEGER AS b FROM hashed)")
def _(spark, sf_dir):
    path = fresh_path(spark, "avro-layout")
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("int").alias("user_id"), "event_id", "event_type")
    avro.write_avro_layout(e, "user_id", 8, path)
    return avro.layout_files(spark, path)


@query("avro_layout_rows", "SELECT user_id::INTEGER AS user_id, event_id, event_type FROM events")
def _(spark, sf_dir):
    path = fresh_path(spark, "avro-layout")
    avro.write_avro_layout(table(spark, sf_dir, "events").select(F.col("user_id").cast("int").alias("user_id"), "event_id", "event_type"), "user_id", 8, path)
    return schemas.read_table(spark, f"{path}/part-b*.avro")


@query("stream_append", murmur_sql("events", "user_id", "event_id, event_type") + f"SELECT {floor_mod('h', 8)}::INTEGER AS bucket_id, event_type, count(*) AS n FROM hashed GROUP BY 1, 2")
def _(spark, sf_dir):
    schema = T.StructType([T.StructField(n, t()) for n, t in (("event_id", T.LongType), ("user_id", T.LongType), ("event_type", T.StringType))])
    path = fresh_path(spark, "stream")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("user_id", F.col("user_id").cast("int"))
    q, m = append_buckets(stream, "user_id", 8, path, f"{path}.checkpoint")
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return read_directory(spark, m).groupBy("bucket_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


SCHEMA_TEXT = '{"type": "record", "name": "Event", "fields": [{"name": "id", "type": "int"}, {"name": "payload", "type": ["null", "bytes"]}, {"name": "tags", "type": {"type": "array", "items": "string"}}, {"name": "at", "type": {"type": "long", "logicalType": "timestamp-micros"}}]}'


@query("schema_loader", "SELECT * FROM (VALUES ('at', 'timestamp', false), ('id', 'int', false), ('payload', 'binary', true), ('tags', 'array<string>', false)) t(name, type, nullable)")
def _(spark, sf_dir):
    path = fresh_path(spark, "schema")
    spark.createDataFrame([(SCHEMA_TEXT,)], "value string").coalesce(1).write.text(path)
    s = schemas.load_schema(spark, path)
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in s.fields], "name string, type string, nullable boolean")


@query("schema_of_files", "SELECT * FROM (VALUES ('r_name', 'string'), ('r_regionkey', 'int')) t(name, type)")
def _(spark, sf_dir):
    s = schemas.load_schema(spark, like=f"{sf_dir}/region.parquet")
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in s.fields], "name string, type string")


@query("record_bytes", f"SELECT event_id, {EVENT_SIZE}::BIGINT AS bytes, true AS same FROM events")
def _(spark, sf_dir):
    """The encoded bytes of a record have the size that record_size states, and give the record back."""
    e = sized_events(spark, sf_dir)
    plain = T.StructType([T.StructField(f.name, f.dataType, False) for f in e.schema.fields])
    coded = records.to_record(e, plain.names, required=True)
    back = records.from_record(coded, F.col("record"), plain)
    bytes_ = coded.select(F.col("event_id"), F.octet_length("record").cast("bigint").alias("bytes"), F.xxhash64(*plain.names).alias("was"))
    return bytes_.join(back.select(F.col("event_id").alias("b_id"), F.xxhash64(*plain.names).alias("now")), F.col("event_id") == F.col("b_id")).select("event_id", "bytes", (F.col("was") == F.col("now")).alias("same"))


# generators

RECORDS_SQL = "SELECT i AS bucket, (floor(20000 * (1.0::DOUBLE / (i + 1)) / h) + (i < 20000 - (SELECT sum(floor(20000 * (1.0::DOUBLE / (j + 1)) / h)) FROM range(8) q(j)))::INTEGER)::BIGINT AS n FROM range(8) r(i), (SELECT sum(1.0::DOUBLE / (j + 1)) AS h FROM range(8) q(j))"


@query("script_records", RECORDS_SQL)
def _(spark, sf_dir):
    r = datagen.script_records(spark, 20_000, 31, 8, 1.0, 0.3, 5)
    return r.groupBy(F.pmod(F.conv("id", 16, 10).cast("bigint"), F.lit(8).cast("bigint")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("script_records_hot", "SELECT i AS bucket, true AS hot FROM range(8) r(i)")
def _(spark, sf_dir):
    """In each bucket one key has about the share of rows that was asked for."""
    r = datagen.script_records(spark, 80_000, 31, 8, 0.0, 0.3, 5)
    each = r.groupBy("id").agg(F.count(F.lit(1)).alias("n")).groupBy(F.pmod(F.conv("id", 16, 10).cast("bigint"), F.lit(8).cast("bigint")).alias("bucket")).agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return each.select("bucket", F.col("top").between(F.col("n") * 0.27, F.col("n") * 0.33).alias("hot"))


@query("worker_files", "SELECT printf('part%d-c1000-b8-s0.50.parquet', i) AS name FROM range(3) r(i)")
def _(spark, sf_dir):
    names = workers.write_per_worker(datagen.script_records(spark, 1000, 31, 8, 0.5), fresh_path(spark, "records"), 3, 1000, 8, 0.5)
    return spark.createDataFrame([(n,) for n in names], "name string")


@query("worker_rows", "SELECT count(*) AS n FROM range(1000)")
def _(spark, sf_dir):
    path = fresh_path(spark, "records")
    workers.write_per_worker(datagen.script_records(spark, 1000, 31, 8, 0.5), path, 3, 1000, 8, 0.5)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))


@query("hex_csv", "SELECT (i * 37 % 16)::BIGINT AS bucket, count(*) AS n FROM range(1000) r(i) GROUP BY 1")
def _(spark, sf_dir):
    path = fresh_path(spark, "hex")
    spark.range(1000).select(F.lpad(F.lower(F.hex(F.col("id") * 37)), 8, "0").alias("k")).write.option("quoteAll", "true").csv(path)
    return datagen.read_hex_csv(spark, path).groupBy(F.pmod("key", F.lit(16).cast("bigint")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@query("gen_payloads", "SELECT 99992::BIGINT AS n, 99992::BIGINT AS distinct_payloads, 96 AS low, 96 AS high, 1.0::DOUBLE AS even")
def _(spark, sf_dir):
    """Payloads have the asked length, do not repeat, and their first bytes are spread over all values."""
    e = datagen.events(spark, 1e5, 10_000, 100, 1.0, 4).select(F.octet_length("payload").alias("b"), F.xxhash64("payload").alias("h"), F.substring(F.hex("payload"), 1, 2).alias("first"))
    spread = F.round(F.count_distinct("first") / 256, 3)
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("distinct_payloads"), F.min("b").alias("low"), F.max("b").alias("high"), spread.alias("even"))


@query("gen_key_uuids", "SELECT 15000::BIGINT AS n, 15000::BIGINT AS distinct_keys, 36 AS length")
def _(spark, sf_dir):
    return datagen.keys(spark, 12_345).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("distinct_keys"), F.max(F.length("key")).alias("length"))


@query("key_gaps", "SELECT i AS rank, true AS inside FROM range(100) r(i)")
def _(spark, sf_dir):
    """One key in each gap of the key space."""
    e = datagen.events(spark, 1e4, 10_000, 100, 0.5, 1, 4, seed=3).select("id").distinct()
    return e.groupBy(F.floor(F.col("id") / 100).cast("bigint").alias("rank")).agg((F.count(F.lit(1)) == 1).alias("inside"))


@query("zipf_tops", "SELECT s::DOUBLE AS shape, i AS rank, floor(6000000000.0::DOUBLE / pow(i + 1, s) / (SELECT sum(1.0::DOUBLE / pow(j + 1, s)) FROM range(1000) q(j)) + 0.5)::BIGINT AS adj FROM range(8) r(i), (SELECT k * 0.2::DOUBLE AS s FROM range(8) z(k))")
def _(spark, sf_dir):
    tops = [datagen.zipf_frequencies(spark, 6e9, 1000, k * 0.2).orderBy("rank").limit(8).select(F.lit(k * 0.2).alias("shape"), "rank", "adj") for k in range(8)]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


@query("random_order", "SELECT o_orderkey FROM orders")
def _(spark, sf_dir):
    return datagen.random_order(orders(spark, sf_dir).select("o_orderkey"), 7)


@query("shard_random", murmur_sql("events", "user_id", "event_id") + f"SELECT {floor_mod('h', 8)}::INTEGER AS bucket_id, count(*) AS n, 0 AS low, 4 AS high FROM hashed GROUP BY 1")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(bucket_id(F.col("user_id"), 8).alias("bucket_id"), sharding.random_shard(F.lit(5), 11).alias("s"))
    return e.groupBy("bucket_id").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))


@query("shard_scattered", "SELECT i::INTEGER AS shard_id, true AS fair FROM range(5) r(i)")
def _(spark, sf_dir):
    """Rows that are all equal spread over the shards of their bucket."""
    same = spark.range(10_000).select(F.lit(1).alias("k"))
    return same.select(sharding.scattered(F.lit(5), same).alias("shard_id")).groupBy("shard_id").agg(F.count(F.lit(1)).between(1900, 2100).alias("fair"))
