import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketloom import cli
from bucketloom.functions.hashing import HASHERS, bucket_id, encode_key, encode_typed, hash32, hash32_portable, hash_bytes, hash_typed, register_hasher
from bucketloom.functions.sizes import bucket_count
from bucketloom.operators import joins, sharding
from bucketloom.operators.bucketing import write_by_size, write_by_threshold, write_fixed
from bucketloom.operators.sizing import shards_by_eps
from bucketloom.plans import catalogue
from bucketloom.plans.steps import step
from bucketloom.sources import avro, pairs, schemas
from bucketloom.sources.datagen import partition_n_over_k, repeated, script_records
from bucketloom.sources.layout import drop_catalogue, files, parse_file_name, read_directory, read_manifest, write_directory
from bucketloom.sources.workspace import fresh_path

SF = "/root/testdata/sf0.001"
GOLDEN = {0: 593689054, 1: 854115492, 2: 3496215247, 5: 2376787436, 42: 356355534, 1000: 1646842212, 123456789: 1906046938, 2147483647: 1792945001, -1: 1982413648, -2147483648: 4162446295, -7: 2698065237}


def murmur(data: bytes) -> int:
    """Seed-0 murmur3, 32 bits, written down from its definition."""
    m, h = 0xFFFFFFFF, 0
    rot = lambda x, r: (x << r | x >> (32 - r)) & m
    for at in range(0, len(data), 4):
        part = data[at : at + 4]
        k = int.from_bytes(part, "little") * 0xCC9E2D51 & m
        h ^= rot(k, 15) * 0x1B873593 & m
        if len(part) == 4:
            h = rot(h, 13) * 5 + 0xE6546B64 & m
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


def test_golden_hashes(spark):
    t = spark.createDataFrame([(k,) for k in GOLDEN], "id int")
    swapped = F.expr("cast(conv(concat(substr(lpad(hex(cast(id as bigint) & 4294967295),8,'0'),7,2),substr(lpad(hex(cast(id as bigint) & 4294967295),8,'0'),5,2),substr(lpad(hex(cast(id as bigint) & 4294967295),8,'0'),3,2),substr(lpad(hex(cast(id as bigint) & 4294967295),8,'0'),1,2)),16,10) as bigint)")
    for r in t.select("id", hash32(F.col("id")).alias("h"), hash32_portable(swapped).alias("p")).collect():
        assert r.h % 2**32 == GOLDEN[r.id] == r.p % 2**32 == murmur(r.id.to_bytes(4, "big", signed=True))


def test_hash_of_text_and_wide_numbers(spark):
    texts = ["", "a", "ab", "abc", "abcd", "abcde", "é" * 9, "x" * 101, None]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", hash_bytes(F.encode("t", "UTF-8")).alias("h")).collect():
        assert r.h is None if r.t is None else r.h % 2**32 == murmur(r.t.encode())
    wide = [0, 1, -1, 1 << 40, -(1 << 63), (1 << 63) - 1]
    for r in spark.createDataFrame([(w,) for w in wide], "k long").select("k", hash_typed(F.col("k"), T.LongType()).alias("h"), hash_bytes(encode_typed(F.col("k"), T.LongType())).alias("p")).collect():
        assert r.h == r.p and r.h % 2**32 == murmur(r.k.to_bytes(8, "big", signed=True))


def test_null_keys_and_order(spark):
    t = spark.createDataFrame([(3,), (-1,), (0,), (None,), (256,)], "id int")
    assert [r.id for r in t.where("id is not null").orderBy(encode_key(F.col("id"))).collect()] == [0, 3, 256, -1]
    assert t.where("id is null").select(bucket_id(F.col("id"), 4).alias("b")).first().b == 0


def test_sizing():
    assert [bucket_count(x, 100) for x in (0, 99, 100, 1322)] == [1, 1, 2, 16]
    assert shards_by_eps({0: 1000, 1: 10, 2: 10, 3: 10}, 4, 0.1) == [25, 1, 1, 1]
    assert shards_by_eps({0: 1000, 1: 10, 2: 10, 3: 10}, 4, 1.0) == [3, 1, 1, 1] and shards_by_eps({0: 5, 1: 5}, 2, 0.5) == [1, 1]
    assert shards_by_eps({0: 3}, 2, 0.0)[1] == 1
    assert partition_n_over_k(10, 4) == [3, 3, 2, 2]


def counted(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("pair", [(5, 7), (8, 4), (1, 3)])
def test_congruent_join_equals_plain(spark, pair):
    a = spark.createDataFrame([(i % 17 - 3, i) for i in range(120)] + [(None, -1)], "a int, x int")
    b = spark.createDataFrame([(i, -i) for i in range(-3, 9)] + [(None, -2)], "b int, y int")
    want = counted(a.join(b, F.col("a") == F.col("b")))
    assert counted(joins.congruent_join(spark, write_fixed(a, "a", pair[0]), write_fixed(b, "b", pair[1])).select("a", "x", "b", "y")) == want


@pytest.mark.parametrize("seed", range(6))
def test_layout_joins_equal_plain_joins(spark, seed):
    """Random keys of each type, bucket counts, shards, nulls, a hot key, and keys that agree in their low 32 bits."""
    r = random.Random(seed)
    kind, make = [("bigint", lambda k: k % 40 + (k % 3 << 32)), ("string", lambda k: f"ключ{k % 40}"), ("int", lambda k: k % 40 - 20), ("date", None)][seed % 4]
    rows = lambda n: [(None if r.random() < 0.05 else 1 if r.random() < 0.3 else r.randrange(10_000), i) for i in range(n)]
    if make is None:
        import datetime

        make = lambda k: datetime.date(1969, 12, 20) + datetime.timedelta(days=k % 40)
    a = spark.createDataFrame([(None if k is None else make(k), i) for k, i in rows(300)], f"k {kind}, x int")
    b = spark.createDataFrame([(None if k is None else make(k), i) for k, i in rows(60)], f"j {kind}, y int")
    shards = F.pmod(F.hash("x"), F.lit(3)).cast("int")
    left = write_directory(a, "k", r.randint(1, 16), shards)
    got = joins.congruent_join(spark, left, write_fixed(b, "j", r.randint(1, 16)))
    assert counted(got) == counted(a.join(b, F.col("k") == F.col("j")))


def test_layout_joins_by_several_keys_and_clashing_names(spark):
    a = spark.createDataFrame([(i % 5, f"t{i % 3}", i) for i in range(60)] + [(1, None, 99)], "k int, t string, v int")
    b = spark.createDataFrame([(i % 4, f"t{i % 4}", -i) for i in range(20)] + [(1, None, 98)], "k int, t string, v int")
    got = joins.congruent_join(spark, write_fixed(a, ["k", "t"], 4), write_fixed(b, ["k", "t"], 6))
    assert got.columns == ["k", "t", "v", "r_k", "r_t", "r_v"]
    renamed = b.toDF("r_k", "r_t", "r_v")
    want = counted(a.join(renamed, (a.k == renamed.r_k) & (a.t == renamed.r_t)))
    assert counted(got) == want == counted(pairs.by_exchange(spark, write_fixed(a, ["k", "t"], 4), write_fixed(b, ["k", "t"], 6)))
    with pytest.raises(ValueError, match="do not match"):
        joins.congruent_join(spark, write_fixed(a, "k", 4), write_fixed(a, "t", 4))


def test_layout_join_streams_many_row_groups(spark, monkeypatch):
    monkeypatch.setattr("bucketloom.sources.layout.ROW_GROUP", 1024)
    a = spark.range(30_000).select((F.col("id") % 900).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    b = spark.range(1_500).select((F.col("id") % 1000).alias("j"), F.sha2(F.col("id").cast("string"), 256).alias("y"))
    left, right = write_fixed(a, "k", 2), write_fixed(b, "j", 4)
    path = files(spark, left).first().path
    assert len(pairs.SortedFile("file://" + path.removeprefix("file:").replace("///", "/"), ["k"]).ranges) > 1
    got, want = joins.congruent_join(spark, left, right), a.join(b, F.col("k") == F.col("j"))
    digest = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("k", "x", "y").cast("decimal(38,0)"))).first()
    assert digest(got) == digest(want)


def test_layout_join_needs_no_exchange_and_empty_sides_work(spark):
    a, b = spark.range(50).withColumnRenamed("id", "k"), spark.range(0).withColumnRenamed("id", "j")
    j = joins.congruent_join(spark, write_by_threshold(a, "k", 0.1, 0.001), write_by_size(a.withColumnRenamed("k", "j"), "j", 0.001))
    assert "Exchange" not in j._jdf.queryExecution().executedPlan().toString() and j.count() == 50
    assert joins.congruent_join(spark, write_fixed(a, "k", 3), write_fixed(b, "j", 2)).count() == 0


def test_small_shards_share_files_and_tasks(spark):
    a = spark.range(40_000).select(F.when(F.col("id") < 8_000, 7).otherwise(F.col("id") % 9_000).alias("k"), F.col("id").alias("x"))
    b = spark.range(9_000).select(F.col("id").alias("j"), (F.col("id") * 3).alias("y"))
    m, n = write_by_threshold(a, "k", 0.01, 0.25), write_by_threshold(b, "j", 0.01, 0.05)
    assert m.packed and read_manifest(spark, m.path) == m
    rows = read_directory(spark, m).groupBy("bucket_id", "shard_id").count().collect()
    of = lambda bucket: [r["count"] for r in rows if r.bucket_id == bucket]
    assert len(rows) == sum(m.shards.values()) and all(len(of(int(k))) == v for k, v in m.shards.items())  # every shard is there
    kept = [f.bucket_id for f in files(spark, m).collect()]
    hot = max(m.shards, key=m.shards.get)
    assert kept.count(int(hot)) > 1 and len(kept) * 8 < len(rows)  # by bytes, not by shards
    bytes_of = lambda t: t.count() * (88 + 6)
    assert len(kept) <= m.num_buckets + bytes_of(a) / (0.25 * 2**20)
    joins.validate_sorted(read_directory(spark, m), "k")
    j = joins.congruent_join(spark, m, n)
    assert counted(j.select("k", "x", "j", "y")) == counted(a.join(b, F.col("k") == F.col("j")).select("k", "x", "j", "y"))
    assert j.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism + 1  # two neighbours are over the limit of one


def test_bundles_hold_every_file_once():
    left, right = [(f"l{i}", str(i % 3), 10 * i) for i in range(20)], {"0": [("r0", 5)], "1": [("r1", 5), ("r2", 900)], "2": []}
    for least, most in ((1, 10), (4, 1 << 30), (1, 1 << 30), (100, 50)):
        runs = pairs.bundled(left, right, least, most)
        assert [x for run in runs for x in run] == [(p, c) for p, c, _ in left] and all(runs)
    assert len(pairs.bundled(left, right, 1, 10)) > 15 and len(pairs.bundled(left, right, 1, 1 << 30)) == 1 and pairs.bundled([], right, 4) == []


def test_unsorted_layouts_are_found(spark):
    m = write_fixed(spark.range(1000).withColumnRenamed("id", "k"), "k", 1)
    joins.validate_sorted(read_directory(spark, m), "k")
    spark.range(1000).orderBy(F.desc("id")).coalesce(1).selectExpr("id k", "0 bucket_id", "0 shard_id").write.mode("overwrite").partitionBy("bucket_id", "shard_id").parquet(m.path)
    with pytest.raises(ValueError, match="not sorted"):
        joins.validate_sorted(read_directory(spark, m), "k")
    with pytest.raises(Exception, match="Data is not sorted"):
        joins.congruent_join(spark, m, write_fixed(spark.range(9).withColumnRenamed("id", "j"), "j", 1)).count()


def test_sharded_layout(spark):
    a = spark.createDataFrame([(1, "x" * 50)] * 3000 + [(i, "y") for i in range(200)], "k int, v string")
    m = write_by_size(a, "k", 0.05)
    assert read_manifest(spark, m.path) == m and max(m.shards.values()) > 1
    back = read_directory(spark, m)
    assert back.count() == 3200
    joins.validate_sorted(back, "k")
    hot = [r["count"] for r in back.where("k = 1").groupBy("shard_id").count().collect()]
    assert len(hot) == max(m.shards.values()) and max(hot) < 1.5 * min(hot)  # equal rows are spread too


def test_bucketed_join_has_no_exchange(spark):
    j = joins.bucketed_join(catalogue.lineitem(spark, SF), catalogue.orders(spark, SF), "l_orderkey", "o_orderkey", 8)
    assert "Exchange hashpartitioning" not in j._jdf.queryExecution().executedPlan().toString()
    assert drop_catalogue(spark) >= 2 and drop_catalogue(spark) == 0


def test_random_shards_and_hashes_of_ones_own(spark):
    t = spark.range(5000).select(sharding.random_shard(F.lit(7), 3).alias("s"))
    n = [r["count"] for r in t.groupBy("s").count().collect()]
    assert len(n) == 7 and max(n) < 1.3 * min(n)
    register_hasher("last-digit", lambda keys, kinds: keys[0] % 10)
    try:
        a, b = spark.range(100).withColumnRenamed("id", "k"), spark.range(40).withColumnRenamed("id", "j")
        assert joins.congruent_join(spark, write_fixed(a, "k", 5, "last-digit"), write_fixed(b, "j", 10, "last-digit")).count() == 40
    finally:
        del HASHERS["last-digit"]


def test_names():
    assert parse_file_name("x/part-b00012-s00003.parquet") == (12, 3)
    with pytest.raises(ValueError, match="no bucket"):
        parse_file_name("part-00000.parquet")


def test_avro_files(spark):
    path = fresh_path(spark, "avro")
    t = spark.createDataFrame([(i, None if i % 7 == 0 else f"é{i}", i / 3, [i, None], {"a": f"{i}"}, bytes([i % 256])) for i in range(20_000)], "k long, s string, d double, xs array<int>, m map<string,string>, b binary")
    avro.write_avro(t.repartition(3), path)
    key = lambda df: df.select("k", "s", "d", "xs", F.map_entries("m").alias("m"), "b")
    want = counted(key(t))
    assert counted(key(schemas.read_table(spark, path, kind="avro"))) == want
    old, avro.SPLIT = avro.SPLIT, 50_000  # splits begin inside blocks; the reader runs where the driver is
    try:
        fs = avro.filesystem(path)[0]
        assert sum(len(list(avro.records(fs, p, at, min(at + avro.SPLIT, n)))) for p, n in avro.listed(path) for at in range(0, n, avro.SPLIT)) == 20_000
    finally:
        avro.SPLIT = old
    assert schemas.load_schema(spark, like=f"{path}/part-*.avro")["s"].dataType == T.StringType()
    with pytest.raises(ValueError, match="no schema given"):
        schemas.load_schema(spark)
    with pytest.raises(ValueError, match="no bucket and shard"):
        avro.layout_files(spark, path)


def test_generators(spark):
    t = repeated(spark.createDataFrame([("a", 250_001), ("b", 0), ("c", 1)], "k string, n long"), "n", "k")
    assert {r.k: (r.n, r.d, r.top) for r in t.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("i").alias("d"), F.max("i").alias("top")).collect()} == {"a": (250_001, 250_001, 250_000), "c": (1, 1, 0)}
    for bad in ({"bits": 0}, {"buckets": 3}, {"hot": 1.5}, {"skew": -1.0}):
        with pytest.raises(ValueError, match="bits of 1"):
            script_records(spark, 10, **bad)


def test_steps_are_labelled(spark):
    with step(spark, "outer"):
        with step(spark, "inner"):
            assert spark.sparkContext.getLocalProperty("spark.job.description") == "inner"
        assert spark.sparkContext.getLocalProperty("spark.job.description") == "outer"
    assert spark.sparkContext.getLocalProperty("spark.job.description") is None


def test_command_line(spark, tmp_path, capsys):
    run = lambda *a: cli.main([str(x) for x in a], spark)
    run("generate-keys", "--output", tmp_path / "keys", "--key-space", "1e4")
    run("generate-events", "--output", tmp_path / "events", "--count", "2e4", "--key-space", "1e4", "--num-keys", "100", "--zipf-shape", "1.1")
    for command, more in (("bucket", ["--num-buckets", "8"]), ("bucket-skewadj", ["--bucket-size-mb", "0.3"]), ("bucket-auto", ["--bucket-size-mb", "0.3"])):
        for t in ("events", "keys"):
            run(command, "--input", tmp_path / t, "--output", tmp_path / f"{command}-{t}", *more)
    n = run("join", "--events", tmp_path / "events", "--keys", tmp_path / "keys")["rows"]
    assert n == spark.read.parquet(str(tmp_path / "events")).count() > 19_000
    for command in ("bucket", "bucket-skewadj", "bucket-auto"):
        assert run("smb-join", "--events", tmp_path / f"{command}-events", "--keys", tmp_path / f"{command}-keys")["rows"] == n
    assert len(run("generate-records", "--output", tmp_path / "records", "--count", "100", "--buckets", "4", "--workers", "2")["files"]) == 2
    times = run("experiment", "--output", tmp_path / "x", "--count", "2e3", "--key-space", "1e4", "--num-keys", "50", "--shapes", "0,1.4", "--num-buckets", "4")
    assert set(times) == {"0.00", "1.40"} and set(times["1.40"]) == {"generate", "bucket", "bucket-skewadj", "join", "smb-join", "smb-join-skewadj"}
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == times
    with pytest.raises(SystemExit):
        cli.arguments().parse_args(["bucket", "--input", "x"])


QUICK = [n for n in catalogue.ORACLES if n not in ("smb_join_skewadj", "smb_join_auto", "smb_join_gcd", "smb_join_pairs", "write_by_size_counts")]


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "customer orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = lambda x: sorted(tuple(map(repr, r)) for r in x)
    assert rows(df.select(columns).collect()) == rows(con.sql(catalogue.ORACLES[name]).select(*columns).fetchall())
