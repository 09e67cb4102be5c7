"""python -m bucketloom.cli: generate, bucket and join tables from the command line."""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bucketloom.operators import bucketing, joins
from bucketloom.plans.steps import step
from bucketloom.sources import datagen
from bucketloom.sources.layout import read_manifest
from bucketloom.sources.schemas import load_schema, read_table
from bucketloom.sources.workers import write_per_worker


def number(text: str) -> float:
    """6e9 as well as 6000000000."""
    return float(text)


def whole(text: str) -> int:
    return int(float(text))


def numbers(text: str) -> list[float]:
    return [float(x) for x in text.split(",")]


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bucketloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, **options) -> None:
        s = sub.add_parser(name, help=about)
        for o, settings in options.items():
            s.add_argument(f"--{o.replace('_', '-')}", **settings)

    need, count = {"required": True}, {"type": whole, "required": True}
    schema = {"schema_file": {"help": "a record schema in JSON"}, "like": {"help": "data files whose schema the input has"}, "key": {"default": "id", "help": "key columns, comma between them"}}
    skew = {"type": number, "default": 0.0}
    command("generate-keys", "ids 0.. with a random key each", output=need, key_space={"type": number, "default": 100_000})
    command("generate-events", "Zipf events", output=need, count=count, key_space=count, num_keys=count, zipf_shape=skew, fanout_factor={"type": whole, "default": 1}, payload_size={"type": whole, "default": 96}, seed={"type": whole, "default": 0})
    command("generate-records", "records with skew over and in buckets", output=need, count=count, key_bits={"type": whole, "default": 31}, buckets={"type": whole, "default": 1}, shape=skew, data_skew=skew, workers={"type": whole, "default": 4}, seed={"type": whole, "default": 0})
    command("bucket", "a layout of a fixed number of buckets", input=need, output=need, num_buckets=count, **schema)
    command("bucket-skewadj", "a layout of buckets and shards by size", input=need, output=need, bucket_size_mb={"type": number, "default": 256}, **schema)
    command("bucket-auto", "a layout of buckets by size, shards by threshold", input=need, output=need, eps={"type": number, "default": 0.05}, bucket_size_mb={"type": number, "default": 256}, **schema)
    for name, about in (("smb-join", "join two layouts without an exchange"), ("join", "join two tables by shuffling them")):
        command(name, about, events=need, keys=need, key={"default": "id"}, output={"help": "where to write the rows; else they are counted"})
    command("experiment", "generate, bucket and join for each Zipf shape, and time it", output=need, count=count, key_space=count, num_keys=count, shapes={"type": numbers, "default": [0.0, 0.5, 1.0, 1.1, 1.4]}, num_buckets={"type": whole, "default": 64}, bucket_size_mb={"type": number, "default": 300}, payload_size={"type": whole, "default": 96})
    return p


def source(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    schema = load_schema(spark, a.schema_file, a.like) if a.schema_file or a.like else None
    return read_table(spark, a.input, schema)


def ended(df: DataFrame, output: str | None) -> dict:
    if output:
        df.write.parquet(output)
        return {"output": output}
    return {"rows": df.count()}


def named(keys: DataFrame, key: str) -> DataFrame:
    return keys.withColumnRenamed(key, f"r_{key}")


def experiment(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Seconds of each step for each shape."""
    out: dict[str, dict[str, float]] = {}

    def timed(shape: str, name: str, run: Callable[[], object]) -> object:
        began = time.perf_counter()
        with step(spark, f"{name}, shape {shape}"):
            got = run()
        out.setdefault(shape, {})[name] = round(time.perf_counter() - began, 3)
        return got

    keys_at = f"{a.output}/keys"
    datagen.keys(spark, a.key_space).write.parquet(keys_at)
    keys = spark.read.parquet(keys_at)
    for s in a.shapes:
        shape, events_at = f"{s:.2f}", f"{a.output}/events-{s:.2f}"
        timed(shape, "generate", lambda: datagen.events(spark, a.count, a.key_space, a.num_keys, s, 1, a.payload_size).write.parquet(events_at))  # noqa: B023
        events = spark.read.parquet(events_at)
        fixed = timed(shape, "bucket", lambda: [bucketing.write_fixed(t, "id", a.num_buckets) for t in (events, keys)])  # noqa: B023
        sized = timed(shape, "bucket-skewadj", lambda: [bucketing.write_by_size(t, "id", a.bucket_size_mb) for t in (events, keys)])  # noqa: B023
        noop = lambda df: df.write.format("noop").mode("overwrite").save()
        timed(shape, "join", lambda: noop(joins.plain_join(events, named(keys, "id"), "id", "r_id")))  # noqa: B023
        timed(shape, "smb-join", lambda: noop(joins.congruent_join(spark, *fixed)))  # noqa: B023
        timed(shape, "smb-join-skewadj", lambda: noop(joins.congruent_join(spark, *sized)))  # noqa: B023
    return out


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    keys = a.key.split(",") if getattr(a, "key", None) else None
    if a.command == "generate-keys":
        return ended(datagen.keys(spark, a.key_space), a.output)
    if a.command == "generate-events":
        return ended(datagen.events(spark, a.count, a.key_space, a.num_keys, a.zipf_shape, a.fanout_factor, a.payload_size, a.seed), a.output)
    if a.command == "generate-records":
        made = datagen.script_records(spark, a.count, a.key_bits, a.buckets, a.shape, a.data_skew, a.seed)
        return {"files": write_per_worker(datagen.random_order(made, a.seed), a.output, a.workers, a.count, a.buckets, a.shape)}
    if a.command == "bucket":
        return {"manifest": bucketing.write_fixed(source(spark, a), keys, a.num_buckets, path=a.output).path + ".manifest"}
    if a.command == "bucket-skewadj":
        return {"manifest": bucketing.write_by_size(source(spark, a), keys, a.bucket_size_mb, path=a.output).path + ".manifest"}
    if a.command == "bucket-auto":
        return {"manifest": bucketing.write_by_threshold(source(spark, a), keys, a.eps, a.bucket_size_mb, path=a.output).path + ".manifest"}
    if a.command == "smb-join":
        return ended(joins.congruent_join(spark, read_manifest(spark, a.events), read_manifest(spark, a.keys)), a.output)
    if a.command == "join":
        return ended(joins.plain_join(read_table(spark, a.events), named(read_table(spark, a.keys), a.key), a.key, f"r_{a.key}"), a.output)
    return experiment(spark, a)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("bucketloom").getOrCreate()
    with step(spark, a.command):
        got = run(spark, a)
    print(json.dumps(got))
    return got


if __name__ == "__main__":
    main()
