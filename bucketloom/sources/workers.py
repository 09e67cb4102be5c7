"""One file a worker, named by what it holds, that appears as a whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketloom.sources.workspace import fresh_path


def worker_file(worker: int, count: int, buckets: int, shape: float, suffix: str = "parquet") -> str:
    return f"part{worker}-c{count}-b{buckets}-s{shape:.2f}.{suffix}"


def write_per_worker(df: DataFrame, path: str, workers: int, count: int, buckets: int, shape: float) -> list[str]:
    """df dealt over the workers' files. They are written beside the path and renamed into it one by one: a reader sees
    whole files only, and a run that dies leaves none that is cut short. Returns the names."""
    spark: SparkSession = df.sparkSession
    made = fresh_path(spark, "workers")
    df.repartition(workers).withColumn("__worker", F.spark_partition_id()).write.partitionBy("__worker").parquet(made)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(conf)
    fs.mkdirs(at(path))
    names = []
    for w in range(workers):
        folder = at(f"{made}/__worker={w}")
        found = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")] if fs.exists(folder) else []
        for k, p in enumerate(found):  # a task writes one file unless a session limits the rows of a file
            name = worker_file(w, count, buckets, shape) if k == 0 else worker_file(w, count, buckets, shape, f"{k}.parquet")
            if not fs.rename(p, at(f"{path}/{name}")):
                raise OSError(f"cannot publish {name}")
            names.append(name)
    fs.delete(at(made), True)
    return names
