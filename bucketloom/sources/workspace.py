"""Where tables go that queries write: the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir. Only a local master, whose executor shares the driver's disk, does without it."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="bucketloom-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{sc.applicationId}/{name}-{uuid.uuid4().hex}"
