"""A Python data source that joins two directory layouts without an exchange: a partition is a file of the left layout, or
neighbours of one that are small together with what they meet.

A partition streams each of its files by row groups against those of the right files in congruent buckets whose key range meets
it, so it holds one row group of each side whatever the files hold; a hot key's rows meet row group by row group. Keys are
compared by value, whole (64 bits, text, several columns); null keys never match. Files are opened by pyarrow, which
reads local, hdfs, s3 and gs paths; for others `join_pairs` falls back on the join of both layouts by Spark.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructField, StructType

from bucketloom.sources.layout import Manifest, files, read_directory

#: Joined rows in a batch.
ROWS_OUT = 1 << 16
#: Bytes of files that a partition reads, if its files are smaller.
BUNDLE = 32 << 20


class PairSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bucketloom_pairs"

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.options["schema"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return PairReader(json.loads(self.options["plan"]), schema)


class SortedFile:
    """The row groups of a file, with the range of the first key of each."""

    def __init__(self, path: str, keys: list[str], columns: list[str] | None = None) -> None:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem

        fs, inner = FileSystem.from_uri(path)
        self.file, self.keys, self.path = pq.ParquetFile(fs.open_input_file(inner)), keys, path
        self.columns = None if columns is None else list(dict.fromkeys([*keys, *columns]))
        at = self.file.schema_arrow.names.index(keys[0])
        self.ranges = []
        for g in range(self.file.num_row_groups):
            s = self.file.metadata.row_group(g).column(at).statistics
            self.ranges.append((s.min, s.max) if s is not None and s.has_min_max else None)
        self.group = functools.lru_cache(maxsize=2)(self._group)

    def _group(self, g: int):
        """Row group g without rows that have a null key."""
        import pyarrow.compute as pc

        t = self.file.read_row_group(g, columns=self.columns, use_threads=False)
        for k in self.keys:
            t = t.filter(pc.is_valid(t[k]))
        check_sorted([t[k].combine_chunks() for k in self.keys], self.path)
        return t

    def meeting(self, of: tuple | None) -> Iterator[int]:
        for g, own in enumerate(self.ranges):
            if of is None or own is None or not (own[1] < of[0] or of[1] < own[0]):
                yield g


def comparable(values):
    """Values in the order of their bytes: unsigned for whole numbers, bytes for text."""
    import pyarrow as pa

    if pa.types.is_integer(values.type):
        return pa.array(values.to_numpy(zero_copy_only=False).view({1: "u1", 2: "u2", 4: "u4", 8: "u8"}[values.type.bit_width // 8]))
    if pa.types.is_date32(values.type):
        return comparable(values.cast(pa.int32()))
    return values.cast(pa.binary()) if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else values


def check_sorted(keys: list, path: str) -> None:
    import numpy as np
    import pyarrow.compute as pc

    if len(keys[0]) < 2:
        return
    bad, same = np.zeros(len(keys[0]) - 1, bool), np.ones(len(keys[0]) - 1, bool)
    for k in map(comparable, keys):
        a, b = k[:-1], k[1:]
        bad |= same & pc.less(b, a).to_numpy(zero_copy_only=False)
        same &= pc.equal(a, b).to_numpy(zero_copy_only=False)
    if bad.any():
        raise ValueError(f"Data is not sorted: {path}")


def codes(left, right, l_keys: list[str], r_keys: list[str]):
    """Numbers for the rows of both tables that are equal just where all keys are."""
    import numpy as np
    import pyarrow as pa

    out = np.zeros(len(left) + len(right), "int64")
    for a, b in zip(l_keys, r_keys, strict=True):
        both = pa.chunked_array([*left[a].chunks, *right[b].cast(left[a].type).chunks], left[a].type).combine_chunks()
        if len(l_keys) == 1 and pa.types.is_integer(both.type):
            out = both.to_numpy(zero_copy_only=False).astype("int64")
            continue
        found = both.dictionary_encode()
        found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
        out = np.unique(out * (len(found.dictionary) + 1) + found.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return out[: len(left)], out[len(left) :]


def bundled(left: list, right: dict[str, list], least: int, most_bytes: int = BUNDLE) -> list[list[tuple[str, str]]]:
    """The left files (path, class, length) in runs for one task each: by the bytes that a file and those of its class in
    right (path, length) hold, at most most_bytes or a least-th of all of them, but a file at least."""
    met = {c: sum(n for _, n in found) for c, found in right.items()}
    weights = [n + met[c] for _, c, n in left]
    limit = min(most_bytes, sum(weights) / max(1, least))
    out, held = [], limit
    for (path, c, _), w in zip(left, weights, strict=True):
        if held + w > limit:
            out.append([])
            held = 0
        out[-1].append((path, c))
        held += w
    return out


class PairReader(DataSourceReader):
    def __init__(self, plan: dict, schema: StructType) -> None:
        self.plan, self.schema = plan, schema

    def __getstate__(self) -> dict:
        """Tasks get their own files as partitions, never the lists of all files."""
        return self.__dict__ | {"plan": {k: v for k, v in self.plan.items() if k not in ("left", "right")}}

    def partitions(self) -> list[InputPartition]:
        right = self.plan["right"]
        runs = bundled(self.plan["left"], right, self.plan["least"])
        return [InputPartition((run, {c: [p for p, _ in right[c]] for _, c in run})) for run in runs] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator:
        if partition.value is None:
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        run, right_of = partition.value
        plan, target = self.plan, to_arrow_schema(self.schema)
        for path, group in run:
            left = SortedFile(path, plan["left_keys"], plan["left_columns"])
            rights = [SortedFile(p, plan["right_keys"], plan["right_columns"]) for p in right_of[group]]
            for g, reach in enumerate(left.ranges):
                for right in rights:
                    for h in right.meeting(reach):
                        yield from self.joined(left.group(g), right.group(h), target)

    def joined(self, a, b, target) -> Iterator:
        import numpy as np
        import pyarrow as pa

        plan = self.plan
        x, y = codes(a, b, plan["left_keys"], plan["right_keys"])
        order = np.argsort(y, kind="stable")
        y = y[order]
        first = np.searchsorted(y, x, "left")
        n = np.searchsorted(y, x, "right") - first
        ends = np.cumsum(n)
        for begin in range(0, int(ends[-1]) if len(ends) else 0, ROWS_OUT):
            out = np.arange(begin, min(begin + ROWS_OUT, int(ends[-1])))
            at = np.searchsorted(ends, out, "right")
            to = order[first[at] + out - (ends[at] - n[at])]
            columns = [a[c].take(pa.array(at)) for c in plan["left_columns"]] + [b[c].take(pa.array(to)) for c in plan["right_columns"]]
            yield from pa.table([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target).to_batches()


def joined_schema(left: Manifest, right: Manifest) -> StructType:
    """Both sides' columns; a right one that clashes gets the prefix r_."""
    a, b = left.columns.fields, right.columns.fields
    taken = {f.name for f in a}
    return StructType([*a, *[StructField("r_" + f.name if f.name in taken else f.name, f.dataType, f.nullable) for f in b]])


def check_alike(left: Manifest, right: Manifest) -> None:
    """Layouts whose buckets can be matched: the same hash over keys of the same types."""
    kinds = [[m.columns[k].dataType for k in m.keys] for m in (left, right)]
    if kinds[0] != kinds[1] or left.hasher != right.hasher:
        raise ValueError(f"layouts do not match: {left.keys} by {left.hasher} and {right.keys} by {right.hasher}, of types {kinds}")


def reachable(path: str) -> bool:
    from urllib.parse import urlparse

    return urlparse(path).scheme in ("", "file", "hdfs", "s3", "s3a", "gs")


def join_pairs(spark: SparkSession, left: Manifest, right: Manifest) -> DataFrame:
    """Inner join of two layouts, whatever their bucket and shard counts: buckets congruent modulo the gcd of the counts
    meet, each left shard with each right shard. The driver sees file names, never pairs."""
    check_alike(left, right)
    if not (reachable(left.path) and reachable(right.path)):
        return by_exchange(spark, left, right)
    g = math.gcd(left.num_buckets, right.num_buckets)
    l_files, r_files = ([(f["path"], f["bucket_id"] % g, f["length"]) for f in files(spark, m).collect()] for m in (left, right))

    def local(path: str) -> str:
        return "file://" + path.removeprefix("file:").replace("///", "/") if path.startswith(("file:", "/")) else path.replace("s3a://", "s3://", 1)

    right_of: dict[str, list[tuple[str, int]]] = {}
    for p, c, n in r_files:
        right_of.setdefault(str(c), []).append((local(p), n))
    plan = {
        "left": [(local(p), str(c), n) for p, c, n in l_files if str(c) in right_of], "right": right_of, "least": 2 * spark.sparkContext.defaultParallelism,
        "left_keys": left.keys, "right_keys": right.keys, "left_columns": left.columns.names, "right_columns": right.columns.names,
    }
    spark.dataSource.register(PairSource)
    return spark.read.format("bucketloom_pairs").options(plan=json.dumps(plan), schema=joined_schema(left, right).json()).load()


def by_exchange(spark: SparkSession, left: Manifest, right: Manifest) -> DataFrame:
    """The same rows by Spark's own join of the two layouts, which shuffles them."""
    names = joined_schema(left, right).names
    a = read_directory(spark, left).drop("bucket_id", "shard_id").toDF(*names[: len(left.columns)])
    b = read_directory(spark, right).drop("bucket_id", "shard_id").toDF(*names[len(left.columns) :])
    of = dict(zip(right.columns.names, b.columns, strict=True))
    return a.join(b, functools.reduce(lambda x, y: x & y, [a[k] == b[of[j]] for k, j in zip(left.keys, right.keys, strict=True)]))
