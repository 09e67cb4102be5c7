"""Avro containers as a Python data source: globs are read in splits between sync markers, tasks write whole files that
appear at commit. With the option layout, rows dealt and sorted by bucket_id and shard_id go to one file a pair, which has
the layout's name and its bucket and shard in the header."""

from __future__ import annotations

import fnmatch
import io
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from bucketloom.functions.records import decoder, encoder, get_long, put_bytes, put_long, record_schema
from bucketloom.sources.layout import file_name, key_list, placed, sort_key
from bucketloom.sources.schemas import parse_schema

#: Fixed values of the format: the first bytes, and the length of a sync marker.
MAGIC, SYNC = b"Obj\x01", 16
#: Rows in a block, and bytes of a read split.
BLOCK_ROWS, SPLIT = 4096, 64 << 20
ROWS_OUT = 8192


def filesystem(path: str):
    from pyarrow.fs import FileSystem

    path = "file://" + path.removeprefix("file:").replace("///", "/") if path.startswith(("file:", "/")) else path.replace("s3a://", "s3://", 1)
    return FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a path: a file, a folder or a glob in the last two parts."""
    from pyarrow.fs import FileSelector, FileType

    fs, inner = filesystem(path.split("*")[0].rsplit("/", 1)[0] if "*" in path else path)
    info = fs.get_file_info(inner)
    if info.type == FileType.File:
        return [(inner, info.size)]
    pattern = (inner.rstrip("/") + "/" + path.split("*")[0].rsplit("/", 1)[1] + path[path.index("*") :]) if "*" in path else inner.rstrip("/") + "/*.avro"
    found = [f for f in fs.get_file_info(FileSelector(inner, recursive=True)) if f.type == FileType.File]
    return sorted((f.path, f.size) for f in found if fnmatch.fnmatch(f.path, pattern) and not os.path.basename(f.path).startswith((".", "_")))


def header(raw) -> tuple[dict[str, bytes], bytes, int]:
    """(metadata, sync marker, length) of a container's header."""
    head = io.BytesIO(raw.read(1 << 20))
    if head.read(4) != MAGIC:
        raise ValueError("not an Avro container")
    meta = {}
    while n := get_long(head):
        if n < 0:
            n = -n
            get_long(head)
        for _ in range(n):
            name = head.read(get_long(head)).decode()
            meta[name] = head.read(get_long(head))
    return meta, head.read(SYNC), head.tell()


def read_headers(path: str) -> list[dict]:
    """The metadata of each file of a path, its name among it."""
    fs, _ = filesystem(path.split("*")[0])
    out = []
    for p, _ in listed(path):
        meta, _, _ = header(fs.open_input_file(p))
        if "avro.schema" not in meta:
            raise ValueError(f"Can't read file {p}: its header has no schema")
        out.append({k: v.decode("utf-8", "replace") for k, v in meta.items()} | {"file": os.path.basename(p)})
    return out


class AvroSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bucketloom_avro"

    def schema(self) -> StructType:
        heads = read_headers(self.options["path"])
        if not heads:
            raise ValueError(f"no Avro files at {self.options['path']}")
        return parse_schema(heads[0]["avro.schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return AvroReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return AvroWriter(self.options["path"], schema, overwrite, self.options.get("layout") == "true", self.options.get("codec", "deflate"))


class AvroReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((p, at, min(at + SPLIT, size))) for p, size in listed(self.path) for at in range(0, size, SPLIT)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator:
        if partition.value is None:
            return
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        path, begin, end = partition.value
        target, held = to_arrow_schema(self.schema), []
        for row in records(filesystem(self.path.split("*")[0])[0], path, begin, end):
            held.append({f.name: row.get(f.name) for f in target})
            if len(held) >= ROWS_OUT:
                yield from pa.Table.from_pylist(held, schema=target).to_batches()
                held = []
        yield from pa.Table.from_pylist(held, schema=target).to_batches()


def records(fs, path: str, begin: int, end: int) -> Iterator[dict]:
    """The rows of the blocks whose sync marker before them begins in [begin, end)."""
    with fs.open_input_file(path) as raw:
        meta, sync, length = header(raw)
        get = decoder(json.loads(meta["avro.schema"]))
        codec = meta.get("avro.codec", b"null").decode()
        if begin < length:
            raw.seek(length)
        else:  # find the marker that is the first to begin in this split
            raw.seek(begin)
            found = raw.read(end - begin + SYNC).find(sync)
            if found < 0:
                return
            raw.seek(begin + found + SYNC)
        size = raw.size()
        while raw.tell() < size and raw.tell() - SYNC < end:
            at = raw.tell()
            lead = io.BytesIO(raw.read(20))
            n, bytes_ = get_long(lead), get_long(lead)
            raw.seek(at + lead.tell())
            block = raw.read(bytes_)
            if raw.read(SYNC) != sync:
                raise ValueError(f"a block of {path} ends without its marker")
            if codec == "deflate":
                block = zlib.decompress(block, -15)
            elif codec == "zstandard":
                import zstandard

                block = zstandard.ZstdDecompressor().decompressobj().decompress(block)
            elif codec != "null":
                raise ValueError(f"unknown codec {codec} in {path}")
            rows = io.BytesIO(block)
            for _ in range(n):
                yield get(rows)


class Container:
    """One file that is being written."""

    def __init__(self, fs, path: str, schema: StructType, codec: str, meta: dict[str, str]) -> None:
        text = json.dumps(record_schema(schema))
        self.put, self.codec, self.sync = encoder(json.loads(text)), codec, uuid.uuid4().bytes
        self.out = fs.open_output_stream(path)
        head = bytearray(MAGIC)
        entries = {"avro.schema": text, "avro.codec": codec} | meta
        put_long(head, len(entries))
        for k, v in entries.items():
            put_bytes(head, k.encode())
            put_bytes(head, v.encode())
        head.append(0)
        self.out.write(bytes(head) + self.sync)

    def write(self, rows: list[dict]) -> None:
        for at in range(0, len(rows), BLOCK_ROWS):
            part, body = rows[at : at + BLOCK_ROWS], bytearray()
            for r in part:
                self.put(body, r)
            if self.codec == "deflate":
                c = zlib.compressobj(6, zlib.DEFLATED, -15)
                body = c.compress(bytes(body)) + c.flush()
            lead = bytearray()
            put_long(lead, len(part))
            put_long(lead, len(body))
            self.out.write(bytes(lead) + bytes(body) + self.sync)

    def close(self) -> None:
        self.out.close()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class AvroWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, layout: bool, codec: str) -> None:
        if codec not in ("null", "deflate"):
            raise ValueError("codec is null or deflate")
        self.path, self.schema, self.overwrite, self.layout, self.codec = path.rstrip("/"), schema, overwrite, layout, codec
        self.attempt = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, base = filesystem(self.path)
        temporary = f"{base}/_temporary-{self.attempt}"
        fs.create_dir(temporary, recursive=True)
        task, done, open_, own = TaskContext.get(), [], None, None
        data = StructType([f for f in self.schema.fields if not (self.layout and f.name in ("bucket_id", "shard_id"))])
        for b in iterator:
            rows = b.to_pylist()
            at = 0
            while at < len(rows):
                key = (rows[at]["bucket_id"], rows[at]["shard_id"]) if self.layout else (task.partitionId(), 0)
                to = at
                while to < len(rows) and (not self.layout or (rows[to]["bucket_id"], rows[to]["shard_id"]) == key):
                    to += 1
                if key != own:
                    if open_:
                        open_.close()
                    name = file_name(*key, "avro") if self.layout else f"part-{key[0]:05d}.avro"
                    meta = {"bucketloom.bucketId": str(key[0]), "bucketloom.shardId": str(key[1])} if self.layout else {}
                    done.append((f"{temporary}/{task.taskAttemptId()}-{name}", f"{base}/{name}"))
                    open_, own = Container(fs, done[-1][0], data, self.codec, meta), key
                open_.write(rows[at:to])
                at = to
        if open_:
            open_.close()
        return Written(done)

    def commit(self, messages: list) -> None:
        fs, base = filesystem(self.path)
        if self.overwrite:
            for p, _ in listed(self.path):
                fs.delete_file(p)
        for m in messages:
            for a, b in m.files if m else ():
                fs.move(a, b)
        self._clear(fs, base)

    def abort(self, messages: list) -> None:
        self._clear(*filesystem(self.path))

    def _clear(self, fs, base: str) -> None:
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{base}/_temporary-{self.attempt}").type == FileType.Directory:
            fs.delete_dir(f"{base}/_temporary-{self.attempt}")


def write_avro(df: DataFrame, path: str, codec: str = "deflate") -> None:
    df.sparkSession.dataSource.register(AvroSource)
    df.write.format("bucketloom_avro").option("codec", codec).mode("append").save(path)


def write_avro_layout(df: DataFrame, key: str | list[str], n: int, path: str, shard=None, hasher: str = "murmur3") -> None:
    """The directory layout in containers: part-b-s.avro, sorted, bucket and shard in the header; no file for an empty bucket."""
    keys = key_list(key)
    t = placed(df, keys, n, hasher, shard).repartition("bucket_id", "shard_id").sortWithinPartitions("bucket_id", "shard_id", *sort_key(df.schema, keys))
    df.sparkSession.dataSource.register(AvroSource)
    t.write.format("bucketloom_avro").option("layout", "true").mode("append").save(path)


def layout_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bucket_id, shard_id) of an Avro layout, from the headers."""
    rows = []
    for h in read_headers(path):
        if "bucketloom.bucketId" not in h or "bucketloom.shardId" not in h:
            raise ValueError(f"no bucket and shard in the header of {h['file']}")
        rows.append((h["file"], int(h["bucketloom.bucketId"]), int(h["bucketloom.shardId"])))
    return spark.createDataFrame(rows, "file string, bucket_id int, shard_id int").orderBy(F.col("file"))
