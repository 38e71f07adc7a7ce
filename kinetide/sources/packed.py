"""Packed frames as a data source: one indexed binary file for each episode, and one manifest that makes a write visible.

A file is the number of its frames (8 bytes, unsigned, little-endian), for each frame its number, its offset in the data and
its length (8 bytes each, signed), then the data. Files lie below ``path`` in a folder of the write; a task lists its files in
one of its own, with size and SHA-256, and only lists that the manifest names are read. The manifest is put in place by one
move, so a write that is killed leaves nothing visible, and files of an attempt that was lost or repeated are never seen.

Files are reached through pyarrow's file systems (local, HDFS, S3, GCS), which read and write at the store itself.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fixed layout: the number of frames, and an entry of the index.
HEAD, ENTRY = struct.Struct("<Q"), struct.Struct("<qqq")
MANIFEST = "_manifest.json"
FRAMES = "key string, frame long, data binary"
#: What a writer's task is given, in the order of key, part (0: entries of the index, 1: data) and frame.
PARTS = "key string, part int, frame long, n long, at long, size long, data binary"
BATCH = 8 << 20


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _manifest(fs: pafs.FileSystem, root: str) -> list[dict]:
    """Lists of the files that are visible: name, first and last key."""
    if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.NotFound:
        return []
    with fs.open_input_file(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())["lists"]


class Packed:
    """One file, read by ranges: its index at first, then only what is asked for."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        n = HEAD.unpack(self.file.read_at(HEAD.size, 0))[0]
        self.index = {frame: (at, size) for frame, at, size in ENTRY.iter_unpack(self.file.read_at(n * ENTRY.size, HEAD.size))}
        self.start = HEAD.size + n * ENTRY.size

    def get(self, frame: int) -> bytes:
        at, size = self.index[frame]
        return self.file.read_at(size, self.start + at)

    def last(self) -> int | None:
        return max(self.index, default=None)


@dataclass
class Lists(InputPartition):
    names: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    name: str | None = None
    first: str | None = None
    last: str | None = None


class Reader(DataSourceReader):
    """A partition for each list. Equality and membership of key and frame are pushed down: lists are left out by their keys,
    files by their key, and of a file only the asked frames' ranges are read."""

    def __init__(self, path: str):
        self.path = path
        self.keys: set | None = None
        self.frames: set | None = None

    def pushFilters(self, filters):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("key",), ("frame",)):
                yield f
            elif f.attribute == ("key",):
                self.keys = values if self.keys is None else self.keys & values
            else:
                self.frames = values if self.frames is None else self.frames & values

    def partitions(self):
        fs, root = _opened(self.path)
        return [Lists((x["name"],)) for x in _manifest(fs, root) if self.keys is None or any(x["first"] <= k <= x["last"] for k in self.keys)] or [Lists(())]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(self.path)
        for name in partition.names:
            with fs.open_input_file(f"{root}/{name}") as f:
                entries = [json.loads(line) for line in f.read().splitlines()]
            for e in entries:
                if self.keys is not None and e["key"] not in self.keys:
                    continue
                packed = Packed(fs, f"{root}/{e['file']}")
                wanted = sorted(packed.index if self.frames is None else set(packed.index) & self.frames)
                yield from _batches(e["key"], packed, wanted)


def _batches(key: str, packed: Packed, wanted: list[int]) -> Iterator[pa.RecordBatch]:
    """Frames in batches of about BATCH bytes."""
    rows, held = [], 0
    for frame in wanted:
        rows.append((frame, packed.get(frame)))
        held += len(rows[-1][1])
        if held >= BATCH or frame == wanted[-1]:
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["key", "frame", "data"])
            rows, held = [], 0


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, f"write-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        """Rows of PARTS; everything is written as it comes, so no episode is held."""
        fs, root = _opened(self.path)
        fs.create_dir(f"{root}/{self.job}", recursive=True)
        attempt, entries, out, key, seen = uuid.uuid4().hex, [], None, None, None

        def close():
            out[0].close()
            entries.append({"key": key, "file": out[1], "n": out[2], "bytes": out[4], "sha256": out[3].hexdigest()})

        def put(data: bytes):
            out[0].write(data)
            out[3].update(data)
            out[4] += len(data)

        for row in iterator:
            if row.key != key:
                if out:
                    close()
                key, seen = row.key, None
                name = f"{self.job}/{attempt}-{len(entries)}.pak"
                out = [fs.open_output_stream(f"{root}/{name}"), name, row.n, hashlib.sha256(), 0]
                put(HEAD.pack(row.n))
            if row.part == 0:
                if row.frame == seen:
                    raise ValueError(f"frame {seen} of {key} is there twice")
                seen = row.frame
                put(ENTRY.pack(row.frame, row.at, row.size))
            else:
                put(bytes(row.data))
        if out is None:
            return Written()
        close()
        name = f"{self.job}/{attempt}.list"
        with fs.open_output_stream(f"{root}/{name}") as f:
            f.write("".join(json.dumps(e) + "\n" for e in entries).encode())
        return Written(name, entries[0]["key"], entries[-1]["key"])

    def commit(self, messages) -> None:
        fs, root = _opened(self.path)
        before = _manifest(fs, root)
        lists = [{"name": m.name, "first": m.first, "last": m.last} for m in messages if m and m.name]
        fs.create_dir(root, recursive=True)
        made = f"{root}/.{self.job}.json"
        with fs.open_output_stream(made) as f:
            f.write(json.dumps({"lists": lists if self.overwrite else before + lists}).encode())
        fs.move(made, f"{root}/{MANIFEST}")
        kept = {posixpath.basename(x["name"]).split(".")[0] for x in lists}
        for info in fs.get_file_info(pafs.FileSelector(f"{root}/{self.job}", allow_not_found=True)):
            if posixpath.basename(info.path).split(".")[0].split("-")[0] not in kept:  # of attempts that were repeated
                fs.delete_file(info.path)
        for job in {posixpath.dirname(x["name"]) for x in before} if self.overwrite else ():
            fs.delete_dir(f"{root}/{job}")

    def abort(self, messages) -> None:
        fs, root = _opened(self.path)
        if fs.get_file_info(f"{root}/{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.job}")


class PackedFrames(DataSource):
    """``spark.read.format("packed").load(path)``: key, frame, data."""

    @classmethod
    def name(cls) -> str:
        return "packed"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def write_packed(frames: DataFrame, path: str, key: str, frame: str, data: str, mode: str = "append") -> None:
    """Frames by key, in ranges of keys; a frame that occurs twice is an error, and rows without key, frame or data are left
    out. Offsets are a running sum over lengths, so an episode of any size is streamed into its file."""
    spark = frames.sparkSession
    spark.dataSource.register(PackedFrames)
    rows = frames.select(F.col(key).cast("string").alias("key"), F.col(frame).cast("bigint").alias("frame"), F.col(data).cast("binary").alias("data")).dropna()
    order = F.expr("sum(size) over (partition by key order by frame rows between unbounded preceding and current row) - size")
    sizes = rows.select("key", "frame", F.octet_length("data").cast("bigint").alias("size")).select("key", F.lit(0).alias("part"), "frame", F.expr("count(*) over (partition by key)").alias("n"), order.alias("at"), "size", F.lit(None).cast("binary").alias("data"))
    own = rows.select("key", F.lit(1).alias("part"), "frame", *[F.lit(None).cast("bigint").alias(c) for c in ("n", "at", "size")], "data")
    both = sizes.unionByName(own).repartitionByRange("key").sortWithinPartitions("key", "part", "frame")
    both.write.format("packed").mode(mode).save(path)


def packed_table(spark: SparkSession, path: str) -> DataFrame:
    """key, frame, data of all frames."""
    spark.dataSource.register(PackedFrames)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("packed").load(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """key, file, n, bytes, sha256 of the visible files."""
    fs, root = _opened(path)
    names = [f"{path.rstrip('/')}/{x['name']}" for x in _manifest(fs, root)]
    schema = "key string, file string, n long, bytes long, sha256 string"
    return spark.read.schema(schema).json(names) if names else spark.createDataFrame([], schema)


def read_packed(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """key, frame and data of each wanted frame; of the key's last frame where it has no such frame, null where the key has
    none. Wanted frames are dealt by file and a range of frames, so a task opens a file once and reads only what it is asked
    for; many frames of one file are many tasks."""
    files = listing(spark, path).where("n > 0").select(F.col("key").alias("fk"), "file", F.col("n").alias("_n"))
    rows = wanted.select(F.col("key").cast("string").alias("key"), F.col("frame").cast("bigint").alias("frame"))
    asked = rows.join(files, F.col("key") == F.col("fk"), "left").drop("fk", "_n")
    asked = asked.withColumn("_part", F.floor(F.col("frame") / 1024)).repartition("file", "_part").sortWithinPartitions("file", "frame").drop("_part")

    def each(batches):
        fs, root = _opened(path)
        held = (None, None)
        for batch in batches:
            for some in range(0, batch.num_rows, 64):  # few frames at once
                part, out = batch.slice(some, 64), []
                for file, frame in zip(part.column(2).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if file != held[0]:
                        held = (file, Packed(fs, f"{root}/{file}") if file else None)
                    out.append(held[1].get(frame if frame in held[1].index else held[1].last()) if file else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], ["key", "frame", "data"])

    return asked.select("key", "frame", "file").mapInArrow(each, FRAMES)
