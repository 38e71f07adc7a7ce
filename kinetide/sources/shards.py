"""Shards by label that become visible all at once or not at all.

Each write has a folder of its own below ``path``: the shards, then a manifest of their files with rows, bytes and SHA-256.
Only when both are complete one small file, ``_current``, is moved into place; it names the folder. A write that is killed
leaves a folder that nothing names, and a retry is a write of its own, so files and digests are always of one attempt.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetide.operators.relational import require_none

CURRENT = "_current"
MANIFEST = "`{}` string, file string, n long, bytes long, sha256 string"


class Pointer:
    """A small file that is replaced by one move, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.sc = spark._jvm, spark.sparkContext
        self.path = self.jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{CURRENT}")
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.conf = spark._jsc.hadoopConfiguration()

    def get(self) -> str | None:
        if not self.fs.exists(self.path):
            return None
        stream = self.fs.open(self.path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, text: str) -> None:
        made = self.jvm.org.apache.hadoop.fs.Path(self.path.getParent(), f".{uuid.uuid4().hex}")
        stream = self.fs.create(made, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        how = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.sc._gateway.new_array(how, 1)
        options[0] = how.OVERWRITE
        uri = self.fs.makeQualified(made).toUri()
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.conf).rename(self.fs.makeQualified(made), self.fs.makeQualified(self.path), options)

    def drop(self, folder: str) -> None:
        self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(self.path.getParent(), folder), True)


def _files(spark: SparkSession, shards: str, label: str) -> DataFrame:
    """label, file (below the folder of the write), n, bytes, sha256; each file is read by one task for its digest."""
    name = lambda c: F.regexp_extract(c, r"(shards/.*)$", 1)
    rows = spark.read.parquet(shards).groupBy(F.col(f"`{label}`").cast("string").alias(label), name(F.col("_metadata.file_path")).alias("file")).agg(F.count(F.lit(1)).alias("n"))
    digests = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(shards)
    digests = digests.select(name(F.col("_metadata.file_path")).alias("_f"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return rows.join(digests, F.col("file") == F.col("_f")).drop("_f")


def write_sealed(df: DataFrame, path: str, label: str, names: list[str], order: list[str], faults: DataFrame | None = None, apply: bool = True, keep: bool = False) -> DataFrame | None:
    """One folder of shards for each label of ``names``, in ranges of ``order``; returns the manifest: label, file, n, bytes,
    sha256, with n of 0 and no file for labels without rows. Rows of other labels are left out. Nothing is written if there is
    a fault (an error) or ``apply`` is false; the write before stays until the new one is visible, and after it with ``keep``."""
    spark = df.sparkSession
    if faults is not None:
        require_none(faults, "faults")
    if not apply:
        return None
    pointer, folder = Pointer(spark, path), f"write-{uuid.uuid4().hex}"
    before, root = pointer.get(), f"{path.rstrip('/')}/{folder}"
    kept = df.where(F.col(f"`{label}`").isin(names))
    kept.repartitionByRange(f"`{label}`", *order).sortWithinPartitions(f"`{label}`", *order).write.partitionBy(label).parquet(f"{root}/shards")
    every = spark.createDataFrame([(x,) for x in names], f"`{label}` string")
    if kept.isEmpty():
        found = every.select(F.col(f"`{label}`"), F.lit(None).cast("string").alias("file"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("bytes"), F.lit(None).cast("string").alias("sha256"))
    else:
        found = every.join(_files(spark, f"{root}/shards", label), label, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    found.coalesce(1).write.option("ignoreNullFields", "false").json(f"{root}/manifest")  # a row for each file
    pointer.put(folder)
    if before and not keep:
        pointer.drop(before)
    return manifest(spark, path, label)


def manifest(spark: SparkSession, path: str, label: str) -> DataFrame:
    """The files of the visible write; an error without one."""
    folder = Pointer(spark, path).get()
    if folder is None:
        raise FileNotFoundError(f"nothing was written to {path}")
    return spark.read.schema(MANIFEST.format(label)).json(f"{path.rstrip('/')}/{folder}/manifest")


def read_sealed(spark: SparkSession, path: str, label: str, schema: str | None = None) -> DataFrame:
    """Rows of the visible write."""
    folder = Pointer(spark, path).get()
    if folder is None:
        raise FileNotFoundError(f"nothing was written to {path}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path.rstrip('/')}/{folder}/shards").withColumn(label, F.col(f"`{label}`").cast("string"))


def damaged(spark: SparkSession, path: str, label: str) -> DataFrame:
    """Files of the manifest that are gone or have other bytes: label, file."""
    known = manifest(spark, path, label).where("file is not null")
    now = _files(spark, f"{path.rstrip('/')}/{Pointer(spark, path).get()}/shards", label).select(F.col("file").alias("_f"), F.col("sha256").alias("_s"))
    return known.join(now, (F.col("file") == F.col("_f")) & (F.col("sha256") == F.col("_s")), "left_anti").select(label, "file")
