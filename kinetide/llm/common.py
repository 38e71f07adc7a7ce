"""Helpers shared by the training-data operators: the shared folder, row keys and whole-text views."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that setting is absent (tests, a laptop) a folder below the warehouse is set. On a cluster whose warehouse is
    a local folder there is none to set, which is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not spark.sparkContext.master.startswith("local") and (base.startswith("/") or base.startswith("file:")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"{base}/_shared"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths made within each open scratch(), the innermost last.
_MADE: list[list[str]] = []


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are stored within are deleted at its end; nothing that reads them may be used after it."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            dropped(spark, path)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: cuts lineage, survives lost executors,
    and gives the planner true sizes to choose its joins by."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, tag: str, make) -> DataFrame:
    """What ``make()`` returns, stored; all tables that it stores on the way are deleted."""
    path = fresh_path(spark, tag)
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``key`` (bigint) and ``text`` (null: empty), whatever other columns there are."""
    return df.select(F.col(id_col).cast("bigint").alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def let(value: Column, body) -> Column:
    """``body`` of a value computed once for the row, as higher-order functions would otherwise compute it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


class KeyFilter:
    """A Bloom filter of 64-bit keys, sized by their number. A key that is in by chance must only cost work."""

    #: Bits for each key, bits set for each, and the most bits of a filter (32 MB).
    EACH, HASHES, MOST = 16, 5, 1 << 28

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @staticmethod
    def places(keys: np.ndarray, bits: int):
        """The places of each hash function, over a 64-bit mix of the keys."""
        with np.errstate(over="ignore"):
            x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            step = (x * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
            for k in range(KeyFilter.HASHES):
                yield ((x + np.uint64(k) * step) >> np.uint64(16)) & np.uint64(bits - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each of ``keys`` (int64) may be in the filter."""
        keys = np.ascontiguousarray(keys, np.int64)
        out = np.ones(len(keys), bool)
        for at in self.places(keys, self.bits):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def key_filter(keys: DataFrame, column: str) -> KeyFilter | None:
    """The filter of a bigint column (no nulls), or None where it would be larger than MOST bits: the keys then have to be
    joined. Tasks set the bits, words are merged before and after one shuffle, and only the words come to the driver."""
    n = keys.count()
    if n * KeyFilter.EACH > KeyFilter.MOST:
        return None
    bits = max(1 << 12, 1 << (n * KeyFilter.EACH - 1).bit_length()) if n else 1 << 12

    def words(batches):
        for batch in batches:
            own = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            at = np.unique(np.concatenate(list(KeyFilter.places(own, bits)))) if len(own) else np.zeros(0, np.uint64)
            place, start = np.unique((at >> np.uint64(6)).astype(np.int32), return_index=True)
            one = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(one.view(np.int64))], ["word", "one"])

    made = keys.select(F.col(column).cast("bigint").alias("key")).mapInArrow(words, "word int, one long").groupBy("word").agg(F.bit_or("one").alias("one")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[made.column("word").to_numpy()] = made.column("one").to_numpy().view(np.uint64)
    return KeyFilter(bits, out)


def among(docs: DataFrame, key: Column, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` in two parts: rows whose bigint ``key`` (no null) may be among ``keys``, and rows whose key is not.

    Few rows besides those that are among them are in the first part, so that a join with ``keys`` moves few texts. Where
    there are too many keys for a filter, all rows are in the first part and there is no second."""
    found = key_filter(keys, column)
    if found is None:
        return docs, None
    shared = docs.sparkSession.sparkContext.broadcast(found)

    @F.arrow_udf("boolean")
    def has(x: pa.Array) -> pa.Array:
        return pa.array(shared.value.has(x.to_numpy(zero_copy_only=False)))

    maybe = has(key)
    return docs.where(maybe), docs.where(~maybe)


def among_bits(docs: DataFrame, key: Column, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame | None]:
    """As among(), by DataFrame operations alone: one bit for each key, of 32 times as many (and KeyFilter.MOST, 32 MB, at
    most), in bitmaps that are broadcast and joined by bucket. About one row in 32 is in the first part by chance."""
    n = keys.count()
    if n * 32 > KeyFilter.MOST:
        return docs, None
    bits = max(1 << 16, 1 << (n * 32 - 1).bit_length()) if n else 1 << 16
    at = lambda c: F.pmod(c, F.lit(bits).cast("bigint")) + 1
    maps = keys.select(at(F.col(column)).alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    both = docs.withColumn("_at", at(key)).join(F.broadcast(maps), F.bitmap_bucket_number("_at") == F.col("_bucket"), "left")
    place = F.bitmap_bit_position("_at").cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return both.where(maybe).select(docs.columns), both.where(~maybe).select(docs.columns)


def pieces(batch: pa.RecordBatch, column: int, most: int):
    """``batch`` in runs of rows whose texts (``column``) have about ``most`` bytes in all; a longer text is alone."""
    if batch.num_rows == 0:
        return
    size = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = (np.cumsum(size) - size) // most
    cut = np.flatnonzero(np.diff(run, prepend=-1))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)
