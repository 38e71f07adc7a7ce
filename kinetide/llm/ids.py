"""Token ids as files, with keyed access through a minimal perfect hash.

Layout below one path, all written and read by Spark:
  blocks/  part int, seq int, n int, keys array<bigint>, lens array<int>, ids binary. Documents in ascending key order, each
           with the end id; ``ids`` is their raw little-endian ids, end to end (``width`` bytes each). A block closes at
           BLOCK_IDS ids and never cuts a document. Blocks are ordered by (part, seq).
  bases/   part, seq, base: ids of all blocks before.
  index/   one row per bucket of about BUCKET_KEYS keys: pilots (uint32 for each group of about four keys), and for each
           slot a fingerprint (uint32), the block and the place and length in it, and how many rows have the key.
A key's bucket, group and slot follow from its hash and one pilot, so a lookup needs one index row and one block. The index
is ordered by bucket and blocks by part and place, both in small row groups, so the few buckets and blocks that up to FEW
keys need are picked by the files' own statistics; for more keys, index and blocks are joined with the request.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import _texts, encoder, tokenizer_file
from .common import fresh_path, keyed_text

BLOCK_IDS = 1 << 17
BUCKET_KEYS = 1000
#: Keys, or blocks, up to which a request is pushed down to the files, and bytes of a row group.
FEW, ROW_GROUP = 1000, 4 << 20
END_ID = 1
BLOCK = "part int, seq int, n int, width int, keys array<bigint>, lens array<int>, ids binary"
INDEX = "bucket bigint, n int, pilots binary, prints binary, part binary, seq binary, at binary, len binary, rows binary"


def write_blocks(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode ``docs`` and write blocks/ and bases/. Null and empty texts are the end id alone; null keys come first; rows
    that share a key stay apart, in the order of their texts' hashes; an empty table writes no block."""
    spark = docs.sparkSession
    rows = keyed_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))

    def blocks(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        width, part, seq = enc.dtype.itemsize, TaskContext.get().partitionId(), 0
        keys, lens, ids = [], [], []

        def row():
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n": sum(lens), "width": width, "keys": keys, "lens": lens, "ids": b"".join(ids)}], schema=kind)

        kind = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("keys", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32())), ("ids", pa.binary())])
        total = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                for key, x in zip(some.column(0).to_pylist(), enc.encode(_texts(some)), strict=True):
                    keys.append(key)
                    lens.append(len(x) // width + 1)
                    ids += [x, end]
                    total += lens[-1]
                    if total >= BLOCK_IDS:
                        yield row()
                        keys, lens, ids, total, seq = [], [], [], 0, seq + 1
        if keys:
            yield row()

    order = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    order.mapInArrow(blocks, BLOCK).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/blocks")
    sizes = spark.read.schema(BLOCK).parquet(f"{path}/blocks").select("part", "seq", "n")
    parts = sizes.groupBy("part").agg(F.sum("n").alias("total"))  # one row per writing task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, F.col("part") == F.col("p"))
    bases.select("part", "seq", (F.col("first") + F.col("inside")).alias("base")).write.parquet(f"{path}/bases")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """key, part, seq, at, len of every document, from the blocks' own lists; the ids are not read."""

    def places(batches):
        for batch in batches:
            lens = batch.column(3)
            flat = lens.flatten().to_numpy()
            counts = pa.compute.list_value_length(lens).to_numpy()
            starts = np.cumsum(flat) - flat
            first = np.repeat(np.concatenate([[0], np.cumsum(np.add.reduceat(flat, np.cumsum(counts) - counts))[:-1]]), counts) if len(flat) else flat
            again = [pa.array(np.repeat(batch.column(i).to_numpy(), counts)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(2).flatten(), *again, pa.array(starts - first, pa.int64()), pa.array(flat, pa.int32())], ["key", "part", "seq", "at", "len"])

    return spark.read.schema(BLOCK).parquet(f"{path}/blocks").select("part", "seq", "keys", "lens").mapInArrow(places, "key long, part int, seq int, at long, len int")


def mix(x: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    """A 64-bit finaliser of ``x`` and ``salt``."""
    with np.errstate(over="ignore"):
        x = x ^ (np.asarray(salt, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slots(h: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """Each hash's slot among ``n``, by its group's pilot."""
    group = mix(h, 1) % np.uint64(len(pilots))
    return (mix(h, pilots[group.astype(np.int64)].astype(np.uint64) + np.uint64(2)) % np.uint64(n)).astype(np.int64)


def prints(h: np.ndarray) -> np.ndarray:
    return (mix(h, 0) >> np.uint64(32)).astype(np.uint32)


def find_pilots(h: np.ndarray, tries: int = 1 << 22) -> np.ndarray:
    """A pilot for each group so that all hashes have slots of their own, as many as hashes; largest groups first."""
    n = len(h)
    r = max(1, -(-n // 4))
    group = (mix(h, 1) % np.uint64(r)).astype(np.int64)
    pilots, free = np.zeros(r, np.uint32), np.ones(n, bool)
    by = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=r))
    for g in np.argsort(-np.bincount(group, minlength=r), kind="stable"):
        own = h[by[ends[g - 1] if g else 0 : ends[g]]]
        if not len(own):
            break
        step, first = 64, 0
        while True:
            if first > tries:
                raise ValueError("two keys have the same hash")
            at = (mix(own[None, :], np.arange(first + 2, first + step + 2, dtype=np.uint64)[:, None]) % np.uint64(n)).astype(np.int64)
            ok = free[at].all(axis=1)
            if len(own) > 1:
                s = np.sort(at, axis=1)
                ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if ok.any():
                k = int(ok.argmax())
                pilots[g] = first + k
                free[at[k]] = False
                break
            first, step = first + step, min(step * 2, 4096)
    return pilots


def _bucket(n):
    return F.pmod(F.xxhash64("key"), F.lit(n))


def write_index(spark: SparkSession, path: str) -> None:
    """Write index/ over the keys of blocks/. A key that many rows share has one slot, with the place of its first row and
    their number; the rows are neighbours in the blocks. Buckets hold distinct keys by hash, so their sizes are even."""
    first = directory(spark, path).groupBy("key").agg(F.min(F.struct("part", "seq", "at", "len")).alias("p"), F.count(F.lit(1)).cast("int").alias("rows"))
    n = spark.read.schema(BLOCK).parquet(f"{path}/blocks").agg(F.sum(F.size("keys"))).first()[0] or 0
    buckets = max(1, -(-n // BUCKET_KEYS))
    rows = first.select(_bucket(buckets).alias("bucket"), F.struct(F.xxhash64("key").alias("h"), "p.*", "rows").alias("e")).repartitionByRange("bucket").groupBy("bucket").agg(F.collect_list("e").alias("e"))

    def build(batches):
        for batch in batches:
            for bucket, entries in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                e = entries.values
                h = e.field("h").to_numpy().astype(np.int64).view(np.uint64)
                pilots = find_pilots(h)
                to = np.argsort(slots(h, pilots, len(h)))
                kinds = {"part": np.int32, "seq": np.int32, "at": np.int64, "len": np.int32, "rows": np.int32}
                yield pa.RecordBatch.from_pylist(
                    [{"bucket": bucket, "n": len(h), "pilots": pilots.tobytes(), "prints": prints(h)[to].tobytes()} | {k: e.field(k).to_numpy().astype(t)[to].tobytes() for k, t in kinds.items()}],
                    schema=pa.schema([("bucket", pa.int64()), ("n", pa.int32()), *((k, pa.binary()) for k in ("pilots", "prints", "part", "seq", "at", "len", "rows"))]),
                )

    made = rows.mapInArrow(build, INDEX).withColumn("buckets", F.lit(buckets)).sortWithinPartitions("bucket")
    made.write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/index")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """key, part, seq, at, len, rows of those ``keys`` (column ``key``) that the index has. A key that was never indexed is
    returned with probability 2**-32, by its fingerprint."""
    index = spark.read.parquet(f"{path}/index")
    found = index.select("buckets").first()
    asked = keys.select("key").distinct().select(_bucket(found[0] if found else 1).alias("b"), "key", F.xxhash64("key").alias("h")).groupBy("b").agg(F.collect_list(F.struct("key", "h")).alias("asked"))

    def probe(batches):
        for batch in batches:
            out = []
            for r, asked in zip(batch.drop_columns(["asked"]).to_pylist(), batch.column(batch.schema.get_field_index("asked")), strict=True):
                h = asked.values.field("h").to_numpy().astype(np.int64).view(np.uint64)
                at = slots(h, np.frombuffer(r["pilots"], np.uint32), r["n"])
                known = np.frombuffer(r["prints"], np.uint32)[at] == prints(h)
                at = at[known]
                got = [pa.array(np.frombuffer(r[k], t)[at]) for k, t in (("part", np.int32), ("seq", np.int32), ("at", np.int64), ("len", np.int32), ("rows", np.int32))]
                out.append(pa.RecordBatch.from_arrays([asked.values.field("key").filter(pa.array(known)), *got], ["key", "part", "seq", "at", "len", "rows"]))
            yield from out

    if keys.limit(FEW + 1).count() <= FEW:
        index = index.where(F.col("bucket").isin([r[0] for r in asked.select("b").collect()]))
    both = index.join(asked, F.col("bucket") == F.col("b")).select("n", "pilots", "prints", "part", "seq", "at", "len", "rows", "asked")
    return both.mapInArrow(probe, "key long, part int, seq int, at long, len int, rows int")


def fetch(spark: SparkSession, path: str, places: DataFrame, result=None, schema: str = "ids array<bigint>", few: bool = False) -> DataFrame:
    """key, start (ids of all documents before it), n_tokens and the ids at ``places`` (key, part, seq, at, len), or what
    ``result(list of uint32 arrays)`` makes of them. A block's requests are joined with it, so each is read once; ``few``
    (FEW places at most) picks the blocks by their statistics."""
    asked = places.groupBy(F.col("part").alias("p"), F.col("seq").alias("s")).agg(F.collect_list(F.struct("key", "at", "len")).alias("asked"))
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks").select("part", "seq", "width", "ids")
    bases = spark.read.parquet(f"{path}/bases")
    if few:
        some = places.select("part", "seq").distinct().collect()  # FEW at most
        blocks = blocks.where(F.col("part").isin(sorted({r["part"] for r in some})) & F.col("seq").isin(sorted({r["seq"] for r in some})))
    asked = asked.join(bases, (F.col("p") == F.col("part")) & (F.col("s") == F.col("seq"))).select("p", "s", "base", "asked")
    both = blocks.join(asked, (F.col("p") == F.col("part")) & (F.col("s") == F.col("seq"))).select("base", "width", "ids", "asked")
    made = result or (lambda ids: [pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))])
    names = [x.split()[0] for x in schema.split(",")]

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                base, width, asked = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(3)[i].values
                raw = np.frombuffer(batch.column(2)[i].as_buffer(), f"<u{width}")
                at, n = asked.field("at").to_numpy(), asked.field("len").to_numpy()
                ids = [raw[a : a + k].astype("<u4") for a, k in zip(at.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([asked.field("key"), pa.array(at + base, pa.int64()), pa.array(n, pa.int64()), *made(ids)], ["key", "start", "n_tokens", *names])

    return both.mapInArrow(cut, f"key long, start long, n_tokens long, {schema}")


def crcs(ids: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]


def read_all(spark: SparkSession, path: str, keys: DataFrame, result=None, schema: str = "ids array<bigint>") -> DataFrame:
    """As fetch(), for every row of the files whose key is in ``keys``: each key through the index, and rows that repeat a
    key through the directory, as they are its neighbours."""
    found = lookup(spark, path, keys)
    if not found.where("rows > 1").isEmpty():
        first = found.where("rows > 1").select(F.col("key").alias("k"), "part", "seq", "at")
        every = directory(spark, path).alias("d").join(first.alias("f"), F.col("d.key").eqNullSafe(F.col("f.k")))
        later = ~((F.col("d.part") == F.col("f.part")) & (F.col("d.seq") == F.col("f.seq")) & (F.col("d.at") == F.col("f.at")))
        found = found.drop("rows").unionByName(every.where(later).select("d.*"))
    return fetch(spark, path, found, result, schema, few=keys.limit(FEW + 1).count() <= FEW)


def op4_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = fresh_path(spark, "ids")
    write_blocks(docs, path, tokenizer_file())
    write_index(spark, path)
    keys = docs.select(F.col("doc_id").cast("bigint").alias("key"))
    return read_all(spark, path, keys, crcs, "ids_crc32 long").withColumnRenamed("key", "doc_id")
