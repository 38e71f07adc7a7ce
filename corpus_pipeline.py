"""The corpus pipeline: documents to token ids, in five stages of whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it to the shared folder and the next stage
reads that. Texts stay where they are read: verdicts are made in the task that has the text, or only the texts that a
verdict concerns are moved. All stages do the same with odd input: an empty table gives an empty one; a null text is kept
null and counts as an empty one; texts of any length are read whole; rows that repeat, or share an id, are told apart by
id and text, and get a verdict each; columns beyond those of documents pass through, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetide.llm import bpe, decontam, neardup, quality, secrets
from kinetide.llm.common import among, among_bits, dropped, fresh_path, scratch, settled, stored


def _row(docs: DataFrame, *more: Column) -> DataFrame:
    """``docs`` as one struct column ``row``, beside ``more``: no name of theirs can clash with one of ours."""
    return docs.select(*more, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of fewer rows than Spark's default, as texts are long: a batch is held by the JVM and by Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier test of their language and source keep. Null and empty texts have no
    words and go."""
    names = [F.col("draw").alias("bd"), F.col("lang").alias("bl"), F.col("source").alias("bs"), F.xxhash64("draw", "lang", "source").alias("id")]
    bad = settled(spark, "pipeline-bad", lambda: quality.judged(docs).where("not kept").select(*names).distinct())
    draw = F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).alias("draw")
    rows = _row(docs, draw, F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    some, others = among_bits(rows, F.xxhash64("draw", "lang", "source"), bad, "id")
    left = some.join(bad, (F.col("draw") == F.col("bd")) & F.col("lang").eqNullSafe(F.col("bl")) & F.col("source").eqNullSafe(F.col("bs")), "left_anti").select("row")
    return (left if others is None else left.unionByName(others.select("row"))).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the least id, and of rows that tie at it, one. Texts without words are in no
    group and stay."""
    _small_batches(spark)
    found = settled(spark, "pipeline-clusters", lambda: neardup.clusters(docs, words=5, share=80))
    named = F.xxhash64("key", "hash").alias("id")
    gone = found.where("not kept").select("key", "hash", named)
    # Of a group's rows that tie at the least id, the one with the least hash stays, and of rows that repeat it, one.
    tied = found.where("kept and node is not null")
    ties = stored(tied.groupBy(F.col("group").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("one")).where("n > 1").drop("n"), "pipeline-ties")
    tied = tied.join(ties, F.col("group") == F.col("g"))
    marked = gone.withColumn("stays", F.lit(False)).unionByName(tied.select("key", "hash", named, (F.col("hash") == F.col("one")).alias("stays"))).distinct()
    marked = stored(marked, "pipeline-marked").select(F.col("key").alias("mk"), F.col("hash").alias("mh"), "id", "stays")
    key, own = F.col("doc_id").cast("bigint"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = _row(docs, key.alias("key"), own.alias("hash"))
    some, others = among(rows, F.xxhash64("key", "hash"), marked, "id")
    both = some.join(marked, F.col("key").eqNullSafe(F.col("mk")) & (F.col("hash") == F.col("mh")), "left")
    left = both.where("stays is null").select("row")
    again = both.where("stays").groupBy("key", "hash").agg(F.first("row").alias("row")).select("row")
    left = left.unionByName(again)
    return (left if others is None else left.unionByName(others.select("row"))).select("row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies inside windows of the benchmark; texts without words stay."""
    _small_batches(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and n_chars of the new text; null texts stay null."""
    _small_batches(spark)
    return secrets.redact(docs, fresh_path(spark, "ledger"), count_col="n_chars" if "n_chars" in docs.columns else None)


def _encoded(enc: bpe.Encoder, ids: list[bytes]) -> list[pa.Array]:
    count, said, decoded = bpe.digests(enc, ids)
    return [count, pa.array(ids, pa.binary()), said, decoded]


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, 16 bits each), ids_sha256 and decoded_sha256 (of the text that the ids decode
    to) of every document; null and empty texts have no ids."""
    _small_batches(spark)
    return bpe.encode(docs, bpe.tokenizer_file(), result=_encoded, schema="n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Robust covariances and tokenizers are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents. What a stage has stored is deleted once its result is written, and the result once the
    next stage's is."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        out = fresh_path(spark, "pipeline-stage")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        if path:
            dropped(spark, path)
        docs, path = spark.read.parquet(out), out
    return STAGES[-1][1](spark, docs, sf_dir)
