"""Queries that write and read back: pages as packed frames, orders as sealed shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetide.shared import fresh_path
from kinetide.sources import packed as P
from kinetide.sources import shards as S

from .tables import _read

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER")


def packed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty pages are an episode with frames of even numbers; every page asks for a frame, the odd ones for one that isn't
    there."""
    episode = F.floor(F.col("page_id") / 50).cast("string")
    pages = _read(spark, sf_dir, "pages").select(episode.alias("key"), (F.col("page_id") * 2).alias("frame"), F.encode("html", "UTF-8").alias("data"))
    path = fresh_path(spark, "packed")
    P.write_packed(pages, path, "key", "frame", "data")
    wanted = _read(spark, sf_dir, "pages").select(episode.alias("key"), (F.col("page_id") * 2 + F.col("page_id") % 2).alias("frame"))
    return P.read_packed(spark, path, wanted).select("key", "frame", F.sha2("data", 256).alias("sha256"))


PACKED_SQL = """WITH f AS (SELECT CAST(page_id // 50 AS VARCHAR) AS key, page_id * 2 AS frame, html FROM pages WHERE html IS NOT NULL),
z AS (SELECT key, max(frame) AS last FROM f GROUP BY key),
w AS (SELECT CAST(page_id // 50 AS VARCHAR) AS key, page_id * 2 + page_id % 2 AS frame FROM pages),
a AS (SELECT w.key, w.frame, coalesce(f.frame, z.last) AS at FROM w LEFT JOIN f ON f.key = w.key AND f.frame = w.frame LEFT JOIN z ON z.key = w.key)
SELECT a.key, a.frame, sha256(f.html) AS sha256 FROM a LEFT JOIN f ON f.key = a.key AND f.frame = a.at"""


def sealed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority, one of which has none; rows as the manifest has them and as they are read back."""
    orders, path = _read(spark, sf_dir, "orders"), fresh_path(spark, "sealed")
    manifest = S.write_sealed(orders, path, "o_orderpriority", list(PRIORITIES), ["o_orderkey"]).groupBy("o_orderpriority").agg(F.sum("n").alias("listed"))
    back = S.read_sealed(spark, path, "o_orderpriority").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
    return manifest.join(back, "o_orderpriority", "left").select("o_orderpriority", "listed", F.coalesce("n", F.lit(0)).alias("n"), "keys")


SEALED_SQL = f"""SELECT p AS o_orderpriority, count(o_orderkey) AS listed, count(o_orderkey) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys
FROM (SELECT unnest([{", ".join(f"'{p}'" for p in PRIORITIES)}]) AS p) LEFT JOIN orders ON o_orderpriority = p GROUP BY p"""

QUERIES = {"packed_frames": (packed_frames, PACKED_SQL), "sealed_shards": (sealed_shards, SEALED_SQL)}
