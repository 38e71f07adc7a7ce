"""Paths and tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path below ``spark.checkpoint.dir`` that no other run uses. Only where that setting is absent (tests, a laptop) it is
    below the warehouse; on a cluster whose warehouse is a local folder that is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not spark.sparkContext.master.startswith("local") and (warehouse.startswith("/") or warehouse.startswith("file:")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{warehouse}/_shared"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to a path of its own and read back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
