"""Verbs of the offline pipeline: python -m kinetide build|split|weights|stats|jobs|pack|cache|prepare INPUT OUTPUT [--apply].

build    predictions (Parquet: task_id, episode_id, skill_timeline, n_rows) to segments
split    segments to one folder for each label and a manifest with digests, which become visible together
weights  segments to a weight for each sample
stats    frames (Parquet: an array column ``action``) to statistics by component
jobs     segments (head_video, start_idx, end_idx) to the frames from which windows may start
cache    frames (key, frame, data) that are not yet packed below OUTPUT are added to it
pack     frames (key, frame, data) to one packed file for each key
prepare  episodes (Parquet files with state and action) to one table of their numbered frames
Without --apply nothing is written and counts are printed.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetide.functions.text import LABELS
from kinetide.operators import relational, sampling, segments, vectors
from kinetide.sources import packed, records, shards


def build(df: DataFrame) -> DataFrame:
    return segments.projected(df, "skill_timeline", ["task_id", "episode_id"], "n_rows", 5.0)


def kept(df: DataFrame) -> DataFrame:
    return df.where((F.col("skill_canonical") != "other") & (F.col("n_frames") >= segments.SHORT))


def weights(df: DataFrame, alpha: float = 0.5) -> DataFrame:
    each = sampling.class_weights(kept(df), "skill_canonical", alpha)
    return relational.looked_up(kept(df), each, "skill_canonical", "weight").select("sample_id", F.round("weight", 6).alias("weight"))


def jobs(df: DataFrame) -> DataFrame:
    return segments.frame_jobs(df, ["head_video"], "start_idx", "end_idx", 50)


def uncached(df: DataFrame, path: str) -> DataFrame:
    """Frames of keys that have no file below ``path`` yet."""
    done = packed.listing(df.sparkSession, path).select(F.col("key").alias("_done"))
    return df.join(done, F.col("key") == F.col("_done"), "left_anti")


VERBS = {"build": build, "weights": weights, "stats": lambda df: vectors.vector_stats(df, "action"), "jobs": jobs}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kinetide", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("verb", choices=[*VERBS, "split", "pack", "cache", "prepare"])
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--apply", action="store_true")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if given.verb == "prepare":
        out = records.episodes(spark, given.input)
        if given.apply:
            out.write.parquet(given.output)
        else:
            records.row_counts(spark, given.input).show(truncate=False)
        return 0
    df = spark.read.parquet(given.input)
    if given.verb == "split":
        if given.apply:
            shards.write_sealed(kept(df), given.output, "skill_canonical", list(LABELS[:-1]), ["sample_id"]).show(truncate=False)
        else:
            relational.counts_of(kept(df), "skill_canonical", list(LABELS[:-1])).show()
        return 0
    if given.verb in ("pack", "cache"):
        rows = df if given.verb == "pack" else uncached(df, given.output)
        if given.apply:
            packed.write_packed(rows, given.output, "key", "frame", "data", mode="overwrite" if given.verb == "pack" else "append")
        else:
            print(f"{rows.count()} frames; --apply writes them")
        return 0
    out = VERBS[given.verb](df)
    if given.apply:
        out.write.parquet(given.output)
    else:
        print(f"{out.count()} rows; --apply writes them")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
