"""Packed frames and sealed shards: round trips, ranges, failed writes."""

import glob
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from kinetide.sources import packed as P
from kinetide.sources import shards as S

SCHEMA = "k string, f long, d binary, other int"


def frames(spark, keys="abcde", n=40):
    rows = [(k, f * 2, f"{k}{f}".encode() * (f % 7), 1) for k in keys for f in range(n)]
    return rows, spark.createDataFrame([*rows, ("z", None, b"x", 1), (None, 3, b"x", 1), ("y", 1, None, 1)], SCHEMA).repartition(5)


def test_packed_round_trip(spark, tmp_path):
    path = str(tmp_path / "p")
    rows, df = frames(spark)
    P.write_packed(df, path, "k", "f", "d")
    assert sorted(map(tuple, P.packed_table(spark, path).collect())) == sorted(r[:3] for r in rows)
    files = {r["key"]: r for r in P.listing(spark, path).collect()}
    assert sorted(files) == list("abcde")
    for k, r in files.items():
        data = (tmp_path / "p" / r["file"]).read_bytes()
        assert (r["n"], r["bytes"], r["sha256"]) == (40, len(data), hashlib.sha256(data).hexdigest())
        assert data[:8] == (40).to_bytes(8, "little") and data[8 + 24 * 40 :] == b"".join(x[2] for x in rows if x[0] == k)


def test_pushed_filters_read_only_their_ranges(spark, tmp_path):
    path = str(tmp_path / "p")
    P.write_packed(frames(spark)[1], path, "k", "f", "d")
    for r in P.listing(spark, path).collect():  # all other data are made unreadable
        if r["key"] != "c":
            (tmp_path / "p" / r["file"]).write_bytes(b"")
    one = P.packed_table(spark, path).where("key = 'c' and frame in (6, 8, 9)").orderBy("frame")
    assert [tuple(r) for r in one.collect()] == [("c", 6, b"c3" * 3), ("c", 8, b"c4" * 4)]
    assert P.packed_table(spark, path).where("key = 'c' and frame > 70").count() == 4
    assert P.packed_table(spark, path).where("key = 'none'").count() == 0


def test_lookup_takes_the_last_frame_where_one_is_missing(spark, tmp_path):
    path = str(tmp_path / "p")
    P.write_packed(frames(spark)[1], path, "k", "f", "d")
    wanted = spark.createDataFrame([("a", 4), ("a", 4), ("a", 5), ("b", 1000), ("none", 3), ("e", -1)], "key string, frame int").repartition(3)
    got = sorted((tuple(r) for r in P.read_packed(spark, path, wanted).collect()), key=str)
    assert got == sorted([("a", 4, b"a2a2"), ("a", 4, b"a2a2"), ("a", 5, b"a39" * 4), ("b", 1000, b"b39" * 4), ("e", -1, b"e39" * 4), ("none", 3, None)], key=str)
    assert P.read_packed(spark, path, wanted.limit(0)).collect() == []


def test_writes_are_appended_replaced_or_nothing(spark, tmp_path):
    path = str(tmp_path / "p")
    assert P.packed_table(spark, path).count() == 0
    P.write_packed(frames(spark, "a")[1], path, "k", "f", "d")
    P.write_packed(frames(spark, "b")[1], path, "k", "f", "d")
    assert {r["key"] for r in P.packed_table(spark, path).collect()} == {"a", "b"}
    twice = frames(spark, "c")[1]
    for bad in (twice.unionByName(twice.limit(1)), twice.withColumn("d", F.when(F.col("f") == 40, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("d")))):
        with pytest.raises(Exception):  # noqa: B017
            P.write_packed(bad, path, "k", "f", "d", mode="overwrite")
    assert P.packed_table(spark, path).count() == 80
    assert len(glob.glob(f"{path}/write-*")) == 2  # folders of failed writes are gone
    P.write_packed(frames(spark, "d")[1], path, "k", "f", "d", mode="overwrite")
    assert {r["key"] for r in P.packed_table(spark, path).collect()} == {"d"} and len(glob.glob(f"{path}/write-*")) == 1


def test_files_of_repeated_attempts_are_not_seen(spark, tmp_path):
    """A task that ran twice leaves files of both attempts; only those of the one that was committed count."""
    writer = P.Writer(str(tmp_path / "p"), False)
    from pyspark.sql import Row

    part = [Row(key="a", part=0, frame=1, n=1, at=0, size=2, data=None), Row(key="a", part=1, frame=1, n=None, at=None, size=None, data=b"xy")]
    lost, kept = writer.write(iter(part)), writer.write(iter(part))
    assert P.packed_table(spark, str(tmp_path / "p")).count() == 0
    writer.commit([kept, writer.write(iter([]))])
    assert [tuple(r) for r in P.packed_table(spark, str(tmp_path / "p")).collect()] == [("a", 1, b"xy")]
    assert not os.path.exists(tmp_path / "p" / lost.name)


def shards(spark):
    return spark.createDataFrame([(k, ["a", "b c", "x=1", "other"][k % 4], k * 1.5) for k in range(200)], "id long, label string, v double").repartition(4)


def test_sealed_shards(spark, tmp_path):
    path, names = str(tmp_path / "s"), ["a", "b c", "x=1", "none"]
    with pytest.raises(FileNotFoundError):
        S.read_sealed(spark, path, "label")
    made = S.write_sealed(shards(spark), path, "label", names, ["v"]).collect()
    folder = glob.glob(f"{path}/write-*")[0]
    assert {n: sum(r["n"] for r in made if r["label"] == n) for n in names} == {"a": 50, "b c": 50, "x=1": 50, "none": 0}
    assert all(r["file"] is None for r in made if r["label"] == "none")
    on_disk = {hashlib.sha256(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{folder}/shards/*/*.parquet")}
    assert on_disk == {r["sha256"] for r in made if r["file"]}
    got = S.read_sealed(spark, path, "label")
    assert got.count() == 150 and {r["label"] for r in got.collect()} == {"a", "b c", "x=1"}
    assert S.damaged(spark, path, "label").collect() == []
    victim = glob.glob(f"{folder}/shards/label=a/*.parquet")[0]
    other = glob.glob(f"{folder}/shards/label=b*/*.parquet")[0]
    open(victim, "wb").write(open(other, "rb").read())
    for crc in glob.glob(f"{folder}/shards/label=a/.*.crc"):
        os.remove(crc)
    assert [r["label"] for r in S.damaged(spark, path, "label").collect()] == ["a"]


def test_a_failed_write_leaves_the_one_before(spark, tmp_path):
    path = str(tmp_path / "s")
    lost = shards(spark).withColumn("v", F.when(F.col("id") == 152, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception):  # noqa: B017
        S.write_sealed(lost, path, "label", ["a", "b c"], ["v"])
    with pytest.raises(FileNotFoundError):
        S.manifest(spark, path, "label")
    S.write_sealed(shards(spark).where("id < 100"), path, "label", ["a", "b c"], ["v"])
    for bad in (lambda: S.write_sealed(lost, path, "label", ["a", "b c"], ["v"]), lambda: S.write_sealed(shards(spark), path, "label", ["a"], ["v"], faults=shards(spark).limit(1))):
        with pytest.raises(Exception):  # noqa: B017
            bad()
        assert S.read_sealed(spark, path, "label").count() == 50
    assert S.write_sealed(shards(spark), path, "label", ["a"], ["v"], apply=False) is None
    S.write_sealed(shards(spark), path, "label", ["a"], ["v"])  # a retry that works takes its place
    assert S.read_sealed(spark, path, "label").count() == 50 and {r["label"] for r in S.manifest(spark, path, "label").collect()} == {"a"}
    empty = S.write_sealed(shards(spark).limit(0), path, "label", ["a", "b"], ["v"]).collect()
    assert sorted((r["label"], r["n"], r["file"]) for r in empty) == [("a", 0, None), ("b", 0, None)]
