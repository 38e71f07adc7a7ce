"""Readers and writers by round trips; stateful operators in batch and in streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from kinetide.operators import vectors as V
from kinetide.sources import records as IO
from kinetide.streaming import attempts as A

START_GAP = [80.0]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\nno json\n')
    kept = IO.json_lines(spark, str(tmp_path / "a.jsonl"), "a long", strict=False)
    assert sorted(r["a"] for r in kept.collect()) == [1, 2]
    with pytest.raises(Exception):
        IO.json_lines(spark, str(tmp_path / "a.jsonl"), "a long").collect()


def test_episodes(spark, tmp_path):
    rows = spark.createDataFrame([([1.0, 2.0], [3.0])] * 5, "state array<double>, action array<double>").coalesce(1)
    rows.write.parquet(str(tmp_path / "e"))
    found = IO.episodes(spark, str(tmp_path / "e"), widths=(2, 1))
    assert sorted(r["frame"] for r in found.collect()) == [0, 1, 2, 3, 4]
    assert IO.row_counts(spark, str(tmp_path / "e")).first()["n"] == 5
    with pytest.raises(Exception, match="components"):
        IO.episodes(spark, str(tmp_path / "e"), widths=(3, 1)).collect()


def test_shards_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("x", 4)], "label string, v int")
    one = IO.write_shards(rows, str(tmp_path / "one"), "label", ["a", "b", "c"], ["v"])
    two = IO.write_shards(rows.orderBy(F.desc("v")), str(tmp_path / "two"), "label", ["a", "b", "c"], ["v"])
    assert {r["label"]: r["n"] for r in one.collect()} == {"a": 2, "b": 1, "c": 0}
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert spark.read.parquet(str(tmp_path / "one/shards")).count() == 3


def test_nothing_is_written_with_faults(spark, tmp_path):
    rows = spark.range(3)
    with pytest.raises(ValueError):
        IO.write_checked(rows, rows.where("id = 1"), str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()
    assert IO.write_checked(rows, rows.where("id > 9"), str(tmp_path / "x"), apply=False) == 3 and not (tmp_path / "x").exists()
    assert not IO.write_csv_if_any(rows.where("id > 9"), str(tmp_path / "c"))


def test_statistics_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 5.0]), (1, [3.0, 5.0]), (2, [0.0, 0.0])], "e int, v array<double>")
    stats = V.vector_stats(rows, "v", ["e"])
    IO.write_stats(stats, str(tmp_path / "s"), ["e"])
    back = IO.read_stats(spark, str(tmp_path / "s"), ["e"])
    want = sorted((r["e"], r["dim"], r["mean"], r["std"], r["q01"], r["q99"]) for r in stats.collect())
    assert sorted((r["e"], r["dim"], r["mean"], r["std"], r["q01"], r["q99"]) for r in back.collect()) == want


def test_complete_episodes(spark, tmp_path):
    for kind, names in {"video": ["e1.mp4", "e2.mp4"], "meta": ["e1.json"]}.items():
        (tmp_path / kind).mkdir()
        for n in names:
            (tmp_path / kind / n).write_text("x")
    found = IO.complete_episodes(spark, {k: str(tmp_path / k) for k in ("video", "meta")}).collect()
    assert [r["id"] for r in found] == ["e1"]


def test_synthetic_is_seeded(spark):
    a, b, c = (IO.synthetic(spark, 20, 4, s).orderBy("id").collect() for s in (1, 1, 2))
    assert a == b != c
    assert all(-1 <= x < 1 for r in a for x in r["x"]) and all(0 <= r["token"] < 2048 for r in a)


def test_summary_and_report(spark):
    rows = spark.createDataFrame([("t", "a", 2), ("t", "b", 1), ("t", "a", 3)], "task string, label string, o int")
    r = IO.summary(rows, "task", "label").first()
    assert json.loads(r["counts"]) == {"a": 2, "b": 1} and r["total"] == 3
    assert IO.report_lines(rows, ["task"], "o", F.col("label")).first()["report"] == "b\na\na"
    m = IO.frame_manifest(rows, ["task"], "o", F.col("label") == "a").first()
    assert (m["kept"], m["dropped"]) == ([2, 3], [1])


def test_contact_fires_once_after_five():
    state, events = A.START["contact"], []
    for gap in [80.0, 40.0, 20.0, 20.0, 20.0, 20.0, 20.0, 20.0]:
        state, event = A.contact(state, gap)
        events.append(event)
    assert events == [None] * 6 + ["hold", None]


def _log(spark):
    rows = [("r1", i, v, f) for i, (v, f) in enumerate([("incomplete", None), ("complete", None), ("error", None), ("incomplete", None), ("incomplete", None), ("incomplete", None)])]
    return spark.createDataFrame([*rows, ("r2", 0, "complete", "retry"), ("r2", 1, "incomplete", "replan_plan_deviated")], "key string, seq long, verdict string, followup string")


WANT = [("r1", 0, "retry"), ("r1", 1, "complete"), ("r1", 2, "failed"), ("r1", 3, "retry"), ("r1", 4, "retry"), ("r1", 5, "failed"), ("r2", 0, "retry"), ("r2", 1, "failed")]


def test_outcomes_in_batch(spark):
    assert sorted(map(tuple, A.in_batch(_log(spark), "outcome").collect())) == WANT


def test_outcomes_in_a_stream(spark, tmp_path):
    log = _log(spark)
    for k, part in enumerate((log.where("seq < 2"), log.where("seq >= 2"))):
        part.coalesce(1).write.json(str(tmp_path / f"part{k}"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "part*"))
    query = A.in_stream(stream, "outcome").writeStream.format("memory").queryName("outcomes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("outcomes").collect())) == WANT


def test_windows_of_a_stream(spark, tmp_path):
    rows = spark.range(30).select((F.timestamp_seconds(F.col("id") * 60)).alias("ts"), (F.col("id") % 2).alias("k"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = A.windowed_counts(stream, "ts", ["k"], "10 minutes").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("counts").collect()) == [5] * 6
