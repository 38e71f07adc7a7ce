"""Guards and recovery: fixed cases, stream against batch over a restart, expiry."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kinetide.plans import recovery as P
from kinetide.streaming import recovery as R

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
T0 = dt.datetime(2024, 1, 1)


def step(seq, prompt=R.SPOUT, state=None, command=None, gap=None, subtask="a", attempt=1, key="k"):
    return (key, seq, T0 + dt.timedelta(seconds=seq), "step", subtask, prompt, attempt, [0.0] * 16 if state is None else state, [1.0] * 12 if command is None else command, gap, None)


def other(seq, kind, prompt=None, gap=None, outcome=None, key="k"):
    return (key, seq, T0 + dt.timedelta(seconds=seq), kind, "a", prompt, 1, None, None, gap, outcome)


def at(x):
    return [x, *[0.0] * 15]


def rolled(n=60, ratio=0.0):
    """Steps whose path is ``ratio`` of the mean command, which is the length of (1, 1, 1)."""
    d = ratio * 3**0.5 / (n - 1)
    return [step(i, state=at(d * i)) for i in range(n)]


CASES = {
    "still": (rolled(), [(59, "nav_pending")]),
    "just below": (rolled(ratio=0.119), [(59, "nav_pending")]),
    "just above": (rolled(ratio=0.121), [(59, "clear")]),
    "too short": (rolled(59), []),
    "low": ([step(i, command=[0.01] * 12) for i in range(60)], [(59, "low_command")]),
    "begins later": ([step(0, prompt="x"), *[step(i + 1) for i in range(60)]], [(60, "nav_pending")]),
    "mixed": ([step(i, prompt="x" if i == 20 else R.SPOUT) for i in range(61)], [(59, "invalid_prompt_window")]),
    "ends elsewhere": ([step(i, prompt="x" if i >= 59 else R.SPOUT) for i in range(62)] + [step(70)], [(70, "invalid_prompt_window")]),
    "short state": ([step(i, state=[0.0] * (15 if i == 3 else 16)) for i in range(60)], [(59, "invalid_robot_data")]),
    "not finite": ([step(i, command=[float("nan") if i == 3 else 1.0] * 3) for i in range(60)], [(59, "invalid_robot_data")]),
    "null number": ([step(i, state=[None if i == 3 else 0.0] * 16) for i in range(60)], [(59, "invalid_robot_data")]),
    "second attempt": ([step(i, attempt=1 + (i == 59)) for i in range(62)], [(60, "nav_pending")]),
    "other subtask": ([step(i, subtask="a" if i < 59 else "b") for i in range(70)], []),
    "recovers once": ([*rolled(), other(60, "attempt", R.SPOUT, outcome="failed"), other(61, "attempt", R.SPOUT, outcome="failed"), other(62, "attempt", R.NAVIGATE, outcome="complete"), other(63, "attempt", R.NAVIGATE, outcome="complete")], [(59, "nav_pending"), (60, "navigate"), (62, "spout")]),
    "not failed": ([*rolled(), other(60, "attempt", R.SPOUT, outcome="complete"), other(61, "attempt", R.NAVIGATE, outcome="failed")], [(59, "nav_pending")]),
    "release at twelve": ([other(0, "start", gap=20.0), *[step(i, prompt="x", gap=20.0) for i in range(1, 12)], step(12, prompt="x", gap=26.0), step(13, prompt="x", gap=40.0)], [(12, "release")]),
    "too early": ([other(0, "start", gap=20.0), *[step(i, prompt="x", gap=20.0 + 6 * (i == 11)) for i in range(1, 13)]], []),
    "step up": ([other(0, "start", gap=90.0), *[step(i, prompt="x", gap=30.0) for i in range(1, 15)], step(15, prompt="x", gap=34.5)], [(15, "release")]),
    "no hold": ([other(0, "start", gap=90.0), *[step(i, prompt="x", gap=70.0 + 9 * (i % 2)) for i in range(1, 20)]], []),
    "no gap at start": ([other(0, "start"), *[step(i, prompt="x", gap=20.0 + 9 * (i > 14)) for i in range(1, 20)]], []),
    "two attempts": ([other(0, "start", gap=20.0), *[step(i, prompt="x", gap=26.0) for i in range(1, 14)], other(20, "start", gap=30.0), *[step(20 + i, prompt="x", gap=None if i < 13 else 40.0) for i in range(1, 15)]], [(12, "release"), (33, "release")]),
}


def all_rows():
    return [(name, *row[1:]) for name, (rows, _) in CASES.items() for row in rows]


WANT = sorted((name, seq, event) for name, (_, events) in CASES.items() for seq, event in events)


def test_cases_in_batch(spark):
    rows = all_rows()
    random.Random(1).shuffle(rows)
    assert sorted(tuple(r) for r in R.in_batch(spark.createDataFrame(rows, R.LOG)).collect()) == WANT
    assert R.in_batch(spark.createDataFrame([], R.LOG)).collect() == []


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield
    spark.conf.set(name, before)


def fed(spark, parts, folder, idle="1000 days"):
    """Each part is a run of the query of its own, from the same checkpoint."""
    for rows in parts:
        rows.coalesce(2).write.mode("append").parquet(f"{folder}/log")
        stream = R.in_stream(spark.readStream.schema(R.LOG).parquet(f"{folder}/log"), idle)
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)
    return sorted(tuple(r) for r in spark.read.schema(R.EVENTS).parquet(f"{folder}/out").collect())


def test_stream_equals_batch_over_restarts(spark, sf_dir, tmp_path, rocks):
    log = spark.createDataFrame(all_rows(), R.LOG).unionByName(P.log(spark, sf_dir).withColumn("ts", F.lit(T0) + F.make_dt_interval(secs=F.col("seq").cast("double"))))
    parts = [log.where("seq < 30"), log.where("seq between 30 and 60"), log.where("seq > 60"), log.where("seq = 12")]  # the last has only rows that were handled
    want = sorted(tuple(r) for r in R.in_batch(log).collect())
    assert fed(spark, parts, str(tmp_path)) == want and len(want) > len(WANT)


def test_silent_runs_are_forgotten(spark, tmp_path, rocks):
    """A run that goes on after its expiry begins anew."""
    mine = spark.createDataFrame(rolled(40), R.LOG)
    wake = spark.createDataFrame([step(100_000, prompt="x", key="z")], R.LOG)
    again = spark.createDataFrame([step(100_001 + i) for i in range(60)], R.LOG)
    got = fed(spark, [mine, wake, again], str(tmp_path), idle="1 hour")
    assert ("k", 39, "expired") in got and ("k", 100_060, "nav_pending") in got and ("k", 100_020, "nav_pending") not in got
