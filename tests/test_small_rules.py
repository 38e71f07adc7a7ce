"""Hand-made cases of budgets, robot states, paths, prompts, rounding, attempts and stream helpers."""

import random

import pytest
from pyspark.sql import functions as F

from kinetide.functions import control as C
from kinetide.functions import text as X
from kinetide.operators import relational as R
from kinetide.operators import sampling as S
from kinetide.operators import segments as G
from kinetide.operators import temporal as T
from kinetide.operators import vectors as V
from kinetide.streaming import attempts as A


def state(gap=0.0, n=16):
    return [float(i) for i in range(n - 2)] + [gap / 1000, 0.0]


def test_windows_and_steps(spark):
    rows = [("pick", "x", 5), ("pick", "x", 10), ("pnp", "Place it", 5), ("open_close", "stir it", 5), ("pick", "Pick up the bread from the toaster.", 5), ("manipulate", "Wait for the toaster to finish and the lever to pop up", 5), ("move_to", "x", 50), ("close", "x", 7)]
    df = spark.createDataFrame(rows, "s string, p string, n int")
    assert [r[0] for r in df.select(C.window_budget(F.col("s"), F.col("p"), F.col("n"))).collect()] == [50, 25, 43, 98, 65, 120, 3, 44]
    assert df.limit(1).select(C.window_budget(F.col("s"), F.col("p"), F.col("n"), {"pick": 7})).first()[0] == 7
    with pytest.raises(Exception, match="no window for dance"):
        spark.range(1).select(C.window_budget(F.lit("dance"), F.lit("x"), F.lit(5))).collect()
    rows = [("KettleBoiling", "place_on", state(25), 5), ("KettleBoiling", "place_on", state(24), 5), ("KettleBoiling", "place_in", state(60), 2), ("KettleBoiling", "pick", state(60), 5), ("Other", "place_on", state(60), 5), ("KettleBoiling", "place_on", None, 5)]
    df = spark.createDataFrame(rows, "t string, s string, x array<double>, n int")
    assert [r[0] for r in df.select(C.steps_at_once(F.col("t"), F.col("s"), F.col("x"), F.col("n"))).collect()] == [3, 5, 2, 5, 5, 5]


def test_robot_info(spark):
    df = spark.createDataFrame([(state(20), state(40)), (state(20), None), (state(20), state(1, 15)), (state(1, 15), state(20))], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(C.robot_info(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0]["jaw_gap_mm"] - 20) < 1e-9 and abs(got[0]["delta_jaw_gap_mm"] + 20) < 1e-9 and got[0]["delta_base_position"] == [0.0] * 3 and got[0]["base_position"] == [7.0, 8.0, 9.0]
    assert got[1]["delta_jaw_gap_mm"] is None and got[2]["delta_end_effector_position"] is None and got[3] is None


def test_images_fields_and_inputs(spark):
    px = lambda *rows: F.array(*[F.array(*[F.array(*map(F.lit, p)) for p in r]) for r in rows])
    assert spark.range(1).select(C.rgb(px([(0.5, 0.0, 1.0, 0.3)]))).first()[0] == [[[127, 0, 255]]]
    assert spark.range(1).select(C.rgb(px([(7.0,), (300.0,)]))).first()[0] == [[[7, 7, 7], [255, 255, 255]]]
    obs = F.create_map(F.lit("old"), F.lit(1), F.lit("older"), F.lit(2))
    assert tuple(spark.range(1).select(C.first_of_fields(obs, ["new", "old", "older"]), C.first_of_fields(obs, ["x"])).first()) == (1, None)
    made = spark.range(1).select(C.policy_input(F.array(F.lit(1.0)), {"head": F.lit("h"), "left": F.lit(None).cast("string")}, prompt=F.lit("p")).alias("i")).first()["i"]
    assert made["image_mask"].asDict() == {"head": True, "left": False} and made["prompt"] == "p" and "actions" not in made.asDict()
    assert [r[0] for r in spark.createDataFrame([(0.2, 0.9), (0.9, 0.2), (0.2, 0.2), (0.9, 0.9)], "l double, r double").select(C.carry_side(F.col("l"), F.col("r"))).collect()] == ["LEFT", "RIGHT", None, None]


def test_prompts_and_paths(spark):
    df = spark.createDataFrame([("Do it. ", "Pick up. . "), (None, "x")], "t string, s string")
    assert [r[0] for r in df.select(X.now_prompt(F.col("t"), F.col("s"))).collect()] == ["Do it. Now: Pick up.", ". Now: x."]
    assert [tuple(r) for r in df.limit(1).select(X.now_prompt(F.col("t"), F.col("s"), "skill_only"), X.now_prompt(F.col("t"), F.col("s"), "skill_only", bare=False)).collect()] == [("Pick up", "Pick up. . ")]
    with pytest.raises(ValueError):
        X.now_prompt(F.lit("a"), F.lit("b"), "loud")
    one = spark.range(1).select(F.lit(3).alias("t"), F.lit(1234).alias("e"), F.lit("head").alias("v"), F.lit(7).alias("f"))
    assert one.select(X.frame_path(F.col("t"), F.col("e"), F.col("v"), F.col("f"))).first()[0] == "task-0003/episode_00001234/head/dataset_00000007.jpg"
    pattern = "data/chunk-{episode_chunk:03d}/{video_key}/episode_{episode_index:06d}.parquet"
    assert one.select(X.episode_path(pattern, F.col("e"), video_key=F.col("v"))).first()[0] == "data/chunk-001/head/episode_001234.parquet"
    for bad in ("../{episode_index:06d}", "/x/{episode_index:06d}", "a/{video_key}/x"):
        with pytest.raises(Exception, match="leaves its folder"):
            one.select(X.episode_path(bad, F.col("e"), video_key=F.lit(".."))).collect()
    assert one.select(X.padded_id("ep", F.col("e"), 6)).first()[0] == "ep001234"
    named = spark.createDataFrame([("release", "put it into a box"), ("release", "drop it on it"), ("release", "let go"), ("grab", "x")], "n string, d string")
    assert [r[0] for r in named.select(X.merged_name(F.col("n"), {"grab": "pick"}, description=F.col("d"))).collect()] == ["place in", "place on", "release", "pick"]


def test_rounding_as_the_binary_number_says(spark):
    r = random.Random(3)
    xs = [0.125, 0.375, 2.675, 1.005, 0.285, 3.0775, -2.675, -0.125, 1.115, 0.0, 5.0] + [round(r.uniform(-500, 500), 3) for _ in range(2000)] + [r.randrange(1, 4000) / 8 for _ in range(300)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", X.half_even_exact(F.col("x"), 2).alias("y")).collect()
    assert all(r["y"] == round(r["x"], 2) for r in got)


def test_curriculum_and_located(spark):
    budgets = spark.createDataFrame([("a", 3), ("b", 1), ("c", 0)], "e string, n int")
    got = sorted(tuple(r) for r in S.curriculum(budgets, "e", "n", 2).collect())
    assert got == [("a", s, k) for s in range(3) for k in range(2)] + [("b", 0, k) for k in range(2)]
    sizes = spark.createDataFrame([(1, 1, 5), (1, 2, 3), (2, 1, 4)], "t int, e int, n long")
    rows = spark.createDataFrame([(1, 1, 4), (1, 2, 5), (2, 1, 11)], "t int, e int, i long")
    assert sorted(tuple(r) for r in R.located(rows, "i", sizes, ["t", "e"], "n").collect()) == [(1, 1, 4, 4), (1, 2, 5, 0), (2, 1, 11, 3)]
    for bad in ((1, 2, 4), (1, 2, 8), (3, 1, 0)):
        with pytest.raises(Exception, match="out of range"):
            R.located(spark.createDataFrame([bad], "t int, e int, i long"), "i", sizes, ["t", "e"], "n").collect()


def test_places_and_starts_by_many_small_ranges(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS", 7)
    r = random.Random(4)
    keys = [None, *range(-3, 30)]
    n = {k: r.randrange(1, 40 if k == 5 else 6) for k in keys}
    rows = [(k, i * 3) for k in keys for i in range(n[k])]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "k int, o int")
    placed = R.global_offsets(df, ["k"], "o")
    assert placed.columns == ["k", "o", "place"]
    assert sorted((x["place"], x["k"], x["o"]) for x in placed.collect()) == [(i, *x) for i, x in enumerate(rows)]
    sizes = spark.createDataFrame(list(n.items()), "k long, n long").repartition(2)
    found = R.located(placed, "place", sizes, ["k"], "n")
    assert found.schema["k"].dataType == df.schema["k"].dataType
    assert sorted(str(tuple(x)) for x in found.select("k", "o", "local").collect()) == sorted(str((k, o, o // 3)) for k, o in rows)
    assert found.rdd.getNumPartitions() == R.tasks(len(rows)) > 10  # by rows, whatever the session deals by


def test_outcomes_by_windows_equal_the_walk(spark):
    r = random.Random(2)
    rows = [(f"k{k}", i, r.choice(["complete", "incomplete", "incomplete", "incomplete", "error"]), r.choice([None, "", "retry", "next", "replan_keep_pose"] + [""] * 4), [None, 0, 1, 3][k % 4]) for k in range(40) for i in range(30)]
    log = spark.createDataFrame(rows, "key string, seq long, verdict string, followup string, retries int").repartition(3)
    walk = sorted(tuple(x) for x in A.in_batch(log, "outcome").collect())
    assert sorted(tuple(x) for x in A.outcomes(log, ["key"], "seq").select("key", "seq", "event").collect()) == walk


def test_clusters_as_rows(spark):
    named = spark.createDataFrame([("Grab ", "m", 1, "x"), ("grab", "m", 2, "x"), ("release", "m", 3, "into it"), (None, "m", 4, "x"), ("noise", None, 5, "x")], "c string, k string, i int, d string")
    listed = {(r["c"], r["k"]): r["members"] for r in G.clusters_merged(named, "c", "k", "i", "d", {"grab": "pick"}, ["noise"]).collect()}
    rows = G.cluster_members(named, "c", "k", "i", "d", {"grab": "pick"}, ["noise"]).collect()
    assert {k: sorted(r["i"] for r in rows if (r["c"], r["k"]) == k) for k in listed} == listed
    assert next(r for r in rows if r["i"] == 2)["n"] == 2


def test_helpers_of_tables_and_arrays(spark):
    df = spark.createDataFrame([(0.1, 0.1), (0.9, 0.1), (None, 0.1)], "a double, b double")
    assert R.conjunctive_keep(df, "a", "b", 0.5, 0.5).count() == 1
    assert R.without_strings(spark.createDataFrame([("x", 1, [1.0])], "s string, n int, a array<double>")).columns == ["n", "a"]
    assert [r[0] for r in spark.createDataFrame([("b",), ("a",), ("z",), (None,)], "x string").select(S.in_order(F.col("x"), ["a", "b"])).collect()] == [1, 0, 99, 99]
    assert tuple(spark.range(1).select(T.evenly(F.lit(10), 4), T.evenly(F.lit(10), 1), V.stride(F.array(*map(F.lit, range(5))), 2)).first()) == ([0, 3, 6, 9], [0], [0, 2, 4])
    made = T.numbered(spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "k string, o int"), ["k"], ["o"], "seg").collect()
    assert sorted((r["k"], r["o"], r["id"]) for r in made) == [("a", 1, "seg-000001"), ("a", 3, "seg-000002"), ("b", 2, "seg-000001")]
    reasons = [(True, True, 9, True), (False, True, 9, True), (False, False, 9, True), (False, False, 1, True), (False, False, 1, False)]
    got = spark.createDataFrame(reasons, "a boolean, d boolean, t int, s boolean").select(A.stop_reason(F.col("a"), F.col("d"), F.col("t"), 5, F.col("s"))).collect()
    assert [r[0] for r in got] == ["abort", "env_done", "max_ticks", "success", None]
    assert [r["id"] for r in spark.range(40).where(A.checkpoints(F.col("id"), 12)).collect()] == [12, 24, 36]


def test_streams_are_appended_and_joined(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    spark.createDataFrame([("a", at(0)), ("b", at(5)), ("a", at(100))], "key string, ts timestamp").write.parquet(str(tmp_path / "one"))
    spark.createDataFrame([("a", at(3)), ("b", at(50)), ("a", at(-2))], "key string, ts timestamp").write.parquet(str(tmp_path / "two"))
    read = lambda name: spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / name))
    A.appended(read("one"), str(tmp_path / "log"), str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination(60)
    A.appended(read("one"), str(tmp_path / "log"), str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination(60)
    assert spark.read.json(str(tmp_path / "log")).count() == 3  # a restart adds nothing twice
    pairs = A.joined_within(read("one"), read("two"), "key", "ts", 10)
    pairs.writeStream.format("parquet").option("path", str(tmp_path / "pairs")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(90)
    assert [(r["key"], r["then"] - r["at"]) for r in spark.read.parquet(str(tmp_path / "pairs")).collect()] == [("a", dt.timedelta(seconds=3))]


def test_timelines_are_not_broadcast_by_the_driver(spark, sf_dir):
    from kinetide.plans import segments as P

    assert "Broadcast" not in P.frame_jobs(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
