"""Queries without SQL against brute force, and hand-made cases of segment and attempt rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kinetide.functions import control as C
from kinetide.operators import sampling as S
from kinetide.operators import segments as G
from kinetide.operators import temporal as T
from kinetide.plans import catalogue
from kinetide.plans import temporal as P
from kinetide.streaming import attempts as A

SF = "/root/testdata/sf0.001"


def _events(spark):
    return [tuple(r) for r in P.events(spark, SF).select("user_id", "event_id", "event_type", "value", "us").collect()]


def test_coincidences_by_brute_force(spark):
    by = {}
    for user, _, kind, _, us in _events(spark):
        by.setdefault(user // 2, []).append((us, kind, user))
    want = []
    for pair, rows in by.items():
        rows.sort()
        i = 0
        while i < len(rows):
            run = [r for r in rows[i:] if r[0] - rows[i][0] <= 6 * P.HOUR]
            n = next((k for k, r in enumerate(run) if r[1] != rows[i][1]), len(run))
            if len({r[2] for r in run[:n]}) >= 2:
                want.append((pair, rows[i][0], rows[i][1], n))
                i += n
            else:
                i += 1
    got = [tuple(r) for r in catalogue.queries()["coincidences"](spark, SF).collect()]
    assert want and sorted(got) == sorted(want)


def test_snapped_by_brute_force(spark):
    by = {}
    for user, _, kind, value, us in sorted(_events(spark), key=lambda r: r[4]):
        by.setdefault(user, []).append((us, kind, value))
    want = []
    for user, rows in by.items():
        stops = [us / P.HOUR for us, kind, _ in rows if kind == "purchase"]
        runs, last = [], []
        for us, _, value in [*rows, (0, "", 0)]:
            if value > P.HIGH:
                last.append(us)
            else:
                runs += [last] if len(last) >= 2 else []
                last = []
        seg = [[r[0] / P.HOUR, r[-1] / P.HOUR, False, r[0]] for r in runs]
        for i, s in enumerate(seg):
            stop = next((x for x in stops if x > s[0]), None)
            if stop is not None and stop < s[1] and stop - s[0] >= 1.0 and s[1] - stop <= 48.0:
                s[1], s[2] = stop, True
                if i + 1 < len(seg):
                    seg[i + 1][0] = stop
        want += [(user, k, round(a, 6), round(b, 6), m) for a, b, m, k in seg]
    got = [(r["user_id"], r["k"], round(r["s"], 6), round(r["t"], 6), r["moved"]) for r in catalogue.queries()["snapped"](spark, SF).collect()]
    assert any(m for *_, m in want) and sorted(got) == sorted(want)


def test_only_navigation_moves_and_parents_follow(spark):
    seg = spark.createDataFrame([("e", 1, 0.0, 9.0, True, "a"), ("e", 2, 9.0, 20.0, True, "b"), ("e", 3, 20.0, 30.0, False, "b"), ("e", 4, 31.0, 40.0, True, "c")], "k string, i int, s double, t double, nav boolean, act string")
    stops = spark.createDataFrame([("e", 6.0), ("e", 17.0), ("e", 25.0), ("e", 32.0)], "k string, stop double")
    got = T.snapped(seg, stops, ["k"], "i", "s", "t", 1.0, 4.0, "nav")
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(1, 0.0, 6.0, True), (2, 6.0, 17.0, True), (3, 17.0, 30.0, False), (4, 31.0, 40.0, False)]
    acts = spark.createDataFrame([("e", 0, "a", 0.0, 9.0), ("e", 1, "b", 9.0, 30.0), ("e", 2, "c", 30.0, 40.0)], "k string, p int, act string, s double, t double")
    moved = got.where("moved").join(seg.select("k", "i", "act"), ["k", "i"]).select("k", "act", "i", "t")
    found = T.parents_snapped(acts, moved, ["k"], "act", "p", "s", "t", "i")
    assert sorted((r["act"], r["s"], r["t"]) for r in found.collect()) == [("a", 0.0, 6.0), ("b", 6.0, 17.0), ("c", 17.0, 40.0)]


def test_subset_and_windows_by_brute_force(spark):
    sizes = {}
    for user, event, *_ in _events(spark):
        sizes.setdefault(user, set()).add(event)
    got = {}
    for r in catalogue.queries()["subset"](spark, SF).collect():
        got.setdefault(r["user_id"], set()).add(r["event_id"])
    assert {u: max(1, len(e) // 10) for u, e in sizes.items()} == {u: len(e) for u, e in got.items()}
    assert all(e <= sizes[u] for u, e in got.items())
    seg = spark.range(2000).select("id", F.lit(5).cast("bigint").alias("s"), F.lit(12).cast("bigint").alias("e"))
    drawn = [r["n"] for r in T.sampled_window(seg, "id", "s", "e", 3, 1).groupBy("window_start").agg(F.count(F.lit(1)).alias("n")).orderBy("window_start").collect()]
    assert len(drawn) == 5 and all(320 < n < 480 for n in drawn)


def test_draws_follow_the_weights(spark):
    items = spark.createDataFrame([("a", i, float(w)) for i, w in enumerate([0, 1, 3, 0, 6])], "k string, i long, w double")
    u = [(k + 0.5) / 1000 for k in range(1000)]
    draws = spark.createDataFrame([("a", x) for x in u], "k string, u double")
    for part in (None, F.floor(F.col("i") / 2)):
        got = {r["picked"]: r["n"] for r in S.weighted_pick(items, "k", "i", "w", draws, "u", part).groupBy("picked").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert got == {1: 100, 2: 300, 4: 600}
    with pytest.raises(Exception, match="no item with a positive weight"):
        S.weighted_pick(items, "k", "i", "w", spark.createDataFrame([("b", 0.5)], "k string, u double"), "u").collect()
    with pytest.raises(Exception, match="negative"):
        S.weighted_pick(items.withColumn("w", F.col("w") - 1), "k", "i", "w", draws, "u").collect()


def test_apportionment_takes_from_the_least_remainder(spark):
    assert S.apportion([0.3, 0.3, 0.3, 4.1, 3.0], 8) == [1, 1, 1, 4, 1]
    for shares, total in (([0.3, 0.3, 0.3, 4.1, 3.0], 8), ([1.0, 2.0, 3.0, 100.0], 7), ([5.0, 4.0, 3.0], 10)):
        rows = spark.createDataFrame([(f"c{i}", s) for i, s in enumerate(shares)], "c string, n double")
        assert [r["slots"] for r in S.apportioned(rows, "c", "n", total).orderBy("c").collect()] == S.apportion(shares, total)
    assert S.count_modes([4, 1], 8, single=1) == [0, 8] and S.count_modes([4, 1], 8, override=[5, 3]) == [5, 3]
    assert S.count_modes([30, 10], 8, proportional=True) == [6, 2] and S.count_modes([30, 10], 8) == [8, 8]
    with pytest.raises(ValueError):
        S.count_modes([4, 1], 8, override=[5, 4])


def test_hierarchical_draws_and_mixtures(spark):
    plan = S.batch_plan(spark, {"a": 40, "b": 20}, 8)
    pools = spark.createDataFrame([(0, "d1", 0.25), (0, "d2", 0.75), (1, "d1", 1.0)], "expert int, dataset string, p double")
    episodes = spark.createDataFrame([("d1", 0, 7, 5), ("d2", 0, 8, 1), ("d2", 1, 9, 30)], "dataset string, place int, episode long, length long")
    got = S.hierarchical(plan, pools, episodes, 3).collect()
    assert len(got) == 60 * 8 and got == S.hierarchical(plan, pools, episodes, 3).collect()
    lengths = {7: 5, 8: 1, 9: 30}
    assert all(0 <= r["frame"] < lengths[r["episode"]] for r in got) and all(r["dataset"] == "d1" for r in got if r["expert"] == 1)
    assert 0.6 < sum(r["dataset"] == "d2" for r in got if r["expert"] == 0) / 320 < 0.9
    parts = {"x": (spark.range(10), 0.3), "y": (spark.range(100, 200), 0.7)}
    mix = S.mixed(parts, "id", 5, 1000).collect()
    assert sorted(r["place"] for r in mix) == list(range(1000)) and 230 < sum(r["name"] == "x" for r in mix) < 370
    with pytest.raises(ValueError):
        S.mixed({"x": (spark.range(3), 0.5)}, "id", 1, 5)


def test_contact_needs_jaws_that_were_open():
    def fired(gaps):
        state, events = A.START["contact"], []
        for g in gaps:
            state, e = A.contact(state, g)
            events.append(e)
        return events

    assert fired([30.0, 20.0, 20.0, 20.0, 20.0, 20.0]) == [None] * 6
    assert fired([80.0, 4.0, 4.0, 4.0, 4.0, 4.0, 4.0]) == [None] * 7
    assert fired([80.0, 40.0, 20.0, 20.0, 20.0, 20.0, 20.0])[-1] == "hold"


def test_outcome_rules():
    assert A.outcome((0, 0), "incomplete", "replan_plan_deviated")[1] == A.outcome((0, 0), "incomplete", "replan_keep_pose")[1] == "failed"
    assert A.outcome((0, 0), "complete", "retry")[1] == "retry" and A.outcome((2, 0), "incomplete", None)[1] == "failed"


def test_release_is_confirmed_once(spark):
    rows = spark.createDataFrame([("r", i, g) for i, g in enumerate([20.0, *[60.0] * 7])], "k string, i int, g double")
    assert [tuple(r) for r in A.releases(rows, ["k"], "i", "g").collect()] == [("r", 5)]


def test_functions_of_control(spark):
    rows = spark.createDataFrame([([0.0] * 14 + [0.02, -0.02], [1, 2, 3]), ([0.0] * 3, [9] * 6)], "s array<double>, t array<bigint>")
    got = rows.select(C.jaw_gap(F.col("s")).alias("g"), C.padded_tokens(F.col("t"), 5).alias("p"), C.mixed_radix(F.array(F.lit(1), F.lit(2)), [8, 5]).alias("m"), C.digitised(F.lit(0.0), 5).alias("d")).collect()
    assert [(round(r["g"], 6) if r["g"] is not None else None, r["p"]["tokens"], r["p"]["mask"], r["m"], r["d"]) for r in got] == [(40.0, [1, 2, 3, 0, 0], [True] * 3 + [False] * 2, 17, 2), (None, [9] * 5, [True] * 5, 17, 2)]
    m = spark.range(1).select(C.meta_summary(F.lit('{"config": "{\\"task\\": {\\"activity_name\\": \\"a\\"}, \\"scene\\": {\\"scene_instance\\": \\"s\\"}}"}')).alias("m")).first()["m"]
    assert tuple(m) == ("a", "s", 0)
    with pytest.raises(Exception, match="both"):
        spark.range(1).select(C.token_fields(F.lit(1), F.lit(None))).collect()


def test_segment_helpers(spark):
    rows = spark.createDataFrame([(1, 2.0, "x")], "a int, b double, c string")
    assert G.repacked(rows, {"o": {"p": "a"}, "q": "c"}).first()["o"]["p"] == 1
    assert G.with_default(rows, "z", 7).first()["z"] == 7 and G.applied(rows, {"b": lambda c: c + 1, "none": lambda c: c}).first()["b"] == 3.0
    with pytest.raises(ValueError):
        G.applied(rows, {"none": lambda c: c}, strict=True)
    assert rows.select(G.first_present(rows, ["z", "c"])).first()[0] == "x" and G.chained(lambda d: d.where("a > 1"), lambda d: d)(rows).count() == 0
    assert G.grouped([1], [2], [3], [4]) == ([1, 3], [4, 2]) and G.with_prompt(rows, lambda c: F.upper(c), "c").first()["prompt"] == "X"
    seg = spark.createDataFrame([("e", "s1", 0.0, 10.0), ("e", "s2", 10.0, 20.0)], "k string, segment_id string, start double, end double")
    ev = spark.createDataFrame([("e", 2.0), ("e", 5.0), ("e", 12.0)], "k string, t double")
    parts = spark.createDataFrame([("e", "s1", i, float(3 * i), float(3 * i + 3)) for i in range(3)], "k string, segment_id string, part int, start double, end double")
    assert sorted((r["segment_id"], r["part"]) for r in G.compound(seg, ev, ["k"], parts).collect()) == [("s1", 0), ("s1", 1), ("s1", 2), ("s2", 0)]
    with pytest.raises(KeyError, match="1 samples"):
        G.weights_in_order(spark.range(3), spark.createDataFrame([(0, 1.0), (1, 2.0)], "id long, w double"), "id", "id", "w")
    both = spark.createDataFrame([("e", 1.0, True, 1), ("e", 1.0, True, 2), ("e", 3.0, False, 3)], "k string, t double, both boolean, i int")
    win = spark.createDataFrame([("e", "w", 0.0, 3.0)], "k string, window_id string, start double, end double")
    assert sorted(r["i"] for r in G.in_window(both, win, ["k"], "t", "i", 10.0).collect()) == [1, 3]


def test_cubic_resampling(spark):
    from kinetide.operators import vectors as V

    x = [k**3 - 2.0 * k for k in range(8)]
    got = spark.createDataFrame([(x,)], "a array<double>").select(V.resample_cubic(F.col("a"), 8, 15, 0.5).alias("y")).first()["y"]
    want = [((k / 2) ** 3 - k) / 2 for k in range(15)]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True))


def test_packed_frames_and_digests(spark, tmp_path):
    import hashlib

    from kinetide.sources import records as IO

    frames = spark.createDataFrame([("e", k, bytes([k])) for k in (0, 1, 4)], "k string, f int, d binary")
    IO.write_packed(frames, str(tmp_path / "p"), "k", "f", "d")
    wanted = spark.createDataFrame([("e", 1), ("e", 3), ("x", 0)], "key string, frame long")
    got = IO.read_packed(spark, str(tmp_path / "p"), wanted).orderBy("key", "frame").collect()
    assert [(r["key"], r["frame"], r["data"] and bytes(r["data"])) for r in got] == [("e", 1, b"\x01"), ("e", 3, b"\x04"), ("x", 0, None)]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_bytes(b"abc")
    r = IO.file_digests(spark, str(tmp_path / "f")).first()
    assert (r["n_bytes"], r["sha256"]) == (3, hashlib.sha256(b"abc").hexdigest())


def test_verbs(spark, tmp_path, capsys):
    from kinetide import __main__ as verbs

    rows = [("t", f"e{i}", [(str(k), float(k), k + 0.5 + i, "open the door" if k % 2 else "move cup") for k in range(4)], 3000) for i in range(3)]
    spark.createDataFrame(rows, "task_id string, episode_id string, skill_timeline array<struct<segment_id:string,start_time_sec:double,end_time_sec:double,skill_description:string>>, n_rows long").write.parquet(str(tmp_path / "in"))
    assert verbs.main(["build", str(tmp_path / "in"), str(tmp_path / "seg")]) == 0 and "12 rows" in capsys.readouterr().out
    verbs.main(["build", str(tmp_path / "in"), str(tmp_path / "seg"), "--apply"])
    verbs.main(["weights", str(tmp_path / "seg"), str(tmp_path / "w"), "--apply"])
    assert spark.read.parquet(str(tmp_path / "w")).agg(F.round(F.sum("weight"), 3)).first()[0] == 12.0
    verbs.main(["split", str(tmp_path / "seg"), str(tmp_path / "shards"), "--apply"])
    from kinetide.sources import packed, shards

    assert shards.read_sealed(spark, str(tmp_path / "shards"), "skill_canonical").count() == 12
    assert shards.damaged(spark, str(tmp_path / "shards"), "skill_canonical").count() == 0
    frames = spark.createDataFrame([(k, f, f"{k}{f}".encode()) for k in "ab" for f in range(5)], "key string, frame long, data binary")
    frames.where("key = 'a'").write.parquet(str(tmp_path / "f1"))
    frames.write.parquet(str(tmp_path / "f2"))
    verbs.main(["pack", str(tmp_path / "f1"), str(tmp_path / "packed"), "--apply"])
    capsys.readouterr()
    assert verbs.main(["cache", str(tmp_path / "f2"), str(tmp_path / "packed")]) == 0 and "5 frames" in capsys.readouterr().out
    verbs.main(["cache", str(tmp_path / "f2"), str(tmp_path / "packed"), "--apply"])
    assert packed.packed_table(spark, str(tmp_path / "packed")).count() == 10
    spark.createDataFrame([([1.0], [2.0]), ([3.0], [4.0])], "state array<double>, action array<double>").coalesce(1).write.parquet(str(tmp_path / "e"))
    verbs.main(["prepare", str(tmp_path / "e"), str(tmp_path / "rows"), "--apply"])
    assert sorted((r["frame"], r["state"]) for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == [(0, [1.0]), (1, [3.0])]
