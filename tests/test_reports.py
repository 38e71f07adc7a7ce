"""Signal lines, planner repairs and codecs by hand and against walks; chains of moved ends in logarithmic rounds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetide.functions import codecs as K
from kinetide.operators import planning as P
from kinetide.operators import signals as G
from kinetide.operators import temporal as T

O, C = G.OPENING, G.CLOSING


def test_lines_by_hand(spark):
    grips = [("r", "left", 1.0, O), ("r", "left", 2.5, C), ("r", "right", 1.5, O), ("r", "left", 4.0, O), ("r", "left", 5.0, O), ("r", "left", 9.0, C), ("r", "left", 12.0, C), ("r", "right", 20.0, "other"), ("r", None, 3.0, O), ("r", "left", None, O), ("q", "left", 0.0, C)]
    spans = [("r", "stop", "cp1", 0.0, 0.2), ("r", "stop", None, 1.0, 1.5), ("r", "active", "left", 3.0, 4.0), ("r", "silent", None, 2.0, 2.1), ("r", "stop", "x", None, 2.0), ("r", "odd", "x", 1.0, 2.0)]
    g, s = spark.createDataFrame(grips, "k string, side string, t double, direction string"), spark.createDataFrame(spans, "k string, kind string, name string, start double, end double")
    made = G.lines(g, s, ["k"])
    got = [(r["k"], r["line"]) for r in sorted(made.collect(), key=lambda r: (r["k"], r["place"]))]
    assert got == [("q", f"- t=0.00s  left gripper {C}")] + [("r", x) for x in (
        "- ?: [2.00s - 2.10s]", "- left: [3.00s - 4.00s]", "- base_zero: [1.00s - 1.50s] dur=0.50s",
        f"- t=1.00s  left gripper {O}  (PAIRED with t=2.50s)", f"- t=1.50s  right gripper {O}", f"- t=2.50s  left gripper {C}  (PAIRED with t=1.00s)", f"- t=4.00s  left gripper {O}  (held until t=9.00s, grip duration 5.0s)",
        f"- t=5.00s  left gripper {O}  (held until t=9.00s, grip duration 4.0s)", f"- t=9.00s  left gripper {C}  (matches grip that started at t=5.00s, grip duration 4.0s)", f"- t=12.00s  left gripper {C}", "- t=20.00s  right gripper other",
    )]
    text = {r["k"]: r["text"] for r in G.report(made, ["k"], {"grip": "## Grips", "stop": "## Stops"}).collect()}
    assert text["q"] == f"## Grips\n- t=0.00s  left gripper {C}" and text["r"].split("\n")[2:4] == ["## Stops", "- base_zero: [1.00s - 1.50s] dur=0.50s"] and text["r"].split("\n")[4] == "## Grips"


SCHEMA = "k string, r int, task string, prompt string, stage string, sketch array<string>, outcome string, state array<double>, intent string"


def walk(rows):
    """What is carried out, row by row."""
    out, was = [], None
    for _, _, task, prompt, stage, sketch, outcome, state, intent in rows:
        rule = None
        if task == P.TASK and was:
            if was[3] == "complete" and was[1] == "place_on" and stage == "switch":
                burners = {s for s in was[2] or [] if s.startswith("Turn on ") and " burner" in s}
                if len(burners) == 1:
                    rule, prompt, sketch = "burner", next(iter(burners)), list(burners)
            if was[3] == "failed" and was[:2] == (P.PICK, "pick_up_from") and prompt == P.PLACE and state and abs(state[14] - state[15]) * 1000 <= 5:
                rule, prompt, stage, sketch = "regrasp", *was[:3]
        if intent:
            rule, (prompt, stage) = "recovery", P.INTENTS[intent]
            sketch = [prompt]
        was = (prompt, stage, sketch, outcome)
        out.append((rule, prompt, stage, sketch))
    return out


def test_repairs_against_a_walk(spark):
    r = random.Random(8)
    jaws = lambda gap: [0.0] * 14 + [gap / 1000, 0.0]
    kinds = [(P.PICK, "pick_up_from", ["a"]), (P.PLACE, "place_on", ["Turn on the left burner.", "x"]), (P.PLACE, "place_on", ["Turn on the left burner.", "Turn on the right burner."]), (P.PLACE, "place_on", None), ("Press it.", "switch", ["s"]), ("Go.", "move_to", [])]
    rows = []
    for k in range(40):
        for i in range(25):
            rows.append((f"k{k}", i, r.choice([P.TASK] * 5 + ["Other"]), *r.choice(kinds[:2] + kinds), r.choice(["failed", "failed", "complete", None]), r.choice([jaws(1.0), jaws(4.0), jaws(9.0), None]), r.choice([None] * 14 + ["navigate", "spout", "odd"])))
    rows = [(*x[:8], None if x[8] == "odd" else x[8]) for x in rows]
    got = {(x["k"], x["r"]): (x["rule"], x["prompt"], x["stage"], x["sketch"]) for x in P.repaired(spark.createDataFrame(rows, SCHEMA).repartition(3), ["k"], "r").collect()}
    want = {(rows[25 * k][0], i): w for k in range(40) for i, w in enumerate(walk(rows[25 * k : 25 * k + 25]))}
    assert got == want and {w[0] for w in want.values()} == {None, "burner", "regrasp", "recovery"}
    assert max(sum(1 for _ in run) for run in runs([want[k][0] for k in sorted(want)])) >= 2


def runs(xs):
    import itertools

    return (list(g) for k, g in itertools.groupby(xs) if k == "regrasp")


def test_stage_of(spark):
    rows = spark.createDataFrame([("open_close", ["manipulate"]), ("open_close", ["manipulate", "switch"]), ("open_close", None), ("pick", ["manipulate"])], "s string, k array<string>")
    assert [r[0] for r in rows.select(P.stage_of(F.col("s"), F.col("k"))).collect()] == ["manipulate", "switch", "switch", "pick"]


def test_cosine_round_trips(spark):
    r = np.random.RandomState(4)
    chunks = [r.uniform(-1, 1, (12, 3)).tolist() for _ in range(20)] + [np.zeros((12, 3)).tolist(), [[1.0, None, 2.0]] * 12, [[1.0, 2.0, 3.0]] * 11, [[float("nan")] * 3] * 12, None]
    df = spark.createDataFrame(list(enumerate(chunks)), "i int, c array<array<double>>").withColumn("t", K.cosine_tokens(F.col("c"), 12, 3)).withColumn("b", K.cosine_chunk(F.col("t"), 12, 3))
    rows = {x["i"]: x for x in df.withColumn("again", K.cosine_tokens(F.col("b"), 12, 3)).collect()}
    m = np.array(K.cosine_matrix(12))
    assert np.allclose(m @ m.T, np.eye(12))
    for i, c in enumerate(chunks[:21]):
        exact = m @ np.array(c) * 10
        assert np.abs(np.array(rows[i]["t"]).reshape(12, 3) - exact).max() <= 0.5 + 1e-9
        assert np.abs(np.array(rows[i]["b"]) - np.array(c)).max() <= 0.05 * math.sqrt(12) + 1e-9
        assert rows[i]["again"] == rows[i]["t"]
    assert all(rows[i]["t"] is None for i in range(21, 25))
    short = spark.range(1).select(K.cosine_chunk(F.array(F.lit(1).cast("bigint")), 2, 2).alias("b")).first()["b"]
    assert short == [[0.0, 0.0], [0.0, 0.0]]


@pytest.mark.parametrize("size", sorted(K.LEVELS))
def test_codes_round_trip(spark, size):
    levels = K.LEVELS[size]
    codes = spark.range(math.prod(levels)).select(F.col("id").alias("code"))
    back = codes.select("code", K.code_of(K.values_of(F.col("code"), levels), levels).alias("again"))
    assert back.where("code != again or again is null").count() == 0
    odd = spark.range(1).select(K.code_of(F.array(F.lit(5.0), F.lit(-5.0), F.lit(0.0)), (8, 6, 5)).alias("a"), K.code_of(F.array(F.lit(0.0)), (8, 6, 5)).alias("b")).first()
    assert tuple(odd) == (7 + 2 * 48, None)


def test_sequences_bins_and_vocabulary(spark):
    ints = lambda *x: F.array(*[F.lit(v).cast("bigint") for v in x])
    row = spark.range(1).select(K.sequence(ints(5, 6), ints(7), 5).alias("s"), K.sequence(ints(5, 6), ints(7, 8), 3).alias("c"), K.binned_actions(ints(0, 128, 256, 64), 2, 2).alias("a"), K.binned_actions(ints(1), 2, 2).alias("z"), K.vocabulary_token(F.lit(3), 1000).alias("v")).first()
    assert row["s"].asDict() == {"tokens": [5, 6, 7, 0, 0], "mask": [True] * 3 + [False] * 2, "causal": [0, 0, 1, 0, 0], "loss": [False, False, True, False, False]}
    assert row["c"].asDict() == {"tokens": [5, 6, 7], "mask": [True] * 3, "causal": [0, 0, 1], "loss": [False, False, True]}
    assert row["a"] == [[-1.0, 0.0], [1.0, -0.5]] and row["z"] == [[0.0, 0.0]] * 2 and row["v"] == 868
    x = np.random.RandomState(1).uniform(-1.2, 1.2, 300)
    x[:4] = -1, 1, 0, 0.9999
    got = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").select("i", K.state_bin(F.col("x")).alias("b")).collect()
    want = np.digitize(x, np.linspace(-1, 1, 257)[:-1]) - 1
    assert {r["i"]: r["b"] for r in got} == dict(enumerate(want.tolist()))


def test_long_chains_need_logarithmic_rounds(spark, monkeypatch):
    """Segments whose ends all have several stops before them, so that each start depends on the one before."""
    r = random.Random(6)
    segments, stops, want = [], [], []
    for k in range(12):
        n = 60
        halts = sorted({round(r.uniform(0, 10 * n), 2) for _ in range(6 * n)})
        start = 0.0
        for i in range(n):
            segments.append((f"k{k}", i, 10.0 * i, 10.0 * (i + 1), r.random() < 0.97))
            end = 10.0 * (i + 1)
            stop = next((x for x in halts if x > start), None)
            moved = segments[-1][4] and stop is not None and stop < end and stop - start >= 0.5 and end - stop <= 9.5
            want.append((f"k{k}", i, start, stop if moved else end, moved))
            start = stop if moved else end
        stops += [(f"k{k}", x) for x in halts]
    written = []
    keep = T.stored
    monkeypatch.setattr(T, "stored", lambda df, tag: written.append(tag) or keep(df, tag))
    got = T.snapped(spark.createDataFrame(segments, "k string, i int, s double, t double, m boolean"), spark.createDataFrame(stops, "k string, stop double"), ["k"], "i", "s", "t", 0.5, 9.5, "m")
    assert sorted(tuple(x) for x in got.collect()) == sorted(want) and sum(w[4] for w in want) > 100
    assert written.count("snap-steps") <= 2 + math.ceil(math.log2(60))
