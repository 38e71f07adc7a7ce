"""Order statistics against sorted lists, running histograms against a fold of batches, and one key with most of the rows."""

import math
import random

import numpy as np
import pytest

from kinetide.operators import quantiles as Q


def kinds(r):
    return {
        "even": [r.random() for _ in range(900)], "same": [3.5] * 500, "two": [1.0, 2.0] * 40, "one": [7.0], "wide": [r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300) for _ in range(900)], "small": [5e-324 * k for k in range(300)],
        "ends": [float("-inf"), float("inf"), 0.0, -0.0, 1.0] * 60, "heavy": [0.0] * 700 + [r.gauss(0, 1) for _ in range(300)], "huge": [-1.7e308, 1.7e308, 1.0, 2.0, 3.0] * 50, "far": [1e15 + k for k in range(400)], None: [1.0, 5.0, 2.0],
    }


@pytest.mark.parametrize("few,bins", [(1, 16), (50, 64), (2000, 4096)])
def test_order_statistics(spark, monkeypatch, few, bins):
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "BINS", bins)
    data = kinds(random.Random(5))
    rows = [(k, x) for k, xs in data.items() for x in [*xs, None, float("nan")]] + [("empty", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    shares = {"a": 0.0, "b": 0.3, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r["k"]: r for r in Q.order_statistics(df, ["k"], "x", shares).collect()}
    assert set(got) == set(data)
    for k, xs in data.items():
        assert got[k]["n"] == len(xs)
        assert [got[k][s] for s in shares] == [sorted(xs)[min(len(xs) - 1, int(len(xs) * q))] for q in shares.values()], k
    got = {r["k"]: r for r in Q.percentiles(df.where("k is null or k not in ('ends', 'huge')"), ["k"], "x", {"p": 0.3, "q": 0.99}).collect()}
    for k in set(data) - {"ends", "huge"}:
        assert all(math.isclose(got[k][n], np.percentile(data[k], 100 * q), rel_tol=1e-9, abs_tol=1e-320) for n, q in (("p", 0.3), ("q", 0.99))), k


def test_one_key_is_many_tasks(spark, monkeypatch):
    """Of a key with nine tenths of the rows, no shuffled group is larger than a range's bins."""
    monkeypatch.setattr(Q, "FEW", 10)
    df = spark.range(40_000).selectExpr("if(id % 10 = 0, 'rare', 'hot') k", "cast(pmod(hash(id), 1000003) as double) x")
    got = {r["k"]: (r["m"], r["n"]) for r in Q.order_statistics(df, ["k"], "x", {"m": 0.5}).collect()}
    for k in ("hot", "rare"):
        xs = sorted(r["x"] for r in df.where(f"k = '{k}'").collect())
        assert got[k] == (xs[len(xs) // 2], len(xs))


def test_without_keys_and_rows(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "x double")
    assert [tuple(r) for r in Q.percentiles(df, [], "x", {"p": 0.25}).collect()] == [(11, 2.5)]
    assert Q.order_statistics(df.limit(0).selectExpr("1 k", "x"), ["k"], "x", {"p": 0.5}).collect() == []


def test_percentiles_are_fused_whatever_their_names(spark):
    r = random.Random(8)
    data = {k: [r.gauss(0, 10) for _ in range(r.randrange(2, 90))] for k in range(60)}
    df = spark.createDataFrame([(k, x) for k, xs in data.items() for x in xs], "k int, x double")
    shares = {"_p": 0.3, "_x": 0.7, "_part": 0.5}
    for row in Q.percentiles(df, ["k"], "x", shares).collect():
        xs = sorted(data[row["k"]])
        for name, q in shares.items():
            place = (len(xs) - 1) * q
            part = place - math.floor(place)
            assert row[name] == math.fma(xs[math.floor(place)], 1 - part, xs[math.ceil(place)] * part), (row["k"], name)


def fold(batches):
    """Quantiles of a histogram kept batch by batch."""
    edges = counts = None
    lo, hi, n = math.inf, -math.inf, 0
    for xs in batches:
        old = (lo, hi)
        lo, hi, n = min(lo, *xs), max(hi, *xs), n + len(xs)
        if edges is None:
            edges, counts = np.linspace(lo - 1e-10, hi + 1e-10, 5001), np.zeros(5000)
        elif old != (lo, hi):
            wider = np.linspace(lo, hi, 5001)
            counts, edges = np.histogram(edges[:-1], wider, weights=counts)[0], wider
        counts = counts + np.histogram(xs, edges)[0]
    return [edges[np.searchsorted(np.cumsum(counts), q * n)] for q in (0.01, 0.99)]


def test_running_histogram(spark):
    r = random.Random(2)
    data = {
        "grows": [[r.gauss(0, 1 + b) for _ in range(30)] for b in range(12)], "rises": [[b + i / 40 for i in range(20)] for b in range(15)], "still": [[r.random() for _ in range(200)]] + [[0.5, 0.6]] * 5,
        "same": [[2.0, 2.0], [2.0]], "steps": [[2.0, 2.0], [2.0, 3.0], [1.0]], "edge": [[0.0, 1.0], [0.2 * k for k in range(6)]],
    }
    rows = [(k, b, x) for k, batches in data.items() for b, xs in enumerate(batches) for x in xs] + [("once", 0, 1.0), ("same", 0, None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, b int, x double").repartition(4)
    got = {x["k"]: x for x in Q.running_quantiles(df, ["k"], "b").collect()}
    assert set(got) == set(data)
    for k, batches in data.items():
        flat = [x for xs in batches for x in xs]
        assert [got[k]["q01"], got[k]["q99"]] == fold(batches), k
        assert (got[k]["n"], got[k]["lo"], got[k]["hi"]) == (len(flat), min(flat), max(flat)) and math.isclose(got[k]["std"], np.std(flat), abs_tol=1e-7)
