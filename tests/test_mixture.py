"""Places by ranges, mixtures and the bounded buffer."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinetide.operators import sampling as S


def test_numbered_by_ranges(spark):
    """A key with most rows lies in many ranges, and places are those of a sort."""
    df = spark.range(6000).selectExpr("if(id % 20 = 0, null, if(id % 20 = 1, 'few', 'hot')) k", "pmod(xxhash64(id), 100000) h", "id")
    rows = S.numbered(df.repartition(5), ["k"], ["h", "id"], "place").collect()
    by = {}
    for r in rows:
        by.setdefault(r["k"], []).append((r["h"], r["id"], r["place"]))
    assert len(rows) == 6000 and {k: len(v) for k, v in by.items()} == {None: 300, "few": 300, "hot": 5400}
    for found in by.values():
        assert [p for *_, p in sorted(found)] == list(range(len(found)))
    assert S.numbered(df.limit(0), ["k"], ["h", "id"], "place").collect() == []


@pytest.mark.parametrize("size,block", [(1, 64), (7, 64), (64, 64), (1000, 64), (5, 1000), (50, 3)])
def test_buffer(spark, size, block):
    n = 500
    df = spark.range(n).selectExpr("id place", "if(id % 3 = 0, null, id) other").repartition(3)
    got = {r["place"]: r["turn"] for r in S.buffered(df, "place", size, 4, block).collect()}
    assert sorted(got.values()) == list(range(n))
    assert all(p // block == t // block for p, t in got.items())
    assert all(t >= p - size + 1 for p, t in got.items())  # a row can't be given out before it has come
    assert got == {r["place"]: r["turn"] for r in S.buffered(df.repartition(7), "place", size, 4, block).collect()}
    if size == 1:
        assert all(p == t for p, t in got.items())
    else:
        assert got != {r["place"]: r["turn"] for r in S.buffered(df, "place", size, 5, block).collect()}


def test_mixture_is_repeatable_and_whole(spark):
    parts = {"a": (spark.range(300), 0.7), "b": (spark.range(50), 0.3)}
    one = sorted(map(tuple, S.mixed(parts, "id", 3, 2000).collect()))
    two = sorted(map(tuple, S.mixed({k: (df.repartition(6), w) for k, (df, w) in parts.items()}, "id", 3, 2000).collect()))
    assert one == two and sorted(r[2] for r in one) == list(range(2000))
    share = Counter(r[0] for r in one)
    assert abs(share["a"] / 2000 - 0.7) < 0.05
    for name, (df, _) in parts.items():  # each row as often as another, give or take one
        times = Counter(r[1] for r in one if r[0] == name)
        assert set(times) == {r[0] for r in df.collect()} and max(times.values()) - min(times.values()) <= 1
    shuffled = S.buffered(S.mixed(parts, "id", 3, 2000), "place", 100, 9)
    assert sorted(r["turn"] for r in shuffled.select("turn").collect()) == list(range(2000))
    with pytest.raises(ValueError):
        S.buffered(spark.range(3), "id", 0, 1)
