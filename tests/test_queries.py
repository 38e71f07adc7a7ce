"""Every query of the catalogue against its SQL on the smallest tables, and hand-made cases of operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kinetide.functions import text as X
from kinetide.operators import relational as R
from kinetide.operators import sampling as S
from kinetide.operators import temporal as T
from kinetide.operators import vectors as V
from kinetide.plans import catalogue
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, con, name):
    assert difference(catalogue.queries()[name], catalogue.oracle_sql()[name], spark, SF, con) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.ALL) - set(catalogue.oracle_sql())))
def test_without_sql_is_repeatable(spark, name):
    run = catalogue.queries()[name]
    a, b = (sorted(map(tuple, run(spark, SF).collect())) for _ in range(2))
    assert a and a == b


def test_stops_merge(spark):
    rows = spark.createDataFrame([("e", 0.0, 2.0), ("e", 2.8, 4.0), ("e", 5.5, 6.0)], "k string, s double, t double")
    assert sorted((r["start"], r["end"]) for r in T.merge_intervals(rows, ["k"], "s", "t", 1.0).collect()) == [(0.0, 4.0), (5.5, 6.0)]


def test_edges(spark):
    rows = spark.createDataFrame([("l", i, v) for i, v in enumerate([1, 1, -1, -1, 1])], "k string, i int, v int")
    assert [(r["i"], r["direction"]) for r in T.edges(rows, ["k"], "i", F.col("v") > 0).orderBy("i").collect()] == [(2, "down"), (4, "up")]


def test_coincidences_are_anchored(spark):
    rows = spark.createDataFrame([("e", 1.0, "close", "left"), ("e", 1.2, "close", "right"), ("e", 1.4, "close", "left")], "k string, t double, d string, side string")
    assert [(r["t"], r["n"]) for r in T.coincidences(rows, ["k"], "t", "d", "side", 0.3).collect()] == [(1.0, 2)]


def test_windows_and_chunks(spark):
    seg = spark.createDataFrame([(10, 15)], "s long, t long")
    assert sorted(r["window_start"] for r in T.windows(seg, "s", "t", 3).collect()) == [10, 11, 12]
    assert [r["window_start"] for r in T.windows(seg, "s", "t", 8).collect()] == [10]
    chunk = T.action_chunks(seg, "s", "t", 8).where("anchor = 10").orderBy("k")
    assert [r["frame"] for r in chunk.collect()] == [10, 11, 12, 13, 14, 14, 14, 14]


def test_gaps_and_percentiles(spark):
    rows = spark.createDataFrame([("e", 0.0, 1.0), ("e", 1.04, 2.0), ("e", 2.2, 2.25)], "k string, s double, t double")
    found = T.gaps(rows, ["k"], "s", "s", "t", 0.05).collect()
    assert len(found) == 1 and abs(found[0]["gap"] - 0.2) < 1e-9
    n = spark.range(1, 11).select(F.lit("a").alias("k"), "id")
    r = T.index_percentiles(n, ["k"], "id", {"p50": 0.5, "p90": 0.9}).first()
    assert (r["n"], r["p50"], r["p90"]) == (10, 6, 10)


def test_frames_are_clamped(spark):
    t = spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "t double")
    assert [r[0] for r in t.orderBy("t").select(T.to_frame(F.col("t"), 30.0, 5.0, F.lit(250).cast("bigint"))).collect()] == [150, 250, 250]


def test_labels(spark):
    said = ["Place cup in sink on left", "Put cup in sink", "move cup", "Open door", "wipe", " pick up x ", None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    assert [r[0] for r in rows.orderBy("i").select(X.label(F.col("s"))).collect()] == ["place_on", "place_in", "move_to", "open", "other", "pick_up_from", None]


def test_text_functions(spark):
    rows = spark.createDataFrame([("  a \t b ", 'say {"a": [1, "}"]} now', "go (2/3)", "x-12", "End.. ")], "s string, j string, o string, n string, e string")
    r = rows.select(X.squeezed(F.col("s")), X.first_json(F.col("j")), X.without_ordinal(F.col("o")), X.number_at_end(F.col("n")), X.bare_end(F.col("e")), X.parsed(F.col("j"), "a array<string>").getField("a").alias("a")).first()
    assert tuple(r) == ("a b", '{"a": [1, "}"]}', "go", 12, "End", ["1", "}"])


def test_apportionment():
    assert S.apportion([12621, 11671, 8394, 3207, 1610, 804], 48) == [16, 15, 10, 4, 2, 1]
    with pytest.raises(ValueError):
        S.apportion([1.0, 1.0], 1)


def test_class_weights(spark):
    rows = spark.createDataFrame([("a",)] * 4 + [("b",)], "k string")
    found = {r["k"]: round(r["weight"], 6) for r in S.class_weights(rows, "k", 0.5).collect()}
    assert found == {"a": 0.833333, "b": 1.666667}


def test_bins_masks_and_widths(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([-1.5, -1.0, 0.0, 0.999, 1.0, 2.0])], "i int, x double")
    assert [r[0] for r in rows.orderBy("i").select(V.bins(F.col("x"))).collect()] == [-1, 0, 128, 255, 255, 255]
    assert V.bool_mask(2, -2, 2) == [True, True, False, False, True, True]


def test_missing_statistics_are_an_error(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "e int, v array<double>")
    stats = V.vector_stats(rows.where("e = 1"), "v", ["e"])
    with pytest.raises(Exception, match="no statistics"):
        V.normalize(rows, [], "v", stats, ["e"]).collect()


def test_mode_and_first(spark):
    rows = spark.createDataFrame([("k", "b", 1), ("k", "a", 0), ("k", None, 2)], "k string, v string, o int")
    assert tuple(R.mode(rows, ["k"], "v").first()) == ("k", "b", 1)
    assert tuple(R.first_of(rows, ["k"], "o").select("k", "o", "v").first()) == ("k", 0, "a")


def test_reasons_in_order(spark):
    rows = spark.createDataFrame([("other", 3), ("open", 3), ("open", 9)], "label string, n int")
    found = R.by_reason(rows, {"dropped_other": F.col("label") == "other", "dropped_short": F.col("n") < 5}, "retained")
    assert {r["reason"]: r["n"] for r in found.collect()} == {"dropped_other": 1, "dropped_short": 1, "retained": 1}


def test_lookup_default_and_error(spark):
    rows, names = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert sorted(r["v"] for r in R.looked_up(rows, names, "k", "v", "none").collect()) == ["a", "none"]
    with pytest.raises(Exception, match="no v for k 2"):
        R.looked_up(rows, names, "k", "v").collect()


def test_names_by_pattern(spark):
    rows = spark.range(1).withColumnsRenamed({"id": "a.x"}).withColumn("b.x", F.lit(1)).withColumn("skip", F.lit(1))
    assert R.renamed(rows, {r"a\.(.*)": r"\1", "skip": None}).columns == ["x", "b.x"]
    with pytest.raises(ValueError):
        R.renamed(rows, {r".\.(.*)": r"\1"})


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, t long, v double")
    assert T.islands(none, ["k"], "t", F.col("v") > 0).count() == 0
    assert T.merge_intervals(none, ["k"], "t", "v", 1).count() == 0
    assert S.class_weights(none, "k", 0.5).count() == 0
    assert R.counts_of(none, "k", ["a"]).collect()[0]["n"] == 0
