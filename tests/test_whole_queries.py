"""Queries that ask every row and component, counted against the tables themselves."""

from pyspark.sql import functions as F

from kinetide.plans import catalogue


def test_every_purchase_is_asked(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    got = catalogue.queries()["next_of_either_side"](spark, sf_dir)
    assert sorted(r[0] for r in got.select("event_id").collect()) == sorted(r[0] for r in events.where("event_type = 'purchase'").select("event_id").collect())
    assert {r[0] for r in got.where("next_us is not null").select("side").distinct().collect()} == {0, 1}


def test_every_component_is_resampled(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.max(F.size("embedding"))).first()[0]
    got = catalogue.queries()["resampled_whole"](spark, sf_dir).select(F.size(F.split("chunk", ",")).alias("n")).distinct().collect()
    assert [r["n"] for r in got] == [2 * n - 1]


def test_no_nation_is_hidden(spark, sf_dir):
    assert catalogue.queries()["lookup_all"](spark, sf_dir).where("nation = 'UNMAPPED'").count() == 0
