import hashlib

import corpus_pipeline as pipeline

from kinetide.llm import bpe, quality

from . import test_decontam, test_neardup, test_secrets


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_each_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {r["key"] for r in quality.judged(docs).where("kept").collect()}
    one = pipeline.quality_rules(spark, docs, sf_dir)
    assert one.columns == columns and rows_of(one) == rows_of(docs.where(docs.doc_id.isin(list(kept))))

    texts = [(r["doc_id"], r["text"]) for r in one.collect()]
    want = {eval(x)[0] for x in test_neardup.truth(texts, 80) if eval(x)[3]}
    two = pipeline.near_duplicates(spark, one, sf_dir)
    assert two.columns == columns and rows_of(two) == rows_of(one.where(one.doc_id.isin(list(want))))

    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {eval(x)[0] for x in test_decontam.truth([(r["doc_id"], r["text"]) for r in two.collect()], bench) if eval(x)[5]}
    three = pipeline.benchmark_decontamination(spark, two, sf_dir)
    assert three.columns == columns and rows_of(three) == rows_of(two.where(~two.doc_id.isin([*bad, -1])))

    four = {r["doc_id"]: r for r in pipeline.secret_scans(spark, three, sf_dir).collect()}
    for r in three.collect():
        said = test_secrets.truth(r["text"])[1]
        mine = four.pop(r["doc_id"])
        if said:
            assert "[SECRET]" in mine["text"] and mine["n_chars"] == len(mine["text"]) and not test_secrets.truth(mine["text"])[1]
        elif "[SECRET]" not in mine["text"]:
            assert tuple(mine) == tuple(r)
    assert not four


def test_run_encodes_what_is_left(spark, sf_dir):
    from tokenizers import Tokenizer

    got = pipeline.run(spark, sf_dir).collect()
    tok = Tokenizer.from_file(bpe.tokenizer_file())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert 0 < len(got) < len(texts)
    for r in got:
        ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        if not any(test_secrets.truth(texts[r["doc_id"]])[1]):
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["n_tokens"] == len(ids)


def test_nulls_and_repeats(spark, sf_dir):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(1, good, "en", "a", 9), (1, good, "en", "a", 9), (2, good, "en", "a", 9), (None, good + " x y z", None, None, None), (3, None, None, "a", 0), (4, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in pipeline.near_duplicates(spark, docs, sf_dir).orderBy("doc_id").collect()] == [1, 3, 4]
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        stage(spark, docs, sf_dir).count()


def test_columns_of_any_name_pass_through(spark, sf_dir):
    good = " ".join(f"w{i}" for i in range(40))
    names = ["k", "h", "n", "one", "_key", "_blob", "_spans", "row", "key", "hash", "id", "group", "kept", "cell", "spans"]
    rows = [(1, good, "en", "a", 9), (1, good, "en", "a", 9), (1, good + " token=0123456789abcdef", "en", "a", 9), (2, good, None, None, 9), (3, None, None, "a", 0)]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in names))
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns and all(tuple(r)[5:] == tuple(range(len(names))) for r in got.collect()), name
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 5
    assert [r["doc_id"] for r in pipeline.near_duplicates(spark, docs, sf_dir).orderBy("doc_id").collect()] == [1, 3]


def test_encoding_decodes(spark, sf_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.tokenizer_file())
    docs = spark.createDataFrame([(1, "Hello, World"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["decoded_sha256"] for r in pipeline.bpe_encoding(spark, docs, sf_dir).collect()}
    want = tok.decode(tok.encode("Hello, World", add_special_tokens=False).ids, skip_special_tokens=False)
    assert got == {1: hashlib.sha256(want.encode()).hexdigest(), 2: hashlib.sha256(b"").hexdigest()}


def test_quality_rules_run_no_python(spark, sf_dir):
    from pyspark.sql import functions as F

    from kinetide.llm.common import among_bits

    one = pipeline.quality_rules(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = spark.range(-5000, 5000).selectExpr("xxhash64(id) h", "id")
    keys = rows.where("id % 5 = 0").selectExpr("h k")
    some, others = among_bits(rows, F.col("h"), keys, "k")
    assert others.where("id % 5 = 0").isEmpty() and some.columns == ["h", "id"]
    assert 2000 <= some.count() < 2800 and some.unionByName(others).distinct().count() == 10_000
    some, others = among_bits(rows, F.col("h"), keys.limit(0), "k")
    assert some.isEmpty() and others.count() == 10_000
