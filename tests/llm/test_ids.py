import zlib

import numpy as np
import pytest

from kinetide.llm import bpe, ids


def truth(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.tokenizer_file())
    out, start = [], 0
    for key, text in rows:
        x = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((key, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    return out


def test_whole_table(spark, sf_dir):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert sorted(map(tuple, ids.op4_ids(spark, sf_dir).collect())) == truth(rows)


def test_nulls_repeats_and_small_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ids, "BLOCK_IDS", 50)
    rows = [(None, "null key"), (-5, None), (2, ""), (3, "same"), (3, "same"), (3, "same"), (4, "a " * 500), (9, "x")]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in reversed(rows)], "doc_id long, text string, key string").repartition(3)
    path = str(tmp_path / "i")
    ids.write_blocks(docs, path, bpe.tokenizer_file())
    ids.write_index(spark, path)
    got = ids.read_all(spark, path, docs.selectExpr("doc_id key"), ids.crcs, "crc long").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, truth(rows)))
    absent = spark.createDataFrame([(k,) for k in range(100, 1100)], "key long")
    assert ids.lookup(spark, path, absent).count() == 0


def test_one_key_reads_its_bucket_and_block(spark, sf_dir, tmp_path):
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), str(tmp_path / "k")
    ids.write_blocks(docs, path, bpe.tokenizer_file())
    ids.write_index(spark, path)
    one = docs.where("doc_id = 7").selectExpr("doc_id key")
    found = ids.lookup(spark, path, one)
    got = ids.fetch(spark, path, found.drop("rows"), ids.crcs, "crc long", few=True)
    for df, column in ((found, "bucket"), (got, "part")):
        plan = df._jdf.queryExecution().toString()
        assert any("PushedFilters" in x and column in x.split("PushedFilters")[1] for x in plan.splitlines())
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert [tuple(r) for r in got.collect()] == [x for x in truth(rows) if x[0] == 7]


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = str(tmp_path / "e")
    ids.write_blocks(docs, path, bpe.tokenizer_file())
    ids.write_index(spark, path)
    assert ids.read_all(spark, path, docs.selectExpr("doc_id key")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 3000])
def test_perfect_and_minimal(n):
    h = np.random.RandomState(n).randint(0, 2**63, n).astype(np.uint64)
    assert sorted(ids.slots(h, ids.find_pilots(h), n).tolist()) == list(range(n))
