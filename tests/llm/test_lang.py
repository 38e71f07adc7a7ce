import zlib

import numpy as np

from kinetide.llm import lang

WORDS = {"aa": "the of and with that from", "bb": "der und nicht ein mit auf", "cc": "que para los una como ñu"}


def say(language, seed, n=60):
    r = np.random.RandomState(seed)
    return " ".join(r.choice(WORDS[language].split(), n))


def train(spark):
    rows = [(i, say(k, i), k, 1) for i in range(300) for k in [list(WORDS)[i % 3]]] + [(900, None, "aa", 1), (901, "the of", None, 1), (None, "the", "aa", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").repartition(3)


def test_learns_predicts_and_mixes(spark):
    docs = train(spark)
    model = lang.learn(docs)
    assert model[0] == ["aa", "bb", "cc"]
    mixed = say("aa", 1, 100) + " " + say("bb", 2, 50)
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 + 4!", "x"), (4, mixed, "x"), (4, mixed, "x"), (5, say("cc", 9, 9000), "x"), (None, "und", "x")]
    got = lang.predict(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string"), model).collect()
    assert len(got) == len(rows)
    by = {r["key"]: r for r in got}
    assert [by[k]["lang_pred"] for k in (1, 2, 3, 4, 5, None)] == ["und", "und", "und", "aa", "cc", "bb"]
    shares = {x["lang"]: x["share"] for x in by[4]["langs"]}
    assert set(shares) == {"aa", "bb"} and abs(shares["aa"] - 2 / 3) < 0.08
    assert len(by[5]["langs"]) == 1 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["key"]: r["held_out"] for r in got if r["key"]} == {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in (1, 2, 3, 4, 5)}


def test_empty(spark):
    none = train(spark).limit(0)
    model = lang.learn(none)
    assert model[0] == [] and lang.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in lang.predict(train(spark), model).collect()} == {"und"}


def test_em_agrees_with_a_grid():
    r = np.random.RandomState(0)
    p = r.dirichlet(np.ones(50) * 0.3, 2).T + 1e-9
    c = r.poisson(200 * (0.7 * p[:, 0] + 0.3 * p[:, 1])).astype(float)
    w, ll = lang.mixture(p, c, 500)
    grid = np.linspace(0.001, 0.999, 999)
    each = [c @ np.log(p @ np.array([x, 1 - x])) for x in grid]
    assert abs(grid[int(np.argmax(each))] - w[0]) < 0.005 and ll >= max(each) - 1e-3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in lang.op9_lang(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in got]) > 0.97


def test_every_language_that_can_rise_is_tried():
    r = np.random.RandomState(28)
    p = r.dirichlet(np.full(12, 0.3), 7).T + 1e-4
    p /= p.sum(0)
    c = r.randint(0, 60, 12).astype(float)
    chosen, _, _ = lang.infer(p, c)
    first = int((c @ np.log(p)).argmax())
    one = float(c @ np.log(p[:, first]))
    best = max(((lang.mixture(p[:, [first, k]], c)[1], k) for k in range(7) if k != first))
    assert best[0] - one > lang.COST * np.log(c.sum() + 1) and best[1] in chosen
    rise = p.T @ (c / p[:, first]) - c.sum()
    assert best[1] not in np.argsort(-rise)[:3]
