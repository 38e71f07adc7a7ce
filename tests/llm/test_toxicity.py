import numpy as np

from kinetide.llm import toxicity


def make(spark, n=600):
    r = np.random.RandomState(3)
    words = [f"word{k}" for k in range(300)]
    rows, marks = [], []
    for i in range(n):
        bad = i % 7 == 0
        text = " ".join(r.choice(words, 40)) + (" vileness " + r.choice(["rotten", "rottenly"]) if bad else "")
        rows.append((i, text, "a", "b", 0.5))
        if i % 2 == 0:
            marks.append((i, int(bad)))
    marks += [(10, None), (None, 1), (0, 1), (10_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").repartition(3)
    return docs, spark.createDataFrame(marks, "doc_id long, toxic int")


def test_finds_what_is_labelled_and_what_is_not(spark):
    docs, labels = make(spark)
    got = toxicity.predict(docs, toxicity.learn(docs, labels)).collect()
    truth = {i: int(i % 7 == 0) for i in range(600)}
    held = [r for r in got if r["held_out"]]
    assert len(got) == 600 and len(held) > 80
    assert np.mean([truth[r["key"]] == r["predicted"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.5) == bool(r["predicted"]) for r in got)


def test_nulls_repeats_long_texts_and_empty_tables(spark):
    docs, labels = make(spark)
    model = toxicity.learn(docs, labels)
    rows = [(1, None), (2, ""), (2, ""), (None, "vileness rotten"), (3, "vileness rotten " + "word1 " * 300_000)]
    got = {r["key"]: r for r in toxicity.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1]["score"] == got[2]["score"] < 0.5 <= got[None]["score"] and got[3]["predicted"] == 1
    none = toxicity.learn(docs.limit(0), labels.limit(0))
    assert not len(none[0]) and toxicity.predict(docs.limit(0), none).count() == 0
    assert {r["predicted"] for r in toxicity.predict(docs, toxicity.learn(docs, labels.limit(0))).collect()} == {0}


def test_risk_is_held_at_zero():
    r = np.random.RandomState(1)
    positive = [[0, *r.randint(1, 40, 2)] for _ in range(60)]
    unlabelled = [[*([0] if i % 4 == 0 else []), *r.randint(1, 40, 2)] for i in range(400)]
    w, b = toxicity.fit(positive, unlabelled, 40, 0.25)
    assert w[0] == max(w) and w[0] + b > 0 > b


def test_held_out_quality(spark):
    """Recall and precision among held-out rows that are labelled, on three sizes; empty texts are near the prior or below."""
    for size, recall, precision in (("0.001", 0, 0), ("0.01", 0.3, 0.6), ("0.1", 0.85, 0.85)):  # 1, 6 and 97 toxic ones are held out
        sf = f"/root/testdata/sf{size}"
        labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
        rows = toxicity.op5_toxicity(spark, sf).collect()
        got = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
        tp, real, said = sum(a == b == 1 for a, b in got), sum(a for a, _ in got), sum(b for _, b in got)
        assert sum(r["predicted"] for r in rows) <= 0.25 * len(rows), size
        assert tp >= recall * real and tp >= precision * said, (size, tp, real, said)


def test_an_empty_text_is_near_the_prior(spark):
    docs, labels = make(spark, 120)
    kept, w, b = toxicity.learn(docs, labels)
    assert 1 / (1 + np.exp(-b)) < 0.3


def test_reader_finds_what_a_plain_one_does():
    """Features of each text against sets of runs, in batches and alone; case, marks, other scripts and repeats."""
    import pyarrow as pa

    r = np.random.RandomState(7)
    stems = ["Rotten", "vile", "ÉÇole", "straße", "x1", "словоСЛОВО", "a", "abcdefghij"]
    texts = ["", " ", "...", "Rotten-rotten ROTTEN", "é" * 30, *[" ,.\n"[i % 4].join(r.choice(stems, r.randint(0, 12))) for i in range(200)], "vile " * 20_000]
    plain = lambda t: set().union(*map(toxicity.runs_of, {w.encode() for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()}))
    kept = tuple(sorted(set().union(*map(plain, texts)))[::3])
    want = [[k for k, s in enumerate(kept) if s in plain(t)] for t in texts]
    own = toxicity.Reader(kept)
    assert own.lists(pa.array(texts)).to_pylist() == want
    assert [own.lists(pa.array([t])).to_pylist()[0] for t in texts] == want
    assert own.lists(pa.array(texts).slice(5, 9)).to_pylist() == want[5:14]
    assert own.lists(pa.array([], pa.string())).to_pylist() == [] and toxicity.Reader(()).lists(pa.array(["a b"])).to_pylist() == [[]]


def test_runs_are_made_only_where_a_kept_one_begins(monkeypatch):
    import pyarrow as pa

    r = np.random.RandomState(4)
    texts = [" ".join("".join(r.choice(list("abé"), r.randint(1, 10))) for _ in range(30)) for _ in range(20)] + [""]
    runs = sorted(set().union(*[toxicity.runs_of(x) for words in toxicity.words_of(pa.array(texts)) for x in words]))
    kept = tuple(runs[k] for k in sorted(r.choice(len(runs), 200, replace=False)))
    number = {s: k for k, s in enumerate(kept)}
    every = [sorted(number[s] for s in set().union(*map(toxicity.runs_of, words)) & number.keys()) if words else [] for words in toxicity.words_of(pa.array(texts))]
    monkeypatch.setattr(toxicity, "runs_of", None)
    assert toxicity.Reader(kept).lists(pa.array(texts)).to_pylist() == every
