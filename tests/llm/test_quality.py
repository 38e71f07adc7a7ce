import re
from collections import Counter

import numpy as np

from kinetide.llm import quality


def truth(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    covered = {k for i, g in enumerate(grams) if n[g] > 1 for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


HARD = [
    None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h i", "a b c d e f g h a b c d e f g h", "x " * 50, "a\n\na\n \na", "é🙂 #*$%&|<>\x0b\x0c\r z", "\x1c nbsp\xa0 joined",
    " ".join(str(i % 37) for i in range(30_000)), " ".join(map(str, range(20_000))), "w " * 3 + " ".join(map(str, range(8))) + " q " + " ".join(map(str, range(8))) + " " + " ".join(map(str, range(8))),
]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_counts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in quality.counts(docs).collect()}
    assert got == {i: truth(t) for i, t in enumerate(HARD)}


def mcd(x, share=0.75, starts=30):
    """Squared distances by the minimum-covariance-determinant estimate, independently: random subsets of five rows, exact
    nearest rows, until nothing changes, the least determinant of all starts."""
    r = np.random.RandomState(1)
    n, d = x.shape
    h, best = int(np.ceil(share * n)), None
    for _ in range(starts):
        own = r.choice(n, d + 1, replace=False)
        for _ in range(100):
            mean, cov = x[own].mean(0), np.cov(x[own].T, bias=True) + np.eye(d) * quality.FLOOR**2
            d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            new = np.argsort(d2, kind="stable")[:h]
            if set(new) == set(own):
                break
            own = new
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = det, d2
    d2 = best[1]
    return d2 / max(1, np.sort(d2)[h - 1] / quality.CHI_75)


def test_outliers_against_an_independent_estimate(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.selectExpr("doc_id", "text", "lang", "'s' source", "n_chars kept")
    got = quality.judged(docs, least=40).toPandas()
    assert len(got) == docs.count() and not got.kept[got.base_failed].any()
    judged, differ, rejected = 0, 0, 0
    for _, own in got[~got.base_failed].groupby("lang"):
        want = mcd(own[quality.NAMES].to_numpy(float)) * own.n_words / (own.n_words + quality.SHORT)
        assert np.corrcoef(np.log(want + 1), np.log(own.d2 + 1))[0, 1] > 0.995
        judged, differ, rejected = judged + len(own), differ + ((want <= quality.CHI_FAR) != own.kept).sum(), rejected + (~own.kept).sum()
    assert rejected > 20 and differ <= 0.005 * judged


def test_good_texts_stay_and_poor_ones_go(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").groupBy("doc_id").max("quality").toPandas().set_index("doc_id")["max(quality)"]
    got = quality.op3_quality(spark, "/root/testdata/sf0.01").toPandas()
    got = got[~got.base_failed].assign(q=got.doc_id.map(labels))
    assert got.kept[got.q == 1].mean() > 0.99 and got.kept[got.q == 0].mean() < 0.05


def test_covariances_decide(spark):
    """Rows that lie within the spread of each statistic, but against their correlation, are rejected."""
    r = np.random.RandomState(5)
    rows = []
    for k in range(400):  # the fewer short words, the longer the mean: odd rows have few short words and a short mean
        share, long = (r.uniform(0.2, 0.6), 6) if k < 390 else (0.25, 4.4)
        words = ["".join(r.choice(list("abcdefghijklmnop"), 2 if r.rand() < share else int(long + r.rand()))) for _ in range(400)]
        rows.append((k, " ".join(words), "en", "a"))
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas().set_index("key")
    assert not got.base_failed.any()
    x = got[quality.NAMES].to_numpy(float)
    alone = (x - np.median(x, 0)) / np.maximum(quality.FLOOR, (np.percentile(x, 75, 0) - np.percentile(x, 25, 0)) / 1.349)
    far = (alone**2).sum(1) > quality.CHI_FAR
    odd = got.index >= 390
    assert not got.kept[odd].any() and got.kept[~odd].mean() > 0.97 and far[odd].mean() < 0.5


def test_nulls_repeats_clashes_and_empty(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(1, good, None, "a", 1), (1, good, None, "a", 1), (None, good, "en", None, 1), (2, None, "en", "a", 1), (3, "", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    got = sorted((r["key"] or 0, r["base_failed"], r["kept"]) for r in quality.judged(docs).collect())
    assert got == [(0, False, True), (1, False, True), (1, False, True), (2, True, False), (3, True, False)]
    assert quality.judged(docs.limit(0)).count() == 0
    many = spark.range(300).selectExpr("id doc_id", f"concat('{good} ', id) text", "'en' lang", "'a' source").unionByName(spark.createDataFrame([(999, good.replace(" ", " ### "), "en", "a")], "doc_id long, text string, lang string, source string"))
    assert [r["key"] for r in quality.judged(many).where("not kept").collect()] == [999]


def test_no_python_in_the_plan(spark, sf_dir):
    plan = quality.op3_quality(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _plain(k):
    return " ".join(f"{(7 * k + i) % 1000:03d}" for i in range(100))


def test_repeats_and_lines_alone_are_outliers(spark):
    words = _plain(0).split()
    lines = "\n".join(x for i in range(0, 90, 3) for x in (" ".join(words[i : i + 3]), "991 992 993"))
    repeats = " ".join([*words[:14], *words[:86]])
    rows = [(k, _plain(k)) for k in range(300)] + [(1000, lines), (1001, repeats)]
    docs = spark.createDataFrame([(k, t, "en", "a") for k, t in rows], "doc_id long, text string, lang string, source string")
    found = quality.judged(docs)
    assert not found.where("base_failed").count()
    assert sorted(r["key"] for r in found.where("not kept").collect()) == [1000, 1001]


def test_last_small_pool_is_judged_against_all_rows(spark):
    rows = [(k, _plain(k), "en", "a") for k in range(150)] + [(500, _plain(500), "zz", "b"), (501, _plain(501).replace(" ", " ### "), "zz", "b")]
    found = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert found.count() == 152 and not found.where("d2 is null").count()
    assert [r["key"] for r in found.where("not kept").collect()] == [501]
