import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetide.llm import phrases as P
from tests.compare import difference, duck

SCHEMA = "doc_id long, text string, lang string, phrase string, a int"


def truth(rows, top=2000, least=10):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {}
    for (lang, *p), a in f.items():
        if len(p) > 1 and a >= least:
            cuts = [(10**6 * a * a // (f[(lang, *p[:k])] * f[(lang, *p[k:])]), k, f[(lang, *p[:k])], f[(lang, *p[k:])]) for k in range(1, len(p))]
            found[(lang, *p)] = (a, *min(cuts))
    out = {}
    for (lang, *p), (a, score, _, left, right) in found.items():
        longer = [x for (g, *q), (x, *_) in found.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not any(100 * x >= 50 * a for x in longer):
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted(str((lang, i, p.decode(), -a, left, right, n[lang], -s)) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


def run(spark, rows, **given):
    docs = spark.createDataFrame([(k, t, g, "clash", 1) for k, (t, g) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(str(tuple(r)) for r in P.mined(docs, **given).collect())


def random_rows(seed, n=60):
    r = random.Random(seed)
    say = lambda: "".join(r.choice(["a", "B", "c", "é", "de", "F g", "x1", "ß"]) + r.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b", " - "]) for _ in range(r.randrange(40)))
    return [(say(), r.choice(["en", "en", "fr", None, "und"])) for _ in range(n)] + [(None, "en"), ("", None), (" \t\n", "fr")]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = random_rows(seed) * (1 + seed)
    assert run(spark, rows) == truth(rows)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    """Cells far too few for the phrases: more survive, and counts stay exact. Small parts and pieces of one text."""
    for name, value in (("FEWEST", 3), ("MOST", 3), ("PIECE", 50), ("RANKED", 1)):
        monkeypatch.setattr(P, name, value)
    rows = random_rows(9)
    assert run(spark, rows) == truth(rows)
    assert run(spark, rows, top=3) == truth(rows, top=3)
    assert run(spark, rows, least=300) == truth(rows, least=300)


def test_long_texts_and_empty_tables(spark):
    rows = [("new york city " * 30_000 + "x" * 50_000, "en"), ("New York, city", "en")]
    assert run(spark, rows) == truth(rows)
    assert run(spark, []) == []
    assert run(spark, [(None, None)]) == []


def test_sketch_filters(spark):
    """With enough cells, few phrases below the least count survive, and all above it."""
    r = random.Random(1)
    docs = spark.createDataFrame([(k, " ".join(r.choice("abcdefgh") + str(int(r.paretovariate(0.4))) for _ in range(300)), "en", "", 1) for k in range(60)], SCHEMA)
    rows = P.texts_of(docs)
    packed = P.sketch(rows, 20)
    seen = Counter()
    for row in rows.collect():
        w = row["text"].split()
        for k in (1, 2, 3):
            seen.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    wanted = {p for p, n in seen.items() if n >= 10}
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 60, "text": [x["text"] for x in rows.collect()]})
    got = set()
    for out in P.exact(P.Grams(batch), packed, 20):
        got |= {tuple(p.split()) for p in out.column(1).to_pylist() if p}
    assert wanted <= got and len(got) < 1.2 * len(wanted)


def test_exact_scores_beyond_64_bits(spark):
    a, left, right = 40_000_000_001, 50_000_000_003, 900_000_000_007
    got = spark.range(1).select(P.score(F.lit(a), F.lit(left), F.lit(right))).first()[0]
    assert got == 10**6 * a * a // (left * right)


def test_counting_of_many_words():
    columns = [np.array([0, 1, 0]), np.array([5, 6, 5])]
    assert all((np.array(x) == np.array(y)).all() for x, y in zip(P.counted(columns, [2, 9])[0], P.counted(columns, [2**40, 2**40])[0], strict=True))


def test_same_as_sql(spark, sf_dir):
    assert difference(P.op12_phrases, P.OP12_SQL, spark, sf_dir, duck(sf_dir)) == ""
