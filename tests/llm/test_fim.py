import hashlib
import random
import re

from kinetide.llm import fim
from tests.compare import difference, duck

TEXTS = [
    None, "", "a", "one two, three", "é🙂 👩‍👩‍👧 é x\x00y\r\n\ttab", "holds <P> itself", "half <P or <S and >M<", "<", "<<<", "ends with <", "line\nline\n" * 40, "x" * 100_000, "word é" * 40_000, "'quoted' \\d {n}", "<S><M>",
]


def truth(key, text):
    t, h = text or "", hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    n, h1, h2, h3, h4 = len(u), *(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return key, n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def rows():
    r = random.Random(4)
    more = ["".join(r.choice("ab <>PSM\né.") for _ in range(r.randrange(60))) for _ in range(150)]
    return [(k, t) for k, t in enumerate(TEXTS + more)] + [(3, TEXTS[3]), (None, "no id here"), (None, "nor here")]


def test_outputs_and_round_trip(spark):
    data = rows()
    docs = spark.createDataFrame([(k, t, "clash", 7) for k, t in data], "doc_id long, text string, output string, n int").repartition(3)
    made = fim.infill(docs)
    got = made.collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [truth(*x) for x in data]
    assert sorted(map(str, ((r["key"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got))) == sorted(map(str, want))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert all(r["output_sha256"] == sha(r["output"]) for r in got)
    assert sorted(str((k, sha(t or ""))) for k, t in data) == sorted(str((r["key"], r["restored_sha256"])) for r in got)
    assert sorted(map(str, ((r["key"], r["text"]) for r in fim.restore(made).collect()))) == sorted(str((k, t or "")) for k, t in data)


def test_rates_and_empty_table(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(400)], "doc_id long, text string")
    assert {r["form"] for r in fim.infill(docs, plain=0).collect()} == {"plain"}
    assert {r["form"] for r in fim.infill(docs, plain=100, spm=100).collect()} == {"spm"}
    assert fim.infill(docs, seed="it's").where("form = 'psm'").count() > 200
    assert fim.infill(docs.limit(0)).collect() == []


def test_same_as_sql(spark, sf_dir):
    assert difference(fim.op13_fim, fim.OP13_SQL, spark, sf_dir, duck(sf_dir)) == ""
