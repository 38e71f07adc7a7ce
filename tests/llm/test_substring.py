import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from kinetide.llm import substring


def truth(rows, size=50):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (k, _), w in zip(rows, words, strict=True):
        if k is not None:
            for i in range(len(w) - size + 1):
                g = tuple(w[i : i + size])
                least[g] = min(least.get(g, k), k)
    out = []
    for (k, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if k is not None and least[tuple(w[i : i + size])] < k:
                gone |= set(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(str, out))


def run(spark, rows):
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], "doc_id long, text string, kept string, row int").repartition(3)
    got = substring.dedup(docs).select("key", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    return sorted(str(tuple(r)) for r in got)


def corpus(seed):
    r = random.Random(seed)
    say = lambda n, words=400: [f"w{r.randrange(words)}é" for _ in range(n)]
    passages = [say(n) for n in (49, 50, 51, 60, 75, 90, 120, 300)]
    rows = []
    for k in range(60):
        own = say(r.randrange(60))
        for _ in range(r.randrange(5)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            own += p[a : a + r.randrange(len(p))] if r.random() < 0.5 else p
            own += say(r.randrange(30))
        if own and r.random() < 0.3:
            own[r.randrange(len(own))] = "edit"
        rows.append((r.choice([k, -k, 1000 - k]), r.choice([" ", "\n", " \t"]).join(own)))
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        rows += [(5000, rows[0][1]), (5001, rows[0][1]), (rows[3][0], rows[4][1]), (None, rows[5][1]), (None, rows[5][1]), (6000, None), (6001, ""), (6002, " "), (6003, "a " * 400), (6004, "b " + "a " * 200), (6005, "a b " * 90), (6006, "x " + "a b " * 60)]
        assert run(spark, rows) == truth(rows)


def test_few_words_many_ties(spark):
    r = random.Random(9)
    rows = [(k, " ".join(r.choice("ab") if r.random() < 0.05 else "a" for _ in range(r.randrange(40, 160)))) for k in range(40)]
    assert run(spark, rows) == truth(rows)


def test_empty_and_whole_table(spark, sf_dir):
    assert run(spark, []) == []
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(str(tuple(r)) for r in substring.op7_substring(spark, sf_dir).collect()) == truth(rows)


def test_files_split_otherwise_in_a_later_pass(spark, tmp_path):
    rows = corpus(3)
    for i in range(4):
        spark.createDataFrame(rows[i::4], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100m")
        found = substring.dedup(spark.read.parquet(str(tmp_path / "d"))).select("key", "n_words", "n_removed", F.sha2("kept", 256))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000b")
        got = sorted(str(tuple(r)) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == truth(rows)


def greedy(reference, words, key):
    """Left to right: the longest run from each place that a source below ``key`` has, if ANCHOR words or more."""
    out, i = [], 0
    while i < len(words):
        best = 0
        for source, r in reference:
            for a in range(len(r) if source < key else 0):
                n = 0
                while i + n < len(words) and a + n < len(r) and r[a + n] == words[i + n]:
                    n += 1
                best = max(best, n)
        if best >= substring.ANCHOR:
            out.append((i, i + best))
        i += best if best >= substring.ANCHOR else 1
    return out


def test_factors_are_greedy_and_maximal():
    r, seen = random.Random(1), 0
    for _ in range(30):
        say = lambda n, words=r.choice([2, 3, 50]): [r.randrange(1, words + 1) * 7919 for _ in range(n)]
        reference = sorted([(r.randrange(9), np.array(say(r.randrange(60, 160)), np.uint64)) for _ in range(5)], key=lambda x: x[0])
        words = []
        for _ in range(6):
            x = r.choice(reference)[1].tolist()
            a = r.randrange(len(x))
            words += x[a : a + r.randrange(80)] + say(r.randrange(6))
        d = substring.Indexed(np.array(words + say(50), np.uint64))
        found = substring.Block(reference).factors(d.w, d.v, 6)
        assert found == greedy(reference, d.w.tolist(), 6)
        seen += len(found)
    assert seen > 60
    assert not len(substring.Block([]).has(d.v, 6).nonzero()[0])


def test_cells_blocks_parts_and_salts(spark, monkeypatch):
    """Small cells, blocks, parts and salts give what large ones do; so do texts of many cells."""
    for name, value in (("CUT", 64), ("BLOCK", 200), ("PART", 2), ("HOT", 3), ("SALTS", 3), ("SENT", 500)):
        monkeypatch.setattr(substring, name, value)
    rows = corpus(4)
    rows += [(7000 + k, rows[0][1] + " " + rows[7][1]) for k in range(12)] + [(8000, " ".join(t for _, t in rows)), (8001, " ".join(t for _, t in reversed(rows)))]
    assert run(spark, rows) == truth(rows)


def test_very_long_texts(spark):
    r = random.Random(5)
    long = " ".join(f"w{r.randrange(30_000)}" for _ in range(150_000))
    rows = [(1, long), (2, "start " + long[: len(long) // 2] + " end"), (3, "a " * 60_000), (4, "b " + "a " * 50_000)]
    assert run(spark, rows) == truth(rows)
