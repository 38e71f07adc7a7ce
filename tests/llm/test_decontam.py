import hashlib
import random
import re

from kinetide.llm import decontam


def truth(docs, items, n=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    sizes = {len(x) for x in windows}
    out = []
    for key, t in docs:
        w, hit, found = words(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        found.discard(None)
        said = ",".join(sorted(map(str, found)))
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(said.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(map(str, out))


def run(spark, docs, items):
    d = spark.createDataFrame([(k, t, "clash", 1) for k, t in docs], "doc_id long, text string, spans string, row int").repartition(2)
    b = spark.createDataFrame([(k, t, 0) for k, t in items], "item_id long, text string, n int").repartition(2)
    got = decontam.verdicts(decontam.matches(d, b)).select("key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    return sorted(str(tuple(r)) for r in got)


def random_case(seed):
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice("aBcdé") + r.choice(["", ".", "-x"]) for _ in range(n))
    items = [(k, say(r.choice([0, 1, 3, 5, 12, 13, 14, 40]))) for k in range(12)] + [(3, "a a"), (None, "zz"), (50, None), (51, " ".join(map(str, range(20)))), (52, " ".join(map(str, range(5, 40))))]
    docs = [(k, say(r.randrange(200))) for k in range(12)]
    docs += [(100, None), (101, ""), (102, "zz"), (103, "q " * 300 + " ".join(map(str, range(3, 30))) + " q" * 50), (104, "7 8 " + " ".join(map(str, range(12)))), (104, "7 8 " + " ".join(map(str, range(12))))]
    return docs, items


def test_against_brute_force(spark):
    for seed in range(3):
        docs, items = random_case(seed)
        assert run(spark, docs, items) == truth(docs, items)


def test_segments_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 60)
    monkeypatch.setattr(decontam, "SEGMENT", 9)
    docs, items = random_case(7)
    assert run(spark, docs, items) == truth(docs, items)


def test_empty(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a b")], []) == truth([(1, "a b")], [])


def test_whole_table(spark, sf_dir):
    get = lambda t, k: [(r[k], r["text"]) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()]
    got = sorted(str(tuple(r)) for r in decontam.op6_decontam(spark, sf_dir).collect())
    assert got == truth(get("documents", "doc_id"), get("benchmark", "item_id"))


def cleaned(spark, docs, items, **limits):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    return {r["key"]: (r["n_removed"], r["text"]) for r in decontam.removed(d, spark.createDataFrame(items, "item_id long, text string"), **limits).collect()}


def test_short_passages_are_cut_from_long_texts(spark):
    item = " ".join(f"q{i}" for i in range(45))
    before, after = " ".join(f"a{i}" for i in range(500)), " ".join(f"é{i}" for i in range(455))
    half = item.split()
    docs = [(1, f"{before}. {item.upper()}! {after}?"), (2, before), (3, None), (4, item), (5, " ".join(half[:12] + half[20:40] + half[12:20]) + " end")]
    assert cleaned(spark, docs, [(7, item)]) == {1: (45, f"{before}. {after}?"), 2: (0, before), 3: (0, ""), 4: (45, ""), 5: (40, "end")}
    assert cleaned(spark, docs, [(7, item)], longest=45, share=0.05)[1] == (0, docs[0][1])
    assert cleaned(spark, docs, [(7, item)], longest=45, share=0.04)[1][0] == 45


def test_nothing_is_found_in_what_is_left(spark):
    docs, items = random_case(11)
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    left = [(k, t) for k, (_, t) in cleaned(spark, docs, items).items()]
    assert len(left) == len(docs) and not any("True" in r for r in truth(left, items))
    assert all(eval(r)[2] == 0 for r in truth(left, items))


def test_clean_keeps_rows_as_they_are(spark, monkeypatch):
    """In one block and in several: other columns, null texts and repeated rows stay; only contaminated rows go."""
    docs, items = random_case(3)
    rows = [(k, t, f"s{k}", 1, None) for k, t in docs] + [(None, None, "null", 2, None), (1, "", "empty", 3, None), (7, docs[0][1], "again", 4, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_words int, _text string").repartition(3)
    b = spark.createDataFrame([(k, t, 0) for k, t in items], "item_id long, text string, n int")
    gone = {key for key, *_, bad in map(eval, truth([(k, t) for k, (_, t, *_) in enumerate(rows)], items)) if bad}
    want = sorted(str(r) for k, r in enumerate(rows) if k not in gone)
    assert gone and len(want) < len(rows)
    for words in (100_000, 60):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", words)
        got = decontam.clean(d, b)
        assert got.columns == d.columns and sorted(str(tuple(r)) for r in got.collect()) == want
    only = decontam.clean(d.select("text"), b)
    assert only.columns == ["text"] and only.count() == len(want)
