import random
import re

from kinetide.llm import neardup


def sets(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def truth(rows, share):
    s = [sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    where = {}
    for i, x in enumerate(s):
        for g in x:
            where.setdefault(g, []).append(i)
    for i, x in enumerate(s):
        near = {}
        for g in x:
            for j in where[g]:
                if j < i:
                    near[j] = near.get(j, 0) + 1
        for j, both in near.items():
            if 100 * both >= share * (len(x) + len(s[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(top(i), []).append(k)
    low = {r: min((k for k in ks if k is not None), default=None) for r, ks in least.items()}
    return sorted(str((k, len(s[i]), low[top(i)], k == low[top(i)])) for i, (k, _) in enumerate(rows))


def run(spark, rows, share):
    docs = spark.createDataFrame([(k, t, "clash", 0) for k, t in rows], "doc_id long, text string, node string, n int").repartition(3)
    got = neardup.clusters(docs, share=share).select("key", "n_shingles", "component_id", "kept").collect()
    return sorted(str(tuple(r)) for r in got)


def corpus(seed, n=12):
    r = random.Random(seed)
    words = [f"W{k}é" for k in range(500)]
    rows, key = [], 1000
    for _ in range(n):
        base = [r.choice(words) for _ in range(r.choice([4, 30, 120]))]
        for _ in range(r.choice([1, 2, 9])):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                own[r.randrange(len(own))] = r.choice(words)
            key -= 1
            rows.append((key, r.choice([" ", "\n", "\t "]).join(own)))
    return rows


def test_components_against_brute_force(spark):
    rows = corpus(1)
    chain = [f"c{k}" for k in range(200)]
    rows += [(5000 + k, " ".join(chain[: 60 + 3 * k])) for k in range(20)]
    rows += [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a a a a a a a a"), (8, "a a a a a a"), (rows[0][0], rows[0][1]), (None, rows[0][1]), (None, "alone here")]
    for share in (80, 85):
        assert run(spark, rows, share) == truth(rows, share)


def test_all_untested_pairs_are_compared_at_the_end(spark, monkeypatch):
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    monkeypatch.setattr(neardup, "FEW", 0)
    rows = corpus(2, 8)
    assert run(spark, rows, 85) == truth(rows, 85)


def test_altered_copies_below_the_threshold(spark, monkeypatch):
    """A group of copies, and copies of those, of which many pairs are alike but not linked; all rounds end in the last one."""
    monkeypatch.setattr(neardup, "FEW", 10**6)
    r = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    rows, key = [(0, " ".join(base))], 1
    for _ in range(120):
        own = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 7])):
            own[r.randrange(len(own))] = f"x{r.randrange(3000)}"
        for _ in range(r.choice([1, 1, 3])):
            more = list(own)
            more[r.randrange(len(more))] = f"y{r.randrange(3000)}"
            rows.append((key, " ".join(more[: r.choice([150, 150, 140, 128])])))
            key += 1
    for share in (80, 85):
        assert run(spark, rows, share) == truth(rows, share)


def test_empty_and_whole_table(spark, sf_dir):
    assert run(spark, [], 85) == []
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(str(tuple(r)) for r in neardup.op10_neardup(spark, sf_dir).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == truth(rows, 85)


def test_stars(spark):
    r = random.Random(4)
    pairs = [(b"%04d" % r.randrange(400), b"%04d" % r.randrange(400)) for _ in range(260)] + [(b"x%03d" % k, b"x%03d" % (k + 1)) for k in range(60)]
    up = {}
    top = lambda x: x if up.get(x, x) == x else top(up[x])
    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    got = {bytes(r["node"]): bytes(r["root"]) for r in neardup.components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in pairs], "a binary, b binary")).collect()}
    assert got == {x: top(x) for x in nodes if top(x) != x}
