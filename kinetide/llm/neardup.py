"""Near duplicates: MinHash with banding, verification by signature and by full sets, components by alternating stars.

Texts with equal shingle sets are one class, and only classes are compared. A class's signature is the minima of HASHES
universal hash functions; classes that share a band of ROWS of them share a bucket. Buckets are never expanded into all
pairs:
  pivots   in each round, members of a bucket outside its pivot's component are compared with the pivot, one pivot for
           each member, and what is linked becomes one component. The first pivot is the member that shares most places in
           buckets, such as the text that others were copied from; later ones are random.
  rest     when pivots no longer help, members outside the largest component of a bucket are compared with all members of
           other components there that the bound allows, so no link within a bucket is lost. Buckets above BLOCK members
           are dealt out in blocks.
  bound    each shingle of a class flips one of BITS bits, so two classes differ in at least as many shingles as their
           bits do. That is exact: it drops pairs below the threshold and no others, without reading a set.
A pair is read in full only if its signatures agree in all but so many places as five standard deviations below the
threshold's mean allow.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _texts
from .common import key_filter, keyed_text, settled, stored
from .shingle import mix, shingles

#: A pair shares no band with probability (1 - 0.85**5)**32 = 7e-9 at a similarity of 0.85, 3e-6 at 0.8.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Words of 64 bits that a set's shingles flip; members of a block of a large bucket.
WORDS, BLOCK = 16, 4096
#: Rounds with pivots at most, and the share of strays by which a round must leave fewer for another to follow.
ROUNDS, FEW = 4, 0.2
BITS = 64 * WORDS
_R = np.random.RandomState(11)
A = (_R.randint(0, 2**62, HASHES).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
B = _R.randint(0, 2**63, HASHES).astype(np.uint64)


def signature(s: np.ndarray) -> bytes:
    """16 bits of each hash function's minimum over a set."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 1024):
        np.minimum(least, (s[k : k + 1024, None] * A[None, :] + B[None, :]).min(axis=0), out=least)
    return (mix(least) >> np.uint64(48)).astype("<u2").tobytes()


def flipped(s: np.ndarray) -> np.ndarray:
    """The bits that an odd number of a set's shingles have, in WORDS words."""
    odd = np.bincount((s >> np.uint64(30)).astype(np.int64) & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketches(rows: DataFrame, words: int) -> DataFrame:
    """key, hash (of the text), n, node (digest of the set; null if it is empty), sig and bits (once for each task's batch
    and node)."""

    def sketch(batches):
        for batch in batches:
            n, node, sig, bits, seen = [], [], [], [], set()
            for t in _texts(batch):
                s = shingles(t, words)
                n.append(len(s))
                d = _digest(s) if len(s) else None
                node.append(d)
                again = d is None or d in seen
                sig.append(None if again else signature(s))
                bits.append(None if again else flipped(s))
                seen.add(d)
            made = [pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary()), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["key", "hash", "n", "node", "sig", "bits"])

    return rows.select("key", F.xxhash64("text").alias("hash"), "text").mapInArrow(sketch, "key long, hash long, n long, node binary, sig binary, bits array<long>")


def sets_of(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and its set for the rows (key, text) whose xxhash64 of key and text's hash is a ``row`` of ``wanted``. A few
    others may be with them, and equal rows give a set each."""

    found = key_filter(wanted, "row")
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def sets(batches):
        for batch in batches:
            if shared.value is not None:
                batch = batch.filter(pa.array(shared.value.has(batch.column(0).to_numpy())))
            made: dict[bytes, bytes] = {}
            for t in _texts(batch):
                s = shingles(t, words)
                if len(s):
                    made[_digest(s)] = s.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.binary()), pa.array(list(made.values()), pa.binary())], ["node", "set"])

    some = rows.select(F.xxhash64("key", F.xxhash64("text")).alias("own"), "text")
    if found is None:
        some = some.join(wanted.select("row"), F.col("own") == F.col("row"), "left_semi")
    return some.mapInArrow(sets, "node binary, set binary")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of every node of ``edges`` (a, b), by alternating large-star and small-star
    until nothing changes. Neighbours are never gathered: least ones are aggregated and joined back."""

    def least(pairs):
        return pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))

    def state(pairs):
        return pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    edges = stored(edges, "neardup-stars")
    before = state(edges)
    while True:
        near = both(edges)
        large = stored(near.join(least(near), F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "neardup-large")
        small = large.join(least(large), F.col("a") == F.col("u"))
        edges = stored(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "neardup-stars")
        now = state(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Of ``pairs`` (a, b), those whose signatures agree enough and whose sets have 100 * intersection >= share * union."""

    def agree(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, HASHES) for k in (2, 3))
            yield batch.filter(pa.array((a == b).sum(axis=1) >= least)).select(["a", "b"]) if batch.num_rows else batch.select(["a", "b"])

    def check(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= share * (len(x) + len(y) - both))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    def both(pairs, t):
        for on, name in (("a", "sa"), ("b", "sb")):
            pairs = pairs.join(t.toDF("_n", name), F.col(on) == F.col("_n")).drop("_n")
        return pairs.select("a", "b", "sa", "sb")

    similar = share / 100
    least = int(HASHES * similar - 5.2 * (HASHES * similar * (1 - similar)) ** 0.5)
    near = stored(both(pairs, classes.select("node", "sig")).mapInArrow(agree, "a binary, b binary"), "neardup-near")
    used = near.select(F.col("a").alias("u")).unionByName(near.select(F.col("b").alias("u"))).distinct()
    sets = sets.join(used, F.substring("u", 10, 16) == F.col("node")).select("u", "set")
    return stored(both(near, sets).mapInArrow(check, "a binary, b binary").distinct(), "neardup-edges")


def _buckets() -> Column:
    """The bucket of each band, from ``sig``."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))))


def _alike(n, m, share: int) -> Column:
    """Whether sets of these sizes can be as similar as ``share``."""
    return 100 * F.least(n, m) >= share * F.greatest(n, m)


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` with the root of each, itself where it has no link."""
    known = members.join(roots.select(F.col("node").alias("rn"), "root"), F.col("node") == F.col("rn"), "left")
    return known.select(*members.columns, F.coalesce("root", "node").alias("root"))


def _open(own: DataFrame, first: Column) -> DataFrame:
    """Buckets (ob) that hold more than one component: pn, pr, pk (the pivot, its root and size), top (the root that most
    members have), alone (members outside it) and all (members)."""
    pivot = F.max(F.struct(first.alias("first"), F.xxhash64("node").alias("tie"), "node", "root", "n")).alias("p")
    sizes = own.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"), pivot)
    top = F.max(F.struct("c", "root")).alias("top")
    found = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.sum("c").alias("all"), F.max("p").alias("p"), top).where("parts > 1")
    found = found.select(F.col("bucket").alias("ob"), F.col("p.node").alias("pn"), F.col("p.root").alias("pr"), F.col("p.n").alias("pk"), F.col("top.root").alias("top"), (F.col("all") - F.col("top.c")).alias("alone"), "all")
    return stored(found, "neardup-open")


def _to_pivots(own: DataFrame, open_: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) of members outside the component of a pivot: all in buckets of two, else one for each member, with the
    pivot it shares most buckets with."""
    stray = own.join(open_, (F.col("bucket") == F.col("ob")) & (F.col("root") != F.col("pr")) & _alike(F.col("n"), F.col("pk"), share))
    shared = stored(stray.groupBy("node", "pn").agg(F.count(F.lit(1)).alias("c"), F.min("all").alias("least")), "neardup-shared")
    best = shared.groupBy(F.col("node").alias("a")).agg(F.max_by("pn", F.struct("c", "pn")).alias("b"))
    pairs = best.unionByName(shared.where("least = 2").select(F.col("node").alias("a"), F.col("pn").alias("b")))
    return stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "neardup-pairs")


def _rest(own: DataFrame, open_: DataFrame, classes: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) of members outside their bucket's largest component with members of other components, in the first
    bucket they share, as far as the bound allows."""
    every = own.join(open_.select("ob", "top", "alone", "all"), F.col("bucket") == F.col("ob")).drop("ob")
    every = every.join(classes.select(F.col("node").alias("cn"), _buckets().alias("every"), "bits"), F.col("node") == F.col("cn")).drop("cn", "m")
    every = every.withColumn("blocks", F.ceil(F.col("all") / BLOCK).cast("int")).drop("all", "alone")
    every = every.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = stored(every.select("bucket", "band", "node", "root", "n", "top", "every", "blocks", "block", *[F.get("bits", F.lit(k)).alias(f"b{k}") for k in range(WORDS)]), "neardup-rest")
    stray = every.where("root != top").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("block", "blocks", "top")
    other = every.drop("blocks")
    other = other.select(*[F.col(c).alias(f"x{c}") for c in other.columns])
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"b{k}").bitwiseXOR(F.col(f"xb{k}"))) for k in range(WORDS)])
    near = apart * (100 + share) <= (100 - share) * (F.col("n") + F.col("xn"))
    once = (F.col("xroot") == F.col("xtop")) | (F.col("node") < F.col("xnode"))
    before = F.exists(F.zip_with(F.slice("every", F.lit(1), F.col("band")), F.slice("xevery", F.lit(1), F.col("band")), lambda x, y: x == y), lambda x: x)
    same = (F.col("bucket") == F.col("xbucket")) & (F.col("to") == F.col("xblock"))
    found = stray.join(other, same & _alike(F.col("n"), F.col("xn"), share) & (F.col("root") != F.col("xroot")) & once & near & ~before)
    return found.select(F.least("node", "xnode").alias("a"), F.greatest("node", "xnode").alias("b")).distinct()


def links(rows: DataFrame, classes: DataFrame, words: int, share: int) -> DataFrame:
    """node, root for the ``classes`` (node, n, row, sig, bits) that are linked with others."""
    none = rows.sparkSession.createDataFrame([], "node binary, root binary")
    bands = classes.select("node", "n", F.posexplode(_buckets()).alias("band", "bucket"))
    full = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumnRenamed("bucket", "fb")
    members = stored(bands.join(full, F.col("bucket") == F.col("fb")).select("bucket", "band", "node", "n", "m"), "neardup-members")
    degree = members.groupBy("node").agg(F.sum("m").alias("places"))
    if degree.isEmpty():
        return none
    degree = stored(degree.join(classes.select(F.col("node").alias("cn"), "row"), F.col("node") == F.col("cn")).drop("cn"), "neardup-degree")
    sets = stored(sets_of(rows, degree, words), "neardup-sets")
    first = members.join(degree.select(F.col("node").alias("dn"), "places"), F.col("node") == F.col("dn")).drop("dn").withColumn("root", F.col("node"))
    open_, roots, stray = _open(first, F.col("places")), none, None
    for turn in range(1, ROUNDS + 1):
        new = _verified(_to_pivots(first, open_, share), classes, sets, share)
        if new.isEmpty() and turn > 1:
            break
        roots = stored(components(new.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "neardup-roots")
        # Buckets of two have no other pair than that with their pivot, which the first round has tested.
        first = stored(_rooted(members.where("m > 2"), roots).join(open_.select("ob"), F.col("bucket") == F.col("ob"), "left_semi"), "neardup-left")
        open_ = _open(first, F.xxhash64("node", F.lit(turn)))
        left = open_.agg(F.coalesce(F.sum("alone"), F.lit(0))).first()[0]
        if not left or stray is not None and left > (1 - FEW) * stray:
            break
        stray = left
    pairs = stored(_rest(first, open_, classes, share), "neardup-pairs")
    if pairs.isEmpty():
        return roots
    last = _verified(pairs, classes, sets, share)
    return stored(components(last.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "neardup-roots")


def _named(node: Column, key: Column) -> Column:
    """A class's name: its least key (a null one is largest) and its digest, so that the least name has the least key."""
    signed = F.hex(key.bitwiseXOR(F.lit(-(1 << 63))))
    return F.concat(F.unhex(F.when(key.isNull(), F.lit("01" + "0" * 16)).otherwise(F.concat(F.lit("00"), F.lpad(signed, 16, "0")))), node)


def _key_of(name: Column) -> Column:
    key = F.conv(F.hex(F.substring(name, 2, 8)), 16, -10).cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(F.substring(name, 1, 1) == F.unhex(F.lit("00")), key)


def clusters(docs: DataFrame, words: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: key, hash (of the text), n_shingles, component_id (the least key of its component), kept (it has that key),
    node (digest of its set), group (of the component).

    Texts are linked whose sets have 100 * intersection >= share * union. Null texts and texts without words have an empty
    set, are linked with nothing and kept. Rows with equal sets are linked; repeated rows get a result each, and all rows
    with the least key are kept. Null keys are never least unless all are. An empty table gives an empty one.
    """
    rows = keyed_text(docs, id_col, text_col)
    found = stored(sketches(rows, words), "neardup-sketches")
    one = lambda c: F.max(c).alias(c)  # noqa: E731  equal in all rows of a class that have it
    classes = found.where("node is not null").groupBy("node").agg(F.min("key").alias("least"), one("n"), one("sig"), one("bits"), F.min(F.xxhash64("key", "hash")).alias("row"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.withColumn("node", _named(F.col("node"), F.col("least"))), "neardup-classes")
    roots = settled(docs.sparkSession, "neardup-links", lambda: links(rows, classes, words, share)).select(F.col("node").alias("rn"), "root")
    # Rows of a class of one row without links are their own component; only the others are joined.
    many = classes.where("copies > 1").select(F.col("node").alias("mn")).join(roots, F.col("mn") == F.col("rn"), "full_outer")
    many = many.select(F.substring(F.coalesce("mn", "rn"), 10, 16).alias("cn"), _key_of(F.coalesce("root", "mn")).alias("least"), F.substring(F.coalesce("root", "mn"), 10, 16).alias("top"))
    many = stored(many, "neardup-grouped")
    both = found.select("key", "hash", F.col("n").alias("n_shingles"), "node").join(many, F.col("node") == F.col("cn"), "left")
    return both.select("key", "hash", "n_shingles", F.when(F.col("top").isNotNull(), F.col("least")).otherwise(F.col("key")).alias("component_id"), "node", F.coalesce("top", "node").alias("group")).withColumn("kept", F.col("key").eqNullSafe(F.col("component_id")))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(spark.read.parquet(f"{sf_dir}/documents.parquet"), share=85)
    return found.select(F.col("key").alias("doc_id"), "n_shingles", "component_id", "kept")
