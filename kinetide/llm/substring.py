"""Substring deduplication by relative Lempel-Ziv factors of each document against blocks of reference text.

Anchors are the runs of ANCHOR words that are least by hash in some window of WINDOW words. Equal windows have equal anchors
at equal places, so a window that another document has can be found by its anchor.
  reference    for each anchor that several documents have, the words that windows with it reach in the document with the
               least id, once for each context of it there. Documents are cut into cells of CUT words; the stretches of a cell
               go to one of as many blocks as hold BLOCK words each. A block's index is all places of all its runs of ANCHOR
               words
  factors      the stretches of a document around anchors that a smaller id has go to the blocks with these anchors, since
               no other block can hold a window of them. There they are parsed greedily from left to right: at each place the longest
               run of words that the block has from a smaller id, with ANCHOR words or more, is a factor, and the parse goes
               on behind it; else one word is passed. Factors of WINDOW words or more are duplicate spans
  boundaries   windows that reach over a factor's ends are held against all places of their anchor in the block, to both
               sides; those that the block doesn't have may be in a document that gave no reference, so they are aggregated
               by hash, each against the least id that has it
Blocks that many cells meet are copied for parts of them, and anchors and windows that many documents have are joined in
salted parts. Words, anchors and windows are compared as 64-bit hashes. No group is gathered: least ids are aggregated, which
merges before the shuffle, and joined back. Only texts that give or need a reference are moved, and a task holds one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _texts
from .common import among, key_filter, keyed_text, stored
from .shingle import POWERS, STEPS, mix, word_hashes

WINDOW, ANCHOR = 50, 25
#: Anchor places in a window.
PLACES = WINDOW - ANCHOR + 1
#: Words of a cell, words of a block, and cells that a copy of a block is for. They set the size of tasks, not the result.
CUT, BLOCK, PART = 1 << 12, 1 << 18, 30_000
#: A key of more rows is joined in SALTS parts; bytes of words sent together; words compared and places looked at together.
HOT, SALTS, SENT, AHEAD, TOGETHER = 2000, 64, 8 << 20, 64, 4096


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: -(width - have)], x[width - have :]) if width > have else x


class Indexed:
    """The anchors of a run of words (as hashes), and hashes of any of its parts."""

    def __init__(self, w: np.ndarray):
        self.w, self.n = w, len(w)
        self.at = np.zeros(0, np.int64)
        n = self.n
        if n < WINDOW:
            return
        self.v = runs_of_words(w)
        self.least = _sliding(self.v, PLACES, np.minimum)
        pad = np.zeros(PLACES - 1, np.uint64)
        self.at = np.flatnonzero(_sliding(np.concatenate([pad, self.least, pad]), PLACES, np.maximum) == self.v)
        up, self.down = POWERS[1].to(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(w * up[:-1], out=self.total[1:])

    def runs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.total[b] - self.total[a]) * self.down[a])

    def contexts(self) -> np.ndarray:
        """A hash of all words that windows with each anchor reach; cut off at the document's ends."""
        a, b = np.maximum(self.at - PLACES + 1, 0), np.minimum(self.at + WINDOW, self.n)
        return mix(self.runs(a, b) + (self.at - a).astype(np.uint64) * STEPS[60] + (b - self.at).astype(np.uint64) * STEPS[61])

    def windows(self, k: int) -> np.ndarray:
        """Starts of the windows whose first least anchor is the ``k``-th."""
        p = int(self.at[k])
        low, high = max(0, p - PLACES + 1), min(p, self.n - WINDOW)
        same = np.flatnonzero(self.v[low:p] == self.v[p])
        low = low + int(same[-1]) + 1 if len(same) else low
        return low + np.flatnonzero(self.least[low : high + 1] == self.v[p])


def runs_of_words(w: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR words from each place."""
    up, down = POWERS[0].to(len(w) + 1)
    total = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * up[:-1], out=total[1:])
    return mix((total[ANCHOR:] - total[:-ANCHOR]) * down[: len(w) - ANCHOR + 1])


def _agreeing(same: np.ndarray) -> np.ndarray:
    """How many of the first columns of each row are true."""
    return np.where(same.all(1), same.shape[1], np.argmin(same, 1))


def maximal(spans) -> list[tuple[int, int]]:
    """Of [s, e) spans, those that no other holds; starts and ends ascend."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not out or e > out[-1][1]:
            out.append((s, e))
    return out


def inside(spans: list[tuple[int, int]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each [a, b) lies within one of ``spans`` (maximal ones)."""
    if not spans:
        return np.zeros(len(a), bool)
    s, e = np.array(spans, np.int64).T
    at = np.searchsorted(s, a, side="right") - 1
    return (at >= 0) & (e[np.maximum(at, 0)] >= b)


class Block:
    """Stretches of reference words (source, words), ascending by source, and all places of each run of ANCHOR words."""

    def __init__(self, stretches: list[tuple[int, np.ndarray]]):
        ends, stop = np.zeros(AHEAD, np.uint64), np.zeros(1, np.uint64)  # no word is 0, so nothing agrees beyond a stretch
        self.words = np.concatenate([ends, *[x for _, w in stretches for x in (w, stop)], ends])
        source = np.repeat([k for k, _ in stretches], [len(w) + 1 for _, w in stretches]).astype(np.int64)
        stops = np.concatenate([[0], np.cumsum(self.words == 0)])
        place = np.flatnonzero(stops[ANCHOR:] == stops[:-ANCHOR])
        v = runs_of_words(self.words)[place]
        order = np.argsort(v, kind="stable")  # of equal runs, the least source is first
        self.v, self.place = v[order], place[order]
        self.source = source[self.place - AHEAD]

    def has(self, v: np.ndarray, key: int) -> np.ndarray:
        """Whether a source below ``key`` has each run."""
        at = np.minimum(np.searchsorted(self.v, v), max(0, len(self.v) - 1))
        return (self.v[at] == v) & (self.source[at] < key) if len(self.v) else np.zeros(len(v), bool)

    def places(self, v: np.uint64, key: int):
        """All places where sources below ``key`` have a run, some at a time."""
        a, b = np.searchsorted(self.v, v), np.searchsorted(self.v, v, side="right")
        b = a + np.searchsorted(self.source[a:b], key)
        for k in range(a, b, TOGETHER):
            yield self.place[k : min(b, k + TOGETHER)]

    def longest(self, w: np.ndarray, p: int, v: np.uint64, key: int) -> int:
        """How many words of ``w`` (with AHEAD ones before and behind) from ``p`` some source below ``key`` has, by the longest of all places."""
        best = 0
        for at in self.places(v, key):
            n = ANCHOR
            while len(at):
                same = self.words[(at + n)[:, None] + np.arange(AHEAD)] == w[p + n : p + n + AHEAD]
                whole = same.all(1)
                if not whole.any():
                    best = max(best, n + int(_agreeing(same).max()))
                    break
                at, n = at[whole], n + AHEAD
        return best

    def factors(self, w: np.ndarray, v: np.ndarray, key: int) -> list[tuple[int, int]]:
        """[start, end) of the factors of a greedy parse of words with runs ``v``: each the longest that there is from its start."""
        padded = _padded(w)
        starts = np.flatnonzero(self.has(v, key))
        out, k = [], 0
        while k < len(starts):
            p = int(starts[k])
            e = p + self.longest(padded, p + AHEAD, v[p], key)
            out.append((p, e))
            k = int(np.searchsorted(starts, e))
        return out

    def around(self, w: np.ndarray, p: int, v: np.uint64, key: int) -> set[tuple[int, int]]:
        """Spans of WINDOW words or more around the anchor at ``p`` of ``w`` (padded) that agree with one of its places."""
        out: set[tuple[int, int]] = set()
        step = np.arange(WINDOW - ANCHOR)
        for at in self.places(v, key):
            left = _agreeing(self.words[(at - 1)[:, None] - step] == w[p - 1 - step])
            right = _agreeing(self.words[(at + ANCHOR)[:, None] + step] == w[p + ANCHOR + step]) + ANCHOR
            long = left + right >= WINDOW
            both = np.unique(left[long] * (WINDOW + 1) + right[long])
            out |= {(p - AHEAD - x // (WINDOW + 1), p - AHEAD + x % (WINDOW + 1)) for x in both.tolist()}
        return set(maximal(out))

    def parsed(self, d: Indexed, key: int) -> tuple[list[tuple[int, int]], tuple[np.ndarray, np.ndarray]]:
        """Duplicate spans of a document's words, and anchors and starts of windows with an anchor of the block that it doesn't have."""
        spans = [(s, e) for s, e in self.factors(d.w, d.v, key) if e - s >= WINDOW]
        mine = np.flatnonzero(self.has(d.v[d.at], key))
        at = d.at[mine]
        mine = mine[~inside(spans, np.maximum(at - PLACES + 1, 0), np.minimum(at + WINDOW, d.n))].tolist()
        padded = _padded(d.w)
        more = [self.around(padded, int(d.at[k]) + AHEAD, d.v[d.at[k]], key) for k in mine]
        spans = maximal(set(spans).union(*more))
        windows = [d.windows(k) for k in mine]
        starts = np.concatenate([*windows, np.zeros(0, np.int64)])
        anchors = np.repeat(d.v[d.at[mine]], [len(x) for x in windows]) if mine else np.zeros(0, np.uint64)
        open_windows = ~inside(spans, starts, starts + WINDOW)
        rest = anchors[open_windows], starts[open_windows]
        return spans, rest


def _padded(w: np.ndarray) -> np.ndarray:
    ends = np.ones(AHEAD, np.uint64)
    return np.concatenate([ends, w, ends])


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """The union of sorted [s, e) as runs that don't touch."""
    out: list[list[int]] = []
    for s, e in spans:
        if out and out[-1][1] >= s:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _anchors(rows: DataFrame) -> DataFrame:
    def index(batches):
        for batch in batches:
            h, c, text, key, at = [], [], [], [], []
            for r, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch), strict=True):
                d = Indexed(word_hashes(t, False))
                if len(d.at):
                    h.append(d.v[d.at])
                    c.append(d.contexts())
                    at.append(d.at)
                    text.append(np.full(len(d.at), r))
                    key.append(np.full(len(d.at), k))
            flat = lambda x, t: pa.array(np.concatenate(x).view(t) if x else np.zeros(0, t))
            yield pa.RecordBatch.from_arrays([flat(x, np.int64) for x in (h, c, text, key, at)], ["h", "c", "hash", "key", "at"])

    return rows.where("key is not null").mapInArrow(index, "h long, c long, hash long, key long, at long")


def _spread(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` (with key and hash) joined with ``few``, which has one row for each value of ``on`` and ``n``, the number of
    rows that may have it. Values of more than HOT rows are dealt out in SALTS parts, of which ``few`` has a copy each."""
    hot = key_filter(few.where(F.col("n") > HOT).select(F.xxhash64(*on).alias("id")), "id")
    if hot is None:
        spread = F.lit(True)
    else:
        shared = rows.sparkSession.sparkContext.broadcast(hot)

        @F.arrow_udf("boolean")
        def among_hot(x: pa.Array) -> pa.Array:
            return pa.array(shared.value.has(x.to_numpy(zero_copy_only=False)))

        spread = among_hot(F.xxhash64(*on))
    mine = rows.withColumn("spread", spread).withColumn("salt", F.when(F.col("spread"), F.pmod(F.xxhash64("key", "hash"), F.lit(SALTS)).cast("int")).otherwise(0))
    copies = few.withColumn("spread", spread).withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("spread"), SALTS - 1).otherwise(0))))
    return mine.drop("spread").join(copies.drop("spread", "n"), [*on, "salt"]).drop("salt")


def _pieces(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """block, part, kind (0: reference, 1: to parse), key, hash, start, words (hashes) of the stretches around the anchors that
    ``wanted`` (key, hash, kind, block, low, high (parts) and at (places in a cell)) names. Only these texts are moved."""
    one = F.struct("kind", "block", "low", "high", "at")
    listed = wanted.groupBy(F.col("key").alias("wk"), F.col("hash").alias("wh")).agg(F.collect_list(one).alias("items"))
    listed = stored(listed.withColumn("id", F.xxhash64("wk", "wh")), "substring-wanted")
    some, _ = among(rows, F.xxhash64("key", "hash"), listed, "id")
    found = some.dropDuplicates(["key", "hash"]).join(listed, (F.col("key") == F.col("wk")) & (F.col("hash") == F.col("wh"))).select("key", "hash", "text", "items")
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["block", "low", "high", "kind", "key", "hash", "start", "words"]

    def cut(batches):
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for key, own, t, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch), batch.column(3).to_pylist(), strict=True):
                w = word_hashes(t, False)
                for x in items:
                    for s, e in _merged([(max(0, p - PLACES + 1), p + WINDOW) for p in sorted(x["at"])]):
                        out.append((x["block"], x["low"], x["high"], x["kind"], key, own, s, w[s:e].tobytes()))
                        size += len(out[-1][-1])
                    if size > SENT:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out, size = [], 0
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    made = found.mapInArrow(cut, "block long, low int, high int, kind int, key long, hash long, start long, words binary")
    return made.select("block", F.explode(F.sequence("low", "high")).alias("part"), "kind", "key", "hash", "start", "words")


def _factors(pieces: DataFrame) -> DataFrame:
    """key, hash, s, e of duplicate spans, and h, w, at (null s and e) of the windows that are still to be held against others."""

    def parse(batches):
        now, stretches, block = None, [], None
        for batch in batches:
            spans: list[tuple] = []
            rest: list[list[np.ndarray]] = [[] for _ in range(5)]
            heads = zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True)
            for b, part, kind, key, own, start, words in heads:
                if (b, part) != now:
                    now, stretches, block = (b, part), [], None
                w = np.frombuffer(words, np.uint64)
                if not kind:
                    stretches.append((key, w))
                    continue
                if block is None:
                    block = Block(stretches)
                d = Indexed(w)
                if not len(d.at):
                    continue
                own_spans, windows = block.parsed(d, key)
                spans += [(key, own, s + start, e + start) for s, e in _merged(own_spans)]
                h, x = windows
                for column, values in zip(rest, (np.full(len(x), key), np.full(len(x), own), h.view(np.int64), d.runs(x, x + WINDOW).view(np.int64), x + start), strict=True):
                    column.append(values)
            key, own, s, e = zip(*spans, strict=True) if spans else ([], [], [], [])
            flat = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in rest]
            n, m = len(key), len(flat[0])
            none = lambda k: pa.nulls(k, pa.int64())
            columns = [
                *[pa.concat_arrays([pa.array(list(a), pa.int64()), pa.array(b)]) for a, b in ((key, flat[0]), (own, flat[1]))],
                *[pa.concat_arrays([pa.array(list(a), pa.int64()), none(m)]) for a in (s, e)],
                *[pa.concat_arrays([none(n), pa.array(b)]) for b in flat[2:]],
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "hash", "s", "e", "h", "w", "at"])

    dealt = pieces.repartition("block", "part").sortWithinPartitions("block", "part", "kind", "key")
    return dealt.select("block", "part", "kind", "key", "hash", "start", "words").mapInArrow(parse, "key long, hash long, s long, e long, h long, w long, at long")


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): hash (of the text), key, text of ``docs``, and hash, key, spans (array of [s, e) in words; they may
    overlap) of the words in windows that a document with a smaller id also has.

    ``docs`` is read several times, so rows are told apart by what they hold and not by a number that depends on how files
    are split; rows of one id and text have the same spans."""
    rows = keyed_text(docs, id_col, text_col).select(F.xxhash64("text").alias("hash"), "key", "text")
    found = stored(_anchors(rows), "substring-anchors")
    low = found.groupBy("h").agg(F.min("key").alias("key"), F.max("key").alias("most"), F.count(F.lit(1)).alias("n")).where("key < most").drop("most")
    low = stored(low, "substring-shared")
    some, _ = among(found, F.col("h"), low, "h")
    first = some.join(low, ["h", "key"]).groupBy("h", "c").agg(F.first("key").alias("key"), F.min(F.struct("hash", "at")).alias("r"), F.first("n").alias("n"))
    first = stored(first.select("h", "key", "r.*", "n"), "substring-first")
    blocks = max(1, -(-first.count() * (WINDOW // 2) // BLOCK))
    cell = F.floor(F.col("at") / CUT).alias("cell")
    first = first.select("h", "key", "hash", "at", "n", cell).withColumn("block", F.pmod(F.xxhash64("key", "hash", "cell"), F.lit(blocks)))
    load = first.groupBy("block").agg(F.ceil(F.greatest(F.max("n"), F.sum("n") / 16) / PART).cast("int").alias("parts"))
    first = stored(first.join(load, "block"), "substring-reference")
    homes = first.groupBy("h").agg(F.min("key").alias("least"), F.max("n").alias("n"), F.collect_set(F.struct("block", "parts")).alias("homes"))
    uses = _spread(some.select("h", "key", "hash", "at"), stored(homes, "substring-homes"), ["h"]).where("key > least")
    uses = uses.select("key", "hash", "at", cell, F.explode("homes").alias("home"))
    part = F.pmod(F.xxhash64("key", "hash", "cell"), F.col("parts")).cast("int")
    uses = uses.groupBy("key", "hash", "home.block", "cell", "home.parts").agg(F.collect_set("at").alias("at"))
    uses = uses.select("key", "hash", F.lit(1).alias("kind"), "block", part.alias("low"), part.alias("high"), "at")
    given = first.groupBy("key", "hash", "block", "cell", "parts").agg(F.collect_list("at").alias("at"))
    given = given.select("key", "hash", F.lit(0).alias("kind"), "block", F.lit(0).alias("low"), (F.col("parts") - 1).alias("high"), "at")
    parsed = stored(_factors(_pieces(rows, given.unionByName(uses))), "substring-factors")
    windows = parsed.where("at is not null").select("h", "w", "hash", "key", "at")
    least = windows.groupBy("h", "w").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most").drop("most")
    outer = _spread(windows, stored(least, "substring-windows"), ["h", "w"]).where("key > least").select("hash", "key", F.col("at").alias("s"), (F.col("at") + WINDOW).alias("e"))
    spans = parsed.where("at is null").select("hash", "key", "s", "e").unionByName(outer)
    spans = spans.groupBy("hash", "key").agg(F.array_sort(F.collect_set(F.struct(F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e")))).alias("spans"))
    return rows, stored(spans, "substring-spans")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: key, n_words, n_removed, spans (merged [s, e) in words) and kept (the other words, joined by
    a space).

    Null texts have no words; texts below WINDOW words lose none; rows that repeat an id lose nothing to each other, and
    each loses what smaller ids have; rows with a null id lose nothing and nothing is lost to them; texts of any length are
    read whole and parsed by cells; other columns are not read; an empty table gives an empty one.
    """
    rows, spans = duplicate_spans(docs, id_col, text_col)
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def cut(batches):
        for batch in batches:
            n, removed, merged, kept = [], [], [], []
            for t, some in zip(_texts(batch), batch.column(2).to_pylist(), strict=True):
                words = t.split()
                own: list[dict] = []
                for x in some or ():
                    if own and own[-1]["e"] >= x["s"]:
                        own[-1]["e"] = max(own[-1]["e"], x["e"])
                    else:
                        own.append(dict(x))
                n.append(len(words))
                removed.append(sum(x["e"] - x["s"] for x in own))
                merged.append(own)
                for x in reversed(own):
                    del words[x["s"] : x["e"]]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(merged, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["key", "n_words", "n_removed", "spans", "kept"])

    spans = spans.withColumnsRenamed({"hash": "sh", "key": "sk"})
    both = rows.join(spans, (F.col("key") == F.col("sk")) & (F.col("hash") == F.col("sh")), "left").select("key", "text", "spans")
    return both.mapInArrow(cut, "key long, n_words long, n_removed long, spans array<struct<s:int,e:int>>, kept string")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("key").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)
), m AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM g
), p AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM m WHERE least < doc_id
), r AS (
  SELECT doc_id, list(p) AS ps, count(*) AS n FROM p GROUP BY doc_id
), k AS (
  SELECT d.doc_id, string_agg(x, ' ' ORDER BY j) AS kept
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d) d ANTI JOIN p ON d.doc_id = p.doc_id AND d.j = p.p GROUP BY d.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""
