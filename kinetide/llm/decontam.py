"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised to words and cut into segments of SEGMENT words (neighbours overlap by window - 1 words, so no window
is lost), and segments are dealt by hash into blocks of about BLOCK_WORDS words. A block's words are broadcast and each
worker builds its automaton, of bounded size, once; texts are streamed past it, tracking the longest match that ends at
each word. All texts are read once, however many blocks there are: with more than one, a filter of the hashes of all
windows picks the texts that may hold one, and only these are streamed past each block; their spans are merged by text.
"""

from __future__ import annotations

import functools
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _texts
from .common import key_filter, keyed_text, stored
from .shingle import STEPS, mix, word_hashes

BLOCK_WORDS, SEGMENT = 100_000, 4000
SPANS = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))
#: Bytes to words, as fixed: A-Z in lower case; digits, a-z and all bytes of other characters are kept, the rest separates.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Automaton:
    """A generalised suffix automaton of word sequences, each with an item number."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.go: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: Items whose window of full length ends in a state; items shorter than a window that end in it, with lengths.
        self.full: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for item, words in items:
            state = 0
            for k, w in enumerate(words):
                state = self.go[state][w]
                if k >= window - 1:
                    self.full.setdefault(self._up(state), set()).add(item)
            if 0 < len(words) < window:
                while self.length[self.link[state]] >= len(words):
                    state = self.link[state]
                self.short.setdefault(state, []).append((len(words), item))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for s in order:  # what ends in a state's link ends in it too
            if self.link[s] in self.short:
                self.short[s] = self.short.get(s, []) + self.short[self.link[s]]

    def _new(self, go: dict[bytes, int], link: int, length: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.length.append(length)
        return len(self.go) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        copy = self._new(dict(self.go[q]), self.link[q], self.length[p] + 1)
        while p >= 0 and self.go[p].get(w) == q:
            self.go[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, w: bytes) -> int:
        if (q := self.go[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        state, p = self._new({}, 0, self.length[last] + 1), last
        while p >= 0 and w not in self.go[p]:
            self.go[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.go[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return state

    def _up(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Merged [start, end) of the words inside any window, and the items those windows belong to."""
        go, link, length, short, window = self.go, self.link, self.length, self.short, self.window
        root, spans, items, state, n = go[0], [], set(), 0, 0
        for i, w in enumerate(words):
            if state:
                to = go[state].get(w)
                if to is None:
                    while to is None and state:
                        state = link[state]
                        to = go[state].get(w)
                    if to is None:
                        n = 0
                        continue
                    n = length[state]
                n += 1
                state = to
            else:
                to = root.get(w)
                if to is None:
                    continue
                state, n = to, 1
            best = 0
            if n >= window:
                best = window
                items |= self.full[self._up(state)]
            if state in short:
                for k, item in short[state]:
                    if k <= n:
                        best = max(best, k)
                        items.add(item)
            if best:
                start = i + 1 - best
                while spans and spans[-1][0] >= start:
                    spans.pop()
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = i + 1
                else:
                    spans.append([start, i + 1])
        return spans, items


def _segments(bench: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    def cut(batches):
        for batch in batches:
            out = []
            for item, t in zip(batch.column(0).to_pylist(), _texts(batch), strict=True):
                words = words_of(t)
                for a in range(0, max(1, len(words) - window + 1), SEGMENT):
                    part = words[a : a + SEGMENT + window - 1]
                    if part:
                        out.append((item, a, len(part), b" ".join(part)))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["item", "at", "n", "words"])

    return stored(keyed_text(bench, id_col, text_col).mapInArrow(cut, "item long, at long, n long, words binary"), "decontam-items")


@functools.lru_cache(1)
def _automaton(words: bytes, window: int) -> Automaton:
    """A block's automaton, one at a time for each worker process."""
    return Automaton(pickle.loads(words), window)


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    w = word_hashes(b" ".join(words), False)
    out = np.zeros(max(0, len(w) - size + 1), np.uint64)
    for k in range(size if len(out) else 0):
        out += w[k : k + len(out)] * STEPS[k % 60]
    return mix(out + np.uint64(size)).view(np.int64)


def _windows(segments: DataFrame, window: int) -> DataFrame:
    """size and hash of the windows of all segments."""

    def each(batches):
        for batch in batches:
            for words in batch.column(0).to_pylist():
                own = words.split()
                size = min(window, len(own))
                h = np.unique(_hashes(own, size))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), size, np.int32)), pa.array(h)], ["size", "h"])

    return stored(segments.select("words").mapInArrow(each, "size int, h long").distinct(), "decontam-windows")


def _scanned(rows: DataFrame, block: DataFrame, window: int, keep: bool = False) -> DataFrame:
    """``rows`` without text (with it if ``keep``), but with n_words, spans and items of one block."""
    words = pickle.dumps([(r["item"], bytes(r["words"]).split()) for r in block.select("item", "words").collect()])  # about BLOCK_WORDS words
    shared = rows.sparkSession.sparkContext.broadcast(words)
    pair = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def scan(batches):
        own = _automaton(shared.value, window)
        for batch in batches:
            sizes, spans, items = [], [], []
            for t in _texts(batch):
                words = words_of(t or b"")
                s, i = own.scan(words)
                sizes.append(len(words))
                spans.append([{"s": x, "e": y} for x, y in s])
                items.append(sorted(i - {None}))
            left = batch if keep else batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*left.columns, pa.array(sizes, pa.int64()), pa.array(spans, pair), pa.array(items, pa.list_(pa.int64()))], [*left.schema.names, "n_words", "spans", "items"])

    kept = T.StructType([f for f in rows.schema if keep or f.name != "text"]).add("n_words", T.LongType()).add("spans", SPANS).add("items", T.ArrayType(T.LongType()))
    return rows.mapInArrow(scan, kept)


def _merged(found: DataFrame) -> DataFrame:
    """``found`` with its spans, of several blocks, in order and joined where they touch."""

    def merge(batches):
        for batch in batches:
            k = batch.schema.get_field_index("spans")
            spans = []
            for x in batch.column(k).to_pylist():
                out: list[dict] = []
                for r in sorted(x, key=lambda r: r["s"]):
                    if out and out[-1]["e"] >= r["s"]:
                        out[-1]["e"] = max(out[-1]["e"], r["e"])
                    else:
                        out.append(dict(r))
                spans.append(out)
            yield batch.set_column(k, "spans", pa.array(spans, batch.schema.field(k).type))

    return found.mapInArrow(merge, found.schema)


def _matches(rows: DataFrame, bench: DataFrame, window: int, item_col: str, item_text: str, keep: bool = False) -> DataFrame:
    """``rows`` (text, and what is to be kept) with n_words, spans and items instead of text; beside it if ``keep``, so that it
    goes through Python once."""
    segments = _segments(bench, window, item_col, item_text)
    blocks = max(1, -(-(segments.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS))
    if blocks == 1:
        return _scanned(rows, segments, window, keep)
    if keep:
        rows = rows.withColumns({"_text": F.col("text"), "text": F.coalesce("text", F.lit(""))})
        return _in_blocks(rows, segments, blocks, window).withColumnRenamed("_text", "text")
    return _in_blocks(rows, segments, blocks, window)


def _in_blocks(rows: DataFrame, segments: DataFrame, blocks: int, window: int) -> DataFrame:
    """``rows`` with n_words, spans and items of several blocks instead of text."""
    spark = rows.sparkSession
    segments = segments.withColumn("block", F.pmod(F.xxhash64("item", "at"), F.lit(blocks)))
    windows = _windows(segments, window)
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # ``window`` at most
    shared = spark.sparkContext.broadcast(key_filter(windows, "h"))

    def look(batches):  # texts that can't hold a window lose their text
        for batch in batches:
            texts, counts = [], []
            for t in _texts(batch):
                words = words_of(t)
                hit = shared.value is None or any(shared.value.has(_hashes(words, k)).any() for k in sizes)
                texts.append(t if hit else None)
                counts.append(len(words))
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, "text", pa.array(texts, pa.binary()).cast(pa.string())).append_column("n_words", pa.array(counts, pa.int64()))

    looked = rows.mapInArrow(look, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]).add("n_words", T.LongType()))
    looked = stored(looked.withColumn("_place", F.monotonically_increasing_id()), "decontam-looked")
    some = looked.where("text is not null").select("_place", "text")
    found = None
    for b in range(blocks):
        one = _scanned(some, segments.where(F.col("block") == b), window)
        found = one if found is None else found.unionByName(one)
    found = found.groupBy("_place").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = stored(_merged(found), "decontam-found").withColumnRenamed("_place", "_found")
    hit = looked.where("text is not null").join(found, F.col("_place") == F.col("_found")).drop("_found")
    none = looked.where("text is null").withColumns({"spans": F.array().cast(SPANS), "items": F.array().cast("array<bigint>")})
    return hit.unionByName(none).drop("text", "_place")


def matches(docs: DataFrame, bench: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each row of ``docs``: key, hash (of the text), n_words, spans (array of [start, end) in words: all inside an occurrence of
    ``window`` consecutive words of an item, or of a whole shorter item) and items (their distinct ids, ascending).

    Null texts have no words, texts of any length are read whole, items without words match nothing, an item with a null id
    counts in spans but is not listed, rows of items that share an id are one item, an empty benchmark gives no spans.
    Repeated rows get a result each; other columns are not read; an empty table gives an empty one.
    """
    rows = keyed_text(docs, id_col, text_col).select("key", F.xxhash64("text").alias("hash"), "text")
    return _matches(rows, bench, window, item_col, item_text)


def clean(docs: DataFrame, bench: DataFrame, window: int = 13, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated (see verdicts), as they are and whatever their columns' names. Odd rows
    are as in matches(); null texts stay."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    spare = F.lit(0).alias("_".join(docs.columns))  # a struct has one field at least; no column has this name
    rows = docs.select(F.struct(*others, spare).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    left = verdicts(_matches(rows, bench, window, item_col, item_text, keep=True)).where(~F.col("contaminated"))
    return left.select(*[F.col("text").cast(docs.schema[c].dataType).alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def verdicts(found: DataFrame) -> DataFrame:
    """``found`` with n_hit, n_items, items_sha256 and contaminated (a twentieth of the words or more)."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["e"] - x["s"])
    said = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.withColumns({"n_hit": hit, "n_items": F.size("items").cast("bigint"), "items_sha256": F.sha2(said, 256)}).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of ``spans`` ([start, end) in words, ascending) and what separates them from the next word."""
    starts = [m.start() for m in re.finditer(rb"[^ ]+", text.translate(NORMAL))] + [len(text)]
    out, last = [], 0
    for s, e in spans:
        out.append(text[last : starts[s]])
        last = starts[e]
    return b"".join([*out, text[last:]])


def removed(docs: DataFrame, bench: DataFrame, window: int = 13, longest: int = 0, share: float = 0.0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each row of ``docs``: key, n_removed (words) and text without its spans (see matches).

    A span goes if it has more than ``longest`` words, and all of a text's go if they are more than ``share`` of its words;
    by default every span goes. What a cut joins is searched again until nothing more goes. Null texts are empty;
    repeated rows get a result each; a span at the end goes with the marks behind it.
    """

    def cut(batches):
        for batch in batches:
            texts, gone = [], []
            for t, n, spans in zip(_texts(batch), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                some = [(x["s"], x["e"]) for x in spans]
                if sum(e - s for s, e in some) <= share * n:
                    some = [(s, e) for s, e in some if e - s > longest]
                texts.append(without_spans(t, some))
                gone.append(sum(e - s for s, e in some))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(gone, pa.int64())], ["row", "text", "gone"])

    keyed = stored(keyed_text(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "key", "text"), "decontam-rows")
    left, done = keyed.select("row", "text"), []
    while True:
        found = matches(left, bench, window, "row", "text", item_col, item_text).where("size(spans) > 0").select(F.col("key").alias("r"), "n_words", "spans")
        found = stored(found, "decontam-spans")
        new = left.join(found, F.col("row") == F.col("r")).select("row", "text", "n_words", "spans").mapInArrow(cut, "row long, text string, gone long").where("gone > 0")
        new = stored(new, "decontam-cut")
        if new.isEmpty():
            break
        done.append(new.withColumn("round", F.lit(len(done))))
        left = new.select("row", "text")
    if not done:
        return keyed.select("key", F.lit(0).cast("bigint").alias("n_removed"), "text")
    all_cuts = done[0]
    for x in done[1:]:
        all_cuts = all_cuts.unionByName(x)
    last = all_cuts.groupBy(F.col("row").alias("r")).agg(F.sum("gone").alias("gone"), F.max_by("text", "round").alias("clean"))
    both = keyed.join(last, F.col("row") == F.col("r"), "left")
    return both.select("key", F.coalesce("gone", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("clean", "text").alias("text"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return verdicts(found).select(F.col("key").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP6_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bs AS (
  SELECT item_id, w, least(len(w), 13) AS k FROM bw WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bs)
), ks AS (SELECT DISTINCT k FROM windows),
grams AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks)
), hits AS (
  SELECT grams.doc_id, grams.i, grams.k, windows.item_id FROM grams JOIN windows USING (k, g)
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
