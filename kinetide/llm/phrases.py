"""Phrase collocation mining with merged count-min sketches.

1. Each task counts the hashes of words, pairs and triples of its texts (lang and words) into a sketch of DEPTH rows of
   cells that stop at the least count. Blocks of cells are compressed, shuffled by block and added; of the merged sketch
   only one bit a cell is left, whether it has reached the least count. Those bits, 2**MOST * DEPTH at most (32 MB), are
   broadcast.
2. Texts are read again: a phrase whose cells, and those of all its parts, have reached the least count survives. A cell
   is never below the count of what falls into it, so nothing frequent is lost. Survivors are counted exactly by their
   words, within an Arrow batch first, then by Spark before and after one shuffle.
3. Candidates are joined with the exact counts of their parts, scored in decimals, and dropped where a longer candidate
   has most of their places; the best of each language are taken by rounds of parts.

Cells are sized by the bytes of text. Beyond the largest sketch more phrases survive, which costs shuffling but no result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, stored, table
from .shingle import STEPS, mix
from .words import as_arrow, cut

#: Fixed: what splits a text into pieces, and pieces into words.
BREAKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
LEAST, SHARE, TOP = 10, 50, 2000
#: Rows of the sketch, cells of a row (powers of two), bytes of text for a cell, cells of a block.
DEPTH, FEWEST, MOST, EACH, BLOCK = 2, 16, 27, 16, 1 << 20
PIECE = 6 << 20
#: Bytes of text that a task may have, so that a lost one is soon done again.
TASK = 1 << 30
#: Candidates of a language that one task ranks.
RANKED = 20_000

BREAK = np.zeros(256, bool)
BREAK[list(BREAKS)] = True
WORD = ~BREAK
WORD[list(SPACES)] = False


def texts_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Only lang (null: und) and text (null: empty), whatever other columns there are."""
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


class Grams:
    """Words of a batch (lang, text) as numbers, and where pairs and triples of words lie."""

    def __init__(self, batch: pa.RecordBatch):
        w = cut(batch.column(1), WORD)
        langs = batch.column(0).dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy()[w.row].astype(np.int64)
        coded = as_arrow(w).dictionary_encode()
        self.names = coded.dictionary
        self.word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        piece = np.cumsum(BREAK[w.data])[w.start] + w.row if len(w.start) else w.start
        self.joined = [np.ones(len(w.start), bool)]  # whether the k words from a place on lie in one piece
        for k in (1, 2):
            after = np.zeros(len(w.start), bool)
            after[:-k] = piece[k:] == piece[:-k]
            self.joined.append(after)

    def hashes(self) -> list[np.ndarray]:
        """Hashes of the one, two and three words from each place on (of any value where they are not in one piece)."""
        each = pd.util.hash_array(np.array(self.names.to_pylist(), object)) if len(self.names) else np.zeros(0, np.uint64)
        lang = pd.util.hash_array(np.array(self.langs, object)) if self.langs else np.zeros(0, np.uint64)
        one = mix(each[self.word] + lang[self.lang] * STEPS[0]) if len(self.word) else np.zeros(0, np.uint64)
        out = [one]
        for k in (1, 2):
            more = np.zeros_like(one)
            more[:-k] = mix(out[-1][:-k] * STEPS[k] + one[k:])
            out.append(more)
        return out


def places(hashed: np.ndarray, bits: int):
    """The cell of each row of the sketch."""
    for k in range(DEPTH):
        yield (hashed >> np.uint64(32 * k)) & np.uint64((1 << bits) - 1)


def sketch(rows: DataFrame, bits: int, least: int = LEAST) -> np.ndarray:
    """Rows of bits, packed: whether a cell of the merged sketch has reached ``least``."""
    kind = np.uint8 if least < 256 else np.uint32
    schema = pa.schema([("block", pa.int32()), ("cells", pa.binary())])
    size = min(BLOCK, 1 << bits)

    def count(batches):
        own = np.zeros((DEPTH, 1 << bits), kind)
        for batch in batches:
            for part in pieces(batch, 1, PIECE):
                grams = Grams(part)
                for hashed, there in zip(grams.hashes(), grams.joined, strict=True):
                    for row, cells in zip(own, places(hashed[there], bits), strict=True):
                        cells, n = np.unique(cells.astype(np.uint32), return_counts=True)
                        row[cells] = np.minimum(row[cells].astype(np.int64) + n, least).astype(kind)
        yield from blocks(enumerate(own.reshape(-1, size)))

    def blocks(numbered):
        for k, cells in numbered:
            if cells.any():
                yield pa.RecordBatch.from_pydict({"block": [k], "cells": [pa.compress(cells.tobytes(), "zstd", asbytes=True)]}, schema)

    def added(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells = np.frombuffer(pa.decompress(packed, size * kind().itemsize, "zstd", asbytes=True), kind)
                found[k] = cells.copy() if k not in found else np.minimum(found[k].astype(np.int64) + cells, least).astype(kind)
        for k, cells in found.items():
            yield pa.RecordBatch.from_pydict({"block": [k], "cells": [np.packbits(cells >= least).tobytes()]}, schema)

    made = rows.mapInArrow(count, "block int, cells binary").repartition("block").mapInArrow(added, "block int, cells binary").toArrow()
    out = np.zeros((DEPTH << bits) // size * (size // 8), np.uint8).reshape(-1, size // 8)
    for k, packed in zip(made.column(0).to_pylist(), made.column(1).to_pylist(), strict=True):
        out[k] = np.frombuffer(packed, np.uint8)
    return out.reshape(DEPTH, -1)


def reached(packed: np.ndarray, hashed: np.ndarray, bits: int) -> np.ndarray:
    """Whether all cells of each hash have reached the least count."""
    out = np.ones(len(hashed), bool)
    for row, cells in zip(packed, places(hashed, bits), strict=True):
        out &= (row[cells >> np.uint64(3)] >> (np.uint8(7) - (cells & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1
    return out


def counts(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, phrase (of one to three words), a: all phrases with ``least`` occurrences within pieces or more, exactly; and a
    row with a null phrase for each language, with the number of its words.

    Null langs are ``und``, null texts empty; texts of any length are cut whole; repeated rows count each; other columns are
    not read; an empty table gives no row."""
    rows = texts_of(docs, text_col, lang_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST, max(FEWEST, (size // EACH).bit_length()))
    # What a task sends does not grow with its texts as they do, so a core has two tasks, not one for each split of a file.
    rows = rows.coalesce(max(2 * docs.sparkSession.sparkContext.defaultParallelism, size // TASK))
    shared = docs.sparkSession.sparkContext.broadcast(sketch(rows, bits, least))

    def survivors(batches):
        for batch in batches:
            for part in pieces(batch, 1, PIECE):
                yield from exact(Grams(part), shared.value, bits)

    found = rows.mapInArrow(survivors, "lang string, phrase string, a bigint").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    return found.where((F.col("a") >= least) | F.col("phrase").isNull())


def exact(grams: Grams, packed: np.ndarray, bits: int):
    """Batches (lang, phrase, a) of a batch's survivors, each counted by its words, and of its words a language."""
    langs, names = pa.array(grams.langs, pa.string()), grams.names
    n = np.bincount(grams.lang, minlength=len(grams.langs))
    yield pa.RecordBatch.from_arrays([langs, pa.nulls(len(langs), pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "a"])
    hashed, word = grams.hashes(), grams.word
    alive = [reached(packed, h, bits) & j for h, j in zip(hashed, grams.joined, strict=True)]
    alive[1][:-1] &= alive[0][:-1] & alive[0][1:]
    alive[2][:-2] &= alive[1][:-2] & alive[1][1:-1]
    for k, there in enumerate(alive):
        at = np.flatnonzero(there)
        if not len(at):
            continue
        columns = [grams.lang[at], *(word[at + j] for j in range(k + 1))]
        columns, n = counted(columns, [len(grams.langs), *[len(names)] * (k + 1)])
        said = pa.compute.binary_join_element_wise(*(names.take(pa.array(c)) for c in columns[1:]), pa.scalar(b" ", pa.large_binary()))
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(columns[0])), said.cast(pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "a"])


def counted(columns: list[np.ndarray], sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of numbers below ``sizes``, and how often each occurs."""
    if np.prod([float(s) for s in sizes]) < 2**62:
        code = np.zeros(len(columns[0]), np.int64)
        for c, s in zip(columns, sizes, strict=True):
            code = code * s + c
        code, n = np.unique(code, return_counts=True)
        out = []
        for s in reversed(sizes):
            code, c = np.divmod(code, s)
            out.append(c)
        return out[::-1], n
    rows, n = np.unique(np.stack(columns, 1), axis=0, return_counts=True)
    return list(rows.T), n


def collocations(found: DataFrame, share: int = SHARE) -> DataFrame:
    """Candidates (two or three words) of counts(), scored, without those that a longer one subsumes: lang, phrase, a, l, r,
    n, score. ``found`` is read several times, so it should be stored."""
    known = found.where("phrase is not null")
    size = F.size(F.split("phrase", " "))
    word = lambda i, n: F.array_join(F.slice(F.split("phrase", " "), i, n), " ")
    pairs, triples = known.where(size == 2), known.where(size == 3)
    split = lambda rows, k, left, right: rows.select("lang", "phrase", "a", F.lit(k).alias("k"), left.alias("left"), right.alias("right"))
    cuts = split(pairs, 1, word(1, 1), word(2, 1)).unionByName(split(triples, 1, word(1, 1), word(2, 2))).unionByName(split(triples, 2, word(1, 2), word(3, 1)))
    # Each part has as many places as the candidate at least, so it is among the counts.
    part = lambda side, name: known.select(F.col("lang").alias(f"{side}_lang"), F.col("phrase").alias(side), F.col("a").alias(name))
    cuts = cuts.join(part("left", "l").withColumnRenamed("left", "_left"), (F.col("lang") == F.col("left_lang")) & (F.col("left") == F.col("_left"))).drop("left_lang", "_left")
    cuts = cuts.join(part("right", "r").withColumnRenamed("right", "_right"), (F.col("lang") == F.col("right_lang")) & (F.col("right") == F.col("_right"))).drop("right_lang", "_right")
    cuts = stored(cuts.withColumn("score", score(F.col("a"), F.col("l"), F.col("r"))), "phrases-cuts")
    inside = cuts.where(F.col("k") == 1).select("lang", F.col("right").alias("phrase"), "a", F.col("r").alias("own")).unionByName(cuts.where(F.col("k") == 2).select("lang", F.col("left").alias("phrase"), "a", F.col("l").alias("own")))
    inside = inside.where(F.col("phrase").contains(" ") & (100 * F.col("a") >= share * F.col("own"))).select("lang", "phrase").distinct()
    least = cuts.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("x")).select("lang", "phrase", "x.*")
    words = found.where("phrase is null").select("lang", F.col("a").alias("n"))
    return least.join(inside, ["lang", "phrase"], "left_anti").join(F.broadcast(words), "lang").select("lang", "phrase", "a", "l", "r", "n", "score")  # a row for each language


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exact: in decimals of 38 digits, for counts below 10**15."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    million = F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", million * a * a, left * right)


def best(df: DataFrame, keys: list[str], order: list[Column], top: int, rows: int, each: int = RANKED) -> DataFrame:
    """The first ``top`` rows of each key with ``rank``. A key's rows are dealt to parts that keep their own first ``top``, in
    rounds, until what is left of a key is for one task; ``rows`` is their number."""
    parts = -(-rows // max(each, 2 * top))
    while parts > 1:
        w = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(parts))).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_part", "_r")
        parts = min(parts // 2, -(-parts * top // max(each, 2 * top)))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)


def mined(docs: DataFrame, top: int = TOP, least: int = LEAST, share: int = SHARE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's best collocations: lang, rank, phrase, a, l, r, n, score; by score, then a, then phrase."""
    found = stored(counts(docs, least, text_col, lang_col), "phrases-counts")
    rows = stored(collocations(found, share), "phrases-scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    return best(rows, ["lang"], order, top, rows.count()).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "documents"))


OP12_SQL = """WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 4) r(k)) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS x FROM f WHERE k > 1 AND f >= 10),
s AS (SELECT c.lang, c.phrase, c.k, c.a, d.cut, array_to_string(x[:d.cut], ' ') AS lp, array_to_string(x[d.cut + 1:], ' ') AS rp FROM c, range(1, 3) d(cut) WHERE d.cut < c.k),
j AS (SELECT s.*, l.f AS l, r.f AS r, (1000000::HUGEINT * s.a * s.a) // (l.f::HUGEINT * r.f) AS score FROM s JOIN f l ON l.lang = s.lang AND l.phrase = s.lp JOIN f r ON r.lang = s.lang AND r.phrase = s.rp),
m AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, x[1:2] AS x, a FROM c WHERE k = 3 UNION ALL SELECT lang, x[2:3], a FROM c WHERE k = 3),
t AS (SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = m.lang AND m.k = 2 AND array_to_string(o.x, ' ') = m.phrase AND 100 * o.a >= 50 * m.a))
SELECT t.lang, row_number() OVER (PARTITION BY t.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM t JOIN n ON n.lang = t.lang QUALIFY rank <= 2000"""
