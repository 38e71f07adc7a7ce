"""Language ID: each text as a mixture of languages.

A language is a distribution over hashed letter trigrams, counted from a bounded sample of labelled texts. For each text,
expectation-maximisation estimates the proportions of a set of languages; the set starts with the likeliest single one and
grows while the penalised likelihood does. A language whose likelihood can't rise at a first step is never tried, as the
likelihood is concave in the proportions.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _texts
from .common import stored

#: Hashed trigrams, added count for each, EM rounds, and the cost of a language more in units of log(number of trigrams).
SLOTS, ADD, ROUNDS, COST = 1 << 15, 0.02, 30, 6.0
#: Bound of the sample that a language is learned from.
SAMPLE = 3000


def held_out(id_col: str):
    """Rows that nothing is learned from: crc32 of the id as text divides by five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), bool, 0x110000)


def trigrams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of the trigrams of a text's letters in lower case, each run of other characters as one space."""
    cp = np.frombuffer(text.decode("utf-8").lower().encode("utf-32-le"), np.uint32)
    cp = np.where(_letters()[cp], cp, np.uint32(32))
    cp = np.concatenate([[np.uint32(32)], cp, [np.uint32(32)]])
    cp = cp[np.concatenate([[True], (cp[1:] != 32) | (cp[:-1] != 32)])]
    if len(cp) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    mixed = cp[:-2] * np.uint32(0x9E3779B1) + cp[1:-1] * np.uint32(0x85EBCA77) + cp[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    count = np.bincount((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(17), minlength=SLOTS)
    slots = np.flatnonzero(count)
    return slots, count[slots].astype(float)


def mixture(p: np.ndarray, c: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``p`` for counts ``c``, by EM, and their log likelihood."""
    w, n = np.full(p.shape[1], 1 / p.shape[1]), c.sum()
    for _ in range(rounds):
        new = w * (p.T @ (c / (p @ w))) / n
        done = np.abs(new - w).max() < 1e-4
        w = new
        if done:
            break
    return w, float(c @ np.log(p @ w))


def infer(p: np.ndarray, c: np.ndarray) -> tuple[list[int], np.ndarray, float]:
    """The languages of a text, their proportions and a score of the first, from probabilities ``p`` of its trigrams."""
    logs = c @ np.log(p)
    best = int(logs.argmax())
    chosen, w, ll, n = [best], np.ones(1), float(logs[best]), c.sum()
    cost = COST * np.log(n + 1)
    while len(chosen) < p.shape[1]:
        rise = p.T @ (c / (p[:, chosen] @ w)) - n
        rise[chosen] = 0
        more = [int(k) for k in np.argsort(-rise) if rise[k] > 0]
        found = max(((*mixture(p[:, [*chosen, k]], c), k) for k in more), key=lambda x: x[1], default=None)
        if found is None or found[1] - ll <= cost:
            break
        w, ll, k = found
        chosen = [*chosen, k]
    order = np.argsort(-w, kind="stable")
    chosen, w = [chosen[i] for i in order], w[order]
    if len(chosen) > 1:
        return chosen, w, float(w[0])
    return chosen, w, float(1 / np.exp((logs - logs[best]) / 3).sum())  # neighbouring trigrams share letters


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order and their trigram probabilities (SLOTS by languages), from whole texts of about ``sample`` rows
    of each language: those whose id hashes lowest. Held-out rows, null texts and null languages are left out."""
    rows = docs.where(~held_out(id_col)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col).alias("h")).where("lang is not null and text is not null")
    sizes = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("lang", "l"), "lang-sizes")  # a row for each language
    rows = rows.join(sizes, F.col("lang") == F.col("l")).where(F.pmod("h", F.lit(1 << 20)) * F.col("n") < sample * (1 << 20))

    def count(batches):
        for batch in batches:
            total: dict[str, np.ndarray] = {}
            for lang, t in zip(batch.column(0).to_pylist(), _texts(batch), strict=True):
                slots, c = trigrams(t)
                total.setdefault(lang, np.zeros(SLOTS))[slots] += c
            for lang, c in total.items():
                slots = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots)), pa.array(slots, pa.int32()), pa.array(c[slots].astype(np.int64))], ["lang", "slot", "n"])

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()  # SLOTS rows a language at most
    langs = sorted(counted["lang"].unique())
    table = np.full((SLOTS, len(langs)), ADD)
    for k, lang in enumerate(langs):
        own = counted[counted["lang"] == lang]
        table[own["slot"].to_numpy(), k] += own["n"].to_numpy()
    return langs, table / table.sum(0, keepdims=True) if langs else table


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, held_out, lang_pred, score, langs (array of lang, share) for each row of ``docs``.

    Null texts, texts without a letter and any text under a model without languages are ``und`` with score 0. Repeated rows
    get a result each; ties go to the first language in order; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("bigint").alias("key"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def score(batches):
        langs, table = shared.value
        for batch in batches:
            out: list[tuple] = []
            for t in _texts(batch):
                slots, c = trigrams(t)
                if not langs or not len(slots):
                    out.append(("und", 0.0, []))
                    continue
                chosen, w, sure = infer(table[slots], c)
                out.append((langs[chosen[0]], min(1.0, max(0.0, sure)), [{"lang": langs[k], "share": float(x)} for k, x in zip(chosen, w, strict=True)]))
            pred, sure, mix = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(sure, pa.float64()), pa.array(mix, kind)], ["key", "held_out", "lang_pred", "score", "langs"])

    return rows.mapInArrow(score, "key long, held_out boolean, lang_pred string, score double, langs array<struct<lang:string,share:double>>")


def op9_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, learn(docs)).withColumnRenamed("key", "doc_id")
