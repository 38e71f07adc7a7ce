"""Toxicity by non-negative positive-unlabelled learning.

Positives are texts labelled toxic; every text that may be learned from is unlabelled text, whatever its label. A linear
classifier over the presence of words and of letter runs within words is trained with numpy on the non-negative estimate of
the risk: with the class prior c, c * risk(positives as 1) + max(0, risk(unlabelled as 0) - c * risk(positives as 0)). The
prior is the share of toxic among the labelled rows that may be learned from.
  candidates   words and runs of the positives (a bounded sample of labelled rows), counted in all unlabelled texts
  features     candidates whose share among positives is far from that among unlabelled texts, in either direction
  steps        all unlabelled texts as short lists of features, equal ones as one row with its number; each Newton step is
               one job in which tasks sum their share of the risk, its gradient and its curvature
  choice       a fifth of all rows is left out of the steps: the iterate with the least non-negative risk there is kept; a
               score of 0.5 is then put where the same risk of zero-one loss is least, and scores are spread so that the mean
               score of unlabelled texts is the prior
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, stored
from .lang import held_out
from .words import as_arrow, cut

#: Bound of the sample of positives (labelled rows); features kept; letter runs.
POSITIVES, FEATURES, RUNS = 4000, 500, (5, 6, 7)
#: A feature is kept if its share among positives is so many times that among unlabelled rows or as many times less, and so
#: many errors away from it; a candidate occurs in so many positives, and in this share of them.
LIFT, LEAST_Z, LEAST, SHARE = 5.0, 8.0, 3, 0.01
#: Newton steps at most, and rows that a task handles at once.
STEPS, ROWS = 12, 2000
CACHE_WORDS, PIECE = 200_000, 8 << 20
#: Bytes of words: letters and digits of ASCII and all of other characters.
INSIDE = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def words_of(texts: pa.Array) -> list[set[bytes]]:
    """The distinct words of each text, in lower case."""
    w = cut(pa.compute.utf8_lower(texts), INSIDE)
    begin = np.searchsorted(w.row, np.arange(len(texts) + 1)).tolist()
    return [{w.bytes(i) for i in range(a, b)} for a, b in zip(begin, begin[1:], strict=False)]


def runs_of(word: bytes) -> set[str]:
    """The word itself, and its runs of letters, with both ends marked."""
    text = "<" + word.decode("utf-8") + ">"
    n = len(text)
    return {text, *[text[i : i + 5] for i in range(n - 4)], *[text[i : i + 6] for i in range(n - 5)], *[text[i : i + 7] for i in range(n - 6)]}


@functools.lru_cache(2)
def _reader(kept: tuple[str, ...]) -> Reader:
    """One for each worker process and set of features."""
    return Reader(kept)


def _once(x: np.ndarray) -> np.ndarray:
    """Distinct numbers (none negative), ascending. Sorted in place, which is quicker than what np.unique does with hashes."""
    x.sort()
    return x[np.diff(x, prepend=-1) != 0]


class Reader:
    """Texts to the kept features they hold. A batch's words are numbered by Arrow; each distinct one is looked at once, by one
    intersection, and remembered for later batches."""

    def __init__(self, kept: tuple[str, ...]):
        self.number = {s: k for k, s in enumerate(kept)}
        self.names = frozenset(kept)
        self.begin = frozenset(s[:5] for s in kept if len(s) >= 5)
        self.words: dict[bytes, tuple[int, ...]] = {}

    def of(self, word: bytes) -> tuple[int, ...]:
        own = self.words.get(word)
        if own is None:
            text = "<" + word.decode("utf-8") + ">"
            at = [i for i in range(len(text) - 4) if text[i : i + 5] in self.begin]  # no other run of its can be kept
            runs = {text, *[text[i : i + n] for n in RUNS for i in at]}
            own = self.words[word] = tuple(self.number[s] for s in self.names & runs)
        return own

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row and feature of each, in order and once."""
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        w = cut(pa.compute.utf8_lower(texts), INSIDE)
        coded = as_arrow(w).dictionary_encode()
        each = [self.of(x) for x in coded.dictionary.to_pylist()]
        size = np.array([len(x) for x in each], np.int64)
        flat = np.fromiter((k for x in each for k in x), np.int64, int(size.sum()))
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        there = size[word] > 0 if len(word) else np.zeros(0, bool)
        pairs = _once(w.row[there] * max(1, len(each)) + word[there])
        row, word = np.divmod(pairs, max(1, len(each)))
        many = size[word]
        place = np.repeat((np.cumsum(size) - size)[word], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        both = _once(np.repeat(row, many) * max(1, len(self.names)) + flat[place])
        return np.divmod(both, max(1, len(self.names)))

    def lists(self, texts: pa.Array) -> pa.Array:
        """Each text's features, ascending."""
        row, feature = self.found(texts)
        offsets = np.searchsorted(row, np.arange(len(texts) + 1))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(feature, pa.int32()))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sums(rows: list, n: np.ndarray, w: np.ndarray, b: float, curved: bool = True) -> np.ndarray:
    """Of rows (lists of features) with numbers: their number, the sum of softplus(z), of sigmoid(z) times (features, 1) and,
    if ``curved``, of its derivative by (weights, bias), as one flat array."""
    d = len(w) + 1
    total, loss, first, second = 0.0, 0.0, np.zeros(d), np.zeros((d, d)) if curved else None
    for k in range(0, len(rows), ROWS):
        part, m = rows[k : k + ROWS], n[k : k + ROWS].astype(float)
        size = np.array([len(x) for x in part], np.int64)
        x = np.zeros((len(part), d))
        x[:, -1] = 1
        x[np.repeat(np.arange(len(part)), size), np.fromiter((j for r in part for j in r), np.int64, int(size.sum()))] = 1
        z = x[:, :-1] @ w + b
        p = _sigmoid(z)
        total, loss, first = total + m.sum(), loss + m @ _softplus(z), first + (m * p) @ x
        if curved:
            second += (x * (m * p * (1 - p))[:, None]).T @ x
    return np.concatenate([[total, loss], first, second.ravel() if curved else []])


def minimised(evaluate, share: np.ndarray, held: np.ndarray, prior: float, decay: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps. ``evaluate(w, b)`` gives the sums() of unlabelled and positive rows that are learned
    from, and those (without curvature) of unlabelled and positive rows that are held back; ``share`` and ``held`` are the
    mean features of positives of either kind.

    The loss of a positive as 1 less that as 0 is -z, so while the second part of the risk is positive, the risk is convex:
    softplus over unlabelled rows less the prior times the mean z of positives. A step that makes that part negative, or the
    risk larger, is halved, so the risk can't be pushed below what the data can have."""
    d = len(share)
    w, b = np.zeros(d), float(np.log(prior / (1 - prior)))

    def parts(w, b):
        un, po, hu, hp = evaluate(w, b)
        rest = un[1] / un[0] - prior * po[1] / po[0]
        risk = un[1] / un[0] - prior * (share @ w + b) + decay / 2 * w @ w
        hold = max(0.0, hu[1] / max(hu[0], 1) - prior * hp[1] / max(hp[0], 1)) + prior * (hp[1] / max(hp[0], 1) - (held @ w + b)) if hp[0] else risk
        return risk, rest, hold, un

    risk, rest, hold, un = parts(w, b)
    best = hold, w, b
    for _ in range(steps):
        grad = un[2 : d + 3] / un[0] - prior * np.append(share, 1) + decay * np.append(w, 0)
        curve = un[d + 3 :].reshape(d + 1, d + 1) / un[0] + decay * np.diag(np.append(np.ones(d), 1e-3))
        step, size = np.linalg.solve(curve, grad), 1.0
        if np.abs(grad).max() < 1e-6:
            break
        while size > 1e-3:
            new = parts(w - size * step[:-1], b - size * step[-1])
            if new[1] >= 0 and new[0] <= risk + 1e-12:
                break
            size /= 2
        else:
            break
        w, b, done = w - size * step[:-1], b - size * step[-1], risk - new[0] < 1e-7
        risk, rest, hold, un = new
        if hold < best[0]:
            best = hold, w, b
        if done:
            break
    return best[1], best[2]


def scaled(w: np.ndarray, unlabelled: np.ndarray, positive: np.ndarray, edges: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias so that a score of 0.5 is the place with the least non-negative risk of zero-one loss, and the mean
    score of unlabelled rows is the prior, from a histogram of z of unlabelled rows and z of positives, without bias."""
    mids = np.concatenate([[edges[0]], (edges[:-1] + edges[1:]) / 2, [edges[-1]]])
    said_u = 1 - np.cumsum(unlabelled)[:-1] / max(1, unlabelled.sum())  # at or above each edge
    said_p = 1 - np.searchsorted(np.sort(positive), edges) / len(positive)
    risk = prior * (1 - said_p) + np.maximum(0, said_u - prior * said_p)
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    cut = float(edges[best[len(best) // 4]])  # of equal risks, one that lets little toxic text pass and is clear of the clean
    low, high = 0.25, 50.0
    for _ in range(60):
        k = (low + high) / 2
        low, high = (k, high) if unlabelled @ _sigmoid(k * (mids - cut)) > prior * unlabelled.sum() else (low, k)
    return w * k, -k * cut


def fit(positive: list[list[int]], unlabelled: list[list[int]], width: int, prior: float, steps: int = STEPS, decay: float | None = None) -> tuple[np.ndarray, float]:
    """minimised() for lists; every fifth row is held back."""
    def halves(rows):
        return [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if i % 5 == 0]

    (lp, hp), (lu, hu) = halves(positive), halves(unlabelled)
    mean = lambda rows: np.bincount([k for r in rows for k in r], minlength=width)[:width] / max(1, len(rows))
    one = lambda rows, w, b, curved: sums(rows, np.ones(len(rows)), w, b, curved)
    return minimised(lambda w, b: (one(lu, w, b, True), one(lp, w, b, False), one(hu, w, b, False), one(hp, w, b, False)), mean(lp), mean(hp), prior, decay or prior / max(1, len(positive)), steps)


def _added(df: DataFrame, body, width: int) -> np.ndarray:
    """The sum of ``body(list of batches)`` (an array of ``width`` numbers) over all tasks, of which each sends one array."""
    def each(batches):
        total = np.zeros(width)
        for batch in batches:
            total += body(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def pair(batches):  # arrays are added by groups of tasks before they come to the driver
        total = np.zeros(width)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = df.mapInArrow(each, "part binary").repartition(8).mapInArrow(pair, "part binary").toArrow().column(0).to_pylist()
    return sum((np.frombuffer(x) for x in parts), np.zeros(width))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> tuple[tuple[str, ...], np.ndarray, float]:
    """Kept features, their weights and the bias (see learned)."""
    return learned(docs, labels, id_col, text_col, toxic_col)[0]


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> tuple[tuple, DataFrame | None]:
    """The model (kept features, their weights, the bias) and the features of every row of ``docs`` (key, held_out, x), for
    scored(); None where there are no features. Held-out rows are never read for it. Positives are the rows of the POSITIVES
    toxic ids that hash lowest, with whole texts; unlabelled are all rows. Null labels are no labels, repeated ones count as
    toxic if any is; without a toxic row there are no features and every score is the prior."""
    marks = labels.where(~held_out(id_col)).groupBy(F.col(id_col).alias("k")).agg(F.max(F.col(toxic_col).cast("int")).alias("toxic")).where("toxic is not null")
    n, ones = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(0.9, max(0.001, ones / n)) if n else 0.001
    none = ((), np.zeros(0), float(np.log(prior / (1 - prior)))), None
    rows = docs.where(~held_out(id_col)).select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = marks.where("toxic = 1").select("k").orderBy(F.xxhash64("k"), "k").limit(POSITIVES)
    positive = stored(rows.join(F.broadcast(ids), F.col("key") == F.col("k"), "left_semi"), "toxic-positive")
    pn = positive.count()
    if not pn:
        return none

    def slots(batches):
        for batch in batches:
            into: dict[str, int] = {}
            for words in words_of(batch.column(0)):
                for s in set().union(*map(runs_of, words)):
                    into[s] = into.get(s, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(into), pa.string()), pa.array(list(into.values()), pa.int64())], ["slot", "n"])

    found = positive.select("text").mapInArrow(slots, "slot string, n long").groupBy("slot").agg(F.sum("n").alias("a")).where(F.col("a") >= max(LEAST, SHARE * pn)).orderBy("slot").toArrow()  # of the sample of positives
    candidates, a = tuple(found.column("slot").to_pylist()), found.column("a").to_numpy().astype(float)
    if not candidates:
        return none
    shared = docs.sparkSession.sparkContext.broadcast(candidates)
    width = len(candidates)

    def counted(batch):
        own = _reader(shared.value)
        out = np.zeros(width + 1)
        for part in pieces(batch, 0, PIECE):
            out[:-1] += np.bincount(own.found(part.column(0))[1], minlength=width)
        out[-1] = batch.num_rows
        return out

    b = _added(rows.select("text"), counted, width + 1)
    share_p, share_u, un = a / pn, (b[:-1] + 0.5) / max(b[-1], 1), b[-1]
    z = (share_p - share_u) * np.sqrt(pn / share_u)
    good = ((share_p > LIFT * share_u) & (z > LEAST_Z)) | ((LIFT * share_p < share_u) & (z < -LEAST_Z))
    order = np.argsort(-np.abs(z), kind="stable")  # candidates are in order
    kept = tuple(candidates[k] for k in sorted(order[good[order]][:FEATURES]))
    if not kept:
        return none
    known = docs.sparkSession.sparkContext.broadcast(kept)

    def read(batches):
        own = _reader(known.value)
        for batch in batches:
            for part in pieces(batch, 3, PIECE):
                yield pa.RecordBatch.from_arrays([*part.columns[:3], own.lists(part.column(3))], ["key", "held_out", "held", "x"])

    fifth = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(5)) == 0
    every = docs.select(F.col(id_col).cast("bigint").alias("key"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lists = stored(every.select("key", "held_out", fifth.alias("held"), "text").mapInArrow(read, "key long, held_out boolean, held boolean, x array<int>"), "toxic-lists")
    vectors = stored(lists.where("not held_out").groupBy("held", "x").agg(F.count(F.lit(1)).alias("n")), "toxic-vectors")
    sample = lists.where("not held_out").join(F.broadcast(ids), F.col("key") == F.col("k").cast("bigint"), "left_semi").select("held", "x").toPandas()  # the sample's lists
    lp, hp = ([list(x) for x in sample.x[sample.held == k]] for k in (False, True))
    if not lp:
        lp, hp = hp, []
    d = len(kept)
    mean = lambda rows: np.bincount([k for r in rows for k in r], minlength=d)[:d] / max(1, len(rows))
    size = 2 + (d + 1) + (d + 1) ** 2

    def evaluate(w, b):
        def body(batch):
            flag, x, m = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            mine = [r for r, h in zip(x, flag, strict=True) if not h]
            back = [r for r, h in zip(x, flag, strict=True) if h]
            return np.concatenate([sums(mine, m[~flag], w, b), sums(back, m[flag], w, b, False)])

        total = _added(vectors, body, size + d + 3)
        return total[:size], sums(lp, np.ones(len(lp)), w, b, False), total[size:], sums(hp, np.ones(len(hp)), w, b, False)

    w, b = minimised(evaluate, mean(lp), mean(hp), prior, prior / pn)
    edges = np.linspace(-40, 40, 8001)

    def histogram(batch):
        z = np.array([w[x].sum() for x in batch.column(1).to_pylist()], float)
        return np.bincount(np.clip(np.digitize(z, edges), 0, 8001), batch.column(2).to_numpy(), 8002)

    w, b = scaled(w, _added(vectors, histogram, 8002), np.array([w[list(x)].sum() for x in sample.x], float), edges, prior)
    return (kept, w, b), lists


def scored(lists: DataFrame, model: tuple) -> DataFrame:
    """key, held_out, score (0 to 1) and predicted for each row of ``lists`` (key, held_out, x)."""
    shared = lists.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        _, w, b = shared.value
        for batch in batches:
            p = _sigmoid(np.array([b + w[x].sum() for x in batch.column(2).to_pylist()], float))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["key", "held_out", "score", "predicted"])

    return lists.select("key", "held_out", "x").mapInArrow(score, "key long, held_out boolean, score double, predicted int")


def predict(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, held_out, score (0 to 1) and predicted for each row of ``docs``; null and empty texts have the score of no
    feature, texts of any length are read whole; repeated rows get a result each; other columns are not read; an empty table
    gives an empty one."""
    kept = docs.sparkSession.sparkContext.broadcast(model[0])
    rows = docs.select(F.col(id_col).cast("bigint").alias("key"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def read(batches):
        own = _reader(kept.value)
        for batch in batches:
            for part in pieces(batch, 2, PIECE):
                yield pa.RecordBatch.from_arrays([*part.columns[:2], own.lists(part.column(2))], ["key", "held_out", "x"])

    return scored(rows.mapInArrow(read, "key long, held_out boolean, x array<int>"), model)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model, lists = learned(docs, labels)
    return (predict(docs, model) if lists is None else scored(lists, model)).withColumnRenamed("key", "doc_id")
