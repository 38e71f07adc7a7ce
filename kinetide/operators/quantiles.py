"""Exact order statistics and running histograms, with neither a sort of a key nor a buffer of its values.

Order statistics are found by refining ranges: rows within a range are counted by bins, before and after one shuffle, and the
bin that holds the wanted place becomes the range. A key with most of the rows is counted by all tasks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetide.shared import stored

#: Bins of a range, cells of a pass in all (more ranges get fewer bins), and rows of a range that are put in order at once.
BINS, CELLS, FEW = 4096, 1 << 22, 2000
#: Fixed: bins of the running histogram, and how far its first edges lie beyond the first batch.
RUNNING_BINS, BEYOND = 5000, 1e-10


def _bin(x: Column, lo: Column, hi: Column, n: int, scaled: bool) -> Column:
    """A bin of [lo, hi] that never falls as x grows; both ends have bins of their own, so each pass gets on. ``scaled``: by
    sign, or by magnitude where all have one sign; else even bins."""
    even = F.floor((x - lo) / (hi - lo) * n)
    size = lambda a, b, c: F.floor((F.ln(a) - F.ln(b)) / (F.ln(c) - F.ln(b)) * n)
    by_size = F.when(lo > 0, size(x, lo, hi)).when(hi < 0, n - size(-x, -hi, -lo)).otherwise(F.signum(x) + 1)
    inner = F.greatest(F.lit(0), F.least(F.lit(n), F.coalesce(F.nanvl(by_size if scaled else even, F.lit(0.0)), F.lit(0.0)))).cast("int")
    return F.when(x == lo, -1).when(x == hi, n + 1).otherwise(inner)


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys], F.lit(True))


def at_places(df: DataFrame, keys: list[str], value: str, places: dict[str, object]) -> DataFrame:
    """keys, target, n, x: for each key and name of ``places`` the value at a place (0 the least) of its sorted values, where a
    place is a function of the column with their number. Exact, for numbers of any distribution; nulls and NaN are left out.

    A pass reads the rows twice at first; then only those within the chosen ranges, which are stored."""
    rows = df.select(*keys, F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("target"), f(F.col("n")).cast("bigint").alias("place")) for name, f in places.items()]))
    state = sizes.select("*", wanted.alias("w")).select(*keys, "n", "w.*", "lo", "hi", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("within"))
    state = stored(state, "places")
    found, turn = [], 0
    while True:
        found.append(state.where("lo = hi"))
        state = state.where("lo < hi")
        left = state.agg(F.count(F.lit(1)), F.max("within")).first()
        if left[0] == 0:
            break
        side = state.select(*[F.col(k).alias(f"_s_{k}") for k in keys], "target", "place", "n", "lo", "hi", "below")
        inside = rows.join(side, _same(keys) & (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")) & ((F.col("target") == F.col("of")) if turn > 1 else F.lit(True)))
        inside = inside.drop("of") if turn > 1 else inside
        by = [*keys, "target"]
        if left[1] <= FEW:
            ranked = inside.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("x")) - 1 + F.col("below"))
            found.append(ranked.where("r = place").select(*keys, "n", "target", "place", F.col("x").alias("lo"), F.col("x").alias("hi"), "below", F.lit(1).cast("bigint").alias("within")))
            break
        if turn == 1:  # the ranges are narrow now: later passes read only what is within them
            inside = stored(inside.select(*keys, F.col("target").alias("of"), "x"), "places-within")
            rows, turn = inside, 2
            continue
        n = max(16, min(BINS, CELLS // left[0]))
        counted = inside.withColumn("bin", _bin(F.col("x"), F.col("lo"), F.col("hi"), n, turn % 2 == 1))
        counted = counted.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("within"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.first("place").alias("place"), F.first("n").alias("n"), F.first("below").alias("before"))
        w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # n + 3 rows at most
        counted = counted.withColumn("upto", F.sum("within").over(w) + F.col("before")).where("place < upto and place >= upto - within")
        state = stored(counted.select(*keys, "n", "target", "place", "lo", "hi", (F.col("upto") - F.col("within")).alias("below"), "within"), "places")
        turn += 1
    return reduce(DataFrame.unionByName, found).select(*keys, "target", "n", F.col("lo").alias("x"))


def order_statistics(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """A3: keys, n and for each share the value at place floor(n * share)."""
    found = at_places(df, keys, value, {name: (lambda n, q=q: F.least(F.floor(n * q), n - 1)) for name, q in shares.items()})
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("target") == name, F.col("x"))).alias(name) for name in shares])


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Keys, n and for each share the percentile, linear between the two values round place share * (n - 1)."""
    both = {f"{side}{name}": (lambda n, q=q, f=f: f((n - 1) * F.lit(q))) for name, q in shares.items() for side, f in (("-", F.floor), ("+", F.ceil))}
    found = at_places(df, keys, value, both)
    rows = found.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("target") == t, F.col("x"))).alias(t) for t in both])
    part = lambda q: (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))
    for name, q in shares.items():
        rows = _between(rows.withColumn("_b_part", part(q)), f"-{name}", f"+{name}", name)
    return rows.select(*keys, "n", *shares)


def _between(rows: DataFrame, low: str, high: str, out: str) -> DataFrame:
    """``rows`` with low * (1 - _part) + high * _part as ``out``, where only the second product and the sum are rounded, as a
    fused multiplication does: a value next to the percentile is above or below it by the last bit. What the first product
    loses is found by halves of its factors (Dekker), what the sum loses by Knuth's two-sum."""
    x, y = F.col(f"`{low}`"), 1 - F.col("_b_part")
    half = lambda c: c * F.lit(134217729.0) - (c * F.lit(134217729.0) - c)
    rows = rows.withColumns({"_b_p": x * y, "_b_c": F.col(f"`{high}`") * F.col("_b_part"), "_b_x": half(x), "_b_y": half(y)})
    lost = ((F.col("_b_x") * F.col("_b_y") - F.col("_b_p")) + F.col("_b_x") * (y - F.col("_b_y")) + (x - F.col("_b_x")) * F.col("_b_y")) + (x - F.col("_b_x")) * (y - F.col("_b_y"))
    rows = rows.withColumns({"_b_e": lost, "_b_s": F.col("_b_p") + F.col("_b_c")})
    other = F.col("_b_s") - F.col("_b_p")
    rows = rows.withColumn("_b_t", (F.col("_b_p") - (F.col("_b_s") - other)) + (F.col("_b_c") - other))
    exact = F.nanvl(F.col("_b_s") + (F.col("_b_t") + F.col("_b_e")), F.col("_b_s"))  # halves of the largest doubles overflow
    return rows.withColumn(out, F.when(F.col("_b_part") == 0, x).otherwise(exact)).drop("_b_part", "_b_p", "_b_c", "_b_x", "_b_y", "_b_e", "_b_s", "_b_t")


def _edge(i: Column, lo: Column, hi: Column) -> Column:
    """The i-th edge of even bins, as they are computed from the first edge on; the last is ``hi`` itself."""
    return F.when(i >= RUNNING_BINS, hi).otherwise(i * ((hi - lo) / RUNNING_BINS) + lo)


def running_quantiles(long: DataFrame, keys: list[str], batch: str, value: str = "x", shares: dict[str, float] | None = None) -> DataFrame:
    """Keys, n, mean, std, lo, hi and quantiles (q01 and q99) of a histogram that is kept batch by batch: 5000 even bins
    over what has been seen; whenever the range grows, counts move to the new bins by the left edges of the old ones (what
    lies left of the new range is lost). Each quantile is the left edge of the first bin up to which its share is counted.
    Keys with fewer than two values are left out; nulls are too.

    The histogram depends on the order of batches, so it can't be merged. But between two changes of the range its counts
    can: batches are cut into such epochs by running minima and maxima, values are counted by epoch and bin in any order, and
    only those counts are folded in order, a histogram at a time."""
    shares = shares or {"q01": 0.01, "q99": 0.99}
    rows = long.select(*keys, F.col(batch).alias("batch"), F.col(value).cast("double").alias("x")).where("x is not null")
    each = rows.groupBy(*keys, "batch").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    w = Window.partitionBy(*keys).orderBy("batch")
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumns({"lo": F.min("least").over(sofar), "hi": F.max("most").over(sofar)})
    new = (F.col("lo") < F.lag("lo").over(w)) | (F.col("hi") > F.lag("hi").over(w))
    each = stored(each.withColumn("epoch", F.sum(F.when(F.coalesce(new, F.lit(False)), 1).otherwise(0)).over(sofar)), "epochs")
    first = F.col("epoch") == 0
    spans = each.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("batch").alias("_b"), "epoch", F.when(first, F.col("lo") - BEYOND).otherwise(F.col("lo")).alias("lo"), F.when(first, F.col("hi") + BEYOND).otherwise(F.col("hi")).alias("hi"))
    inside = rows.join(spans, _same(keys) & (F.col("batch") == F.col("_b")))
    lo, hi, x = F.col("lo"), F.col("hi"), F.col("x")
    guess = F.greatest(F.lit(0), F.least(F.lit(RUNNING_BINS - 1), F.floor((x - lo) / ((hi - lo) / RUNNING_BINS)))).cast("int")
    inside = inside.withColumn("bin", guess).withColumn("bin", F.when(x < _edge(F.col("bin"), lo, hi), F.col("bin") - 1).when((x >= _edge(F.col("bin") + 1, lo, hi)) & (F.col("bin") < RUNNING_BINS - 1), F.col("bin") + 1).otherwise(F.col("bin")))
    counted = inside.groupBy(*keys, "epoch", "bin").agg(F.count(F.lit(1)).alias("c"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    counted = counted.withColumn("_key", F.to_json(F.struct(*keys)) if keys else F.lit("{}"))
    counted = counted.repartition("_key").sortWithinPartitions("_key", "epoch", "bin")

    def folded(frames):
        """Each key's histogram, epoch by epoch; rows come in order and one histogram is held."""
        held = None  # key, epoch, edges, counts
        for frame in frames:
            for (own, epoch), part in frame.groupby(["_key", "epoch"], sort=False):
                if held is not None and held[0] != own:
                    yield done(held)
                    held = None
                if held is None or held[1] != epoch:
                    edges = np.linspace(part.lo.iloc[0], part.hi.iloc[0], RUNNING_BINS + 1)
                    counts = np.zeros(RUNNING_BINS) if held is None else np.histogram(held[2][:-1], bins=edges, weights=held[3])[0]
                    held = (own, epoch, edges, counts)
                held[3][part.bin.to_numpy()] += part.c.to_numpy()
        if held is not None:
            yield done(held)

    def done(held):
        own, _, edges, counts = held
        return pd.DataFrame({"_key": [own], "edges": [edges], "sums": [np.cumsum(counts)]})

    sums = counted.select("_key", "epoch", "bin", "c", "lo", "hi").mapInPandas(folded, "_key string, edges array<double>, sums array<double>")
    total = each.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.min("least").alias("lo"), F.max("most").alias("hi")).where("n >= 2")
    total = total.withColumn("_k", F.to_json(F.struct(*keys)) if keys else F.lit("{}"))
    made = total.join(sums, F.col("_k") == F.col("_key"))
    at = lambda q: F.get("edges", F.size(F.filter("sums", lambda s: s < F.col("n") * F.lit(q))))
    mean, square = F.col("s") / F.col("n"), F.col("ss") / F.col("n")
    return made.select(*keys, "n", mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"), "lo", "hi", *[at(q).alias(name) for name, q in shares.items()])
