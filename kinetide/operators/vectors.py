"""Operators over vectors (arrays of numbers): statistics by grouping sets, scaling, differences, slices, bins."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetide.operators.quantiles import percentiles


def long_form(df: DataFrame, ids: list[str], vector: str) -> DataFrame:
    """A row for each component: ids, dim, x."""
    return df.select(*ids, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def moments() -> list[Column]:
    """n, mean, population std, lo and hi of x."""
    mean, square = F.avg("x"), F.avg(F.col("x") * F.col("x"))
    return [F.count("x").alias("n"), mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"), F.min("x").alias("lo"), F.max("x").alias("hi")]


def vector_stats(df: DataFrame, vector: str, keys: list[str] | None = None, quantiles: str = "minmax") -> DataFrame:
    """For each key and component n, mean, population std, lo, hi, q01, q99 (least and greatest, or exact
    percentiles by ranges that are refined). Partial sums merge before the shuffle; no values are gathered."""
    keys = keys or []
    long = long_form(df, keys, vector)
    if quantiles == "minmax":
        return long.groupBy(*keys, "dim").agg(*moments(), F.min("x").alias("q01"), F.max("x").alias("q99"))
    by = [*keys, "dim"]
    found = percentiles(long, by, "x", {"q01": 0.01, "q99": 0.99}).drop("n").withColumnsRenamed({k: f"_s_{k}" for k in by})
    return long.groupBy(*by).agg(*moments()).join(found, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in by], "left").drop(*[f"_s_{k}" for k in by])


def grouping_set_stats(df: DataFrame, vector: str, keys: list[str], least: int = 2) -> DataFrame:
    """The same over all rows and over each key, in one pass; groups below ``least`` rows are dropped. A null key
    is the total (``total`` tells it from a key that is null)."""
    long = long_form(df, keys, vector)
    sets = long.groupingSets([[F.col("dim")], [F.col("dim"), *map(F.col, keys)]], F.col("dim"), *map(F.col, keys))
    return sets.agg(F.grouping(keys[0]).cast("boolean").alias("total"), *moments()).where(F.col("n") >= least)


def timestamp_set_stats(long: DataFrame, t: str, keys: list[str], least: int = 2) -> DataFrame:
    """Statistics of components (dim, x) over all rows, over each timestamp, over each key and over both, in one pass;
    ``all_t`` and ``total`` tell totals from null timestamps and keys; groups below ``least`` rows are dropped."""
    dim, by, at = F.col("dim"), [F.col(k) for k in keys], F.col(t)
    sets = long.groupingSets([[dim], [dim, at], [dim, *by], [dim, at, *by]], dim, at, *by)
    return sets.agg(F.grouping(t).cast("boolean").alias("all_t"), F.grouping(keys[0]).cast("boolean").alias("total"), *moments()).where(F.col("n") >= least)


def z_score(x: Column, mean: Column, std: Column) -> Column:
    """F14."""
    return (x - mean) / (std + 1e-6)


def z_inverse(x: Column, mean: Column, std: Column) -> Column:
    """F14, inverse."""
    return x * (std + 1e-6) + mean


def quantile_scale(x: Column, q01: Column, q99: Column) -> Column:
    """q01 to q99 becomes -1 to 1."""
    return (x - q01) / (q99 - q01 + 1e-6) * 2 - 1


def quantile_inverse(x: Column, q01: Column, q99: Column) -> Column:
    """F15, inverse."""
    return (x + 1) / 2 * (q99 - q01 + 1e-6) + q01


def normalize(df: DataFrame, ids: list[str], vector: str, stats: DataFrame, keys: list[str] | None = None, how: str = "z") -> DataFrame:
    """Components scaled by the statistics of their dim (and of their row's key): ids, keys, dim, y.

    A row whose key has no statistics is an error, reported when the result is read."""
    keys = keys or []
    long = long_form(df, [*ids, *[k for k in keys if k not in ids]], vector)
    s = stats.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("dim").alias("_dim"), "mean", "std", "q01", "q99")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("dim") == F.col("_dim"))
    y = z_score(F.col("x"), F.col("mean"), F.col("std")) if how == "z" else quantile_scale(F.col("x"), F.col("q01"), F.col("q99"))
    found = long.join(s, on, "left")
    missing = F.raise_error(F.lit("no statistics for a row's key")).cast("double")
    return found.select(*long.columns[:-1], F.when(F.col("_dim").isNull(), missing).otherwise(y).alias("y"))


def delta(actions: Column, state: Column, mask: list[bool], sign: int = -1) -> Column:
    """state subtracted from (sign -1) or added to (1) the masked components; others and missing ones stay."""
    flags = F.array(*map(F.lit, mask))
    return F.transform(actions, lambda x, i: F.when(F.coalesce(F.get(flags, i), F.lit(False)), x + sign * F.coalesce(F.get(state, i), F.lit(0.0))).otherwise(x))


def bool_mask(*dims: int) -> list[bool]:
    """runs of true (positive numbers) and false (negative ones)."""
    return [d > 0 for d in dims for _ in range(abs(d))]


def pad(a: Column, n: int, value=0.0) -> Column:
    """``value`` appended up to length ``n``; longer ones stay."""
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(F.lit(0), F.lit(n) - F.size(a))))


def slices(a: Column, spans: list[tuple[int, int]]) -> Column:
    """[start, end) pieces, in order, as one array."""
    return F.concat(*[F.slice(a, s + 1, e - s) for s, e in spans])


def gripper_width(a: Column, start: int, end: int, span: float = 0.1) -> Column:
    """2 * sum / span - 1."""
    return F.aggregate(F.slice(a, start + 1, end - start), F.lit(0.0), lambda s, x: s + x.cast("double")) * 2 / span - 1


def bins(x: Column, n: int = 256) -> Column:
    """place of x among ``n`` bins of [-1, 1]; -1 below, the last at 1 and above."""
    return F.greatest(F.lit(-1).cast("bigint"), F.least(F.lit(n - 1).cast("bigint"), F.floor((x + 1) * (n / 2))))


def stride(a: Column, k: int) -> Column:
    """W16."""
    return F.filter(a, lambda x, i: i % k == 0)


def finite(a: Column) -> Column:
    """No null, NaN or infinity."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def resample(a: Column, m: int) -> Column:
    """W21, linear: ``m`` values at even places of the array."""
    n = F.size(a)

    def at(k):
        p = k * (n - 1) / F.lit(max(1, m - 1))
        low = F.floor(p).cast("int")
        high = F.least(low + 1, n - 1)
        return F.get(a, low) + (F.get(a, high) - F.get(a, low)) * (p - low)

    return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), at)


def cubic_matrix(n: int, m: int) -> np.ndarray:
    """The (m, n) matrix that takes ``n`` values at even places to those of their cubic spline (third derivative
    continuous at the second and last but one) at ``m`` even places."""
    if n < 4:
        raise ValueError("a cubic needs four values")
    a, second = np.zeros((n, n)), np.zeros((n, n))
    a[0, :3] = a[-1, -3:] = 1, -2, 1
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = 1, 4, 1
        second[i, i - 1 : i + 2] = 6, -12, 6
    bend, x = np.linalg.solve(a, second), np.linspace(0, n - 1, m)
    low = np.minimum(x.astype(int), n - 2)
    t, one = (x - low)[:, None], np.eye(n)
    return one[low] * (1 - t) + one[low + 1] * t + bend[low] * (((1 - t) ** 3 - (1 - t)) / 6) + bend[low + 1] * ((t**3 - t) / 6)


def resample_cubic(a: Column, n: int, m: int, scale: float = 1.0) -> Column:
    """W21, cubic: an array of ``n`` numbers at ``m`` even places, times ``scale`` (n / m for velocities). The spline is linear
    in the values, so it is a fixed matrix and stays an expression."""
    rows = F.array(*[F.array(*map(F.lit, r)) for r in (cubic_matrix(n, m) * scale).tolist()])
    return F.transform(rows, lambda r: F.aggregate(F.zip_with(r, a, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
