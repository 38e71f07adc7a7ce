"""Counts, reasons, validation, first rows, offsets and set comparisons of tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetide.shared import stored

#: Rows that a task of a range or of some keys has, about.
ROWS = 1 << 19

def counts_of(df: DataFrame, label: str, names: list[str], **more: Column) -> DataFrame:
    """Label, n (and ``more`` aggregates) for each of a fixed list of names, 0 (null) where no row has it. Rows of
    other labels are not counted."""
    found = df.where(F.col(label).isin(names)).groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in more.items()])
    listed = df.sparkSession.createDataFrame([(x,) for x in names], f"`{label}` string")
    return listed.join(found, F.col(label) == F.col("_l"), "left").select(label, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), *more)


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each key's most frequent value (the larger of equally frequent ones) as ``mode``, with its count ``n``. Values are
    counted first, so a key of any size merges before the shuffle."""
    each = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    best = each.groupBy(*keys).agg(F.max(F.struct("_n", value)).alias("_b"))
    return best.select(*keys, F.col(f"_b.{value}").alias("mode"), F.col("_b._n").alias("n"))


def majority(df: DataFrame, keys: list[str], yes: Column, for_: str, against: str) -> DataFrame:
    """``vote`` is ``for_`` where at least half of a key's rows say yes."""
    return df.groupBy(*keys).agg(F.when(F.count_if(yes) * 2 >= F.count(F.lit(1)), for_).otherwise(against).alias("vote"))


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row that is first by ``order``; by an aggregate, so nothing is sorted."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    best = df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_b"))
    return best.select(*keys, "_b.*")


def by_reason(df: DataFrame, rules: dict[str, Column], kept: str = "kept") -> DataFrame:
    """P10: rows by the first rule that fits: reason, n."""
    return df.groupBy(reason(rules, kept).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def reason(rules: dict[str, Column], kept: str = "kept") -> Column:
    """The name of the first rule that is true."""
    names = list(rules)
    first = reduce(lambda w, k: w.when(rules[k], F.lit(k)), names[1:], F.when(rules[names[0]], F.lit(names[0])))
    return first.otherwise(F.lit(kept))


def faults(df: DataFrame, checks: dict[str, Column], ids: list[str]) -> DataFrame:
    """Ids and ``fault`` for each check that is true of a row; null checks are no fault."""
    named = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))
    return df.select(*ids, F.explode(named).alias("fault"))


def require_none(found: DataFrame, what: str) -> None:
    """Raise with the first faults if there are any; nothing is written before."""
    some = found.limit(3).collect()
    if some:
        raise ValueError(f"{what}: {[tuple(r) for r in some]}")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with ``side`` left or right; empty if the sets are equal."""
    b = b.select(a.columns)
    only = lambda x, y, side: x.subtract(y).withColumn("side", F.lit(side))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def tasks(n: int) -> int:
    """Tasks for ``n`` rows, so that none has much more than ROWS of them, however many there are in all."""
    return max(1, -(-n // ROWS))


def _ranged(df: DataFrame, n: int, order: list[str], tag: str) -> DataFrame:
    """``df`` (``n`` rows) dealt by ranges of ``order`` and sorted within them, with ``_range`` and ``_i``, a row's place in
    its range."""
    made = df.repartitionByRange(tasks(n), *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return stored(made, tag).withColumns({"_range": F.shiftright("_id", 33), "_i": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")


def _before(ranged: DataFrame, n: Column) -> DataFrame:
    """``_r`` and ``_first``: the sum of ``n`` over the ranges before each."""
    totals = ranged.groupBy(F.col("_range").alias("_r")).agg(n.alias("_total"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    return F.broadcast(totals.select("_r", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_first")))


def _starts(sizes: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """Each key, ``_start`` and ``_rows``: where each key starts when keys follow one another in order. Keys are dealt by
    ranges; a start is the sum of the ranges before and of the keys before within its own, so no task has more than a few
    ranges."""
    each = stored(sizes.select(*keys, F.col(rows).alias("_rows")), "sizes")
    n = each.count()
    ranged = _ranged(each, n, keys, "starts")
    inside = Window.partitionBy("_range").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.repartition(tasks(n), "_range").withColumn("_inside", F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
    return found.join(_before(ranged, F.sum("_rows")), F.col("_range") == F.col("_r")).select(*keys, (F.col("_first") + F.col("_inside")).alias("_start"), "_rows")


def global_offsets(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``place`` of each row when keys follow one another in order. Rows are dealt by ranges of keys and order, so a
    place is the number of rows in the ranges before and the place in its own; no key is gathered in one task."""
    ranged = _ranged(df, df.count(), [*keys, order], "places")
    found = ranged.join(_before(ranged, F.count(F.lit(1))), F.col("_range") == F.col("_r"))
    return found.withColumn("place", F.col("_first") + F.col("_i")).drop("_range", "_i", "_r", "_first")


def located(manifest: DataFrame, index: str, sizes: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """``manifest`` rows (keys, ``index``: a place in all episodes one after another) with ``local``, their place in their
    own episode. ``sizes``: keys and each episode's number of rows. An index outside its episode is an error when it is read,
    and so is one of an episode that is not known. Episodes and rows are dealt together by key, in tasks of ROWS rows."""
    both = manifest.unionByName(_starts(sizes, keys, rows), allowMissingColumns=True).repartition(tasks(manifest.count()), *keys)
    own = Window.partitionBy(*keys)
    found = both.withColumns({"_s": F.max("_start").over(own), "_n": F.max("_rows").over(own)}).where(F.col("_start").isNull())
    local = F.col(index) - F.col("_s")
    wrong = F.raise_error(F.concat(F.lit("row index out of range for episode "), F.to_json(F.struct(*keys)))).cast("bigint")
    kinds = {k: F.col(k).cast(manifest.schema[k].dataType) for k in keys if both.schema[k].dataType != manifest.schema[k].dataType}
    return found.withColumns(kinds | {"local": F.when((local >= 0) & (local < F.col("_n")), local).otherwise(wrong)}).drop("_start", "_rows", "_s", "_n")


def path_lengths(df: DataFrame, keys: list[str], order: str, value: str, first: int) -> DataFrame:
    """Over the first rows of each key, the sum of changes of a number (``path``) and its mean."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumns({"_r": F.row_number().over(w), "_p": F.lag(value).over(w)}).where(F.col("_r") <= first)
    return rows.groupBy(*keys).agg(F.sum(F.coalesce(F.abs(F.col(value) - F.col("_p")), F.lit(0.0))).alias("path"), F.avg(value).alias("mean"))


def looked_up(df: DataFrame, table: DataFrame, key: str, value: str, default=None) -> DataFrame:
    """``df`` with ``value`` of the table's row of the same key; missing ones are ``default``, or an
    error when read if that is None. Spark broadcasts the table only if its size allows."""
    other = table.select(F.col(key).alias("_k"), F.col(value), F.lit(True).alias("_has"))
    missing = F.raise_error(F.concat(F.lit(f"no {value} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))) if default is None else F.lit(default)
    kind = table.schema[value].dataType
    found = df.join(other, F.col(key) == F.col("_k"), "left")
    return found.withColumn(value, F.when(F.col("_has"), F.col(value)).otherwise(missing.cast(kind))).drop("_k", "_has")


def conjunctive_keep(df: DataFrame, a: str, b: str, at_a: float, at_b: float) -> DataFrame:
    """Rows but for those where both signals are at or below their limit."""
    return df.where(~((F.col(a) <= at_a) & (F.col(b) <= at_b)))


def renamed(df: DataFrame, rules: dict[str, str | None]) -> DataFrame:
    """Columns renamed by the first pattern that fits the whole name (None drops it); two of one name are an error."""
    names: dict[str, str] = {}
    for c in df.columns:
        to = next((None if new is None else re.sub(old, new, c) for old, new in rules.items() if re.fullmatch(old, c)), c)
        if to is None:
            continue
        if to in names:
            raise ValueError(f"{names[to]} and {c} would both become {to}")
        names[to] = c
    return df.select(*[F.col(f"`{c}`").alias(to) for to, c in names.items()])


def without_strings(df: DataFrame) -> DataFrame:
    """P16."""
    return df.select(*[f"`{f.name}`" for f in df.schema if f.dataType.typeName() != "string"])
