"""Weights, apportionment and deterministic sampling. Draws come from hashes of seed and place, so reruns draw the same."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetide.shared import stored


def uniform(*parts) -> Column:
    """A number in [0, 1) from the hash of its parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def class_weights(df: DataFrame, label: str, alpha: float) -> DataFrame:
    """Label, n, raw = (1 / n) ** alpha, and weight, scaled so that the weights of all rows sum to their number."""
    each = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("raw", F.pow(1.0 / F.col("n"), F.lit(alpha)))
    total = each.agg((F.sum("n") / F.sum(F.col("n") * F.col("raw"))).alias("_k"))  # one row
    return each.join(F.broadcast(total)).withColumn("weight", F.col("raw") * F.col("_k")).drop("_k")


def inverse_frequency(df: DataFrame, label: str) -> DataFrame:
    """Each row with 1 / the number of rows of its label; counts are aggregated first and joined, not windowed."""
    each = df.groupBy(F.col(label).alias("_l")).agg((1.0 / F.count(F.lit(1))).alias("weight"))
    return df.join(each, F.col(label).eqNullSafe(F.col("_l"))).drop("_l")


def task_balanced(df: DataFrame, head: str, task: str, weight: str) -> DataFrame:
    """Weights scaled so that the tasks of a head have equal totals, whose sum is the head's; rows without a positive
    weight keep it."""
    good = df.where(F.col(weight) > 0)
    tasks = good.groupBy(head, task).agg(F.sum(weight).alias("_t"))
    heads = tasks.groupBy(F.col(head).alias("_h")).agg(F.sum("_t").alias("_ht"), F.count(F.lit(1)).alias("_n"))
    scale = tasks.join(heads, F.col(head) == F.col("_h")).select(F.col(head).alias("_sh"), F.col(task).alias("_st"), (F.col("_ht") / F.col("_n") / F.col("_t")).alias("_k"))
    out = df.join(scale, (F.col(head) == F.col("_sh")) & (F.col(task) == F.col("_st")), "left")
    return out.withColumn("balanced", F.when(F.col(weight) > 0, F.col(weight) * F.col("_k")).otherwise(F.col(weight))).drop("_sh", "_st", "_k")


def mixture(df: DataFrame, name: str, n: str, power: float = 0.4) -> DataFrame:
    """Name, p = n ** power over the sum of all; a table of datasets. Not positive: error."""
    bad = F.raise_error(F.lit("a dataset is empty")).cast("double")
    rows = df.select(name, F.when(F.col(n) > 0, F.pow(F.col(n), F.lit(power))).otherwise(bad).alias("_p"))
    return rows.join(F.broadcast(rows.agg(F.sum("_p").alias("_s")))).select(name, (F.col("_p") / F.col("_s")).alias("p"))


def apportion(shares: list[float], total: int) -> list[int]:
    """``total`` places by share, at least one each: floors, then the largest remainders over what is given. Places too
    many are taken from the class with the least remainder until it has one, then from the next. Ties go by place. A list
    of classes, so on the driver."""
    if not shares or min(shares) < 0 or sum(shares) <= 0 or total < len(shares):
        raise ValueError("shares must be positive in sum, and no more of them than places")
    raw = [s / sum(shares) * total for s in shares]
    given = [max(1, int(r)) for r in raw]
    left = total - sum(given)
    for i in sorted(range(len(raw)), key=lambda i: given[i] - raw[i])[: max(0, left)]:
        given[i] += 1
    for i in sorted(range(len(raw)), key=lambda i: raw[i] - given[i]):
        back = min(given[i] - 1, max(0, -left))
        given[i] -= back
        left += back
    return given


def apportioned(df: DataFrame, label: str, n: str, total: int) -> DataFrame:
    """O5 over a table of classes, with the same rule: label, slots. Ties go by label."""
    rows = df.join(F.broadcast(df.agg(F.sum(n).alias("_s")))).withColumn("_raw", F.col(n) / F.col("_s") * total)
    rows = rows.withColumn("_base", F.greatest(F.lit(1), F.floor("_raw")).cast("bigint"))
    rows = rows.withColumn("_left", F.lit(total) - F.sum("_base").over(Window.partitionBy()))  # a row for each class
    rank = F.row_number().over(Window.orderBy((F.col("_raw") - F.col("_base")).desc(), label))
    before = F.coalesce(F.sum(F.col("_base") - 1).over(Window.orderBy(F.col("_raw") - F.col("_base"), label).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    back = F.greatest(F.lit(0), F.least(F.col("_base") - 1, -F.col("_left") - before))
    return rows.select(label, (F.col("_base") + F.when(rank <= F.col("_left"), 1).otherwise(0) - back).alias("slots"))


def count_modes(pools: list[int], batch: int, single: int | None = None, override: list[int] | None = None, proportional: bool = False, each: int = 8) -> list[int]:
    """Slots of each class in a batch. The first mode that is asked for counts: all to a single class, given numbers, in
    proportion to ``pools`` (rows or windows of each class), ``each`` to every class. Numbers that don't fit are errors."""
    if single is not None:
        if not 0 <= single < len(pools):
            raise ValueError(f"class {single} is not below {len(pools)}")
        return [batch if i == single else 0 for i in range(len(pools))]
    if override is not None:
        if len(override) != len(pools) or sum(override) != batch:
            raise ValueError("given numbers must be one for each class and sum to the batch")
        return list(override)
    return apportion([float(p) for p in pools], batch) if proportional else [each] * len(pools)


def hierarchical(plan: DataFrame, pools: DataFrame, episodes: DataFrame, seed: int) -> DataFrame:
    """For each row of ``plan`` (step, expert, slot) a dataset of the expert by probability, an episode of the dataset and
    a frame of the episode, both uniform: dataset, episode, frame. ``pools``: expert, dataset, p (sums to one);
    ``episodes``: dataset, place (0 to n - 1 within it), episode, length. Draws are hashes of seed and place in the plan."""
    u = lambda k: uniform(F.lit(seed), F.lit(k), "step", "expert", "slot")
    drawn = weighted_pick(pools.select("expert", "dataset", "p"), "expert", "dataset", "p", plan.withColumn("u", u(0)), "u").withColumnRenamed("picked", "_d").drop("u")
    sizes = episodes.groupBy(F.col("dataset").alias("_sd")).agg(F.count(F.lit(1)).alias("_n"))
    drawn = drawn.join(sizes, F.col("_d") == F.col("_sd")).withColumn("_place", F.floor(u(1) * F.col("_n"))).drop("_sd", "_n")
    found = drawn.join(episodes, (F.col("_d") == F.col("dataset")) & (F.col("_place") == F.col("place")))
    return found.select(*plan.columns, "dataset", "episode", F.floor(u(2) * F.col("length")).alias("frame"))


def mixed(parts: dict[str, tuple[DataFrame, float]], id_col: str, seed: int, n: int) -> DataFrame:
    """A mixture of tables by weight, in an order that a hash draws: name, id, place (0 to n - 1). Weights must sum to
    one. Each place draws its table, and the table's rows follow in hash order, over again when they are used up. Both are
    numbered by ranges, so no task holds a table."""
    if abs(sum(w for _, w in parts.values()) - 1) > 1e-9:
        raise ValueError("weights must sum to one")
    spark = next(iter(parts.values()))[0].sparkSession
    u = uniform(F.lit(seed), "place")
    upto, name = 0.0, None
    for k, (_, w) in parts.items():
        upto += w
        name = F.when(u < upto, F.lit(k)) if name is None else name.when(u < upto, F.lit(k))
    places = spark.range(n).withColumnRenamed("id", "place").withColumn("name", name.otherwise(F.lit(list(parts)[-1])))
    places = numbered(places, ["name"], ["place"], "_i")
    rows = None
    for k, (df, _) in parts.items():
        one = df.select(F.lit(k).alias("_name"), F.col(id_col).alias("id"))
        rows = one if rows is None else rows.unionByName(one)
    rows = numbered(rows.withColumn("_h", F.xxhash64(F.lit(seed), "id")), ["_name"], ["_h", "id"], "_r")
    sizes = rows.groupBy(F.col("_name").alias("_sn")).agg(F.count(F.lit(1)).alias("_size"))
    places = places.join(sizes, F.col("name") == F.col("_sn")).withColumn("_at", F.pmod("_i", "_size"))
    return places.join(rows, (F.col("name") == F.col("_name")) & (F.col("_at") == F.col("_r"))).select("name", "id", "place")


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """``df`` with each row's place (from 0) among those of its keys by ``order``, which must tell rows of a key apart. Rows
    are dealt by ranges of keys and order and counted by range; a place is that of its range and the one within it, so a key
    that has most of the rows is many tasks."""
    ranged = stored(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    counted = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_c")  # a row for each range
    starts = counted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_kr"), before.alias("_before"))
    found = ranged.join(starts, [*[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_range") == F.col("_kr")])
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    return found.withColumn(out, (F.col("_before") + own).cast("bigint")).drop("_range", "_kr", "_before", *[f"_k{i}" for i in range(len(keys))])


@functools.lru_cache(4)
def buffer_turns(seed: int, block: int, n: int, size: int) -> np.ndarray:
    """For each of ``n`` places of a block the turn at which a buffer of ``size`` gives it out."""
    draws, turns = np.random.Generator(np.random.PCG64([seed, block])).random(n).tolist(), np.empty(n, np.int64)
    held, coming = list(range(min(size, n))), size
    for turn, u in enumerate(draws):
        at = int(u * len(held))
        turns[held[at]] = turn
        if coming < n:
            held[at], coming = coming, coming + 1
        else:
            held[at] = held[-1]
            held.pop()
    return turns


def buffered(df: DataFrame, order: str, size: int, seed: int, block: int = 1 << 20) -> DataFrame:
    """``df`` with ``turn``, its place after a shuffle with a bounded buffer: rows come by ``order`` (0 to n - 1, each
    once), the buffer is filled, and each turn gives out one of it, drawn by seed and turn, whose place the next row takes.

    Each ``block`` of rows has a buffer of its own, so blocks are spread over tasks. Turns depend on places alone: a task works
    them out for its blocks (a number for each place of a block) and holds no row; a lost one gives the same again."""
    if size < 1 or block < 1:
        raise ValueError("a buffer has one row at least")
    n = df.count()

    @F.arrow_udf("bigint")
    def turn(places: pa.Array) -> pa.Array:
        at = places.to_numpy()
        out = np.empty(len(at), np.int64)
        for b in np.unique(at // block).tolist():
            mine = at // block == b
            out[mine] = buffer_turns(seed, b, min(block, n - b * block), size)[at[mine] - b * block] + b * block
        return pa.array(out)

    rows = df.withColumn("_block", F.floor(F.col(order) / block)).repartition("_block").sortWithinPartitions("_block")
    return rows.withColumn("turn", turn(F.col(order).cast("bigint"))).drop("_block")


def curriculum(budgets: DataFrame, expert: str, budget: str, slots: int) -> DataFrame:
    """Expert, step, slot: at every step ``slots`` rows of each expert whose budget of steps is not used up."""
    rows = budgets.where(F.col(budget) > 0).select(expert, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(budget).cast("bigint") - 1)).alias("step"))
    return rows.select(expert, "step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint"))).alias("slot"))


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by several keys; each task keeps its own first ones, so no table is sorted as a whole."""
    return df.orderBy(*order).limit(n)


def weighted_pick(items: DataFrame, key: str, item: str, weight: str, draws: DataFrame, u: str, part: Column | None = None) -> DataFrame:
    """Each draw (key, u in [0, 1)) with the item of its key whose share of the cumulated weights, in order of items,
    holds u. A negative weight is an error, and so are draws of a key without a positive weight; null keys have no draws.

    ``part`` is a column that never falls as ``item`` rises and cuts a key's items into parts, some thousands for a key at
    most: weights are summed by part first, a draw finds its part among the sums and then its item within the part, so a
    key that has most of the rows is many tasks. Without it a key is one."""
    part = F.lit(0) if part is None else part
    own = F.when(F.col(weight) < 0, F.raise_error(F.lit("a weight is negative")).cast("double")).otherwise(F.col(weight))
    mine = items.select(F.col(key).alias("_k"), part.alias("_part"), F.col(item).alias("_item"), own.alias("_w")).where("_w > 0")
    sums = mine.groupBy("_k", "_part").agg(F.sum("_w").alias("_w"))
    before = F.sum("_w").over(Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w")
    sums = sums.withColumn("_low", before).groupBy(F.col("_k").alias("_lk")).agg(F.sum("_w").alias("_total"), F.array_sort(F.collect_list(F.struct("_low", "_part"))).alias("_parts"))
    none = F.raise_error(F.lit("a key of draws has no item with a positive weight")).cast("double")
    rows = draws.where(F.col(key).isNotNull()).join(sums, F.col(key) == F.col("_lk"), "left")
    rows = rows.withColumn("_at", F.when(F.col("_total").isNull(), none).otherwise(F.col(u) * F.col("_total")))
    rows = rows.withColumn("_in", F.element_at(F.filter("_parts", lambda x: x["_low"] <= F.col("_at")), -1))
    rows = rows.withColumns({"_part": F.col("_in._part"), "_rest": F.col("_at") - F.col("_in._low"), "_side": F.lit(1)}).drop("_in", "_at", "_parts", "_total", "_lk")
    inside = F.sum("_w").over(Window.partitionBy("_k", "_part").orderBy("_item").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w")
    inside = mine.select(F.col("_k").alias(key), "_part", inside.alias("_rest"), F.lit(0).alias("_side"), "_item")
    both = rows.unionByName(inside, allowMissingColumns=True)
    order = Window.partitionBy(key, "_part").orderBy("_rest", "_side", "_item").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("picked", F.last("_item", ignorenulls=True).over(order)).where("_side = 1").drop("_part", "_rest", "_side", "_item")


def draws(spark: SparkSession, slots: dict[str, int], batches: int, seed: int, epoch: int = 0) -> DataFrame:
    """Key, batch, slot, u for fixed numbers of slots for each key, in order of the keys."""
    plan = spark.createDataFrame([(k, n) for k, n in slots.items() if n > 0], "key string, n int")
    rows = spark.range(batches).withColumnRenamed("id", "batch").join(F.broadcast(plan)).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    return rows.withColumn("u", uniform(F.lit(seed + epoch * 1_000_003), "key", "batch", "slot"))


def batch_plan(spark: SparkSession, budgets: dict[str, int], each: int) -> DataFrame:
    """Step, expert, slot: ``each`` slots for each expert whose budget of steps is not used up."""
    plan = spark.createDataFrame([(i, n) for i, n in enumerate(budgets.values())], "expert int, budget long")
    rows = spark.range(max(budgets.values())).withColumnRenamed("id", "step").join(F.broadcast(plan), F.col("step") < F.col("budget"))
    return rows.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(each - 1)))).drop("budget")


def batches(df: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """Rows of whole batches of ``size`` within each key, with ``batch``; the rest is dropped, as the feature asks."""
    rows = df.withColumns({"_r": F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    return rows.where(F.col("_r") < F.floor(F.col("_n") / size) * size).withColumn("batch", F.floor(F.col("_r") / size)).drop("_r", "_n")


def subset(df: DataFrame, keys: list[str], id_col: str, share: float, seed: int = 0) -> DataFrame:
    """Of each key max(1, floor(n * share)) rows, by hash order."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"_r": F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col)), "_n": F.count(F.lit(1)).over(w)})
    return rows.where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).drop("_r", "_n")


def choice(options: list[Column], *parts) -> Column:
    """One of the options, by hash."""
    return F.element_at(F.array(*options), 1 + F.pmod(F.xxhash64(*parts), F.lit(len(options))).cast("int"))


def in_order(c: Column, order: list[str], other: int = 99) -> Column:
    """O3: place in a fixed list."""
    place = F.array_position(F.array(*map(F.lit, order)), c)
    return F.when(place > 0, place - 1).otherwise(F.lit(other))
