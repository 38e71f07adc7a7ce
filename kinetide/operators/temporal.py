"""Operators over time-ordered rows: islands, intervals, edges, as-of and range joins, chunks and windows.

All take and return DataFrames and are keyed by ``keys`` (an episode, a task, a side), so work is spread by key; order is
always an explicit column. IDs of the operator inventory are given with each.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetide.operators.quantiles import order_statistics, percentiles
from kinetide.shared import stored

#: Parts of a key's events between two cuts that one task walks together (see coincidences).
CUTS = 1000


def _by(keys: list[str], *order) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def islands(df: DataFrame, keys: list[str], order: str, flag: str | Column, least: int = 1) -> DataFrame:
    """Maximal runs of rows with a true ``flag``, of ``least`` rows or more: keys, first, last (of ``order``), n.

    Null flags are false. Rows of a key must have distinct ``order``; ties are put in any order."""
    flag = F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False))
    rows = df.select(*keys, F.col(order).alias("_o"), flag.alias("_f"))
    rows = rows.withColumn("_all", F.row_number().over(_by(keys, "_o")))
    rows = rows.where("_f").withColumn("_run", F.col("_all") - F.row_number().over(_by(keys, "_o")))
    runs = rows.groupBy(*keys, "_run").agg(F.min("_o").alias("first"), F.max("_o").alias("last"), F.count(F.lit(1)).alias("n"))
    return runs.where(F.col("n") >= least).drop("_run")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap) -> DataFrame:
    """Intervals of a key that are ``gap`` or less apart become one: keys, start, end, parts. Contained and
    overlapping ones too, as the furthest end so far counts."""
    w = _by(keys, start, end)
    rows = df.withColumn("_far", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_new", F.when(F.col("_far").isNull() | (F.col(start) - F.col("_far") > gap), 1).otherwise(0))
    rows = rows.withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_group").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("parts")).drop("_group")


def numbered(df: DataFrame, keys: list[str], order: list[str], prefix: str) -> DataFrame:
    """``id`` = prefix and the place within the key, six digits."""
    return df.withColumn("id", F.format_string(f"{prefix}-%06d", F.row_number().over(_by(keys, *order))))


def edges(df: DataFrame, keys: list[str], order: str, signal: Column) -> DataFrame:
    """Rows where ``signal`` (boolean) differs from the row before, with direction up or down."""
    rows = df.withColumn("_s", signal).withColumn("_p", F.lag("_s").over(_by(keys, order)))
    return rows.where("_s != _p").withColumn("direction", F.when(F.col("_s"), "up").otherwise("down")).drop("_s", "_p")


def differences(df: DataFrame, keys: list[str], order: str, value: str, out: str = "speed") -> DataFrame:
    """Length of the change of a number or an array since the row before; 0 at the first."""
    before = F.lag(value).over(_by(keys, order))
    if df.schema[value].dataType.typeName() == "array":
        change = F.sqrt(F.aggregate(F.zip_with(value, "_b", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    else:
        change = F.abs(F.col(value) - F.col("_b"))
    return df.withColumn("_b", before).withColumn(out, F.when(F.col("_b").isNull(), F.lit(0.0)).otherwise(change)).drop("_b")


def adaptive_threshold(df: DataFrame, keys: list[str], value: str, q: float = 0.3, floor: float = 1e-4) -> DataFrame:
    """For each key, the linear ``q`` percentile of the values above zero, ``floor`` at least. Exact, by ranges that are
    refined, so no task holds a key's values."""
    names = df.select(*keys).distinct()
    found = percentiles(df.where(F.col(value) > 0), keys, value, {"_p": q}).withColumnsRenamed({k: f"_s_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys]
    return names.join(found, on, "left").select(*keys, F.greatest(F.coalesce("_p", F.lit(floor)), F.lit(floor)).alias("threshold"))


def active_intervals(df: DataFrame, keys: list[str], order: str, value: str, least, gap, q: float = 0.3) -> DataFrame:
    """Runs of change above the key's adaptive threshold, ``least`` long before merging, merged over ``gap``."""
    moved = differences(df, keys, order, value)
    limits = adaptive_threshold(moved, keys, "speed", q)
    runs = islands(moved.join(limits, keys), keys, order, F.col("speed") > F.col("threshold"))
    return merge_intervals(runs.where(F.col("last") - F.col("first") >= least), keys, "first", "last", gap)


def index_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """A3: for each share the value at place floor(n * share) of the sorted values (0.5: the upper median).

    Places are found by ranges that are refined, so a key of any size is counted by all tasks and never sorted in one."""
    return order_statistics(df, keys, value, shares)


def range_join(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, start: str, end: str, guard, width, how: str = "inner") -> DataFrame:
    """``points`` with ``intervals`` of the same key where start - guard <= t <= end + guard; ``how`` may be
    inner, left_semi or left_anti. Both sides are cut into buckets of ``width``, so this is an equi-join of key and bucket
    whatever the number of points of a key; a point has one bucket, so no pair is found twice."""
    other = intervals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in intervals.columns if c not in keys])
    low, high = F.floor((F.col(start) - guard) / width), F.floor((F.col(end) + guard) / width)
    other = other.withColumn("_bucket", F.explode(F.sequence(low, high)))
    mine = points.withColumn("_slot", F.floor(F.col(t) / width))
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    found = mine.join(other, [*on, F.col("_slot") == F.col("_bucket"), F.col(t) >= F.col(start) - guard, F.col(t) <= F.col(end) + guard], how)
    return found.drop("_slot", "_bucket", *[f"_k{i}" for i in range(len(keys))])


def asof_previous(left: DataFrame, right: DataFrame, keys: list[str], t: str, value: str, strict: bool = False) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` of the same key at or before t (before it if ``strict``), by one
    sort of both sides together; null if there is none."""
    a = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_side": F.lit(0 if strict else 1)})
    b = right.select(*keys, t, F.col(value).alias("_v"), F.lit(1 if strict else 0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = _by(keys, t, "_side").rowsBetween(Window.unboundedPreceding, 0)
    own = 0 if strict else 1
    return both.withColumn("previous", F.last("_v", ignorenulls=True).over(w)).where(F.col("_side") == own).drop("_v", "_side")


def asof_next(left: DataFrame, right: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """``left`` with the first ``value`` of ``right`` of the same key after t; null if there is none."""
    a = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_side": F.lit(1)})
    b = right.select(*keys, t, F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = _by(keys, t, "_side").rowsBetween(1, Window.unboundedFollowing)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("following", F.first("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").drop("_v", "_side")


def paired(df: DataFrame, keys: list[str], t: str, is_open: Column, is_close: Column, gap) -> DataFrame:
    """Openings whose next row of the key is a closing at most ``gap`` later, with ``closed``."""
    rows = df.withColumns({"_open": is_open, "_close": is_close})
    w = _by(keys, t)
    rows = rows.withColumns({"_next": F.lead("_close").over(w), "closed": F.lead(t).over(w)})
    return rows.where(F.col("_open") & F.col("_next") & (F.col("closed") - F.col(t) <= gap)).drop("_open", "_close", "_next")


def sustained(df: DataFrame, keys: list[str], t: str, is_open: Column, is_close: Column, gap=None) -> DataFrame:
    """Openings with the nearest later closing of the key (several may share one): ``closed``, null if there is none.
    With ``gap``, openings and closings that are paired() within it are left out first."""
    if gap is not None:
        w = _by(keys, t)
        rows = df.withColumns({"_open": is_open, "_close": is_close})
        pair = lambda a, b: F.col("_open" if a else "_close") & b
        rows = rows.withColumns({"_to": pair(True, F.lead("_close").over(w) & (F.lead(t).over(w) - F.col(t) <= gap)), "_from": pair(False, F.lag("_open").over(w) & (F.col(t) - F.lag(t).over(w) <= gap))})
        df = rows.where(~F.coalesce("_to", F.lit(False)) & ~F.coalesce("_from", F.lit(False))).drop("_open", "_close", "_to", "_from")
    w = _by(keys, t).rowsBetween(1, Window.unboundedFollowing)
    rows = df.withColumns({"_open": is_open, "_at": F.when(is_close, F.col(t))})
    return rows.withColumn("closed", F.first("_at", ignorenulls=True).over(w)).where("_open").drop("_open", "_at")


def forward_fill(df: DataFrame, keys: list[str], order: str, value: Column, out: str) -> DataFrame:
    """The last non-null value so far."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(_by(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def first_stop(df: DataFrame, keys: list[str], order: str, still: Column, n: int) -> DataFrame:
    """For each key the first row that has moved before and is still for ``n`` rows from it on (the last run may be cut
    short by the end)."""
    w = _by(keys, order)
    rows = df.withColumn("_still", still)
    rows = rows.withColumns({"_run": F.min("_still").over(w.rowsBetween(0, n - 1)), "_moved": F.max(~F.col("_still")).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    return rows.where("_run and _moved").groupBy(*keys).agg(F.min(order).alias("stop"))


def stop_starts(frames: DataFrame, keys: list[str], order: str, still: Column, n: int) -> DataFrame:
    """Keys, ``stop``: frames that are still for ``n`` frames from them on (fewer at the key's end) after one that moves."""
    rows = frames.select(*keys, F.col(order).alias("stop"), still.alias("_s"))
    w = _by(keys, "stop")
    rows = rows.withColumns({"_run": F.min("_s").over(w.rowsBetween(0, n - 1)), "_before": F.lag("_s").over(w)})
    return rows.where("_run and not _before").select(*keys, "stop")


def first_stop_in(segments: DataFrame, frames: DataFrame, keys: list[str], order: str, start: str, end: str, still: Column, n: int, window: int) -> DataFrame:
    """``segments`` with ``stop``, the first frame from ``start`` on that comes after a moving frame of the segment and
    is still for ``n`` frames; at the latest ``n`` before max(end + window, start + n) or the key's end; else null.

    Such a frame always starts a run of still ones, so it is the next start of a run after ``start``: one sort of both."""
    sizes = frames.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(order).alias("_last"))
    rows = segments.join(sizes, [F.col(k) == F.col(f"_{k}") for k in keys]).drop(*[f"_{k}" for k in keys])
    rows = rows.withColumn("_from", F.greatest(F.lit(0), F.least(F.col(start), F.col("_last"))))
    stops = stop_starts(frames, keys, order, still, n).withColumn("_from", F.col("stop"))
    rows = asof_next(rows, stops, keys, "_from", "stop")
    limit = F.least(F.col("_last") + 1, F.greatest(F.col(end) + window, F.col("_from") + n)) - n
    found = F.when(F.col("following") <= F.greatest(F.col("_from"), limit), F.col("following"))
    return rows.withColumn("stop", found).drop("_last", "_from", "following")


def silent_intervals(active: DataFrame, grips: DataFrame, keys: list[str], least, guard, merge, back, follow, width) -> DataFrame:
    """Keys, side, start, end of arm activity without a grip that follows a release. ``active``: keys, side, start, end;
    ``grips``: keys, side, t, released (boolean). Times are numbers of one unit.

    Spans of ``least`` or longer without a grip of any side within ``guard`` are merged with the next of their side over
    ``merge`` at most, if no grip lies between; end where the other side grips or starts to move; must start ``follow`` at
    most after the last release of their side, and start at it where it is ``back`` at most away."""
    long = active.where(F.col("end") - F.col("start") >= least).select(*keys, "side", "start", "end")
    points = grips.select(*keys, F.col("t").alias("_t"))
    # A span with a grip inside: the grips are the points, so spans that have one are found by their own row.
    spans = long.withColumn("_id", F.struct("side", "start", "end"))
    held = range_join(points, spans.select(*keys, "_id", "start", "end"), keys, "_t", "start", "end", guard, width).select(*keys, "_id").distinct()
    free = spans.join(held.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_id").alias("_hid")), [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_id") == F.col("_hid")], "left_anti").drop("_id")
    free = asof_previous(free.withColumn("_t", F.col("start")), points.withColumn("_grip", F.col("_t")), keys, "_t", "_grip").withColumnRenamed("previous", "_grip").drop("_t")
    own = _by([*keys, "side"], "start", "end")
    gap = F.col("start") - F.lag("end").over(own)
    joined = (gap <= merge) & (F.col("_grip").isNull() | (F.col("_grip") < F.lag("end").over(own)))
    free = free.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    free = free.withColumn("_group", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = free.groupBy(*keys, "side", "_group").agg(F.min("start").alias("start"), F.max_by("end", "start").alias("end")).drop("_group")
    begun = grips.select(*keys, "side", "t").unionByName(active.select(*keys, "side", F.col("start").alias("t")))
    sides = begun.select(*keys, F.col("side").alias("_other")).unionByName(merged.select(*keys, F.col("side").alias("_other"))).distinct()
    other = begun.join(sides.select(*[F.col(k).alias(f"_{k}") for k in keys], "_other"), [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("side") != F.col("_other")])
    other = other.select(*keys, F.col("_other").alias("side"), F.col("t").alias("_t"), F.col("t").alias("_next"))
    merged = asof_next(merged.withColumn("_t", F.col("start")), other, [*keys, "side"], "_t", "_next")
    merged = merged.withColumn("end", F.when(F.col("following") < F.col("end"), F.col("following")).otherwise(F.col("end"))).drop("following")
    freed = grips.where("released").select(*keys, "side", F.col("t").alias("_t"), F.col("t").alias("_freed"))
    merged = asof_previous(merged, freed, [*keys, "side"], "_t", "_freed").withColumnRenamed("previous", "_freed").drop("_t")
    merged = merged.where(F.col("start") - F.col("_freed") <= follow)
    merged = merged.withColumn("start", F.when(F.col("start") - F.col("_freed") <= back, F.col("_freed")).otherwise(F.col("start"))).drop("_freed")
    return merged.where(F.col("end") - F.col("start") >= least)


def action_chunks(segments: DataFrame, start: str, end: str, horizon: int, clamp: str | None = None) -> DataFrame:
    """Every start of a segment [start, end) with its ``horizon`` frames, the last one of the segment (or
    ``clamp`` - 1) repeated: ``anchor``, ``k``, ``frame``, ``padded``."""
    stop = F.col(clamp or end)
    rows = segments.withColumn("anchor", F.explode(F.sequence(F.col(start), F.col(end) - 1))).where(F.col(end) > F.col(start))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(horizon - 1).cast("bigint"))))
    at = F.col("anchor") + F.col("k")
    return rows.withColumns({"frame": F.least(at, stop - 1), "padded": at > stop - 1})


def windows(segments: DataFrame, start: str, end: str, horizon: int) -> DataFrame:
    """A row for each start of a whole window of ``horizon`` frames; one for a shorter segment."""
    return segments.where(F.col(end) > F.col(start)).withColumn("window_start", F.explode(F.sequence(F.col(start), F.greatest(F.col(start), F.col(end) - horizon))))


def window_count(n: Column, horizon: int) -> Column:
    """W6, A18."""
    return F.greatest(F.lit(1), n - horizon + 1)


def sampled_window(segments: DataFrame, id_col: str, start: str, end: str, horizon: int, seed: int) -> DataFrame:
    """One window start of each segment, uniform by hash of seed and id, so a rerun draws the same."""
    n = F.greatest(F.lit(0), F.col(end) - F.col(start) - horizon) + 1
    return segments.withColumn("window_start", F.col(start) + F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), n))


def to_frame(seconds: Column, fps: float, scale: float = 1.0, n: Column | None = None) -> Column:
    """Nearest frame (halves to even), within [0, n]."""
    frame = F.greatest(F.lit(0).cast("bigint"), F.rint(seconds * scale * fps).cast("bigint"))
    return frame if n is None else F.least(frame, n)


def evenly(n: Column, k: int) -> Column:
    """``k`` of ``n`` places, both ends included."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (n - 1) / F.lit(max(1, k - 1))).cast("bigint"))


def cumulative(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Running sum of differences."""
    return df.withColumn(out, F.sum(value).over(_by(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def ordinals(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """W19: '(i/n)' where a key occurs twice or more, else null."""
    rows = df.withColumns({"_i": F.row_number().over(_by(keys, order)), "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    return rows.withColumn("ordinal", F.when(F.col("_n") >= 2, F.format_string("(%d/%d)", "_i", "_n"))).drop("_i", "_n")


def gaps(df: DataFrame, keys: list[str], order: str, start: str, end: str, tolerance) -> DataFrame:
    """Rows whose successor starts more than ``tolerance`` after their end, with ``gap``."""
    return df.withColumn("gap", F.lead(start).over(_by(keys, order)) - F.col(end)).where(F.col("gap") > tolerance)


def coincidences(df: DataFrame, keys: list[str], t: str, direction: str, side: str, span: float) -> DataFrame:
    """Runs of same-direction events within ``span`` of the run's first, on two sides or more: keys, t, direction, n.

    A run depends on where the last one ended, but no run crosses a change of direction or a gap above ``span``: a key's
    events are cut there first, by a window that spills, and only what lies between two cuts has to be walked by one task;
    CUTS such parts are walked together."""
    w = _by(keys, t, direction, side)
    cut = (F.lag(direction).over(w) != F.col(direction)) | (F.col(t) - F.lag(t).over(w) > span)
    rows = df.select(*keys, t, direction, side).withColumn("_cut", F.when(F.coalesce(cut, F.lit(False)), 1).otherwise(0))
    rows = rows.withColumn("_part", F.floor(F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)) / CUTS)).drop("_cut")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([t, direction, side], kind="stable").reset_index(drop=True)
        out, i = [], 0
        at, way, who = rows[t].tolist(), rows[direction].tolist(), rows[side].tolist()
        while i < len(rows):
            j = i
            while j < len(rows) and at[j] - at[i] <= span and way[j] == way[i]:
                j += 1
            if len(set(who[i:j])) >= 2:
                out.append((*rows.loc[i, keys], at[i], way[i], j - i))
                i = j
            else:
                i += 1
        return pd.DataFrame(out, columns=[*keys, t, direction, "n"])

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return rows.groupBy(*keys, "_part").applyInPandas(walk, ", ".join(f"`{c}` {types[c]}" for c in [*keys, t, direction]) + ", n long")


def snapped(segments: DataFrame, stops: DataFrame, keys: list[str], order: str, start: str, end: str, least: float = 1.0, most: float = 4.0, moves: str | None = None) -> DataFrame:
    """Keys, order, start, end, moved. The end of each segment that ``moves`` (a boolean column; all without it) goes to
    the first stop (column ``stop``, see stop_starts) after its start if that lies before its end, ``least`` after the start
    and ``most`` before the end at most; the next segment of the key, whatever it is, then starts there.

    A segment's start depends on the one before it alone, and can only be its own or a stop in the last ``most`` of that one.
    So each segment is a function of few starts, a row for each. Where all starts of a segment lead to the same next one,
    that is sure at once; only between such places chains have to be followed, and functions are composed pairwise: each round
    doubles the reach, so there are as many as the logarithm of the longest chain."""
    w = _by(keys, order)
    flag = F.coalesce(F.col(moves), F.lit(False)) if moves else F.lit(True)
    segs = segments.select(*keys, order, F.col(start).alias("_s"), F.col(end).alias("_e"), flag.alias("_m"))
    segs = segs.withColumns({"_i": F.row_number().over(w), "_next": F.lead("_s").over(w), "_pe": F.lag("_e").over(w), "_pm": F.lag("_m").over(w)})
    segs = stored(segs.withColumn("_low", F.col("_pe") - most), "snap-segments")
    halts = stops.select(*keys, F.col("stop").alias("_at")).distinct()
    tails = range_join(halts, segs.where("_pm and _pe is not null"), keys, "_at", "_low", "_pe", 0, max(most, 1e-9)).where("_at < _pe and _at != _s")
    nodes = segs.withColumn("_t", F.col("_s")).unionByName(tails.withColumnRenamed("_at", "_t"))
    nodes = asof_next(nodes, halts.withColumn("_t", F.col("_at")), keys, "_t", "_at")
    ok = F.col("_m") & (F.col("following") < F.col("_e")) & (F.col("following") - F.col("_t") >= least) & (F.col("_e") - F.col("following") <= most)
    nodes = nodes.withColumn("_snap", F.when(ok, F.col("following"))).select(*keys, order, "_i", "_t", "_s", "_e", "_snap", F.when(F.col("_next").isNotNull(), F.coalesce("_snap", "_next")).alias("_to"))
    nodes = stored(nodes, "snap-nodes")
    here = lambda df, names: df.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], *names)
    same = [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)]
    drop = [f"_k{n}" for n in range(len(keys))]
    sure = nodes.where("_to is not null").groupBy(*keys, "_i").agg(F.min("_to").alias("_t"), F.max("_to").alias("_most")).where("_t = _most")
    reached = sure.select(*keys, (F.col("_i") + 1).alias("_i"), "_t").unionByName(nodes.where("_i = 1").select(*keys, "_i", "_t"))
    reached = stored(reached, "snap-reached")
    steps = nodes.where("_to is not null").select(*keys, "_i", "_t", (F.col("_i") + 1).alias("_j"), "_to")
    steps = stored(steps.join(here(reached, [F.col("_i").alias("_known")]), [*same, F.col("_j") == F.col("_known")], "left_anti"), "snap-steps")
    while not steps.isEmpty():
        ahead = here(steps, [F.col("_i").alias("_bi"), F.col("_t").alias("_bt"), F.col("_j").alias("_bj"), F.col("_to").alias("_bto")])
        found = reached.join(ahead, [*same, F.col("_i") == F.col("_bi"), F.col("_t") == F.col("_bt")]).select(*keys, F.col("_bj").alias("_i"), F.col("_bto").alias("_t"))
        reached = stored(reached.unionByName(found), "snap-reached")
        steps = stored(steps.join(ahead, [*same, F.col("_j") == F.col("_bi"), F.col("_to") == F.col("_bt")]).select(*keys, "_i", "_t", F.col("_bj").alias("_j"), F.col("_bto").alias("_to")), "snap-steps")
    chosen = here(reached, [F.col("_i").alias("_ri"), F.col("_t").alias("_rt")])
    made = nodes.join(chosen, [*same, F.col("_i") == F.col("_ri"), F.col("_t") == F.col("_rt")]).drop(*drop)
    return made.select(*keys, order, F.col("_t").alias(start), F.coalesce("_snap", "_e").alias(end), F.col("_snap").isNotNull().alias("moved"))


def parents_snapped(activities: DataFrame, moved: DataFrame, keys: list[str], activity: str, order: str, start: str, end: str, segment_order: str) -> DataFrame:
    """``activities`` whose end goes to that of their last segment that was moved (``moved``: keys, activity,
    segment_order, end), and whose start goes to the end of the activity before them where that one's went."""
    last = moved.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col(activity).alias("_a")).agg(F.max_by(end, segment_order).alias("_end"))
    rows = activities.join(last, [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(activity) == F.col("_a")], "left").drop(*[f"_{k}" for k in keys], "_a")
    before = F.lag("_end").over(_by(keys, order))
    return rows.withColumns({start: F.coalesce(before, F.col(start)), end: F.coalesce("_end", F.col(end))}).drop("_end")
