"""Segments of episodes: projection from timelines, frame jobs, weights in row order, clusters of descriptions, guards."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetide.functions import text as X

from .temporal import to_frame

# Frames a second, and the fewest frames of a segment that is not short.
FPS, SHORT = 30.0, 5
# How a description's first words name its cluster and type, in order.
VERBS = (
    (("move to", "move toward", "move away", "move back", "walk to", "walk toward", "back away", "leave", "retreat", "depart"), "move to", "navigation"),
    (("pick up", "grasp", "grab", "lift", "acquire", "take from", "retrieve", "fetch"), "pick up from", "manipulation"),
    (("place in", "place into", "put in", "put into", "insert", "drop into", "release into", "release in"), "place in", "manipulation"),
    (("place on", "place onto", "put on", "put down", "set down", "drop onto", "release onto", "release on"), "place on", "manipulation"),
    (("release", "let go", "drop", "hand off"), "place in", "manipulation"),
    (("open",), "open", "manipulation"),
    (("close", "shut"), "close", "manipulation"),
)
TYPES = ("navigation", "manipulation")


def projected(predictions: DataFrame, timeline: str, keys: list[str], rows: str, scale: float, fps: float = FPS) -> DataFrame:
    """A row for each segment of an array of structs (segment_id, start_time_sec, end_time_sec,
    skill_description) whose description is not blank and whose frames, clamped to the episode's ``rows``, are not none:
    keys, segment_id, sample_id, skill_canonical, skill_description, start_idx, end_idx, n_frames, short."""
    each = predictions.select(*keys, F.col(rows).alias("_n"), F.explode(timeline).alias("_s"))
    each = each.where(F.length(X.strip(F.col("_s.skill_description"))) > 0)
    at = lambda c: to_frame(F.col(f"_s.{c}"), fps, scale, F.col("_n"))
    each = each.withColumns({"start_idx": at("start_time_sec"), "end_idx": at("end_time_sec"), "skill_description": F.col("_s.skill_description"), "segment_id": F.col("_s.segment_id").cast("string")})
    each = each.where("end_idx > start_idx").withColumns({"n_frames": F.col("end_idx") - F.col("start_idx"), "skill_canonical": X.label(F.col("skill_description"))})
    each = each.withColumn("sample_id", F.concat_ws("/", *[F.col(k).cast("string") for k in keys], "segment_id"))
    return each.withColumn("short", F.col("n_frames") < SHORT).drop("_n", "_s")


def duration_checks(episodes: DataFrame, task: str, episode: str, rows: str, seconds: str, fps: float = FPS, slack: int = 2) -> DataFrame:
    """Of each task's first episode, the frames that its duration (by default its rows) leads to, and whether its rows
    agree within ``slack``."""
    first = episodes.groupBy(task).agg(F.min_by(F.struct(episode, rows, seconds), episode).alias("_f")).select(task, "_f.*")
    wanted = F.floor(F.coalesce(F.col(seconds), F.col(rows) / fps) * fps).cast("bigint")
    return first.withColumn("expected", wanted).withColumn("ok", F.abs(F.col(rows) - F.col("expected")) <= slack)


def selected(df: DataFrame, names: dict[str, list] | None = None, matches: dict[str, str] | None = None, flag: str | None = None) -> DataFrame:
    """Rows whose columns are in the given lists, match the given patterns as a whole, and have a true flag,
    which is dropped."""
    for c, values in (names or {}).items():
        df = df.where(F.col(c).isin(values))
    for c, pattern in (matches or {}).items():
        df = df.where(F.col(c).rlike(f"^(?:{pattern})$"))
    return df.where(F.col(flag)).drop(flag) if flag else df


def weights_in_order(samples: DataFrame, weights: DataFrame, key: str, order: str, weight: str) -> DataFrame:
    """``samples`` with their weight, in the order that ``order`` keeps. Missing ones are an error that names their number
    and the first three; it is raised before anything is returned."""
    found = samples.join(weights.select(F.col(key).alias("_k"), weight), F.col(key) == F.col("_k"), "left").drop("_k")
    gone = found.where(F.col(weight).isNull())
    n = gone.count()
    if n:
        raise KeyError(f"{n} samples have no weight, first {[r[0] for r in gone.orderBy(order).select(key).limit(3).collect()]}")
    return found


def parent_types(segments: DataFrame, activities: DataFrame, keys: list[str], parent: str, activity: str, kind: str, order: str, description: str, moves: str = r"(?i)^\s*(navigate|move|walk|travel|go to|approach|turn)\b") -> DataFrame:
    """Segments with ``activity_type``: that of their parent (the last of activities that share an id), by their verb
    where it is neither navigation nor manipulation; a description that says travel is navigation whatever the parent."""
    last = activities.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col(activity).alias("_a")).agg(F.max_by(kind, order).alias("_type"))
    rows = segments.join(last, [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(parent) == F.col("_a")], "left")
    travels = F.coalesce(F.col(description).rlike(moves), F.lit(False))
    known = F.when(F.col("_type").isin(*TYPES), F.col("_type")).otherwise(F.when(travels, TYPES[0]).otherwise(TYPES[1]))
    return rows.withColumn("activity_type", F.when(travels, TYPES[0]).otherwise(known)).drop("_type", "_a", *[f"_{k}" for k in keys])


def frame_jobs(segments: DataFrame, videos: list[str], start: str, end: str, horizon: int, done: DataFrame | None = None) -> DataFrame:
    """Video, frame: every frame from which a window of a segment may start, once for each video; without those
    that are ``done``. Frames are bits of blocks of 64; wanted and done ones meet in one aggregate by block, never in lists, and
    not in a join: a planner takes frames for as few as the rows they are made of, and would broadcast them by the driver."""
    high = F.greatest(F.col(start), F.col(end) - horizon)
    rows = segments.select(F.explode(F.array(*videos)).alias("video"), F.col(start).alias("_low"), high.alias("_high"))
    kind = rows.schema["_high"].dataType
    rows = rows.withColumns({"_low": F.col("_low").cast("bigint"), "_high": F.col("_high").cast("bigint")})
    rows = rows.withColumn("_block", F.explode(F.sequence(F.shiftright("_low", 6), F.shiftright("_high", 6))))
    first = F.greatest(F.col("_low") - F.col("_block") * 64, F.lit(0)).cast("int")
    last = F.least(F.col("_high") - F.col("_block") * 64, F.lit(63)).cast("int")
    run = F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), 63 - last + first), first)
    none = F.lit(0).cast("bigint")
    rows = rows.select("video", "_block", run.alias("_want"), none.alias("_done"))
    if done is not None:
        at = F.col("frame").cast("bigint")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int"))
        there = done.where("video is not null and frame is not null").select("video", F.shiftright(at, 6).alias("_block"), none.alias("_want"), bit.alias("_done"))
        rows = rows.unionByName(there)
    left = rows.groupBy("video", "_block").agg(F.bit_or("_want").bitwiseAND(F.bitwise_not(F.bit_or("_done"))).alias("_bits")).where("_bits != 0")
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("_bits"), i).bitwiseAND(F.lit(1)) == 1)
    return left.select("video", "_block", F.explode(bits).alias("_i")).select("video", (F.col("_block") * 64 + F.col("_i")).cast(kind).alias("frame"))


def length_stats(df: DataFrame, label: str, n: str, windows: int) -> DataFrame:
    """A4: segments, windows, and mean, least and greatest length of each label."""
    chunks = F.greatest(F.lit(1), F.col(n) - windows + 1)
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("segments"), F.sum(chunks).alias("chunks"), F.avg(n).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"))


def value_counts(df: DataFrame, value: str, order: str) -> DataFrame:
    """A5: each value with its count and the place where it occurs first, by which they are listed."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))


def masked_means(df: DataFrame, head: str, loss: str, heads: list[int]) -> DataFrame:
    """Head, n, mean (NaN without rows) and ``filled`` (the mean of all rows without rows), of a fixed list of heads."""
    listed = df.sparkSession.createDataFrame([(h,) for h in heads], "head int")
    each = df.groupBy(F.col(head).alias("_h")).agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("mean"))
    total = df.agg(F.avg(loss).alias("_all"))  # one row
    rows = listed.join(each, F.col("head") == F.col("_h"), "left").join(F.broadcast(total))
    return rows.select("head", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.coalesce("mean", F.lit(float("nan"))).alias("mean"), F.coalesce("mean", "_all").alias("filled"))


def run_summary(df: DataFrame, keys: list[str], outcome: str, name: str) -> DataFrame:
    """For each run how many entries were completed and failed, how many there are, how many names and which."""
    return df.groupBy(*keys).agg(F.count_if(F.col(outcome) == "complete").alias("completed"), F.count_if(F.col(outcome) == "failed").alias("failed"), F.count(F.lit(1)).alias("ticks"), F.count_distinct(name).alias("names"), F.array_join(F.array_sort(F.collect_set(name)), ",").alias("listed"))


def timing_totals(df: DataFrame, keys: list[str], kind: str, seconds: str, sums: dict[str, list[str]]) -> DataFrame:
    """For each run calls, and seconds summed over the kinds of each name in ``sums``."""
    part = lambda kinds: F.sum(F.when(F.col(kind).isin(kinds), F.col(seconds)).otherwise(0.0))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), *[part(kinds).alias(k) for k, kinds in sums.items()])


def cluster_faults(named: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """``fault`` and item: unknown ones, those named twice or more, and those that no cluster names."""
    each = named.groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    known = items.select(F.col(item).alias("_i")).distinct()
    both = each.join(known, F.col(item) == F.col("_i"), "full_outer")
    fault = F.when(F.col("_i").isNull(), "unknown").when(F.col(item).isNull(), "missing").when(F.col("_n") > 1, "duplicate")
    return both.select(fault.alias("fault"), F.coalesce(item, "_i").alias(item)).where("fault is not null")


def _cluster(name: str, description: str, aliases: dict[str, str], drop: list[str]) -> Column:
    """The normal name of a cluster."""
    folded = X.aliased(X.folded(F.col(name)), aliases)
    gone = folded.isin(*drop, "release")
    routed = F.when(gone & F.col(description).rlike(r"(?i)\b(into|inside|in)\b"), "place in").when(gone & F.col(description).rlike(r"(?i)\b(onto|on)\b"), "place on").otherwise(folded)
    return F.when(routed.isin(*drop) | (routed == "") | routed.isNull(), "other").otherwise(routed)


def clusters_merged(named: DataFrame, name: str, kind: str, item: str, description: str, aliases: dict[str, str], drop: list[str]) -> DataFrame:
    """Clusters of one normal name and type as one: name, kind, n, members (ascending). A release or dropped name goes
    by its description, and to ``other`` where that says nothing. Members of a cluster are listed, as the feature asks."""
    rows = named.select(_cluster(name, description, aliases, drop).alias(name), kind, item)
    return rows.groupBy(name, kind).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(item)).alias("members"))


def cluster_members(named: DataFrame, name: str, kind: str, item: str, description: str, aliases: dict[str, str], drop: list[str]) -> DataFrame:
    """The same as a row for each member: name, kind, item, n (of its cluster). Clusters are counted before the join, so
    one that has most of the items is never in one task."""
    rows = named.select(_cluster(name, description, aliases, drop).alias(name), kind, item)
    sizes = rows.groupBy(F.col(name).alias("_n"), F.col(kind).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(sizes, F.col(name).eqNullSafe(F.col("_n")) & F.col(kind).eqNullSafe(F.col("_k"))).drop("_n", "_k")


def fallback_cluster(description: Column, kind: Column) -> tuple[Column, Column]:
    """name and type for an item that no cluster names, by the first words of its description, else by its type."""
    said = X.folded(F.coalesce(description, F.lit("")))
    starts = lambda words: reduce(lambda a, b: a | b, [F.startswith(said, F.lit(w)) for w in words])
    kind = F.coalesce(F.nullif(kind, F.lit("")), F.lit(TYPES[1]))
    name, own = F.when(starts(VERBS[0][0]), VERBS[0][1]), F.when(starts(VERBS[0][0]), VERBS[0][2])
    for words, to, of in VERBS[1:]:
        name, own = name.when(starts(words), to), own.when(starts(words), of)
    return name.otherwise(F.when(kind == TYPES[0], "move to").otherwise("pick up from")), own.otherwise(F.when(kind.isin(*TYPES), kind).otherwise(TYPES[1]))


def slot_faults(batch: DataFrame, step: str, slot: str, expert: str, counts: list[int]) -> DataFrame:
    """Step, expected, bad: slots of a batch that are not those of the class whose run of ``counts`` they are in."""
    runs = [(k, sum(counts[:k]), sum(counts[: k + 1])) for k in range(len(counts))]
    want = reduce(lambda w, r: w.when((F.col(slot) >= r[1]) & (F.col(slot) < r[2]), F.lit(r[0])), runs[1:], F.when((F.col(slot) >= 0) & (F.col(slot) < runs[0][2]), F.lit(0)))
    rows = batch.withColumn("expected", want)
    return rows.where(~F.col("expected").eqNullSafe(F.col(expert))).groupBy(step, "expected").agg(F.count(F.lit(1)).alias("bad"))


def recipe_faults(recipe: DataFrame, name: str, names: list[str], single: list[str], required: list[str], unique: str | None = None) -> DataFrame:
    """``fault``, ``what``: names that are missing or not known, required columns that are null, columns that differ
    between names although they must not, and values of ``unique`` that two names share. No row: the recipe is good."""
    listed = recipe.sparkSession.createDataFrame([(n,) for n in names], "_n string")
    both = recipe.select(name).distinct().join(listed, F.col(name) == F.col("_n"), "full_outer")
    out = both.where(F.col(name).isNull() | F.col("_n").isNull()).select(F.when(F.col("_n").isNull(), "unknown").otherwise("missing").alias("fault"), F.coalesce(name, "_n").alias("what"))
    out = out.unionByName(recipe.select(F.col(name), F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))).alias("what")).select(F.lit("null").alias("fault"), F.concat_ws(".", name, "what").alias("what")))
    spread = recipe.agg(*[F.count_distinct(c).alias(c) for c in single])
    out = out.unionByName(spread.select(F.explode(F.array_compact(F.array(*[F.when(F.col(c) > 1, F.lit(c)) for c in single]))).alias("what")).select(F.lit("differs").alias("fault"), "what"))
    if unique:
        out = out.unionByName(recipe.groupBy(F.col(unique).cast("string").alias("what")).agg(F.count_distinct(name).alias("_n")).where("_n > 1").select(F.lit("shared").alias("fault"), "what"))
    return out


def timeline_faults(predictions: DataFrame, ids: list[str], timeline: str) -> DataFrame:
    """Ids and ``fault`` of predictions without a timeline or with a segment that lacks a time."""
    bad = F.exists(timeline, lambda s: s.isNotNull() & (s["start_time_sec"].isNull() | s["end_time_sec"].isNull()))
    return predictions.select(*ids, F.when(F.col(timeline).isNull(), "no timeline").when(bad, "no times").alias("fault")).where("fault is not null")


def compound(segments: DataFrame, events: DataFrame, keys: list[str], parts: DataFrame) -> DataFrame:
    """Segments (keys, segment_id, start, end) that hold two events or more are replaced by their ``parts`` (keys,
    segment_id, part, start, end), one more than the events; where the numbers differ, the segment stays."""
    from .temporal import range_join

    held = range_join(events.select(*keys, "t"), segments, keys, "t", "start", "end", 0, 3600).groupBy(*keys, "segment_id").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    given = parts.groupBy(*keys, "segment_id").agg(F.count(F.lit(1)).alias("_m"))
    swap = held.join(given, [*keys, "segment_id"]).where("_m = _n + 1").select(*keys, "segment_id")
    kept = segments.join(swap, [*keys, "segment_id"], "left_anti").select(*keys, "segment_id", F.lit(0).alias("part"), "start", "end")
    return kept.unionByName(parts.join(swap, [*keys, "segment_id"], "left_semi").select(*keys, "segment_id", "part", "start", "end"))


def repacked(df: DataFrame, structure: dict) -> DataFrame:
    """A new tree of columns from flat ones: names lead to columns or to trees of their own."""
    def tree(x):
        return F.col(f"`{x}`") if isinstance(x, str) else F.struct(*[tree(v).alias(k) for k, v in x.items()])

    return df.select(*[tree(v).alias(k) for k, v in structure.items()])


def with_default(df: DataFrame, column: str, value) -> DataFrame:
    """A column with a value where it is null or missing."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)) if column in df.columns else F.lit(value))


def applied(df: DataFrame, functions: dict[str, Callable[[Column], Column]], strict: bool = False) -> DataFrame:
    """Each function over its column, where the table has it; with ``strict`` a missing one is an error."""
    gone = [c for c in functions if c not in df.columns]
    if strict and gone:
        raise ValueError(f"no columns {gone}")
    return df.withColumns({c: f(F.col(c)) for c, f in functions.items() if c in df.columns})


def first_present(df: DataFrame, names: list[str]) -> Column:
    """The first of several columns that a row has; names that the table lacks are passed over, and where no name fits
    as a whole, the first column that holds one is taken."""
    have = [c for c in names if c in df.columns] or [c for n in names for c in df.columns if n in c][:1]
    if not have:
        raise KeyError(f"none of {names}")
    return F.coalesce(*[F.col(f"`{c}`") for c in have])


def chained(*transforms: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Transforms in order as one."""
    return lambda df: reduce(lambda d, t: d.transform(t), transforms, df)


def grouped(inputs: list, outputs: list, more_inputs: list, more_outputs: list) -> tuple[list, list]:
    """Later inputs are appended; later outputs come first, as they undo the last input first."""
    return [*inputs, *more_inputs], [*more_outputs, *outputs]


def with_prompt(df: DataFrame, resolve: Callable[..., Column], *columns: str) -> DataFrame:
    """``prompt`` by a function of columns that the caller gives."""
    return df.withColumn("prompt", resolve(*[F.col(c) for c in columns]))


def in_window(events: DataFrame, windows: DataFrame, keys: list[str], t: str, order: str, width) -> DataFrame:
    """P25: events within the closed range of each window (keys, window_id, start, end); of events at one time with a true
    ``both``, a window keeps the first by ``order``."""
    from .temporal import range_join

    found = range_join(events, windows, keys, t, "start", "end", 0, width)
    w = Window.partitionBy(*keys, "window_id", t, "both").orderBy(order)
    return found.withColumn("_r", F.row_number().over(w)).where(~F.col("both") | (F.col("_r") == 1)).drop("_r")
