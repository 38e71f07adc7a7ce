"""Stateful operators over streams of ticks, each with the same rule in batch.

Rows arrive by key (a run or a side) and are put in order by ``seq`` within a trigger; rows that arrive after later ones of
their key were handled are passed over. State is a few numbers a key, and keys are spread by hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinetide.operators.temporal import islands

# Fixed values in mm: confirmations of contact, the contact band, how far jaws must have been open and have closed since,
# and the step between gaps that breaks a run.
CONFIRMATIONS, BAND, LEAST_OPEN, LEAST_CLOSED, STEP = 5, (5.0, 62.0), 70.0, 8.0, 2.5
# Fixed values of the release: jaws held at most this wide at the start, as wide as that after, and so much wider.
PLACE_HELD, PLACE_WIDE, PLACE_RISE = 62.0, 45.0, 10.0
# Fixed values of the release guard: the band and spread of a hold's three gaps, chunks before it looks, rise and step.
HOLD_BAND, HOLD_SPREAD, GUARD_FROM, GUARD_RISE, GUARD_STEP = (5.0, 68.0), 2.5, 12, 5.0, 4.0
# What a judge recommends when the plan no longer fits; retries where a subtask names none.
DEVIATED = ("replan_plan_deviated", "replan_keep_pose")
RETRIES = 2


def contact(state: tuple, gap: float) -> tuple[tuple, str | None]:
    """T4: state (peak gap, gap before, count, done) and an event: ``hold`` once after CONFIRMATIONS steady gaps in the band
    below the peak. A jump above STEP starts the count again with this gap as its first."""
    peak, before, count, done = state
    peak = max(peak, gap)
    touching = peak >= LEAST_OPEN and BAND[0] <= gap <= BAND[1] and peak - gap >= LEAST_CLOSED
    steady = before is None or abs(gap - before) <= STEP
    count = 0 if not touching else count + 1 if steady else 1
    fires = count >= CONFIRMATIONS and not done
    return (peak, gap, count, done or fires), "hold" if fires else None


def outcome(state: tuple, verdict: str, followup: str | None, retries: int = RETRIES) -> tuple[tuple, str]:
    """State (attempts, failures in a row) of one subtask and what becomes of the attempt: complete, retry or failed."""
    attempts, failures = state
    if verdict == "complete" and followup != "retry":
        return (0, 0), "complete"
    attempts += 1
    if verdict == "error" or followup in DEVIATED or attempts > retries:
        return (0, failures + 1), "failed"
    return (attempts, failures), "retry"


def _walk(rows: pd.DataFrame, kind: str, state: tuple) -> tuple[pd.DataFrame, tuple]:
    rows = rows.sort_values("seq", kind="stable")
    out = []
    for r in rows.itertuples(index=False):
        if kind == "contact":
            state, event = contact(state, r.gap)
        else:
            limit = getattr(r, "retries", None)
            state, event = outcome(state, r.verdict, r.followup, RETRIES if limit is None or pd.isna(limit) else int(limit))
        if event:
            out.append((r.key, r.seq, event))
    return pd.DataFrame(out, columns=["key", "seq", "event"]), state


START = {"contact": (float("-inf"), None, 0, False), "outcome": (0, 0)}
EVENTS = "key string, seq long, event string"
STATES = {"contact": "last long, peak double, before double, count int, done boolean", "outcome": "last long, attempts int, failures int"}


def in_batch(df: DataFrame, kind: str) -> DataFrame:
    """Events (key, seq, event) of a finished log: columns key, seq and gap, or verdict, followup and perhaps retries (of the
    subtask). The key of outcomes names run and subtask, as attempts are counted by subtask. Keys come in order, and a key's
    rows by seq, batch by batch: a task holds a batch and one state, however long a run is. Null keys are left out."""
    rows = df.where("key is not null").repartition("key").sortWithinPartitions("key", "seq")

    def walked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state = None, START[kind]
        for frame in frames:
            for key, part in frame.groupby("key", sort=False):
                if key != own:
                    own, state = key, START[kind]
                out, state = _walk(part, kind, state)
                yield out

    return rows.mapInPandas(walked, EVENTS)


def in_stream(df: DataFrame, kind: str) -> DataFrame:
    """The same over a stream; output mode append."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, *own = state.get if state.exists else (-1, *START[kind])
        rows = pd.concat(list(batches))
        rows = rows[rows.seq > last]
        if len(rows):
            out, own = _walk(rows, kind, tuple(own))
            state.update((int(rows.seq.max()), *own))
            yield out

    return df.groupBy("key").applyInPandasWithState(step, EVENTS, STATES[kind], "append", GroupStateTimeout.NoTimeout)


def _run(key: list[str], order: str) -> Window:
    return Window.partitionBy(*key).orderBy(order)


def contacts(df: DataFrame, key: list[str], order: str, gap: str) -> DataFrame:
    """T4 over a finished log of any length, by windows: key, ``held`` (order of the gap that confirms contact). A key's
    gaps are never gathered; its first is the gap at the start."""
    rows = df.select(*key, F.col(order).alias("_o"), F.col(gap).alias("_g"))
    w = _run(key, "_o")
    peak = F.max("_g").over(w.rowsBetween(Window.unboundedPreceding, 0))
    touching = (peak >= LEAST_OPEN) & F.col("_g").between(*BAND) & (peak - F.col("_g") >= LEAST_CLOSED)
    rows = rows.withColumns({"_t": touching, "_jump": F.abs(F.col("_g") - F.lag("_g").over(w)) > STEP})
    starts = F.when(~F.col("_t") | F.coalesce("_jump", F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("_part", F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_t")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key, "_part").orderBy("_o")))
    return rows.where(F.col("_n") == CONFIRMATIONS).groupBy(*key).agg(F.min("_o").alias("held"))


def outcomes(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """T2 over a finished log of any length, by windows: ``df`` with ``event``. Columns verdict, followup and retries (null:
    RETRIES), which must be the same for all rows of a key.

    Attempts are counted since the last one that ended the subtask. Some end it by what they are (complete, an error, a plan
    that no longer fits); between two of these every (retries + 1)-th fails, so its place there says what it is."""
    limit = F.coalesce(F.col("retries"), F.lit(RETRIES)) if "retries" in df.columns else F.lit(RETRIES)
    done = F.coalesce((F.col("verdict") == "complete") & (F.coalesce("followup", F.lit("")) != "retry"), F.lit(False))
    fatal = F.coalesce((F.col("verdict") == "error") | F.col("followup").isin(*DEVIATED), F.lit(False))
    rows = df.withColumns({"_done": done, "_fatal": fatal & ~done})
    ends = F.sum(F.when(F.col("_done") | F.col("_fatal"), 1).otherwise(0)).over(_run(key, order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_part", F.coalesce(ends, F.lit(0)))
    rows = rows.withColumn("_n", F.row_number().over(_run([*key, "_part"], order)))
    event = F.when(F.col("_done"), "complete").when(F.col("_fatal") | (F.pmod("_n", limit + 1) == 0), "failed").otherwise("retry")
    return rows.withColumn("event", event).drop("_done", "_fatal", "_part", "_n")


def releases(df: DataFrame, key: list[str], order: str, gap: str) -> DataFrame:
    """T5 over a finished log: key, ``released``: the order of the fifth gap in a row that is wide, and wider than the key's
    first, which must have held something."""
    w = _run(key, order)
    rows = df.select(*key, F.col(order).alias("_o"), F.col(gap).alias("_g"), F.first(gap).over(w).alias("_start"))
    wide = (F.col("_start") <= PLACE_HELD) & (F.col("_g") >= PLACE_WIDE) & (F.col("_g") - F.col("_start") >= PLACE_RISE)
    runs = islands(rows, key, "_o", wide, least=CONFIRMATIONS).groupBy(*key).agg(F.min("first").alias("_first"))
    later = rows.join(runs, key).where(F.col("_o") >= F.col("_first"))
    ranked = later.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_o")))
    return ranked.where(F.col("_n") == CONFIRMATIONS).select(*key, F.col("_o").alias("released"))


def guarded(df: DataFrame, key: list[str], order: str, gap: str) -> DataFrame:
    """T6 over a finished log: key, ``opened``: the first chunk from GUARD_FROM on whose gap has risen above the hold or
    stepped up. The hold is the mean of the first three gaps in a row that are in the band and close together."""
    w = _run(key, order)
    last = w.rowsBetween(-2, 0)
    rows = df.select(*key, F.col(order).alias("_o"), F.col(gap).alias("_g"), F.lag(gap).over(w).alias("_p"), F.row_number().over(w).alias("_n"), F.min(gap).over(last).alias("_lo"), F.max(gap).over(last).alias("_hi"), F.avg(gap).over(last).alias("_mean"))
    steady = (F.col("_n") >= 3) & (F.col("_lo") >= HOLD_BAND[0]) & (F.col("_hi") <= HOLD_BAND[1]) & (F.col("_hi") - F.col("_lo") <= HOLD_SPREAD)
    hold = F.first(F.when(steady, F.col("_mean")), ignorenulls=True).over(_run(key, "_o").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_hold", hold).where((F.col("_n") >= GUARD_FROM) & F.col("_hold").isNotNull())
    fires = (F.col("_g") - F.col("_hold") >= GUARD_RISE) | (F.col("_g") - F.col("_p") >= GUARD_STEP)
    return rows.where(fires).groupBy(*key).agg(F.min("_o").alias("opened"))


def stalls(df: DataFrame, key: list[str], order: str, place: str, command: str, rows: int = 60, least_command: float = 0.05, ratio: float = 0.12) -> DataFrame:
    """For each key one phase, from the first ``rows`` rows: ``low_command`` where the mean length of the command arrays
    is ``least_command`` at most, ``nav_pending`` where the path of the place arrays over it is below ``ratio``, else
    ``clear``. Keys with fewer rows are ``waiting``; with numbers that are not finite, ``invalid_robot_data``."""
    w = _run(key, order)
    length = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    some = df.select(*key, F.row_number().over(w).alias("_n"), F.col(place).alias("_x"), F.lag(place).over(w).alias("_b"), F.col(command).alias("_c")).where(F.col("_n") <= rows)
    step = F.when(F.col("_b").isNotNull(), length(F.zip_with("_x", "_b", lambda a, b: a - b))).otherwise(0.0)
    good = F.forall(F.concat("_x", "_c"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    each = some.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"), F.sum(step).alias("path"), F.avg(length("_c")).alias("command"), F.bool_and(good).alias("_good"))
    phase = F.when(F.col("_rows") < rows, "waiting").when(~F.col("_good"), "invalid_robot_data").when(F.col("command") <= least_command, "low_command")
    return each.select(*key, "path", "command", phase.when(F.col("path") / F.col("command") < ratio, "nav_pending").otherwise("clear").alias("phase"))


def intents(df: DataFrame, key: list[str], order: str, phase: str, outcome_: str, prompt: str, stalled: str, moved: str) -> DataFrame:
    """Rows of a run's history where the recovery speaks: ``intent`` navigate after the first failure of ``stalled`` in a
    run that is nav_pending, then spout at the first row of ``moved`` after it."""
    w = _run(key, order)
    mine = (F.col(phase) == "nav_pending") & (F.col(outcome_) == "failed") & (F.col(prompt) == stalled)
    rows = df.withColumn("_at", F.min(F.when(mine, F.col(order))).over(Window.partitionBy(*key)))
    rows = rows.withColumn("_back", F.min(F.when((F.col(order) > F.col("_at")) & (F.col(prompt) == moved), F.col(order))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    said = F.when(F.col(order) == F.col("_at"), "navigate").when(F.col(order) == F.col("_back"), "spout")
    return rows.withColumn("intent", said).where("intent is not null").drop("_at", "_back")


def every_third(df: DataFrame, key: list[str], order: str, counts: Column) -> DataFrame:
    """Of the rows of a key that count, every third."""
    rows = df.where(counts).withColumn("_n", F.row_number().over(_run(key, order)))
    return rows.where(F.pmod("_n", F.lit(3)) == 0).drop("_n")


def failures_in_row(df: DataFrame, key: list[str], order: str, failed: Column, abort: int = 3) -> DataFrame:
    """Rows with ``failures``, how many rows of the key up to this one have failed without a success between, and
    ``abort`` where they reach the limit."""
    w = _run(key, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_f", F.coalesce(failed, F.lit(False))).withColumn("_part", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w))
    inside = Window.partitionBy(*key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("failures", F.sum(F.when(F.col("_f"), 1).otherwise(0)).over(inside))
    return rows.withColumn("abort", F.col("failures") >= abort).drop("_f", "_part")


def overlap_prior(df: DataFrame, key: list[str], order: str, chunk: str, executed: int, overlap: int) -> DataFrame:
    """Each chunk with ``prior`` and ``mask``, as long as it: the frames of the chunk before that were not executed,
    ``overlap`` at most, then zeros. A key is one subtask of a run, so a change of subtask starts without a prior (null)."""
    before = F.lag(chunk).over(_run(key, order))
    rows = df.withColumn("_b", before)
    n = F.least(F.lit(overlap), F.greatest(F.lit(0), F.size("_b") - executed))
    rows = rows.withColumn("_n", F.when(F.col("_b").isNotNull(), n))
    prior = F.transform("_b", lambda x, i: F.when(i < F.col("_n"), F.get("_b", i + executed)).otherwise(F.lit(0.0)))
    return rows.withColumns({"prior": prior, "mask": F.transform("_b", lambda x, i: i < F.col("_n"))}).drop("_b", "_n")


def broker(df: DataFrame, ids: list[str], chunk: str, horizon: int) -> DataFrame:
    """One inference for each ``horizon`` steps: ids, step (of the chunk) and its action."""
    return df.select(*ids, F.posexplode(F.slice(chunk, 1, horizon)).alias("step", "action"))


def round_trips(df: DataFrame, key: list[str], order: str, total: str) -> DataFrame:
    """Each request with the total time of the one before it."""
    return df.withColumn("previous_total", F.lag(total).over(_run(key, order)))


def repeated(df: DataFrame, epochs: int) -> DataFrame:
    """The table once for each epoch, with ``epoch``."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def stop_reason(aborted, env_done, ticks, most: int, success):
    """Why a run ends, by precedence; null while it goes on."""
    return F.when(aborted, "abort").when(env_done, "env_done").when(ticks >= most, "max_ticks").when(success, "success")


def checkpoints(step, least: int, every: int = 12):
    """True at ``least`` and every so many steps after it."""
    return (step >= least) & (F.pmod(step - F.lit(least), F.lit(every)) == 0)


def appended(df: DataFrame, path: str, checkpoint: str):
    """Rows of a stream appended as JSON lines; restarts go on from the checkpoint."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def windowed_counts(df: DataFrame, ts: str, keys: list[str], size: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Extension: counts by tumbling or sliding window; state older than the watermark is dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return df.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", *keys, "n")


def joined_within(a: DataFrame, b: DataFrame, key: str, ts: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Extension: pairs of two streams with an equal key, b at most so long after a."""
    left = a.withWatermark(ts, late).select(F.col(key).alias("key"), F.col(ts).alias("at"))
    right = b.withWatermark(ts, late).select(F.col(key).alias("other"), F.col(ts).alias("then"))
    return left.join(right, F.expr(f"key = other AND then >= at AND then <= at + INTERVAL {seconds} SECONDS")).select("key", "at", "then")
