"""Guards of an attempt and recovery of a stalled run: several keyed states with marks that are set once, in stream and batch.

A log has a row for each step, result or start of an attempt, in the order of ``seq`` within its key (a run): columns key, seq,
ts, kind (step, attempt or start), subtask, prompt, attempt, state (an array), command (an array), gap and outcome; those that
do not concern a kind are null. Both forms give rows (key, seq, event).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Wordings of the two instructions, steps of the window, least mean command, ratio of path to command below which
# a run stands still, and numbers of a state and a command that count.
SPOUT, NAVIGATE = "Move the spout to wash all locations of the sink basin.", "Navigate to the sink."
STEPS, LEAST_COMMAND, RATIO = 60, 0.05, 0.12
STATE_SIZE, PLACE = 16, 3
# Fixed values of the release guard in mm: a start that holds something, spread of a hold's three gaps, steps before it looks,
# rise above the hold and rise at once.
HELD, SPREAD, FROM, RISE, STEP = (5.0, 68.0), 2.5, 12, 5.0, 4.0
LOG = "key string, seq long, ts timestamp, kind string, subtask string, prompt string, attempt int, state array<double>, command array<double>, gap double, outcome string"
EVENTS = "key string, seq long, event string"


def _finite(c: Column) -> Column:
    return F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _length(c: Column) -> Column:
    return F.sqrt(F.aggregate(F.slice(c, 1, PLACE), F.lit(0.0), lambda s, x: s + x * x))


def _run(*order: str) -> Window:
    return Window.partitionBy("key").orderBy(*order)


SO_FAR = (Window.unboundedPreceding, 0)


def phases(log: DataFrame) -> DataFrame:
    """Key, seq, event (low_command, nav_pending, clear, invalid_prompt_window or invalid_robot_data), path, command.

    The window is the first STEPS steps from the first one of SPOUT on. It is judged once, at the first step at or after its
    end that is a first attempt of SPOUT in the subtask that first was one; runs without such a step have no row. Nothing of
    a run is gathered: steps are numbered and added."""
    steps = log.where("kind = 'step'").withColumn("r", F.row_number().over(_run("seq")))
    mine = (F.col("prompt") == SPOUT) & (F.col("attempt") == 1)
    w = _run("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = steps.withColumns({"from": F.min(F.when(F.col("prompt") == SPOUT, F.col("r"))).over(w), "first": F.first(F.when(mine, F.col("subtask")), ignorenulls=True).over(w), "before": F.lag("state").over(_run("seq"))})
    inside = F.col("r").between(F.col("from"), F.col("from") + STEPS - 1)
    good = (F.size("state") == STATE_SIZE) & (F.size("command") >= PLACE) & _finite(F.col("state")) & _finite(F.slice("command", 1, PLACE))
    moved = F.when(F.col("r") > F.col("from"), _length(F.zip_with(F.slice("state", 1, PLACE), F.slice("before", 1, PLACE), lambda a, b: a - b))).otherwise(0.0)
    at = F.min(F.when(mine & (F.col("subtask") == F.col("first")) & (F.col("r") >= F.col("from") + STEPS - 1), F.col("seq")))
    each = steps.groupBy("key").agg(
        at.alias("seq"), F.min(F.when(inside, F.coalesce(F.col("prompt") == SPOUT, F.lit(False)))).alias("same"), F.min(F.when(inside, F.coalesce(good, F.lit(False)))).alias("good"),
        F.sum(F.when(inside, moved)).alias("path"), F.avg(F.when(inside, _length(F.col("command")))).alias("command"),
    ).where("seq is not null")
    event = F.when(~F.col("same"), "invalid_prompt_window").when(~F.col("good"), "invalid_robot_data").when(F.col("command") <= LEAST_COMMAND, "low_command").when(F.col("path") / F.col("command") < RATIO, "nav_pending").otherwise("clear")
    judged = F.col("same") & F.col("good")
    return each.select("key", "seq", event.alias("event"), F.when(judged, F.col("path")).alias("path"), F.when(judged, F.col("command")).alias("command"))


def intents(log: DataFrame) -> DataFrame:
    """Navigate at the first failed attempt of SPOUT after a run is nav_pending, spout at the first attempt of NAVIGATE after
    that; each once."""
    pending = phases(log).where("event = 'nav_pending'").select(F.col("key").alias("_k"), F.col("seq").alias("since"))
    results = log.where("kind = 'attempt'").join(pending, F.col("key") == F.col("_k")).where("seq > since")
    failed = (F.col("prompt") == SPOUT) & (F.col("outcome") == "failed")
    results = results.withColumn("at", F.min(F.when(failed, F.col("seq"))).over(Window.partitionBy("key")))
    results = results.withColumn("back", F.min(F.when((F.col("prompt") == NAVIGATE) & (F.col("seq") > F.col("at")), F.col("seq"))).over(Window.partitionBy("key")))
    return results.where("seq = at or seq = back").select("key", "seq", F.when(F.col("seq") == F.col("at"), "navigate").otherwise("spout").alias("event"))


def releases(log: DataFrame) -> DataFrame:
    """At most one release an attempt, from its FROM-th step on: where the gap has risen RISE above the hold or STEP since the
    step before. The hold is the gap at the attempt's start if that holds something; else the mean of the first three gaps in a
    row that are within it and close together. An attempt begins at a ``start``; without a gap there it has no release; steps
    without a gap are counted, and otherwise passed over."""
    rows = log.where("kind in ('start', 'step')").withColumn("no", F.sum(F.when(F.col("kind") == "start", 1).otherwise(0)).over(_run("seq").rowsBetween(*SO_FAR)))
    own = Window.partitionBy("key", "no").orderBy("seq")
    rows = rows.withColumns({"first": F.first(F.struct("kind", "gap")).over(own), "r": F.row_number().over(own) - 1}).where("first.kind = 'start' and first.gap is not null and r > 0 and gap is not null")
    three = own.rowsBetween(-2, 0)
    rows = rows.withColumns({"p": F.lag("gap").over(own), "k": F.count(F.lit(1)).over(three), "lo": F.min("gap").over(three), "hi": F.max("gap").over(three), "mean": F.avg("gap").over(three)})
    steady = (F.col("k") == 3) & (F.col("lo") >= HELD[0]) & (F.col("hi") <= HELD[1]) & (F.col("hi") - F.col("lo") <= SPREAD)
    hold = F.when(F.col("first.gap").between(*HELD), F.col("first.gap")).otherwise(F.first(F.when(steady, F.col("mean")), ignorenulls=True).over(own.rowsBetween(*SO_FAR)))
    fires = (F.col("r") >= FROM) & ((F.col("gap") - hold >= RISE) | (hold.isNotNull() & (F.col("gap") - F.col("p") >= STEP)))
    return rows.withColumn("fires", fires).where("fires").groupBy("key", "no").agg(F.min("seq").alias("seq")).select("key", "seq", F.lit("release").alias("event"))


def in_batch(log: DataFrame) -> DataFrame:
    """T6, T8, T9 of a finished log: key, seq, event."""
    return phases(log).select("key", "seq", "event").unionByName(intents(log)).unionByName(releases(log))


class Recovery(StatefulProcessor):
    """The same over a stream. Each concern has a state of its own, so a row rewrites only what it changes: how far the log was
    read, the window's sums, the phase with its marks, and the attempt's guard. A run that is silent for ``idle`` in event time
    is forgotten, with an event ``expired`` (its seq the last one)."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.read = handle.getValueState("read", "seq long, timer long")
        self.window = handle.getValueState("window", "steps int, first string, same boolean, good boolean, path double, command double, last array<double>")
        self.phase = handle.getValueState("phase", "phase string")
        self.guard = handle.getValueState("guard", "start double, steps int, gaps array<double>, hold double, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(rows))
        last, timer = self.read.get() if self.read.exists() else (-(2**62), None)
        log = log[log.seq > last].sort_values("seq", kind="stable")
        if not len(log):
            return
        out = [(key[0], r.seq, event) for r in log.itertuples(index=False) for event in self.events(r)]
        expires = int(log.ts.max().timestamp() * 1000) + self.idle_ms
        if timer is None or expires > timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(expires)
            timer = expires
        self.read.update((int(log.seq.max()), timer))
        if out:
            yield pd.DataFrame(out, columns=["key", "seq", "event"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.read.get()[0]
        for state in (self.read, self.window, self.phase, self.guard):
            state.clear()
        yield pd.DataFrame({"key": [key[0]], "seq": [last], "event": ["expired"]})

    def close(self) -> None:
        pass

    def events(self, r) -> Iterator[str]:
        if r.kind == "start":
            held = _number(r.gap)
            hold = held if held is not None and HELD[0] <= held <= HELD[1] else None
            self.guard.update((held, 0, [], hold, held is None))
        elif r.kind == "step":
            yield from self.stall(r)
            yield from self.release(_number(r.gap))
        elif r.kind == "attempt":
            phase = self.phase.get()[0] if self.phase.exists() else None
            if phase == "nav_pending" and r.prompt == SPOUT and r.outcome == "failed":
                self.phase.update(("navigating",))
                yield "navigate"
            elif phase == "navigating" and r.prompt == NAVIGATE:
                self.phase.update(("done",))
                yield "spout"

    def stall(self, r) -> Iterator[str]:
        if self.phase.exists():  # judged once
            return
        spout = r.prompt == SPOUT
        if not self.window.exists():
            if not spout:
                return
            held = (0, None, True, True, 0.0, 0.0, None)
        else:
            held = self.window.get()
        steps, first, same, good, path, command, last = held
        mine = spout and r.attempt == 1
        first = r.subtask if first is None and mine else first
        if steps < STEPS:
            steps, same = steps + 1, same and spout
            place, given = _numbers(r.state, STATE_SIZE, exact=True), _numbers(r.command, PLACE)
            good = good and place is not None and given is not None
            if good:
                path += 0.0 if last is None else math.dist(place[:PLACE], last)
                command += math.hypot(*given[:PLACE])
                last = place[:PLACE]
        if steps == STEPS and mine and r.subtask == first:
            mean = command / STEPS
            phase = "invalid_prompt_window" if not same else "invalid_robot_data" if not good else "low_command" if mean <= LEAST_COMMAND else "nav_pending" if path / mean < RATIO else "clear"
            self.phase.update((phase,))
            self.window.clear()
            yield phase
        else:
            self.window.update((steps, first, same, good, path, command, last))

    def release(self, gap: float | None) -> Iterator[str]:
        if not self.guard.exists():
            return
        start, steps, gaps, hold, done = self.guard.get()
        if done:
            return
        steps, gaps = steps + 1, list(gaps)
        if gap is not None:
            before, gaps = gaps[-1] if gaps else None, [*gaps, gap][-3:]
            if hold is None and len(gaps) == 3 and HELD[0] <= min(gaps) and max(gaps) <= HELD[1] and max(gaps) - min(gaps) <= SPREAD:
                hold = sum(gaps) / 3
            done = hold is not None and steps >= FROM and (gap - hold >= RISE or (before is not None and gap - before >= STEP))
        self.guard.update((start, steps, gaps, hold, done))
        if done:
            yield "release"


def _number(x) -> float | None:
    return None if x is None or pd.isna(x) else float(x)


def _numbers(xs, n: int, exact: bool = False) -> list[float] | None:
    """``n`` finite numbers at the beginning of an array (all of it if ``exact``)."""
    if xs is None or len(xs) < n or (exact and len(xs) != n):
        return None
    out = [math.nan if x is None else float(x) for x in list(xs)[:n]]
    return out if all(map(math.isfinite, out)) else None


def in_stream(log: DataFrame, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """T6, T8, T9 of a log as it comes; output mode append. Needs the RocksDB state store. Rows of a run that come after later
    ones were handled are passed over."""
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return log.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(Recovery(ms), EVENTS, "append", "eventtime")
