"""Queries of guards and recovery: three users are a run, events its steps, starts and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetide.streaming import recovery as R

from .temporal import E, events


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that move by the value, the more the higher the run's number; runs of some numbers break a rule of the window."""
    run = F.floor(F.col("user_id") / 3)
    rows = events(spark, sf_dir).withColumn("run", run).withColumn("r", (F.row_number().over(Window.partitionBy("run").orderBy("us")) - 1).cast("bigint"))
    r, run, value = F.col("r"), F.col("run"), F.col("value")
    kind = F.when((F.col("event_type") == "signup") & (r % 4 == 0), "start").when((F.col("event_type") == "error") & (r >= 70), "attempt").otherwise("step")
    prompt = F.when((r < 5) | ((run % 13 == 1) & (r == 30)), "Open the drawer.").when(r % 160 < 110, R.SPOUT).otherwise(R.NAVIGATE)
    saw = F.when(r % 20 < 4, F.lit(80.0)).when(r % 20 < 14, F.lit(30.0)).otherwise(F.lit(60.0))
    return rows.select(
        run.cast("string").alias("key"), r.alias("seq"), F.timestamp_micros("us").alias("ts"), kind.alias("kind"), F.floor(r / 200).cast("string").alias("subtask"), prompt.alias("prompt"), F.lit(1).alias("attempt"),
        F.concat(F.array(value * 5e-6 * (1 + run % 8), F.lit(0.0), F.lit(1.0)), F.array_repeat(F.lit(0.0), F.when(run % 17 == 2, 12).otherwise(13))).alias("state"),
        F.array(F.lit(0.0), value / F.when(run % 11 == 3, 10_000).otherwise(100), F.lit(0.0)).alias("command"), F.when(r % 23 > 0, saw + F.floor(value / 10) / 4).alias("gap"), F.when(value > 50, "failed").otherwise("complete").alias("outcome"),
    )


LOG = f"""{E}, q AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY us) - 1 AS r FROM (SELECT *, user_id // 3 AS run FROM e)),
g AS MATERIALIZED (SELECT run, r, value, CASE WHEN event_type = 'signup' AND r % 4 = 0 THEN 'start' WHEN event_type = 'error' AND r >= 70 THEN 'attempt' ELSE 'step' END AS kind, r // 200 AS subtask,
CASE WHEN r < 5 OR (run % 13 = 1 AND r = 30) THEN 'other' WHEN r % 160 < 110 THEN 'spout' ELSE 'navigate' END AS prompt, CASE WHEN r % 23 > 0 THEN (CASE WHEN r % 20 < 4 THEN 80.0 WHEN r % 20 < 14 THEN 30.0 ELSE 60.0 END)::DOUBLE + floor(value / 10) / 4 END AS gap FROM q),
s AS (SELECT *, row_number() OVER w AS n, value * 5e-6::DOUBLE * (1 + run % 8) AS x, lag(value) OVER w * 5e-6::DOUBLE * (1 + run % 8) AS px, value / (CASE WHEN run % 11 = 3 THEN 10000 ELSE 100 END) AS c FROM g WHERE kind = 'step' WINDOW w AS (PARTITION BY run ORDER BY r)),
f AS (SELECT run, min(n) AS n0, arg_min(subtask, r) AS sub FROM s WHERE prompt = 'spout' GROUP BY run),
w AS (SELECT s.run, min(CASE WHEN n >= n0 + 59 AND prompt = 'spout' AND subtask = sub THEN r END) AS seq, bool_and(prompt = 'spout') FILTER (WHERE n BETWEEN n0 AND n0 + 59) AS same,
sum(abs(x - px)) FILTER (WHERE n BETWEEN n0 + 1 AND n0 + 59) AS path, avg(abs(c)) FILTER (WHERE n BETWEEN n0 AND n0 + 59) AS command FROM s JOIN f ON f.run = s.run GROUP BY s.run),
p AS MATERIALIZED (SELECT run, seq, CASE WHEN NOT same THEN 'invalid_prompt_window' WHEN run % 17 = 2 THEN 'invalid_robot_data' WHEN command <= 0.05 THEN 'low_command' WHEN path / command < 0.12 THEN 'nav_pending' ELSE 'clear' END AS event FROM w WHERE seq IS NOT NULL),
t0 AS (SELECT g.run, min(r) AS r FROM g JOIN p ON p.run = g.run AND p.event = 'nav_pending' AND g.r > p.seq WHERE kind = 'attempt' AND prompt = 'spout' AND value > 50 GROUP BY g.run),
t1 AS (SELECT g.run, min(g.r) AS r FROM g JOIN t0 ON t0.run = g.run AND g.r > t0.r WHERE kind = 'attempt' AND prompt = 'navigate' GROUP BY g.run)"""
EVENTS_SQL = f"""WITH {LOG},
a AS (SELECT *, sum(CASE WHEN kind = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY r) AS no FROM g WHERE kind <> 'attempt'),
b AS (SELECT *, first_value(gap) OVER w AS g0, row_number() OVER w - 1 AS k FROM a WHERE no > 0 WINDOW w AS (PARTITION BY run, no ORDER BY r)),
c AS (SELECT *, lag(gap) OVER w AS pg, count(*) OVER v AS m, min(gap) OVER v AS lo, max(gap) OVER v AS hi, avg(gap) OVER v AS mean FROM b WHERE k > 0 AND g0 IS NOT NULL AND gap IS NOT NULL WINDOW w AS (PARTITION BY run, no ORDER BY r), v AS (PARTITION BY run, no ORDER BY r ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
d AS (SELECT *, CASE WHEN g0 BETWEEN 5 AND 68 THEN g0 ELSE first_value(CASE WHEN m = 3 AND lo >= 5 AND hi <= 68 AND hi - lo <= 2.5 THEN mean END IGNORE NULLS) OVER (PARTITION BY run, no ORDER BY r ROWS UNBOUNDED PRECEDING) END AS hold FROM c)
SELECT CAST(run AS VARCHAR) AS key, seq, event FROM p UNION ALL SELECT CAST(run AS VARCHAR), r, 'navigate' FROM t0 UNION ALL SELECT CAST(run AS VARCHAR), r, 'spout' FROM t1
UNION ALL SELECT CAST(run AS VARCHAR), min(r), 'release' FROM d WHERE k >= 12 AND hold IS NOT NULL AND (gap - hold >= 5 OR gap - pg >= 4) GROUP BY run, no"""


def recovery_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6, T8, T9, with the fixed values."""
    return R.in_batch(log(spark, sf_dir))


def stalled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's phase, path and mean command."""
    return R.phases(log(spark, sf_dir)).select("key", "event", F.round("path", 6).alias("path"), F.round("command", 6).alias("command"))


STALLED_SQL = f"""WITH {LOG} SELECT CAST(p.run AS VARCHAR) AS key, event, CASE WHEN event NOT LIKE 'invalid%' THEN round(path, 6) END AS path, CASE WHEN event NOT LIKE 'invalid%' THEN round(command, 6) END AS command FROM p JOIN w ON w.run = p.run"""

QUERIES = {"recovery_events": (recovery_events, EVENTS_SQL), "stalled_runs": (stalled_runs, STALLED_SQL)}
