"""Queries of attempts, contacts and intervals: users are runs, events their ticks, values their gaps and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetide.functions import control as C
from kinetide.operators import temporal as T
from kinetide.streaming import attempts as A

from .tables import _read
from .temporal import HOUR, E, events

DAY = 24 * HOUR


def _gaps(spark: SparkSession, sf_dir: str, later: int = 0) -> DataFrame:
    """Gaps in mm that move slowly: a saw of the place within the run, which begins ``later``, and the value's tenths."""
    r = F.row_number().over(Window.partitionBy("user_id").orderBy("us")) - 1
    rows = events(spark, sf_dir).withColumn("r", r)
    at = F.pmod(F.col("r") + later, F.lit(20))
    saw = F.when(at < 4, F.lit(80.0)).when(at < 14, F.lit(30.0)).otherwise(F.lit(60.0))
    return rows.select("user_id", F.col("r").cast("bigint").alias("seq"), (saw + F.floor(F.col("value") / 10) / 4).alias("gap"))


GAPS = f"""{E}, g AS (SELECT user_id, r AS seq, (CASE WHEN r % 20 < 4 THEN 80.0 WHEN r % 20 < 14 THEN 30.0 ELSE 60.0 END)::DOUBLE + floor(value / 10) / 4 AS gap
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS r FROM e))"""
LATER = GAPS.replace("r % 20", "(r + 4) % 20")


def contact_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, through the keyed state's rule in batch."""
    rows = _gaps(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), "seq", "gap")
    return A.in_batch(rows, "contact").select(F.col("key").cast("bigint").alias("user_id"), F.col("seq").alias("held"))


def contact_holds_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, by windows, for logs of any length."""
    return A.contacts(_gaps(spark, sf_dir), ["user_id"], "seq", "gap")


HOLDS_SQL = f"""WITH {GAPS}, p AS (SELECT *, max(gap) OVER (PARTITION BY user_id ORDER BY seq) AS peak, abs(gap - lag(gap) OVER (PARTITION BY user_id ORDER BY seq)) > 2.5 AS jump FROM g),
t AS (SELECT *, peak >= 70 AND gap BETWEEN 5 AND 62 AND peak - gap >= 8 AS touching FROM p),
s AS (SELECT *, sum(CASE WHEN NOT touching OR coalesce(jump, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS part FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, part ORDER BY seq) AS n FROM s WHERE touching)
SELECT user_id, min(seq) AS held FROM n WHERE n = 5 GROUP BY user_id"""


def place_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: jaws hold something at first."""
    return A.releases(_gaps(spark, sf_dir, 4), ["user_id"], "seq", "gap")


RELEASES_SQL = f"""WITH {LATER}, w AS (SELECT *, first_value(gap) OVER (PARTITION BY user_id ORDER BY seq) AS start FROM g),
x AS (SELECT *, start <= 62 AND gap >= 45 AND gap - start >= 10 AS wide, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS r FROM w),
y AS (SELECT *, r - row_number() OVER (PARTITION BY user_id ORDER BY seq) AS part FROM x WHERE wide),
z AS (SELECT *, row_number() OVER (PARTITION BY user_id, part ORDER BY seq) AS n FROM y)
SELECT user_id, min(seq) AS released FROM z WHERE n = 5 GROUP BY user_id"""


def release_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6."""
    return A.guarded(_gaps(spark, sf_dir, 4), ["user_id"], "seq", "gap")


GUARD_SQL = f"""WITH {LATER}, w AS (SELECT *, row_number() OVER v AS n, lag(gap) OVER v AS p, min(gap) OVER k AS lo, max(gap) OVER k AS hi, avg(gap) OVER k AS mean FROM g
WINDOW v AS (PARTITION BY user_id ORDER BY seq), k AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
h AS (SELECT *, first_value(CASE WHEN n >= 3 AND lo >= 5 AND hi <= 68 AND hi - lo <= 2.5 THEN mean END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS hold FROM w)
SELECT user_id, min(seq) AS opened FROM h WHERE n >= 12 AND hold IS NOT NULL AND (gap - hold >= 5 OR gap - p >= 4) GROUP BY user_id"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as attempts of a subtask; verdicts and followups by tick and event."""
    rows = events(spark, sf_dir).withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("us")))
    k = F.pmod(F.col("event_id") * 7, F.lit(10))
    verdict = F.when(k < 2, "complete").when(k == 2, "error").otherwise("incomplete")
    followup = F.when(F.pmod("event_id", F.lit(11)) == 0, "retry").when(F.pmod("event_id", F.lit(11)) == 1, "replan_keep_pose")
    return rows.select("user_id", F.col("seq").cast("bigint").alias("seq"), verdict.alias("verdict"), followup.alias("followup"), F.pmod("user_id", F.lit(3)).cast("int").alias("retries"))


ATTEMPTS = f"""{E}, a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us) AS seq, event_id * 7 % 10 AS k, event_id % 11 AS f, user_id % 3 AS most FROM e),
o AS (SELECT user_id, seq, 0 AS tries, CASE WHEN k < 2 AND f <> 0 THEN 'complete' WHEN k = 2 OR f = 1 OR 1 > most THEN 'failed' ELSE 'retry' END AS event FROM a WHERE seq = 1
UNION ALL SELECT a.user_id, a.seq, CASE WHEN o.event = 'retry' THEN o.tries + 1 ELSE 0 END, CASE WHEN k < 2 AND f <> 0 THEN 'complete' WHEN k = 2 OR f = 1 OR (CASE WHEN o.event = 'retry' THEN o.tries + 2 ELSE 1 END) > most THEN 'failed' ELSE 'retry' END
FROM o JOIN a ON a.user_id = o.user_id AND a.seq = o.seq + 1)"""


def attempt_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2, through the keyed state's rule in batch; each run is one subtask with its own retries."""
    rows = _attempts(spark, sf_dir).withColumn("key", F.col("user_id").cast("string")).drop("user_id")
    return A.in_batch(rows, "outcome").select(F.col("key").cast("bigint").alias("user_id"), "seq", "event")


RESULTS_SQL = f"WITH RECURSIVE {ATTEMPTS} SELECT user_id, seq, event FROM o"


def attempt_results_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2, by windows, for logs of any length."""
    return A.outcomes(_attempts(spark, sf_dir), ["user_id"], "seq").select("user_id", "seq", "event")


def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T13."""
    rows = _attempts(spark, sf_dir)
    return A.failures_in_row(rows, ["user_id"], "seq", F.col("verdict") != "complete").select("user_id", "seq", F.col("failures").cast("bigint").alias("failures"), "abort")


FAILURES_SQL = f"""WITH {E}, a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us) AS seq, event_id * 7 % 10 >= 2 AS f FROM e),
p AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY seq) AS part FROM a),
c AS (SELECT user_id, seq, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, part ORDER BY seq) AS BIGINT) AS failures FROM p)
SELECT *, failures >= 3 AS abort FROM c"""


def third_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T12."""
    rows = _attempts(spark, sf_dir)
    return A.every_third(rows, ["user_id"], "seq", F.col("verdict") == "incomplete").select("user_id", "seq")


THIRD_SQL = f"""WITH {E}, a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us) AS seq, event_id * 7 % 10 > 2 AS f FROM e)
SELECT user_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS n FROM a WHERE f) WHERE n % 3 = 0"""


def stall_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and commands of three numbers, from the first ten rows of a run."""
    rows = events(spark, sf_dir).select("user_id", "us", F.array(F.col("value") / 1000, F.lit(0.0), F.lit(1.0)).alias("place"), F.array(F.lit(0.0), F.col("value") / 100, F.lit(0.0)).alias("command"))
    found = A.stalls(rows, ["user_id"], "us", "place", "command", rows=10, least_command=0.3, ratio=0.5)
    return found.select("user_id", F.round("path", 6).alias("path"), F.round("command", 6).alias("command"), "phase")


STALL_SQL = f"""WITH {E}, r AS (SELECT *, row_number() OVER w AS n, abs(value / 1000 - lag(value / 1000) OVER w) AS step FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
a AS (SELECT user_id, count(*) AS n, sum(coalesce(step, 0)) AS path, avg(abs(value / 100)) AS command FROM r WHERE n <= 10 GROUP BY user_id)
SELECT user_id, round(path, 6) AS path, round(command, 6) AS command, CASE WHEN n < 10 THEN 'waiting' WHEN command <= 0.3 THEN 'low_command' WHEN path / command < 0.5 THEN 'nav_pending' ELSE 'clear' END AS phase FROM a"""


def recovery_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of even users are pending."""
    rows = events(spark, sf_dir).select("user_id", "us", F.when(F.col("user_id") % 2 == 0, "nav_pending").otherwise("clear").alias("phase"), F.when(F.col("value") > 50, "failed").otherwise("complete").alias("outcome"), F.col("event_type").alias("prompt"))
    return A.intents(rows, ["user_id"], "us", "phase", "outcome", "prompt", "click", "view").select("user_id", "us", "intent")


INTENTS_SQL = f"""WITH {E}, a AS (SELECT *, min(CASE WHEN user_id % 2 = 0 AND value > 50 AND event_type = 'click' THEN us END) OVER (PARTITION BY user_id) AS t0 FROM e),
b AS (SELECT *, min(CASE WHEN us > t0 AND event_type = 'view' THEN us END) OVER (PARTITION BY user_id) AS back FROM a)
SELECT user_id, us, CASE WHEN us = t0 THEN 'navigate' ELSE 'spout' END AS intent FROM b WHERE us = t0 OR us = back"""


def overlap_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label as chunks that follow one another; 26 numbers of each are executed, four overlap."""
    rows = _read(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("chunk"))
    found = A.overlap_prior(rows, ["label"], "vec_id", "chunk", 26, 4)
    return found.select("vec_id", F.size("prior").alias("n"), F.get("prior", F.lit(0)).alias("first"), F.get("prior", F.lit(3)).alias("fourth"), F.get("prior", F.lit(4)).alias("fifth"), F.size(F.filter("mask", lambda x: x)).alias("kept")).where("n > 0")


PRIOR_SQL = """WITH p AS (SELECT vec_id, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT vec_id, CAST(len(b) AS INT) AS n, CAST(b[27] AS DOUBLE) AS first, CAST(b[30] AS DOUBLE) AS fourth, 0.0::DOUBLE AS fifth, 4 AS kept FROM p WHERE b IS NOT NULL"""


def chunk_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five numbers of each chunk as steps, in two epochs."""
    rows = A.broker(_read(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", 5)
    return A.repeated(rows, 2).select("vec_id", "epoch", "step", F.col("action").cast("double").alias("action"))


CHUNK_SQL = "SELECT vec_id, CAST(ep AS INT) AS epoch, CAST(s AS INT) AS step, CAST(embedding[s + 1] AS DOUBLE) AS action FROM embeddings, range(2) a(ep), range(5) b(s)"


def round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T16."""
    return A.round_trips(events(spark, sf_dir), ["user_id"], "us", "value").select("event_id", "previous_total")


TRIPS_SQL = f"WITH {E} SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY us) AS previous_total FROM e"


def carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clicks are completed picks, purchases places, where the value is low."""
    stage = F.when(F.col("event_type") == "click", "pick_up_from").when(F.col("event_type") == "purchase", "place_in").otherwise("move_to")
    w = Window.partitionBy("user_id").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    outcome = F.when(F.col("value") < 70, "complete").otherwise("failed")
    held = C.carrying(outcome, stage, F.col("event_id").cast("string"), w)
    return events(spark, sf_dir).select("event_id", held.alias("held"))


CARRIED_SQL = f"""WITH {E}, l AS (SELECT event_id, last_value(CASE WHEN value < 70 AND event_type IN ('click', 'purchase') THEN event_type || ':' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS x FROM e)
SELECT event_id, CASE WHEN x LIKE 'click:%' THEN substr(x, 7) END AS held FROM l"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users of a pair are its sides: active while values are high, gripping at clicks and releasing at purchases."""
    rows = events(spark, sf_dir).select(F.floor(F.col("user_id") / 2).alias("pair"), F.pmod("user_id", F.lit(2)).alias("side"), "us", "event_type", "value")
    runs = T.islands(rows, ["pair", "side"], "us", F.col("value") > 30, least=2)
    active = runs.select("pair", "side", F.col("first").alias("start"), F.col("last").alias("end"))
    grips = rows.where("event_type in ('click', 'purchase') and value < 25").select("pair", "side", F.col("us").alias("t"), (F.col("event_type") == "purchase").alias("released"))
    return active, grips


SIDES = f"""{E}, v AS (SELECT CAST(floor(user_id / 2) AS BIGINT) AS pair, user_id % 2 AS side, us, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY us) AS r FROM e),
i AS (SELECT *, r - row_number() OVER (PARTITION BY pair, side ORDER BY us) AS g FROM v WHERE value > 30),
act AS (SELECT pair, side, min(us) AS s, max(us) AS t FROM i GROUP BY pair, side, g HAVING count(*) >= 2),
grip AS (SELECT pair, side, us AS t, event_type = 'purchase' AS released FROM v WHERE event_type IN ('click', 'purchase') AND value < 25)"""
LEAST, GUARD, MERGE, BACK, FOLLOW = HOUR, HOUR // 4, 20 * HOUR, 30 * HOUR, 60 * HOUR


def silent_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10."""
    active, grips = _sides(spark, sf_dir)
    found = T.silent_intervals(active, grips, ["pair"], LEAST, GUARD, MERGE, BACK, FOLLOW, 7 * DAY)
    return found.select("pair", "side", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


SILENT_SQL = f"""WITH {SIDES}, free AS (SELECT * FROM act WHERE t - s >= {LEAST} AND NOT EXISTS (SELECT 1 FROM grip WHERE grip.pair = act.pair AND grip.t BETWEEN act.s - {GUARD} AND act.t + {GUARD})),
l AS (SELECT *, lag(t) OVER (PARTITION BY pair, side ORDER BY s) AS p FROM free),
m AS (SELECT *, CASE WHEN s - p <= {MERGE} AND NOT EXISTS (SELECT 1 FROM grip WHERE grip.pair = l.pair AND grip.t BETWEEN l.p AND l.s) THEN 0 ELSE 1 END AS new FROM l),
n AS (SELECT *, sum(new) OVER (PARTITION BY pair, side ORDER BY s) AS part FROM m),
d AS (SELECT pair, side, min(s) AS s, max(t) AS t FROM n GROUP BY pair, side, part),
starts AS (SELECT pair, side, t FROM grip UNION ALL SELECT pair, side, s FROM act),
cut AS (SELECT pair, side, s, coalesce((SELECT min(o.t) FROM starts o WHERE o.pair = d.pair AND o.side <> d.side AND o.t > d.s AND o.t < d.t), t) AS t,
(SELECT max(r.t) FROM grip r WHERE r.released AND r.pair = d.pair AND r.side = d.side AND r.t <= d.s) AS freed FROM d)
SELECT pair, side, CASE WHEN s - freed <= {BACK} THEN freed ELSE s END AS start_us, t AS end_us FROM cut WHERE s - freed <= {FOLLOW} AND t - CASE WHEN s - freed <= {BACK} THEN freed ELSE s END >= {LEAST}"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("f", (F.row_number().over(Window.partitionBy("user_id").orderBy("us")) - 1).cast("bigint")).select("user_id", "f", "value")


def segment_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of ten frames, each with its first stop of two frames, searched for up to three frames beyond it."""
    frames = _frames(spark, sf_dir)
    segments = frames.groupBy("user_id", F.floor(F.col("f") / 10).alias("k")).agg(F.min("f").alias("s"), (F.max("f") + 1).alias("e"))
    return T.first_stop_in(segments, frames, ["user_id"], "f", "s", "e", F.col("value") <= 50, 2, 3).select("user_id", "s", "stop")


STOPS_SQL = f"""WITH {E}, f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS f, value <= 50 AS still FROM e),
r AS (SELECT *, bool_and(still) OVER (PARTITION BY user_id ORDER BY f ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS run, count(*) OVER (PARTITION BY user_id) AS n FROM f),
g AS (SELECT user_id, min(f) AS s, max(f) + 1 AS e, any_value(n) AS n FROM r GROUP BY user_id, f // 10)
SELECT user_id, s, (SELECT min(r.f) FROM r WHERE r.user_id = g.user_id AND r.run AND r.f >= g.s AND r.f <= greatest(g.s, least(g.n, greatest(g.e + 3, g.s + 2)) - 2)
AND EXISTS (SELECT 1 FROM r q WHERE q.user_id = g.user_id AND NOT q.still AND q.f >= g.s AND q.f < r.f)) AS stop FROM g"""


def sustained_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the next purchase, both without those that are pairs within a day."""
    is_ = lambda kind: F.col("event_type") == kind
    return T.sustained(events(spark, sf_dir), ["user_id"], "us", is_("click"), is_("purchase"), gap=DAY).select("user_id", "event_id", "us", "closed")


UNPAIRED_SQL = f"""WITH {E}, l AS (SELECT *, event_type = 'click' AND coalesce(lead(event_type) OVER w = 'purchase' AND lead(us) OVER w - us <= {DAY}, false) AS opens,
event_type = 'purchase' AND coalesce(lag(event_type) OVER w = 'click' AND us - lag(us) OVER w <= {DAY}, false) AS closes FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
k AS (SELECT *, first_value(CASE WHEN event_type = 'purchase' THEN us END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closed FROM l WHERE NOT opens AND NOT closes)
SELECT user_id, event_id, us, closed FROM k WHERE event_type = 'click'"""

QUERIES = {
    "contact_holds": (contact_holds, HOLDS_SQL),
    "contact_holds_windowed": (contact_holds_windowed, HOLDS_SQL),
    "place_releases": (place_releases, RELEASES_SQL),
    "release_guard": (release_guard, GUARD_SQL),
    "attempt_results": (attempt_results, RESULTS_SQL),
    "attempt_results_windowed": (attempt_results_windowed, RESULTS_SQL),
    "failure_runs": (failure_runs, FAILURES_SQL),
    "third_retries": (third_retries, THIRD_SQL),
    "stall_phases": (stall_phases, STALL_SQL),
    "recovery_intents": (recovery_intents, INTENTS_SQL),
    "overlap_priors": (overlap_priors, PRIOR_SQL),
    "chunk_actions": (chunk_actions, CHUNK_SQL),
    "round_trips": (round_trips, TRIPS_SQL),
    "carried": (carried, CARRIED_SQL),
    "silent_intervals": (silent_intervals, SILENT_SQL),
    "segment_stops": (segment_stops, STOPS_SQL),
    "sustained_unpaired": (sustained_unpaired, UNPAIRED_SQL),
}
