"""Queries over the event table as trajectories: users are episodes, the clock is microseconds, values are signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetide.operators import temporal as T

SECOND = 1_000_000
HOUR = 3600 * SECOND


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, event_type, value and ``us``, the time in microseconds."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("user_id", "event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


E = "e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS us FROM events)"
HIGH = 50.0


def _high(c: str = "value") -> Column:
    return F.col(c) > HIGH


def island_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = T.islands(events(spark, sf_dir), ["user_id"], "us", _high(), least=3)
    return runs.select("user_id", F.col("first").alias("start_us"), F.col("last").alias("end_us"), "n")


ISLANDS = f"""{E}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) AS r FROM e),
b AS (SELECT *, r - row_number() OVER (PARTITION BY user_id ORDER BY us) AS g FROM a WHERE value > {HIGH})"""
ISLAND_SQL = f"""WITH {ISLANDS}
SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM b GROUP BY user_id, g HAVING count(*) >= 3"""


def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = T.islands(events(spark, sf_dir), ["user_id"], "us", _high())
    merged = T.merge_intervals(runs, ["user_id"], "first", "last", 12 * HOUR)
    return merged.select("user_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "parts")


MERGED = f"""{ISLANDS}, i AS (SELECT user_id, min(us) AS s, max(us) AS t FROM b GROUP BY user_id, g),
j AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY s) AS p FROM i),
k AS (SELECT *, sum(CASE WHEN p IS NULL OR s - p > {12 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s) AS m FROM j),
x AS (SELECT user_id, min(s) AS start_us, max(t) AS end_us, count(*) AS parts FROM k GROUP BY user_id, m)"""
MERGED_SQL = f"WITH {MERGED} SELECT * FROM x"


def edge_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.edges(events(spark, sf_dir), ["user_id"], "us", _high()).select("user_id", "event_id", "us", "direction")


EDGES = f"""d AS (SELECT *, value > {HIGH} AS v, lag(value > {HIGH}) OVER (PARTITION BY user_id ORDER BY us) AS p FROM e),
y AS (SELECT user_id, event_id, us, CASE WHEN v THEN 'up' ELSE 'down' END AS direction FROM d WHERE v <> p)"""
EDGE_SQL = f"WITH {E}, {EDGES} SELECT * FROM y"


def interval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: merged intervals with the number of edges within them."""
    spans = merged_intervals(spark, sf_dir)
    found = T.range_join(edge_transitions(spark, sf_dir).select("user_id", "us", "direction"), spans, ["user_id"], "us", "start_us", "end_us", 0, 7 * 24 * HOUR)
    return found.groupBy("user_id", "start_us", "end_us", "parts").agg(F.count_if(F.col("direction") == "up").alias("ups"), F.count_if(F.col("direction") == "down").alias("downs"))


REPORT_SQL = f"""WITH {MERGED}, {EDGES}
SELECT x.user_id, start_us, end_us, parts, count(*) FILTER (direction = 'up') AS ups, count(*) FILTER (direction = 'down') AS downs
FROM x JOIN y ON x.user_id = y.user_id AND y.us BETWEEN start_us AND end_us GROUP BY ALL"""


def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.adaptive_threshold(events(spark, sf_dir), ["event_type"], "value")
    return found.select("event_type", F.round("threshold", 6).alias("threshold"))


THRESHOLD_SQL = "SELECT event_type, round(greatest(quantile_cont(value, 0.3) FILTER (value > 0), 1e-4), 6) AS threshold FROM events GROUP BY event_type"


def motion_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.active_intervals(events(spark, sf_dir), ["user_id"], "us", "value", HOUR, 6 * HOUR)
    return found.select("user_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "parts")


MOTION_SQL = f"""WITH {E}, s AS (SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY us)), 0.0) AS speed FROM e),
h AS (SELECT user_id, greatest(coalesce(quantile_cont(speed, 0.3) FILTER (speed > 0), 1e-4), 1e-4) AS threshold FROM s GROUP BY user_id),
a AS (SELECT s.*, speed > threshold AS f, row_number() OVER (PARTITION BY s.user_id ORDER BY us) AS r FROM s JOIN h USING (user_id)),
b AS (SELECT *, r - row_number() OVER (PARTITION BY user_id ORDER BY us) AS g FROM a WHERE f),
i AS (SELECT user_id, min(us) AS s, max(us) AS t FROM b GROUP BY user_id, g HAVING max(us) - min(us) >= {HOUR}),
j AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY s) AS p FROM i),
k AS (SELECT *, sum(CASE WHEN p IS NULL OR s - p > {6 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s) AS m FROM j)
SELECT user_id, min(s) AS start_us, max(t) AS end_us, count(*) AS parts FROM k GROUP BY user_id, m"""


def index_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.index_percentiles(events(spark, sf_dir), ["user_id"], "value", {"p50": 0.5, "p90": 0.9})


PERCENTILE_SQL = """SELECT user_id, count(*) AS n, list_sort(list(value))[CAST(floor(count(*) * 0.5) AS INT) + 1] AS p50,
list_sort(list(value))[CAST(floor(count(*) * 0.9) AS INT) + 1] AS p90 FROM events GROUP BY user_id"""


def paired_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_ = lambda kind: F.col("event_type") == kind
    return T.paired(events(spark, sf_dir), ["user_id"], "us", is_("click"), is_("purchase"), 24 * HOUR).select("user_id", "event_id", "us", "closed")


PAIRED_SQL = f"""WITH {E}, l AS (SELECT *, lead(event_type) OVER w AS nt, lead(us) OVER w AS closed FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us))
SELECT user_id, event_id, us, closed FROM l WHERE event_type = 'click' AND nt = 'purchase' AND closed - us <= {24 * HOUR}"""


def sustained_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_ = lambda kind: F.col("event_type") == kind
    return T.sustained(events(spark, sf_dir), ["user_id"], "us", is_("click"), is_("purchase")).select("user_id", "event_id", "us", "closed")


SUSTAINED_SQL = f"""WITH {E}, l AS (SELECT *, first_value(CASE WHEN event_type = 'purchase' THEN us END IGNORE NULLS) OVER
(PARTITION BY user_id ORDER BY us ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closed FROM e)
SELECT user_id, event_id, us, closed FROM l WHERE event_type = 'click'"""


def asof_prev_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    left = rows.where("event_type = 'purchase'").select("user_id", "event_id", "us")
    right = rows.where("event_type = 'click'").select("user_id", "us", F.col("us").alias("click_us"))
    return T.asof_previous(left, right, ["user_id"], "us", "click_us", strict=True).withColumnRenamed("previous", "click_us")


ASOF_SQL = f"""WITH {E} SELECT user_id, event_id, us, click_us FROM (SELECT *, max(CASE WHEN event_type = 'click' THEN us END) OVER
(PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click_us FROM e) WHERE event_type = 'purchase'"""


def next_of_either_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every purchase, the next click of the other side of its pair; the side is a column."""
    rows = events(spark, sf_dir).select(F.floor(F.col("user_id") / 2).alias("pair"), F.pmod("user_id", F.lit(2)).alias("side"), "event_id", "event_type", "us")
    left = rows.where("event_type = 'purchase'").select("pair", "side", "event_id", "us")
    right = rows.where("event_type = 'click'").select("pair", (1 - F.col("side")).alias("side"), "us", F.col("us").alias("next_us"))
    return T.asof_next(left, right, ["pair", "side"], "us", "next_us").withColumnRenamed("following", "next_us")


EITHER_SQL = f"""WITH {E}, p AS (SELECT *, CAST(floor(user_id / 2) AS BIGINT) AS pair, user_id - 2 * CAST(floor(user_id / 2) AS BIGINT) AS side FROM e)
SELECT pair, side, event_id, us, (SELECT min(o.us) FROM p o WHERE o.event_type = 'click' AND o.pair = p.pair AND o.side <> p.side AND o.us > p.us) AS next_us
FROM p WHERE event_type = 'purchase'"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.islands(events(spark, sf_dir), ["user_id"], "us", _high(), least=2).select("user_id", F.col("first").alias("start_us"), F.col("last").alias("end_us"))


SPANS = f"{ISLANDS}, n AS (SELECT user_id, min(us) AS start_us, max(us) AS end_us FROM b GROUP BY user_id, g HAVING count(*) >= 2)"


def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = events(spark, sf_dir).where("event_type = 'click'").select("user_id", "event_id", "us")
    return T.range_join(points, _spans(spark, sf_dir), ["user_id"], "us", "start_us", "end_us", HOUR, 7 * 24 * HOUR)


RANGE_SQL = f"""WITH {SPANS} SELECT e.user_id, event_id, us, start_us, end_us FROM e JOIN n ON e.user_id = n.user_id AND us BETWEEN start_us - {HOUR} AND end_us + {HOUR}
WHERE event_type = 'click'"""


def anti_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = events(spark, sf_dir).where("event_type = 'click'").select("user_id", "event_id", "us")
    return T.range_join(points, _spans(spark, sf_dir), ["user_id"], "us", "start_us", "end_us", HOUR, 7 * 24 * HOUR, "left_anti")


ANTI_SQL = f"""WITH {SPANS} SELECT user_id, event_id, us FROM e WHERE event_type = 'click'
AND NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = e.user_id AND e.us BETWEEN start_us - {HOUR} AND end_us + {HOUR})"""


def frame_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", T.to_frame(F.col("value"), 30.0, n=F.lit(2000).cast("bigint")).alias("frame"))


FRAME_SQL = "SELECT event_id, least(2000, greatest(0, CAST(round_even(value * 30, 0) AS BIGINT))) AS frame FROM events"


def gap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.gaps(events(spark, sf_dir), ["user_id"], "us", "us", "us", 24 * HOUR).select("user_id", "event_id", "us", "gap")


GAP_SQL = f"WITH {E} SELECT user_id, event_id, us, gap FROM (SELECT *, (lead(us) OVER (PARTITION BY user_id ORDER BY us)) - us AS gap FROM e) WHERE gap > {24 * HOUR}"


def zero_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = T.islands(events(spark, sf_dir), ["user_id"], "us", _high())
    return runs.where(F.col("last") - F.col("first") < SECOND).select("user_id", F.col("first").alias("start_us"), F.col("last").alias("end_us"))


ZERO_SQL = f"WITH {ISLANDS} SELECT user_id, min(us) AS start_us, max(us) AS end_us FROM b GROUP BY user_id, g HAVING max(us) - min(us) < {SECOND}"


def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.forward_fill(events(spark, sf_dir), ["user_id"], "us", F.when(_high(), F.col("value")), "filled")
    return rows.select("event_id", "filled")


FILL_SQL = f"WITH {E} SELECT event_id, last_value(CASE WHEN value > {HIGH} THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us) AS filled FROM e"


def rolling_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.cumulative(events(spark, sf_dir), ["user_id"], "us", "value", "total")
    return rows.select("event_id", F.round("total", 4).alias("total"))


ROLLING_SQL = f"WITH {E} SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING), 4) AS total FROM e"


def first_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.first_stop(events(spark, sf_dir), ["user_id"], "us", ~_high(), 3)


STOP_SQL = f"""WITH {E}, m AS (SELECT user_id, us, min(CAST(value <= {HIGH} AS INT)) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS still,
max(CAST(value > {HIGH} AS INT)) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS moved FROM e)
SELECT user_id, min(us) AS stop FROM m WHERE still = 1 AND moved = 1 GROUP BY user_id"""


def debounced_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a run of high values reaches three, once for each run."""
    runs = T.islands(events(spark, sf_dir), ["user_id"], "us", _high(), least=3)
    rows = events(spark, sf_dir).select("user_id", "us")
    inside = T.range_join(rows, runs.select("user_id", F.col("first").alias("s"), F.col("last").alias("t")), ["user_id"], "us", "s", "t", 0, 7 * 24 * HOUR)
    nth = inside.withColumn("k", F.row_number().over(Window.partitionBy("user_id", "s").orderBy("us"))).where("k = 3")
    return nth.select("user_id", F.col("s").alias("start_us"), F.col("us").alias("confirmed_us"))


CONTACT_SQL = f"""WITH {ISLANDS}, c AS (SELECT user_id, g, us, row_number() OVER (PARTITION BY user_id, g ORDER BY us) AS k, min(us) OVER (PARTITION BY user_id, g) AS start_us FROM b)
SELECT user_id, start_us, us AS confirmed_us FROM c WHERE k = 3"""


def session_10m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: session windows of ten minutes by user."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    found = rows.groupBy("user_id", F.session_window("ts", "10 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return found.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n")


SESSION_SQL = f"""WITH {E}, s AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= {600 * SECOND} THEN 0 ELSE 1 END AS f FROM e),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY us) AS g FROM s)
SELECT user_id, min(us) AS start_us, max(us) AS last_us, count(*) AS n FROM g GROUP BY user_id, g"""


def coincidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one type by both users of a pair within six hours of the first."""
    rows = events(spark, sf_dir).select(F.floor(F.col("user_id") / 2).alias("pair"), "us", "event_type", "user_id")
    return T.coincidences(rows, ["pair"], "us", "event_type", "user_id", float(6 * HOUR))


def snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals whose ends move to the first purchase within them."""
    rows = events(spark, sf_dir)
    runs = T.islands(rows, ["user_id"], "us", _high(), least=2)
    segments = runs.select("user_id", F.col("first").alias("k"), (F.col("first") / HOUR).alias("s"), (F.col("last") / HOUR).alias("t"))
    stops = rows.where("event_type = 'purchase'").select("user_id", (F.col("us") / HOUR).alias("stop"))
    return T.snapped(segments, stops, ["user_id"], "k", "s", "t", 1.0, 48.0)


QUERIES = {
    "interval_report": (interval_report, REPORT_SQL),
    "island_intervals": (island_intervals, ISLAND_SQL),
    "merged_intervals": (merged_intervals, MERGED_SQL),
    "edge_transitions": (edge_transitions, EDGE_SQL),
    "adaptive_threshold": (adaptive_threshold, THRESHOLD_SQL),
    "motion_active": (motion_active, MOTION_SQL),
    "index_percentiles": (index_percentiles, PERCENTILE_SQL),
    "paired_events": (paired_events, PAIRED_SQL),
    "sustained_match": (sustained_match, SUSTAINED_SQL),
    "asof_prev_release": (asof_prev_release, ASOF_SQL),
    "next_of_either_side": (next_of_either_side, EITHER_SQL),
    "range_join": (range_join, RANGE_SQL),
    "anti_range": (anti_range, ANTI_SQL),
    "frame_alignment": (frame_alignment, FRAME_SQL),
    "gap_check": (gap_check, GAP_SQL),
    "zero_duration": (zero_duration, ZERO_SQL),
    "forward_fill": (forward_fill, FILL_SQL),
    "rolling_absolute": (rolling_absolute, ROLLING_SQL),
    "first_stop": (first_stop, STOP_SQL),
    "debounced_contact": (debounced_contact, CONTACT_SQL),
    "session_10m": (session_10m, SESSION_SQL),
    "coincidences": (coincidences, None),
    "snapped": (snapped, None),
}
