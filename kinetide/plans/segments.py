"""Queries of segments, shards, clusters and guards: orders are episodes, their lines are segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetide.functions import control as C
from kinetide.operators import sampling as S
from kinetide.operators import segments as G
from kinetide.operators import vectors as V

from .tables import _read

SAID = ["Place cup in sink on left", "Put cup in sink", " move cup", "Open door", "close it", "Pick up cup", " "]
LABELS = ["place_on", "place_in", "move_to", "open", "close", "pick_up_from", "other"]
HORIZON = 50


def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction for each order: its lines in order as segments of the compressed clock; frames by price. Orders grow as
    lines do, but two of their columns look small to the planner, which would broadcast them by the driver; so both are sorted."""
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.pmod("l_partkey", F.lit(7)) + 1).cast("int"))
    start = F.col("l_linenumber") * F.lit(2.0)
    seg = F.struct(F.col("l_linenumber").alias("segment_id"), start.alias("start_time_sec"), (start + F.col("l_quantity") / 10).alias("end_time_sec"), said.alias("skill_description"))
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(seg).alias("skill_timeline"))
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 400).alias("n_rows")).hint("merge")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.projected(timelines(spark, sf_dir), "skill_timeline", ["l_orderkey"], "n_rows", 5.0)


def _listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SAMPLES = f"""l AS (SELECT l_orderkey, l_linenumber, {_listed(SAID)}[(l_partkey % 7) + 1] AS d, {_listed(LABELS)}[(l_partkey % 7) + 1] AS c,
l_linenumber * 2.0::DOUBLE AS a, l_linenumber * 2.0::DOUBLE + l_quantity / 10 AS b, CAST(floor(o_totalprice / 400) AS BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT *, least(n, CAST(round_even(a * 5.0::DOUBLE * 30.0::DOUBLE, 0) AS BIGINT)) AS s, least(n, CAST(round_even(b * 5.0::DOUBLE * 30.0::DOUBLE, 0) AS BIGINT)) AS e FROM l WHERE length(trim(d)) > 0),
g AS (SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS segment_id, d, c, s, e, e - s AS n FROM f WHERE e > s)"""


def segment_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 to P3, P8, P9."""
    return samples(spark, sf_dir).select("sample_id", "skill_canonical", "skill_description", "start_idx", "end_idx", "n_frames", "short")


SAMPLES_SQL = f"""WITH {SAMPLES} SELECT CAST(l_orderkey AS VARCHAR) || '/' || segment_id AS sample_id, c AS skill_canonical, d AS skill_description, s AS start_idx, e AS end_idx,
n AS n_frames, n < 5 AS short FROM g"""


def frame_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each order's two videos from which a window may start, without the first hundred, which are
    there already."""
    rows = samples(spark, sf_dir).withColumns({"head": F.concat(F.lit("h"), F.col("l_orderkey")), "left": F.concat(F.lit("l"), F.col("l_orderkey"))})
    done = rows.select("head").distinct().select(F.col("head").alias("video"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(99).cast("bigint"))).alias("frame"))
    found = G.frame_jobs(rows, ["head", "left"], "start_idx", "end_idx", HORIZON, done)
    return found.groupBy("video").agg(F.count(F.lit(1)).alias("n"), F.sum("frame").alias("total"))


JOBS_SQL = f"""WITH {SAMPLES}, j AS (SELECT DISTINCT v || l_orderkey AS video, unnest(range(s, greatest(s, e - {HORIZON}) + 1)) AS frame FROM g, (VALUES ('h'), ('l')) t(v))
SELECT video, count(*) AS n, CAST(sum(frame) AS BIGINT) AS total FROM j WHERE NOT (video[1] = 'h' AND frame < 100) GROUP BY video"""


def segment_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.length_stats(samples(spark, sf_dir), "skill_canonical", "n_frames", HORIZON)
    return found.withColumn("mean", F.round("mean", 6))


LENGTHS_SQL = f"""WITH {SAMPLES} SELECT c AS skill_canonical, count(*) AS segments, CAST(sum(greatest(1, n - {HORIZON} + 1)) AS BIGINT) AS chunks, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most FROM g GROUP BY c"""


def episode_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are tasks, orders their episodes; every other order states its seconds."""
    stated = F.when(F.col("o_orderkey") % 2 == 0, F.round(F.col("o_totalprice") / 12_000, 2))
    rows = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 400).alias("n_rows"), stated.alias("seconds"))
    return G.duration_checks(rows, "o_custkey", "o_orderkey", "n_rows", "seconds").select("o_custkey", "o_orderkey", "expected", "ok")


DURATIONS_SQL = """WITH o AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice / 400) AS BIGINT) AS n, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice / 12000, 2) END AS s FROM orders),
f AS (SELECT *, CAST(floor(coalesce(s, n / 30.0::DOUBLE) * 30.0::DOUBLE) AS BIGINT) AS expected FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)
SELECT o_custkey, o_orderkey, expected, abs(n - expected) <= 2 AS ok FROM f"""


def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12, P14, P15."""
    rows = _read(spark, sf_dir, "part").withColumn("flag", F.col("p_retailprice") > 905)
    return G.selected(rows, {"p_brand": ["Brand#2", "Brand#11", "Brand#12", "Brand#13", "Brand#21"]}, {"p_type": "[A-P].*[AEIOU]?."}, "flag").select("p_partkey", "p_brand", "p_type")


MANIFEST_ROWS_SQL = "SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand IN ('Brand#2', 'Brand#11', 'Brand#12', 'Brand#13', 'Brand#21') AND regexp_full_match(p_type, '[A-P].*[AEIOU]?.') AND p_retailprice > 905"


def ordered_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the weight of its user, in the order of events."""
    events = _read(spark, sf_dir, "events").select(F.col("user_id").alias("sample"), F.col("event_id").alias("pos"))
    weights = events.groupBy("sample").agg((1.0 / F.count(F.lit(1))).alias("w"))
    return G.weights_in_order(events, weights, "sample", "pos", "w").select("pos", F.round("w", 9).alias("w"))


ORDERED_SQL = "SELECT event_id AS pos, round(1.0 / count(*) OVER (PARTITION BY user_id), 9) AS w FROM events"


def parent_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as segments of their order; the order's priority gives the type, and every third order has none."""
    kinds = F.when(F.col("o_orderkey") % 3 == 0, F.lit(None).cast("string")).when(F.col("o_orderpriority").startswith("1"), "navigation").otherwise("manipulation")
    activities = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("activity_id"), kinds.alias("activity_type"), F.lit(0).alias("pos"))
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.pmod("l_partkey", F.lit(7)) + 1).cast("int"))
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.col("l_orderkey").alias("parent"), said.alias("d"))
    found = G.parent_types(lines, activities.where("activity_type is not null"), ["k"], "parent", "activity_id", "activity_type", "pos", "d")
    return found.groupBy("k", "activity_type").agg(F.count(F.lit(1)).alias("n"))


PARENT_SQL = f"""WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderpriority LIKE '1%' THEN 'navigation' ELSE 'manipulation' END AS t FROM orders),
l AS (SELECT l_orderkey AS k, trim({_listed(SAID)}[(l_partkey % 7) + 1]) LIKE 'move%' AS travels FROM lineitem)
SELECT l.k, CASE WHEN travels THEN 'navigation' ELSE coalesce(t, 'manipulation') END AS activity_type, count(*) AS n FROM l LEFT JOIN a ON l.k = a.k GROUP BY 1, 2"""


def value_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.value_counts(_read(spark, sf_dir, "lineitem"), "l_shipdate", "l_orderkey").select(F.col("l_shipdate").cast("string").substr(1, 10).alias("day"), "n", "first")


VALUES_SQL = "SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS n, min(l_orderkey) AS first FROM lineitem GROUP BY l_shipdate"


def masked_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six heads, of which the last two never occur."""
    rows = _read(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(4)).cast("int").alias("h"), "value")
    found = G.masked_means(rows, "h", "value", list(range(6)))
    return found.select("head", "n", F.isnan("mean").alias("none"), F.round("filled", 6).alias("filled"))


MASKED_SQL = """WITH e AS (SELECT user_id % 4 AS h, value FROM events), m AS (SELECT h, count(*) AS n, avg(value) AS mean FROM e GROUP BY h)
SELECT CAST(v AS INT) AS head, coalesce(n, 0) AS n, mean IS NULL AS none, round(coalesce(mean, (SELECT avg(value) FROM e)), 6) AS filled FROM range(6) t(v) LEFT JOIN m ON h = v"""


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("user_id", "event_type", F.when(F.col("event_type") == "purchase", "complete").when(F.col("value") > 90, "failed").alias("outcome"))
    return G.run_summary(rows, ["user_id"], "outcome", "event_type")


SUMMARY_SQL = """SELECT user_id, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type <> 'purchase' AND value > 90) AS failed, count(*) AS ticks,
count(DISTINCT event_type) AS names, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT unnest(list_distinct(list(event_type))) AS x)) AS listed FROM events GROUP BY user_id"""


def timing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.timing_totals(_read(spark, sf_dir, "events"), ["user_id"], "event_type", "value", {"acted": ["click", "purchase"], "seen": ["view"]})
    return found.select("user_id", "calls", F.round("acted", 4).alias("acted"), F.round("seen", 4).alias("seen"))


TIMING_SQL = """SELECT user_id, count(*) AS calls, round(sum(CASE WHEN event_type IN ('click', 'purchase') THEN value ELSE 0.0 END), 4) AS acted,
round(sum(CASE WHEN event_type = 'view' THEN value ELSE 0.0 END), 4) AS seen FROM events GROUP BY user_id"""


def timestamp_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of vectors as chunks of eight timestamps by eight dimensions, over all, over each timestamp, over each
    label and over both, in one pass."""
    rows = _read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("p", "x")).select("label", F.floor(F.col("p") / 8).cast("int").alias("t"), (F.col("p") % 8).alias("dim"), F.col("x").cast("double").alias("x"))
    found = V.timestamp_set_stats(rows, "t", ["label"])
    return found.select("dim", "t", "label", "all_t", "total", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "lo", "hi")


TIMESTAMP_SQL = """WITH r AS (SELECT label, CAST(floor((p - 1) / 8) AS INT) AS t, CAST((p - 1) % 8 AS INT) AS dim, CAST(embedding[p] AS DOUBLE) AS x FROM embeddings, range(1, 65) q(p))
SELECT dim, t, label, grouping(t) = 1 AS all_t, grouping(label) = 1 AS total, count(*) AS n, round(avg(x), 6) AS mean, round(sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)), 6) AS std, min(x) AS lo, max(x) AS hi
FROM r GROUP BY GROUPING SETS ((dim), (dim, t), (dim, label), (dim, t, label)) HAVING count(*) >= 2"""


def timestamp_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: the same chunks, scaled by the statistics of their label and timestamp; sums by label and dimension."""
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("p", "x")).select("vec_id", "label", F.floor(F.col("p") / 8).cast("int").alias("t"), (F.col("p") % 8).alias("dim"), F.col("x").cast("double").alias("x"))
    stats = rows.groupBy(F.col("label").alias("sl"), F.col("t").alias("st"), F.col("dim").alias("sd")).agg(*V.moments())
    both = rows.join(stats, (F.col("label") == F.col("sl")) & (F.col("t") == F.col("st")) & (F.col("dim") == F.col("sd")))
    return both.select("vec_id", "t", "dim", F.round(V.z_score(F.col("x"), F.col("mean"), F.col("std")), 4).alias("y"))


NORMALIZE_SQL = """WITH r AS (SELECT vec_id, label, CAST(floor((p - 1) / 8) AS INT) AS t, CAST((p - 1) % 8 AS INT) AS dim, CAST(embedding[p] AS DOUBLE) AS x FROM embeddings, range(1, 65) q(p))
SELECT vec_id, t, dim, round((x - avg(x) OVER w) / (sqrt(greatest(avg(x * x) OVER w - (avg(x) OVER w) * (avg(x) OVER w), 0)) + 1e-6), 4) AS y FROM r WINDOW w AS (PARTITION BY label, t, dim)"""


def cluster_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are items; lines name them, some twice. Lines of every seventh part name one that does not exist instead, so
    those are never named."""
    named = _read(spark, sf_dir, "lineitem").select(F.when(F.col("l_partkey") % 7 == 0, -1 - F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("item"))
    return G.cluster_faults(named, _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item")), "item")


FAULTS_SQL = """WITH n AS (SELECT item, count(*) AS n FROM (SELECT CASE WHEN l_partkey % 7 = 0 THEN -1 - l_partkey ELSE l_partkey END AS item FROM lineitem) GROUP BY item)
SELECT CASE WHEN p_partkey IS NULL THEN 'unknown' WHEN item IS NULL THEN 'missing' ELSE 'duplicate' END AS fault, coalesce(item, p_partkey) AS item
FROM n FULL JOIN part ON item = p_partkey WHERE p_partkey IS NULL OR item IS NULL OR n > 1"""

NAMES = ["Release", " move to", "grab", "place in", "OPEN", "noise", ""]
MEANS = ["drop into bin", "walk", "grab cup", "put in box", "open", "set on top", "wave"]


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.pmod("p_partkey", F.lit(7)) + 1).cast("int")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), k)
    kind = F.when(F.col("p_size") > 25, "navigation").otherwise("manipulation")
    return _read(spark, sf_dir, "part").select("p_partkey", pick(NAMES).alias("name"), pick(MEANS).alias("said"), kind.alias("kind"))


NAMED = f"""p AS (SELECT p_partkey, {_listed(NAMES)}[(p_partkey % 7) + 1] AS name, {_listed(MEANS)}[(p_partkey % 7) + 1] AS said, CASE WHEN p_size > 25 THEN 'navigation' ELSE 'manipulation' END AS kind FROM part)"""


def clusters_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each cluster, ascending."""
    found = G.clusters_merged(_named(spark, sf_dir), "name", "kind", "p_partkey", "said", {"grab": "pick up from"}, ["noise"])
    return found.select("name", "kind", "n", F.sha2(F.array_join(F.transform("members", lambda x: x.cast("string")), ","), 256).alias("members"))


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each member of a cluster, with the cluster's size."""
    return G.cluster_members(_named(spark, sf_dir), "name", "kind", "p_partkey", "said", {"grab": "pick up from"}, ["noise"])


MERGED_SQL = f"""WITH {NAMED}, m AS (SELECT p_partkey, kind, CASE lower(trim(name)) WHEN 'release' THEN 'place in' WHEN 'noise' THEN 'place on' WHEN 'grab' THEN 'pick up from' WHEN '' THEN 'other' ELSE lower(trim(name)) END AS name FROM p)
SELECT name, kind, count(*) AS n, sha256(string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey)) AS members FROM m GROUP BY name, kind"""


MEMBERS_SQL = f"""WITH {NAMED}, m AS (SELECT p_partkey, kind, CASE lower(trim(name)) WHEN 'release' THEN 'place in' WHEN 'noise' THEN 'place on' WHEN 'grab' THEN 'pick up from' WHEN '' THEN 'other' ELSE lower(trim(name)) END AS name FROM p)
SELECT name, kind, p_partkey, count(*) OVER (PARTITION BY name, kind) AS n FROM m"""


def fallback_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, kind = G.fallback_cluster(F.col("said"), F.col("kind"))
    return _named(spark, sf_dir).select("p_partkey", name.alias("cluster"), kind.alias("type"))


FALLBACK_SQL = f"""WITH {NAMED} SELECT p_partkey, CASE said WHEN 'drop into bin' THEN 'place in' WHEN 'walk' THEN CASE kind WHEN 'navigation' THEN 'move to' ELSE 'pick up from' END WHEN 'grab cup' THEN 'pick up from'
WHEN 'put in box' THEN 'place in' WHEN 'open' THEN 'open' ELSE CASE kind WHEN 'navigation' THEN 'move to' ELSE 'pick up from' END END AS cluster,
CASE WHEN said IN ('drop into bin', 'grab cup', 'put in box', 'open') THEN 'manipulation' ELSE kind END AS type FROM p"""


def slot_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are batches, their first 24 events the slots; a slot's class is right but where the value is high."""
    rows = _read(spark, sf_dir, "events").select("user_id", "event_id", "value").withColumn("slot", F.row_number().over(S.Window.partitionBy("user_id").orderBy("event_id")) - 1).where("slot < 24")
    rows = rows.withColumn("expert", F.when(F.col("value") > 90, 2).otherwise(F.floor(F.col("slot") / 8)).cast("int"))
    return G.slot_faults(rows, "user_id", "slot", "expert", [8, 8, 8]).withColumn("expected", F.col("expected").cast("int"))


GUARD_SQL = """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS slot FROM events)
SELECT user_id, CAST(slot // 8 AS INT) AS expected, count(*) AS bad FROM r WHERE slot < 24 AND slot // 8 <> CASE WHEN value > 90 THEN 2 ELSE slot // 8 END GROUP BY 1, 2"""


RECIPES = (*[f"NATION_{k}" for k in range(20)], "MARS")


def recipe_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are the sources of nations' recipes, some of them without an account, and share their tens of a balance."""
    rows = _read(spark, sf_dir, "supplier").join(_read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    source = F.floor(F.col("s_acctbal") / 10).cast("string")
    rows = rows.select("n_name", source.alias("source"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("path"), F.lit("b").alias("base"), F.col("n_regionkey").alias("mode"))
    return G.recipe_faults(rows, "n_name", RECIPES, ["base", "mode"], ["path"], "source")


RECIPE_SQL = f"""WITH r AS (SELECT n_name, CAST(CAST(floor(s_acctbal / 10) AS BIGINT) AS VARCHAR) AS source, CASE WHEN s_acctbal > 0 THEN s_name END AS path, 'b' AS base, CAST(n_regionkey AS VARCHAR) AS mode FROM supplier JOIN nation ON s_nationkey = n_nationkey),
k AS (SELECT unnest({_listed(RECIPES)}) AS name)
SELECT 'unknown' AS fault, n_name AS what FROM r WHERE n_name NOT IN (SELECT name FROM k) GROUP BY n_name UNION ALL SELECT 'missing', name FROM k WHERE name NOT IN (SELECT n_name FROM r)
UNION ALL SELECT 'null', n_name || '.path' FROM r WHERE path IS NULL UNION ALL SELECT 'differs', c FROM (SELECT unnest(['base', 'mode']) AS c, unnest([base, mode]) AS v FROM r) GROUP BY c HAVING count(DISTINCT v) > 1
UNION ALL SELECT 'shared', source FROM r GROUP BY source HAVING count(DISTINCT n_name) > 1"""


def first_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the hundred smallest parts by size, type and key."""
    return S.first_rows(_read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type"), ["p_size", "p_type", "p_partkey"], 100)


FIRST_SQL = "SELECT p_partkey, p_size, p_type FROM part ORDER BY p_size, p_type, p_partkey LIMIT 100"


def timeline_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timelines of which those that hold a line of 50 pieces lack its time, and those of small orders are null."""
    seg = F.struct(F.col("l_linenumber").alias("segment_id"), F.when(F.col("l_quantity") < 50, F.col("l_quantity")).alias("start_time_sec"), F.lit(1.0).alias("end_time_sec"))
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(seg).alias("t"), F.sum("l_quantity").alias("q"))
    return G.timeline_faults(rows.withColumn("t", F.when(F.col("q") > 20, F.col("t"))), ["l_orderkey"], "t")


TIMELINE_SQL = "SELECT l_orderkey, CASE WHEN sum(l_quantity) <= 20 THEN 'no timeline' ELSE 'no times' END AS fault FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) <= 20 OR max(l_quantity) >= 50"


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """verdicts in odd spelling, with followups, gaps and observations by event."""
    said = F.element_at(F.array(*map(F.lit, [" Complete ", "error", "done"])), (F.pmod("event_id", F.lit(3)) + 1).cast("int"))
    then = F.when(F.col("event_id") % 2 == 0, "NEXT").otherwise("later")
    stage = F.when(F.col("event_type") == "click", "pick").otherwise("open")
    v = C.verdict_of(said, then, stage, F.col("value"), F.pmod("user_id", F.lit(4)))
    return _read(spark, sf_dir, "events").select("event_id", v["verdict"].alias("verdict"), v["followup"].alias("followup"))


VERDICTS_SQL = """WITH e AS (SELECT *, event_id % 3 = 0 AND (user_id % 4 < 3 OR (event_type = 'click' AND value <= 5)) AS weak FROM events)
SELECT event_id, CASE WHEN weak THEN 'incomplete' WHEN event_id % 3 = 0 THEN 'complete' WHEN event_id % 3 = 1 THEN 'error' ELSE 'incomplete' END AS verdict,
CASE WHEN weak THEN 'retry' WHEN event_id % 2 = 0 THEN 'next' ELSE '' END AS followup FROM e"""


def action_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds, budgets, retries, gripper words and modes by event."""
    stage = F.element_at(F.array(*map(F.lit, ["pick_up_from", "pnp", "open_close", "move_to", "manipulate", "close"])), (F.pmod("event_id", F.lit(6)) + 1).cast("int"))
    prompt = F.when(F.col("user_id") % 2 == 0, "Place it").otherwise("Stir it")
    kind = C.action_kind(stage, prompt)
    steps = F.pmod("user_id", F.lit(7)) + 1
    return _read(spark, sf_dir, "events").select(
        "event_id", kind.alias("kind"), C.step_budget(F.col("value"), steps).alias("budget"), C.retry_budget(kind, F.pmod("user_id", F.lit(4))).cast("int").alias("retries"),
        C.gripper_word(F.col("value") / 50 - 1).alias("grip"), C.inference_mode(F.col("value"), F.col("user_id"), 60, 500.0).alias("mode"), C.expert_of(stage, F.when(F.col("value") > 50, 9), {"move_to": 0, "close": 5}).alias("expert"),
    )


ACTION_SQL = """WITH e AS (SELECT *, event_id % 6 AS k, user_id % 2 = 0 AS even, value / 50 - 1 AS g FROM events),
f AS (SELECT *, CASE k WHEN 0 THEN 'pick' WHEN 1 THEN CASE WHEN even THEN 'place' ELSE 'pick' END WHEN 2 THEN CASE WHEN even THEN 'switch' ELSE 'action' END WHEN 3 THEN 'navigate' WHEN 4 THEN 'action' ELSE 'close' END AS kind FROM e),
c AS (SELECT *, CASE kind WHEN 'navigate' THEN 1 WHEN 'action' THEN 1 ELSE 2 END AS cap FROM f)
SELECT event_id, kind, CAST(greatest(1, ceil(value * 5 / (user_id % 7 + 1))) AS BIGINT) AS budget, CAST(CASE WHEN user_id % 4 > 0 THEN least(user_id % 4, cap) ELSE cap END AS INT) AS retries,
CASE WHEN g > 0.6 THEN 'OPEN' WHEN g > 0 THEN 'PARTLY-OPEN' WHEN g > -0.6 THEN 'PARTLY-CLOSED' ELSE 'CLOSED' END AS grip, CASE WHEN value > 60 OR user_id > 500 THEN 'frames' ELSE 'full_video' END AS mode,
CAST(CASE WHEN value > 50 THEN 9 WHEN k = 3 THEN 0 WHEN k = 5 THEN 5 END AS INT) AS expert FROM c"""


def subtasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subtasks from JSON, flat or wrapped, by turn."""
    flat = F.concat(F.lit('{"id": "t'), F.col("turn"), F.lit('", "prompt": " go '), F.col("role"), F.lit(' ", "stage_hint": " MOVE_to", "plan_sketch": [" a ", "", "'), F.col("role"), F.lit('"]}'))
    c = F.when(F.col("turn") % 2 == 0, flat).otherwise(F.concat(F.lit('{"subtask": '), flat, F.lit("}")))
    s = C.subtask(c)
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", s["id"].alias("id"), s["prompt"].alias("prompt"), s["stage_hint"].alias("stage_hint"), F.array_join(s["plan_sketch"], "|").alias("sketch"))


#: Its JSON as text, read by the other engine's own JSON functions.
SUBTASK_SQL = """WITH j AS (SELECT conv_id, turn, '{"id": "t' || turn || '", "prompt": " go ' || role || ' ", "stage_hint": " MOVE_to", "plan_sketch": [" a ", "", "' || role || '"]}' AS flat FROM conversations),
w AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN flat ELSE '{"subtask": ' || flat || '}' END AS c FROM j),
s AS (SELECT conv_id, turn, coalesce(json_extract(c, '$.subtask'), json(c)) AS s FROM w)
SELECT conv_id, turn, s->>'$.id' AS id, trim(s->>'$.prompt') AS prompt, lower(trim(s->>'$.stage_hint')) AS stage_hint, array_to_string(list_filter(list_transform(CAST(s->'$.plan_sketch' AS VARCHAR[]), lambda x: trim(x)), lambda x: x <> ''), '|') AS sketch FROM s"""


def video_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations and measured time scales of orders as videos."""
    v = C.video_context(F.col("frames"), F.lit(30.0), F.when(F.col("o_orderkey") % 3 > 0, F.col("frames") / 4), F.lit(25.0), 5.0)
    return _read(spark, sf_dir, "orders").withColumn("frames", F.floor("o_totalprice").cast("double")).select("o_custkey", v.alias("v")).groupBy("o_custkey").agg(F.count("v.compressed").alias("packed"), F.round(F.avg("v.source"), 3).alias("mean"), F.max("v.time_scale").alias("scale"))


VIDEO_SQL = """SELECT o_custkey, count(*) FILTER (o_orderkey % 3 > 0) AS packed, round(avg(round_even(floor(o_totalprice) / 30, 2)), 3) AS mean,
max(CASE WHEN o_orderkey % 3 > 0 THEN round_even((floor(o_totalprice) / 30) / (floor(o_totalprice) / 4 / 25), 2) ELSE 5.0 END) AS scale FROM orders GROUP BY o_custkey"""

QUERIES = {
    "segment_samples": (segment_samples, SAMPLES_SQL),
    "frame_jobs": (frame_jobs, JOBS_SQL),
    "segment_lengths": (segment_lengths, LENGTHS_SQL),
    "episode_durations": (episode_durations, DURATIONS_SQL),
    "manifest_rows": (manifest_rows, MANIFEST_ROWS_SQL),
    "ordered_weights": (ordered_weights, ORDERED_SQL),
    "parent_types": (parent_types, PARENT_SQL),
    "value_order": (value_order, VALUES_SQL),
    "masked_means": (masked_means, MASKED_SQL),
    "run_summary": (run_summary, SUMMARY_SQL),
    "timing_totals": (timing_totals, TIMING_SQL),
    "timestamp_stats": (timestamp_stats, TIMESTAMP_SQL),
    "timestamp_normalize": (timestamp_normalize, NORMALIZE_SQL),
    "cluster_faults": (cluster_faults, FAULTS_SQL),
    "clusters_merged": (clusters_merged, MERGED_SQL),
    "fallback_assigned": (fallback_assigned, FALLBACK_SQL),
    "slot_guard": (slot_guard, GUARD_SQL),
    "cluster_members": (cluster_members, MEMBERS_SQL),
    "recipe_faults": (recipe_faults, RECIPE_SQL),
    "first_parts": (first_parts, FIRST_SQL),
    "timeline_faults": (timeline_faults, TIMELINE_SQL),
    "verdicts": (verdicts, VERDICTS_SQL),
    "action_rules": (action_rules, ACTION_SQL),
    "subtasks": (subtasks, SUBTASK_SQL),
    "video_contexts": (video_contexts, VIDEO_SQL),
}
