"""Queries of labels, lookups, counts, weights and samples over the other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetide.functions import text as X
from kinetide.operators import relational as R
from kinetide.operators import sampling as S
from kinetide.operators import temporal as T


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts_of(_read(spark, sf_dir, "lineitem"), "l_returnflag", ["A", "N", "R", "X"])


LABEL_COUNTS_SQL = "SELECT f AS l_returnflag, count(l_orderkey) AS n FROM (VALUES ('A'), ('N'), ('R'), ('X')) v(f) LEFT JOIN lineitem ON f = l_returnflag GROUP BY f"


def label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions made of turns by their role, put through the label rules."""
    rows = _read(spark, sf_dir, "conversations")
    verbs = F.array(*map(F.lit, ["Place cup in sink on left", "Put cup in sink", " move cup", "Open door", "close it", "Pick up cup", "wipe"]))
    said = F.element_at(verbs, (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7)) + 1).cast("int"))
    return rows.select("conv_id", "turn", X.label(said).alias("label"), X.shortened(X.squeezed(F.col("role")), 5).alias("short"))


LABEL_RULES_SQL = """SELECT conv_id, turn, ['place_on', 'place_in', 'move_to', 'open', 'close', 'pick_up_from', 'other'][((conv_id + turn) % 7) + 1] AS label,
CASE WHEN length(role) > 5 THEN substr(role, 1, 2) || '...' ELSE role END AS short FROM conversations"""


def cluster_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("name"))
    found = rows.groupBy(X.folded(F.col("name")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))
    return found


CLUSTER_SQL = "SELECT lower(trim(upper(p_name))) AS key, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1"


def mode_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mode(_read(spark, sf_dir, "part"), ["p_brand"], "p_type").withColumnRenamed("mode", "p_type")


MODE_SQL = "SELECT p_brand, arg_max(p_type, (n, p_type)) AS p_type, max(n) AS n FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY p_brand"


def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return R.majority(docs.select("doc_id", "lang").join(labels, "doc_id"), ["lang"], F.col("quality") == 1, "good", "poor")


MAJORITY_SQL = "SELECT lang, CASE WHEN sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) * 2 >= count(*) THEN 'good' ELSE 'poor' END AS vote FROM documents JOIN labels USING (doc_id) GROUP BY lang"


def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ordinals(_read(spark, sf_dir, "conversations"), ["conv_id", "role"], "turn").select("conv_id", "turn", "ordinal")


ORDINALS_SQL = """SELECT conv_id, turn, CASE WHEN count(*) OVER (PARTITION BY conv_id, role) >= 2 THEN
'(' || row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) || '/' || count(*) OVER (PARTITION BY conv_id, role) || ')' END AS ordinal FROM conversations"""


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents")
    return R.first_of(rows.select("doc_id", F.sha2("text", 256).alias("h")), ["h"], "doc_id").select("doc_id")


DEDUP_SQL = "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text"


def shard_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")
    return R.counts_of(rows, "l_returnflag", ["A", "N", "R", "X"], total=F.sum("l_quantity"))


MANIFEST_SQL = "SELECT f AS l_returnflag, count(l_orderkey) AS n, sum(l_quantity) AS total FROM (VALUES ('A'), ('N'), ('R'), ('X')) v(f) LEFT JOIN lineitem ON f = l_returnflag GROUP BY f"


def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").rollup("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


ROLLUP_SQL = "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ROLLUP (user_id, event_type)"


def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(_read(spark, sf_dir, "labels"), "doc_id", "left")
    rules = {"unlabelled": F.col("quality").isNull(), "toxic": F.col("toxic") == 1, "short": F.col("n_chars") < 200}
    return R.by_reason(docs, rules)


REASONS_SQL = """SELECT CASE WHEN quality IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 200 THEN 'short' ELSE 'kept' END AS reason, count(*) AS n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"""


def lookup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation of every customer, from all nations."""
    customers, nations = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "nation")
    found = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return found.select("c_custkey", F.coalesce("n_name", F.lit("UNMAPPED")).alias("nation"))


LOOKUP_ALL_SQL = "SELECT c_custkey, coalesce(n_name, 'UNMAPPED') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"


def semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that have lines of more than 49 pieces."""
    lines = _read(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_orderkey")
    return _read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


SEMI_SQL = "SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)"


def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", "lang").join(_read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


ANTI_MISSING_SQL = "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.class_weights(_read(spark, sf_dir, "events"), "event_type", 0.5)
    return found.select("event_type", "n", F.round("raw", 9).alias("raw"), F.round("weight", 6).alias("weight"))


WEIGHTS_SQL = """WITH c AS (SELECT event_type, count(*) AS n, pow(1.0 / count(*), 0.5) AS raw FROM events GROUP BY 1)
SELECT event_type, n, round(raw, 9) AS raw, round(raw * (sum(n) OVER ()) / (sum(n * raw) OVER ()), 6) AS weight FROM c"""


def inverse_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.inverse_frequency(_read(spark, sf_dir, "events"), "user_id").select("event_id", F.round("weight", 9).alias("weight"))


INVERSE_SQL = "SELECT event_id, round(1.0 / count(*) OVER (PARTITION BY user_id), 9) AS weight FROM events"


def task_balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.task_balanced(_read(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value"), "event_type", "user_id", "value")
    return found.select("event_id", F.round("balanced", 5).alias("balanced"))


BALANCED_SQL = """WITH t AS (SELECT event_type, user_id, sum(value) AS t FROM events WHERE value > 0 GROUP BY 1, 2),
h AS (SELECT *, (sum(t) OVER (PARTITION BY event_type)) / (count(*) OVER (PARTITION BY event_type)) / t AS k FROM t)
SELECT event_id, round(CASE WHEN value > 0 THEN value * k ELSE value END, 5) AS balanced FROM events LEFT JOIN h USING (event_type, user_id)"""


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def mixture_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mixture(_types(spark, sf_dir), "event_type", "n").withColumn("p", F.round("p", 9))


MIXTURE_SQL = "SELECT event_type, round(pow(count(*), 0.4) / sum(pow(count(*), 0.4)) OVER (), 9) AS p FROM events GROUP BY event_type"


def apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.apportioned(_types(spark, sf_dir), "event_type", "n", 48)


APPORTION_SQL = """WITH c AS (SELECT event_type, count(*) * 48.0 / (sum(count(*)) OVER ()) AS raw FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY raw - floor(raw) DESC, event_type) AS k, 48 - (sum(greatest(1, floor(raw))) OVER ()) AS rest FROM c)
SELECT event_type, CAST(greatest(1, floor(raw)) + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS slots FROM r"""


def weighted_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every user one customer order of its bucket, drawn by price; the draws are a fixed function of the key."""
    orders = _read(spark, sf_dir, "orders").select(F.pmod("o_custkey", F.lit(50)).alias("bucket"), "o_orderkey", F.round("o_totalprice").alias("w"))
    draws = spark.range(200).select((F.col("id") % 50).alias("bucket"), "id", ((F.col("id") * 37 % 101) / 101.5 + 0.001).alias("u"))
    return S.weighted_pick(orders, "bucket", "o_orderkey", "w", draws, "u", F.floor(F.col("o_orderkey") / 20_000)).select("id", F.col("picked").alias("o_orderkey"))


PICK_SQL = """WITH o AS (SELECT o_custkey % 50 AS bucket, o_orderkey, round(o_totalprice) AS w FROM orders),
c AS (SELECT *, sum(w) OVER (PARTITION BY bucket ORDER BY o_orderkey) AS high, sum(w) OVER (PARTITION BY bucket) AS total FROM o),
d AS (SELECT id % 50 AS bucket, id, (id * 37 % 101) / 101.5 + 0.001 AS u FROM range(200) t(id))
SELECT id, arg_max(o_orderkey, high) AS o_orderkey FROM d JOIN c ON d.bucket = c.bucket AND (high - w) / total <= u GROUP BY id"""


def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands are experts, their parts' number the budget of steps, with eight slots a step."""
    budgets = _read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("expert")).agg(F.count(F.lit(1)).alias("budget"))
    return S.curriculum(budgets, "expert", "budget", 8)


PLAN_SQL = "SELECT p_brand AS expert, step, slot FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), unnest(range(0, n)) s(step), range(0, 8) t(slot)"


def whole_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.batches(_read(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 16).select("event_id", "batch")


BATCHES_SQL = """SELECT event_id, (r // 16) AS batch FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
WHERE r < n // 16 * 16"""


def half_even_2dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quarters of values, many of which lie halfway in decimals, to two digits, and tenths to none."""
    return _read(spark, sf_dir, "events").select("event_id", X.half_even(F.col("value") * 10).alias("tenths"), X.half_even_exact(F.col("value") / 4, 2).alias("quarters"))


HALF_SQL = "SELECT event_id, round_even(value * 10, 0) AS tenths, CAST(printf('%.2f', value / 4) AS DOUBLE) AS quarters FROM events"


def attempt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive turns of a role by conversation."""
    rows = _read(spark, sf_dir, "conversations")
    return T.islands(rows, ["conv_id"], "turn", F.col("role") == "user").select("conv_id", "first", "last", "n")


OUTCOMES_SQL = """WITH a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
b AS (SELECT *, r - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM a WHERE role = 'user')
SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS n FROM b GROUP BY conv_id, g"""


def subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.subset(_read(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 0.1)


def stratified_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 batches of 48 slots by apportionment, drawn within each event type by value."""
    counts = {r["event_type"]: r["n"] for r in _types(spark, sf_dir).orderBy("event_type").collect()}  # a row for each class
    slots = dict(zip(counts, S.apportion([float(n) for n in counts.values()], 48), strict=True))
    draws = S.draws(spark, slots, 100, seed=7)
    items = _read(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "event_id", "value")
    return S.weighted_pick(items, "key", "event_id", "value", draws, "u", F.floor(F.col("event_id") / 20_000)).select("batch", "key", "slot", F.col("picked").alias("event_id"))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fault of an order's line, one row each; rows without one are not listed."""
    rows = _read(spark, sf_dir, "lineitem")
    checks = {"small": F.col("l_quantity") < 2, "dear": F.col("l_extendedprice") > 90_000, "late": F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp")}
    return R.faults(rows, checks, ["l_orderkey", "l_linenumber"])


FAULTS_SQL = """SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN l_quantity < 2 THEN 'small' END, CASE WHEN l_extendedprice > 90000 THEN 'dear' END,
CASE WHEN l_shipdate >= TIMESTAMP '2001-06-01' THEN 'late' END], lambda x: x IS NOT NULL)) AS fault FROM lineitem"""


def same_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What only one of two tables has."""
    a = _read(spark, sf_dir, "documents").select("doc_id")
    return R.set_difference(a, _read(spark, sf_dir, "labels").select("doc_id"))


SETS_SQL = "(SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) UNION ALL (SELECT doc_id, 'right' AS side FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents))"


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's place in the whole, from its place within its user and the users' offsets."""
    return R.global_offsets(_read(spark, sf_dir, "events"), ["user_id"], "event_id").select("event_id", "place")


OFFSETS_SQL = "SELECT event_id, row_number() OVER (ORDER BY user_id, event_id) - 1 AS place FROM events"


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are episodes of their lines; each line's place among all leads back to its place in its order."""
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    lines = R.global_offsets(rows, ["l_orderkey"], "l_linenumber").withColumn("place", F.col("place").cast("bigint"))
    dealt = rows.select("l_orderkey").repartition(R.tasks(rows.count()), "l_orderkey")  # a task's counts don't grow with the table
    sizes = dealt.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return R.located(lines, "place", sizes, ["l_orderkey"], "n").groupBy("l_orderkey").agg(F.max("local").alias("last"), F.sum("local").alias("total"), F.min("place").alias("start"))


LOCATED_SQL = """WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, n - 1 AS last, n * (n - 1) // 2 AS total, CAST(coalesce(sum(n) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s"""


def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each user's path through the first 60 values, and its mean."""
    rows = _read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("at"), "value")
    return R.path_lengths(rows, ["user_id"], "at", "value", 60).select("user_id", F.round("path", 6).alias("path"), F.round("mean", 6).alias("mean"))


PATH_SQL = """WITH a AS (SELECT user_id, value, row_number() OVER w AS r, lag(value) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, round(sum(coalesce(abs(value - p), 0)), 6) AS path, round(avg(value), 6) AS mean FROM a WHERE r <= 60 GROUP BY user_id"""


QUERIES = {
    "label_counts": (label_counts, LABEL_COUNTS_SQL),
    "label_rules": (label_rules, LABEL_RULES_SQL),
    "cluster_exact": (cluster_exact, CLUSTER_SQL),
    "mode_tiebreak": (mode_tiebreak, MODE_SQL),
    "majority_vote": (majority_vote, MAJORITY_SQL),
    "ordinals": (ordinals, ORDINALS_SQL),
    "dedup_first": (dedup_first, DEDUP_SQL),
    "shard_manifest": (shard_manifest, MANIFEST_SQL),
    "rollup_counts": (rollup_counts, ROLLUP_SQL),
    "drop_reasons": (drop_reasons, REASONS_SQL),
    "lookup_all": (lookup_all, LOOKUP_ALL_SQL),
    "semi_filter": (semi_filter, SEMI_SQL),
    "anti_missing": (anti_missing, ANTI_MISSING_SQL),
    "class_weights": (class_weights, WEIGHTS_SQL),
    "inverse_frequency": (inverse_frequency, INVERSE_SQL),
    "task_balanced_weights": (task_balanced_weights, BALANCED_SQL),
    "mixture_probs": (mixture_probs, MIXTURE_SQL),
    "apportion": (apportion, APPORTION_SQL),
    "weighted_pick": (weighted_pick, PICK_SQL),
    "batch_plan": (batch_plan, PLAN_SQL),
    "whole_batches": (whole_batches, BATCHES_SQL),
    "half_even_2dp": (half_even_2dp, HALF_SQL),
    "attempt_outcomes": (attempt_outcomes, OUTCOMES_SQL),
    "validated": (validated, FAULTS_SQL),
    "same_sets": (same_sets, SETS_SQL),
    "offsets": (offsets, OFFSETS_SQL),
    "located": (located, LOCATED_SQL),
    "path_length": (path_length, PATH_SQL),
    "subset": (subset, None),
    "stratified_draws": (stratified_draws, None),
}
