"""Queries of signal reports, planner repairs, codecs and mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetide.functions import codecs as K
from kinetide.operators import planning as P
from kinetide.operators import sampling as S
from kinetide.operators import signals as G

from .tables import _read
from .temporal import HOUR, E, events

TENTH = HOUR // 10


def signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two users are a run and its sides; tenths of an hour are tenths of a second. Clicks close a gripper and purchases open it;
    views are stops, sign-ups activity and errors silent spans, as long as their value says."""
    rows = events(spark, sf_dir).withColumn("run", F.floor(F.col("user_id") / 2))
    t = F.floor((F.col("us") - F.min("us").over(Window.partitionBy("run"))) / TENTH) / 10
    rows = rows.select("run", F.when(F.col("user_id") % 2 == 0, "left").otherwise("right").alias("side"), t.alias("t"), "event_type", "value", "event_id")
    grips = rows.where("event_type in ('click', 'purchase')").select("run", "side", "t", F.when(F.col("event_type") == "click", G.OPENING).otherwise(G.CLOSING).alias("direction"))
    kind = F.when(F.col("event_type") == "view", "stop").when(F.col("event_type") == "signup", "active").when(F.col("event_type") == "error", "silent")
    name = F.when(F.col("event_type") != "view", F.col("side")).when(F.col("event_id") % 2 == 0, F.concat(F.lit("cp"), F.col("event_id").cast("string")))
    return grips, rows.where("event_type not in ('click', 'purchase')").select("run", kind.alias("kind"), name.alias("name"), F.col("t").alias("start"), (F.col("t") + F.floor("value") / 10).alias("end"))


def signal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's report, line by line."""
    return G.lines(*signals(spark, sf_dir), ["run"]).select("run", F.col("place").cast("bigint").alias("place"), "section", "line")


LINES_SQL = f"""WITH {E}, r AS (SELECT user_id // 2 AS run, CASE WHEN user_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, floor((us - min(us) OVER (PARTITION BY user_id // 2)) / {TENTH}) / 10 AS t, event_type, value, event_id FROM e),
g AS (SELECT run, side, t, CASE event_type WHEN 'click' THEN 'open_to_close' ELSE 'close_to_open' END AS d FROM r WHERE event_type IN ('click', 'purchase')),
p AS (SELECT *, lead(d) OVER w AS nd, lead(t) OVER w AS nt, lag(d) OVER w AS pd, lag(t) OVER w AS pt FROM g WINDOW w AS (PARTITION BY run, side ORDER BY t, d)),
q AS (SELECT run, side, t, d, CASE WHEN d = 'open_to_close' AND nd = 'close_to_open' AND nt - t <= 2.0 THEN nt WHEN d = 'close_to_open' AND pd = 'open_to_close' AND t - pt <= 2.0 THEN pt END AS pair FROM p),
f AS (SELECT *, first_value(CASE WHEN d = 'close_to_open' THEN t END IGNORE NULLS) OVER (PARTITION BY run, side ORDER BY t, d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt, lag(d) OVER w AS pd, lag(t) OVER w AS pt FROM q WHERE pair IS NULL WINDOW w AS (PARTITION BY run, side ORDER BY t, d)),
s AS (SELECT run, side, t, d, printf('  (PAIRED with t=%.2fs)', pair) AS said FROM q WHERE pair IS NOT NULL UNION ALL
SELECT run, side, t, d, CASE WHEN d = 'open_to_close' AND nt IS NOT NULL THEN printf('  (held until t=%.2fs, grip duration %.1fs)', nt, nt - t) WHEN d = 'close_to_open' AND pd = 'open_to_close' THEN printf('  (matches grip that started at t=%.2fs, grip duration %.1fs)', pt, t - pt) ELSE '' END FROM f),
l AS (SELECT run, 3 AS k, 'grip' AS section, t, side AS name, printf('- t=%.2fs  %s gripper %s%s', t, side, d, said) AS line FROM s UNION ALL
SELECT run, CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, CASE event_type WHEN 'error' THEN 'silent' WHEN 'signup' THEN 'active' ELSE 'stop' END, t, CASE WHEN event_type <> 'view' THEN side WHEN event_id % 2 = 0 THEN 'cp' || event_id ELSE 'base_zero' END,
printf('- %s: [%.2fs - %.2fs]', CASE WHEN event_type <> 'view' THEN side WHEN event_id % 2 = 0 THEN 'cp' || event_id ELSE 'base_zero' END, t, t + floor(value) / 10) || CASE event_type WHEN 'view' THEN printf(' dur=%.2fs', t + floor(value) / 10 - t) ELSE '' END
FROM r WHERE event_type IN ('error', 'signup') OR (event_type = 'view' AND t + floor(value) / 10 - t >= 0.3::DOUBLE))
SELECT run, row_number() OVER (PARTITION BY run ORDER BY k, t, name, line) AS place, section, line FROM l"""


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as plans; burners, jaws, outcomes and intents by event and value."""
    rows = events(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("us")))
    k, b = F.col("event_id") % 7, F.col("event_id") % 3
    sketch = F.when(k.isin(2, 3, 6) & (b == 0), F.array(F.lit("Turn on the front left burner of the stove."), F.lit("Then wait"), F.lit("Turn on the front left burner of the stove.")))
    sketch = sketch.when(k.isin(2, 3, 6) & (b == 1), F.array(F.lit("Turn on the rear left burner of the stove."), F.lit("Turn on the center burner of the stove."))).otherwise(F.array(F.concat(F.lit("plan "), F.col("event_id").cast("string"))))
    prompt = F.when(k < 2, P.PICK).when(k.isin(2, 3, 6), P.PLACE).when(k == 4, "Turn on the stove.").otherwise("Navigate to the stove.")
    stage = F.when(k < 2, "pick_up_from").when(k.isin(2, 3, 6), "place_on").when(k == 4, "switch").otherwise("move_to")
    intent = F.when(F.col("event_id") % 29 == 0, "navigate").when(F.col("event_id") % 29 == 1, "spout")
    state = F.concat(F.array_repeat(F.lit(0.0), 14), F.array(F.floor("value") % 10 / 1000, F.lit(0.0)))
    return rows.select("user_id", "r", F.when(F.col("user_id") % 4 > 0, P.TASK).otherwise("Other").alias("task"), prompt.alias("prompt"), stage.alias("stage"), sketch.alias("sketch"), F.when(F.col("value") > 30, "failed").otherwise("complete").alias("outcome"), state.alias("state"), intent.alias("intent"))


def repaired_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F40."""
    made = P.repaired(plans(spark, sf_dir), ["user_id"], "r")
    return made.select("user_id", F.col("r").cast("bigint").alias("r"), "rule", "prompt", "stage", F.array_join("sketch", "|").alias("sketch"))


#: A walk: what is carried out at each row, from that of the row before.
PLANS_SQL = f"""WITH RECURSIVE {E}, a AS MATERIALIZED (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us) AS r, user_id % 4 > 0 AS mine, event_id % 7 AS k, event_id % 3 AS b, event_id, value > 30 AS failed, floor(value) % 10 <= 5 AS shut,
CASE event_id % 29 WHEN 0 THEN 'navigate' WHEN 1 THEN 'spout' END AS intent FROM e),
p AS MATERIALIZED (SELECT *, CASE WHEN k < 2 THEN '{P.PICK}' WHEN k IN (2, 3, 6) THEN '{P.PLACE}' WHEN k = 4 THEN 'Turn on the stove.' ELSE 'Navigate to the stove.' END AS prompt, CASE WHEN k < 2 THEN 'pick_up_from' WHEN k IN (2, 3, 6) THEN 'place_on' WHEN k = 4 THEN 'switch' ELSE 'move_to' END AS stage,
CASE WHEN k IN (2, 3, 6) AND b = 0 THEN ['Turn on the front left burner of the stove.', 'Then wait', 'Turn on the front left burner of the stove.'] WHEN k IN (2, 3, 6) AND b = 1 THEN ['Turn on the rear left burner of the stove.', 'Turn on the center burner of the stove.'] ELSE ['plan ' || event_id] END AS sketch FROM a),
x AS (SELECT user_id, 0::BIGINT AS r, NULL::VARCHAR AS rule, '' AS prompt, '' AS stage, []::VARCHAR[] AS sketch, false AS failed FROM (SELECT DISTINCT user_id FROM p) UNION ALL
SELECT user_id, r, rule, CASE rule WHEN 'recovery' THEN CASE intent WHEN 'navigate' THEN 'Navigate to the sink.' ELSE 'Move the spout to wash all locations of the sink basin.' END WHEN 'regrasp' THEN was_prompt WHEN 'burner' THEN burners[1] ELSE prompt END,
CASE rule WHEN 'recovery' THEN CASE intent WHEN 'navigate' THEN 'move_to' ELSE 'manipulate' END WHEN 'regrasp' THEN was_stage ELSE stage END,
CASE rule WHEN 'recovery' THEN [CASE intent WHEN 'navigate' THEN 'Navigate to the sink.' ELSE 'Move the spout to wash all locations of the sink basin.' END] WHEN 'regrasp' THEN was_sketch WHEN 'burner' THEN burners ELSE sketch END, failed
FROM (SELECT *, CASE WHEN intent IS NOT NULL THEN 'recovery' WHEN mine AND r > 1 AND was_failed AND was_stage = 'pick_up_from' AND was_prompt = '{P.PICK}' AND prompt = '{P.PLACE}' AND shut THEN 'regrasp' WHEN mine AND r > 1 AND NOT was_failed AND was_stage = 'place_on' AND stage = 'switch' AND len(burners) = 1 THEN 'burner' END AS rule
FROM (SELECT p.*, x.prompt AS was_prompt, x.stage AS was_stage, x.sketch AS was_sketch, x.failed AS was_failed, list_distinct(list_filter(x.sketch, lambda s: s LIKE 'Turn on % burner%')) AS burners FROM x JOIN p ON p.user_id = x.user_id AND p.r = x.r + 1)))
SELECT user_id, r, rule, prompt, stage, array_to_string(sketch, '|') AS sketch FROM x WHERE r > 0"""


def action_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eight steps of four numbers as cosine tokens and back, five numbers as a code and back, and a prompt."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    chunk = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.transform(F.slice(v, t * 4 + 1, 4), lambda x: x * 4))
    levels = K.LEVELS[2**12]
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", K.cosine_tokens(chunk, 8, 4).alias("tokens"), K.code_of(F.transform(F.slice(v, 33, 5), lambda x: x * 3), levels).alias("code"), K.state_prompt(F.concat(F.lit(" Move_TO shelf "), F.col("label").cast("string")), F.slice(v, 38, 4)).alias("prompt"))
    rows = rows.withColumn("back", K.cosine_chunk(F.col("tokens"), 8, 4))
    text = lambda a, digits: F.array_join(F.transform(a, lambda x: F.round(x * 10**digits).cast("bigint").cast("string")), ",")
    return rows.select("vec_id", F.array_join(F.transform("tokens", lambda x: x.cast("string")), ",").alias("tokens"), (K.cosine_tokens(F.col("back"), 8, 4) == F.col("tokens")).alias("same"), text(F.flatten("back"), 4).alias("back"), "code", F.array_join(F.transform(K.digits_of(F.col("code"), levels), lambda x: x.cast("string")), ",").alias("digits"), text(K.values_of(F.col("code"), levels), 6).alias("numbers"), "prompt")


_COS = "sqrt((CASE WHEN {k} = 0 THEN 1 ELSE 2 END) / 8.0::DOUBLE) * cos(pi() * (2 * {t} + 1) * ({k}) / 16)"
CODES_SQL = f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
t AS (SELECT vec_id, label, v, list_transform(range(0, 32), lambda i: CAST(round_even(10 * list_sum(list_transform(range(0, 8), lambda t: 4 * v[t * 4 + i % 4 + 1] * {_COS.format(k="i // 4", t="t")})), 0) AS BIGINT)) AS tokens,
list_transform(range(1, 6), lambda d: CAST(round_even((greatest(-1, least(1, v[d + 32] * 3)) + 1) * ([7, 5, 5, 5, 5][d] - 1) / 2, 0) AS BIGINT)) AS digits FROM v),
b AS (SELECT *, list_transform(range(0, 32), lambda i: list_sum(list_transform(range(0, 8), lambda k: tokens[k * 4 + i % 4 + 1] / 10 * {_COS.format(k="k", t="(i // 4)")}))) AS back FROM t)
SELECT vec_id, array_to_string(tokens, ',') AS tokens, true AS same, array_to_string(list_transform(back, lambda x: CAST(CAST(round(x * 1e4) AS BIGINT) AS VARCHAR)), ',') AS back,
digits[1] + 7 * digits[2] + 35 * digits[3] + 175 * digits[4] + 875 * digits[5] AS code, array_to_string(digits, ',') AS digits, array_to_string(list_transform(range(1, 6), lambda d: CAST(CAST(round((digits[d] / ([7, 5, 5, 5, 5][d] - 1) * 2 - 1) * 1e6) AS BIGINT) AS VARCHAR)), ',') AS numbers,
'Task: move to shelf ' || label || ', State: ' || array_to_string(list_transform(v[38:41], lambda x: CAST(greatest(-1, least(255, CAST(floor((x + 1) / (2.0::DOUBLE / 256)) AS BIGINT))) AS VARCHAR)), ' ') || ';' || chr(10) AS prompt FROM b"""


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice as many draws as there are customers, three quarters of them customers and a quarter suppliers, through a buffer."""
    parts = {"customer": (_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), 0.75), "supplier": (_read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), 0.25)}
    n = 2 * parts["customer"][0].count()
    return S.buffered(S.mixed(parts, "id", 7, n), "place", 1000, 7)


QUERIES = {
    "signal_lines": (signal_lines, LINES_SQL),
    "repaired_plans": (repaired_plans, PLANS_SQL),
    "action_codes": (action_codes, CODES_SQL),
    "mixture": (mixture, None),
}
