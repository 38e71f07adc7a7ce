"""Queries through readers and writers, and rules over texts, states and inputs: what is written is read back and held against
the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetide.functions import control as C
from kinetide.functions import text as X
from kinetide.operators import relational as R
from kinetide.operators import sampling as S
from kinetide.operators import segments as G
from kinetide.shared import fresh_path
from kinetide.sources import records as IO

from .tables import _read
from .temporal import E, events


def episode_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label are an episode's file; its frames are numbered as they lie in the file."""
    path = fresh_path(spark, "episodes")
    rows = _read(spark, sf_dir, "embeddings").select("label", "vec_id", F.slice("embedding", 1, 16).alias("observation.state"), F.slice("embedding", 17, 12).alias("action"))
    rows.repartition("label").sortWithinPartitions("label", "vec_id").write.partitionBy("label").parquet(path)
    of = lambda c: F.regexp_extract(c, "label=([0-9-]+)", 1).cast("int")
    frames = IO.episodes(spark, path, "observation.state", "action", (16, 12))
    found = frames.groupBy(of(F.col("file")).alias("label")).agg(F.sum("frame").alias("frames"), F.round(F.sum(F.get("state", F.lit(0)) * (F.col("frame") + 1)), 4).alias("states"), F.round(F.sum(F.get("action", F.lit(11))), 4).alias("actions"))
    sizes = IO.row_counts(spark, path).groupBy(of(F.col("file")).alias("l")).agg(F.sum("n").alias("n"))
    return found.join(sizes, F.col("label") == F.col("l")).select("label", "n", "frames", "states", "actions")


EPISODES_SQL = """WITH r AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS f FROM embeddings)
SELECT label, count(*) AS n, CAST(sum(f) AS BIGINT) AS frames, round(sum(CAST(embedding[1] AS DOUBLE) * (f + 1)), 4) AS states, round(sum(CAST(embedding[28] AS DOUBLE)), 4) AS actions FROM r GROUP BY label"""


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of JSON, read strictly; and leniently where every tenth line is cut short and blank ones
    lie between."""
    orders, path = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("price")), fresh_path(spark, "lines")
    schema = "o_orderkey bigint, o_orderpriority string, price double"
    IO.write_json_lines(orders, f"{path}/good")
    line = F.to_json(F.struct(*orders.columns))
    damaged = F.when(F.col("o_orderkey") % 10 == 0, F.substring(line, 1, 9)).otherwise(line)
    orders.select(F.explode(F.array(damaged, F.when(F.col("o_orderkey") % 4 == 0, "  ").otherwise(""))).alias("value")).write.text(f"{path}/bad")
    count = lambda df, how: df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("price"), 2).alias("price")).select(F.lit(how).alias("how"), "*")
    return count(IO.json_lines(spark, f"{path}/good", schema), "strict").unionByName(count(IO.json_lines(spark, f"{path}/bad", schema, strict=False), "lenient"))


LINES_SQL = """SELECT 'strict' AS how, o_orderpriority, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, round(sum(CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END), 2) AS price FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 'lenient', o_orderpriority, count(*), CAST(sum(o_orderkey) AS BIGINT), round(sum(CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END), 2) FROM orders WHERE o_orderkey % 10 > 0 GROUP BY o_orderpriority"""


def vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are entries of files by brand; a name's first text, and the types that have it."""
    entries = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.concat("p_name", F.lit(" "), F.col("p_size").cast("string")).alias("text"), F.col("p_type").alias("skill"))
    first, skills = IO.vocabulary(entries, F.substring_index("text", " ", 2))
    return first.join(skills, "key").select("key", "text", F.array_join("skills", ",").alias("skills"))


VOCABULARY_SQL = """WITH e AS (SELECT p_brand AS file, p_name || ' ' || p_size AS text, p_type AS skill, array_to_string(string_split(p_name, ' ')[1:2], ' ') AS key FROM part)
SELECT key, arg_min(text, (file, text)) AS text, array_to_string(list_sort(list(DISTINCT skill)), ',') AS skills FROM e GROUP BY key"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of event types by user as JSON."""
    return IO.summary(_read(spark, sf_dir, "events"), "user_id", "event_type")


SUMMARY_SQL = """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS counts, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY user_id"""


def stats_and_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's statistics of two components, written and read back, beside the frames that are kept."""
    long = events(spark, sf_dir).select("user_id", F.posexplode(F.array("value", F.col("value") * 2)).alias("dim", "x"))
    stats = long.groupBy("user_id", "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("q01"), F.max("x").alias("q99"))
    path = fresh_path(spark, "stats")
    IO.write_stats(stats, path, ["user_id"])
    back = IO.read_stats(spark, path, ["user_id"]).groupBy(F.col("user_id").alias("u")).agg(F.round(F.max(F.when(F.col("dim") == 1, F.col("mean"))), 6).alias("mean"), F.round(F.sum("q99"), 6).alias("q99"))
    frames = IO.frame_manifest(_read(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("value") > 20)
    return frames.join(back, F.col("user_id") == F.col("u")).select("user_id", "mean", "q99", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"), F.size("dropped").alias("dropped"))


STATS_SQL = """SELECT user_id, round(avg(value * 2), 6) AS mean, round(max(value) + max(value * 2), 6) AS q99, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (WHERE value > 20), '') AS kept,
CAST(count(*) FILTER (WHERE NOT coalesce(value > 20, false)) AS INT) AS dropped FROM events GROUP BY user_id"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns, one line each."""
    line = F.concat("role", F.lit(": "), X.shortened(F.col("text"), 60))
    return IO.report_lines(_read(spark, sf_dir, "conversations").where("text is not null"), ["conv_id"], "turn", line)


REPORT_SQL = """SELECT conv_id, string_agg(role || ': ' || CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END, chr(10) ORDER BY turn) AS report FROM conversations WHERE text IS NOT NULL GROUP BY conv_id"""


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts' names with ordinals, marks and numbers round them."""
    said = F.concat(F.lit("  The "), F.initcap("p_name"), F.lit("!_No."), F.col("p_size").cast("string"), F.lit(" ("), (F.col("p_partkey") % 5).cast("string"), F.lit("/7)  "))
    url = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("data:image/"), F.col("p_brand"), F.lit(";base64,AAAA"), F.col("p_name"))).otherwise(F.concat(F.lit("http://x/"), F.col("p_name")))
    name = F.concat(F.col("p_type"), F.lit("-"), F.col("p_partkey").cast("string"))
    return _read(spark, sf_dir, "part").select(
        "p_partkey", X.bare_prompt(said).alias("bare"), X.without_ordinal(said).alias("plain"), X.now_prompt(F.col("p_name"), F.concat(F.col("p_type"), F.lit(". ."))).alias("prompt"), X.number_at_end(name).alias("number"),
        X.padded_id("part", F.col("p_partkey"), 6).alias("id"), X.frame_path(F.col("p_size"), F.col("p_partkey"), F.col("p_type"), F.col("p_partkey") * 2).alias("path"), X.base64_size(F.col("p_size")).alias("size"), X.without_data_url(url).alias("url"), X.prompt_text(said).alias("clean"),
    )


TEXT_SQL = r"""WITH s AS (SELECT *, '  The ' || (SELECT string_agg(upper(w[1]) || w[2:], ' ') FROM (SELECT unnest(string_split(p_name, ' ')) AS w)) || '!_No.' || p_size || ' (' || p_partkey % 5 || '/7)  ' AS said FROM part),
p AS (SELECT *, trim(regexp_replace(said, '\s*\(\d+/\d+\)\s*$', '')) AS plain FROM s)
SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(plain), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS bare, plain, p_name || '. Now: ' || p_type || '.' AS prompt, p_partkey AS number,
printf('part%06d', p_partkey) AS id, printf('task-%04d/episode_%08d/', p_size, p_partkey) || p_type || printf('/dataset_%08d.jpg', p_partkey * 2) AS path, CAST(ceil(p_size / 3) * 4 AS BIGINT) AS size,
CASE WHEN p_partkey % 2 = 0 THEN 'data:image/' || p_brand || ';base64,<redacted>' ELSE 'http://x/' || p_name END AS url, lower(trim(translate(said, '_' || chr(10), '  '))) AS clean FROM p"""


def json_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first object within a turn's words."""
    inner = F.concat(F.lit('{"a": {"role": "'), F.col("role"), F.lit('"}, "turn": '), F.col("turn").cast("string"), F.lit(', "odd": "}{"}'))
    said = F.when(F.col("turn") % 3 == 0, inner).when(F.col("turn") % 3 == 1, F.concat(F.lit("So: "), inner, F.lit(" and {more}"))).otherwise(F.concat(F.lit("no object, "), F.col("role")))
    got = X.parsed(said, "a struct<role:string>, turn bigint, odd string")
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", X.first_json(said).alias("found"), got["a"]["role"].alias("role"), got["turn"].alias("said"), got["odd"].alias("odd"))


JSON_SQL = """SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN '{"a": {"role": "' || role || '"}, "turn": ' || turn || ', "odd": "}{"}' END AS found, CASE WHEN turn % 3 < 2 THEN role END AS role, CASE WHEN turn % 3 < 2 THEN turn END AS said, CASE WHEN turn % 3 < 2 THEN '}{' END AS odd FROM conversations"""


def robot_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as states of sixteen numbers, every ninth of them short."""
    v = F.col("value")
    state = F.concat(F.array(v, v * 2, v * 3), F.array_repeat(F.lit(1.0), 4), F.array(v + 1, v + 2, v + 3), F.array_repeat(F.lit(0.5), F.when(F.col("event_id") % 9 == 0, 3).otherwise(4)), F.array(v / 1000, F.lit(0.01)))
    rows = events(spark, sf_dir).select("user_id", "event_id", "us", state.alias("s"))
    info = C.robot_info(F.col("s"), F.lag("s").over(Window.partitionBy("user_id").orderBy("us")))
    rows = rows.withColumn("i", info)
    sides = C.carry_side(F.get("s", F.lit(0)) / 100, F.get("s", F.lit(1)) / 100)
    return rows.select("event_id", F.round("i.jaw_gap_mm", 6).alias("gap"), F.round("i.delta_jaw_gap_mm", 6).alias("gap_change"), F.round(F.get("i.delta_end_effector_position", F.lit(2)), 6).alias("moved"), F.round(F.get("i.delta_base_position", F.lit(0)), 6).alias("driven"), F.size("i.base_rotation").alias("turns"), sides.alias("side"))


STATES_SQL = f"""WITH {E}, r AS (SELECT *, event_id % 9 > 0 AS good, lag(value) OVER w AS pv, coalesce(lag(event_id) OVER w % 9 > 0, false) AS pgood FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
g AS (SELECT *, abs(value / 1000 - 0.01::DOUBLE) * 1000 AS gap, abs(pv / 1000 - 0.01::DOUBLE) * 1000 AS pgap FROM r)
SELECT event_id, CASE WHEN good THEN round(gap, 6) END AS gap, CASE WHEN good AND pgood THEN round(gap - pgap, 6) END AS gap_change, CASE WHEN good AND pgood THEN round(value * 3 - pv * 3, 6) END AS moved, CASE WHEN good AND pgood THEN round((value + 1) - (pv + 1), 6) END AS driven,
CASE WHEN good THEN 4 END AS turns, CASE WHEN value / 100 < 0.5 AND value * 2 / 100 >= 0.5 THEN 'LEFT' WHEN value * 2 / 100 < 0.5 AND value / 100 >= 0.5 THEN 'RIGHT' END AS side FROM g"""

STAGES = ("pick", "place_on", "move_to", "open_close", "close", "pnp", "manipulate", "switch")
PROMPTS = ("Place it on the tray.", "Stir the soup.", "Pick up the bread from the toaster.", "Wait for the toaster to finish and the lever to pop up", "Press it.")


def step_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as subtasks of a stage, a prompt and a number of steps."""
    pick = lambda options, k: F.element_at(F.array(*map(F.lit, options)), (F.pmod(k, F.lit(len(options))) + 1).cast("int"))
    k = F.col("o_orderkey")
    stage, prompt, steps = pick(STAGES, k), pick(PROMPTS, F.col("o_custkey")), (F.pmod(k, F.lit(50)) + 1).cast("int")
    state = F.concat(F.array_repeat(F.lit(0.0), 14), F.array(F.pmod(F.floor("o_totalprice"), F.lit(50)) / 1000, F.lit(0.0)))
    task = F.when(k % 4 > 0, C.CAREFUL).otherwise("Other")
    kind = C.action_kind(stage, prompt)
    return _read(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), C.window_budget(stage, prompt, steps).alias("window"), C.steps_at_once(task, stage, state, steps).alias("steps"), C.retry_budget(kind, F.pmod(k, F.lit(4)).cast("int")).alias("retries"))


def _sql_list(options: tuple, k: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in options) + f"][{k} % {len(options)} + 1]"


WINDOWS_SQL = f"""WITH o AS (SELECT o_orderkey, {_sql_list(STAGES, "o_orderkey")} AS stage, {_sql_list(PROMPTS, "o_custkey")} AS prompt, CAST(o_orderkey % 50 + 1 AS INT) AS steps, floor(o_totalprice) % 50 AS gap FROM orders),
k AS (SELECT *, CASE stage WHEN 'place_on' THEN 'place' WHEN 'move_to' THEN 'navigate' WHEN 'manipulate' THEN 'action' WHEN 'pnp' THEN CASE WHEN prompt LIKE 'Place%' THEN 'place' ELSE 'pick' END WHEN 'open_close' THEN CASE WHEN prompt LIKE 'Stir %' THEN 'action' ELSE 'switch' END ELSE stage END AS kind FROM o),
c AS (SELECT *, greatest(CASE kind WHEN 'pick' THEN 50 WHEN 'place' THEN 43 WHEN 'navigate' THEN 27 WHEN 'close' THEN 61 WHEN 'switch' THEN 72 ELSE 98 END, CASE WHEN prompt LIKE '%bread%' THEN 65 WHEN prompt LIKE 'Wait%' THEN 120 ELSE 0 END) AS chunks, CASE kind WHEN 'navigate' THEN 1 WHEN 'action' THEN 1 ELSE 2 END AS cap FROM k)
SELECT o_orderkey, kind, CAST(greatest(1, ceil(chunks * 5 / steps)) AS BIGINT) AS window, CASE WHEN o_orderkey % 4 > 0 AND stage = 'place_on' AND gap >= 25 THEN least(steps, 3) ELSE steps END AS steps, CAST(CASE WHEN o_orderkey % 4 > 0 THEN least(o_orderkey % 4, cap) ELSE cap END AS INT) AS retries FROM c"""


def list_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of part keys by supplier with negative and repeated ones, and lengths that don't agree."""
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_partkey") % 97 == 0, -1).otherwise(F.pmod("l_partkey", F.lit(40))).alias("k"), "l_linenumber")
    lists = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("k")).alias("ks"), F.max("l_linenumber").alias("stated"))  # an order's lines
    checks = {"negative": F.exists("ks", lambda x: x < 0), "repeated": F.size(F.array_distinct("ks")) < F.size("ks"), "length": F.size("ks") != F.col("stated")}
    return R.faults(lists, checks, ["l_orderkey"])


LIST_SQL = """WITH r AS (SELECT l_orderkey, CASE WHEN l_partkey % 97 = 0 THEN -1 ELSE l_partkey % 40 END AS k, l_linenumber FROM lineitem)
SELECT l_orderkey, 'negative' AS fault FROM r GROUP BY 1 HAVING min(k) < 0 UNION ALL SELECT l_orderkey, 'repeated' FROM r GROUP BY 1 HAVING count(DISTINCT k) < count(*) UNION ALL SELECT l_orderkey, 'length' FROM r GROUP BY 1 HAVING count(*) <> max(l_linenumber)"""


def policy_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as observations, nested, with defaults, experts and padded tokens."""
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax")).alias("wrist_image"), F.col("l_returnflag").alias("hint"))
    rows = G.applied(G.with_default(rows, "wrist_image", -1.0), {"q": lambda c: c * 2, "gone": lambda c: c})
    rows = rows.withColumn("state", F.coalesce(G.first_present(rows, ["proprio", "q"]), F.lit(0.0)))
    made = C.policy_input(F.array("state", F.lit(1.0)), {"head": F.col("q"), "wrist": F.when(F.col("wrist_image") >= 0, F.col("wrist_image"))}, prompt=F.col("hint"))
    rows = rows.select("l_orderkey", "l_linenumber", made.alias("i"), C.expert_of(F.col("hint"), F.when(F.col("l_linenumber") == 1, F.lit(9)), {"A": 0, "N": 1}).alias("expert"), C.padded_tokens(F.transform(F.sequence(F.lit(1), F.col("l_linenumber")), lambda x: x.cast("bigint")), 4).alias("t"))
    flat = G.repacked(rows, {"key": "l_orderkey", "line": "l_linenumber", "expert": "expert", "given": {"first": "i", "tokens": "t"}})
    i, t = F.col("given.first"), F.col("given.tokens")
    tokens = F.array_join(F.transform(t["tokens"], lambda x: x.cast("string")), ",")
    return flat.select("key", "line", "expert", F.round(F.get(i["state"], F.lit(0)), 4).alias("state"), i["image_mask"]["wrist"].alias("wrist"), i["prompt"].alias("prompt"), tokens.alias("tokens"), F.size(F.filter(t["mask"], lambda x: x)).alias("there"))


INPUTS_SQL = """SELECT l_orderkey AS key, l_linenumber AS line, CASE WHEN l_linenumber = 1 THEN 9 WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 END AS expert, round(l_quantity * 2, 4) AS state, l_linenumber % 2 = 0 AS wrist, l_returnflag AS prompt,
array_to_string(list_resize(range(1, least(l_linenumber, 4) + 1), 4, 0), ',') AS tokens, CAST(least(l_linenumber, 4) AS INT) AS there FROM lineitem"""


def mode_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of a batch of 48 in proportion to the parts of each type, beside even ones."""
    pools = _read(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy("p_type").collect()  # a row for each type
    counts = S.count_modes([r["n"] for r in pools], 48, proportional=True)
    even = S.count_modes([r["n"] for r in pools], 48)
    plan = spark.createDataFrame([(r["p_type"], a, b) for r, a, b in zip(pools, counts, even, strict=True)], "t string, slots int, even int")
    return _read(spark, sf_dir, "part").join(F.broadcast(plan), F.col("p_type") == F.col("t")).groupBy("p_type", "slots", "even").agg(F.count(F.lit(1)).alias("n"))


SLOTS_SQL = """WITH n AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type), r AS (SELECT *, n / sum(n) OVER () * 48 AS raw FROM n), b AS (SELECT *, greatest(1, floor(raw)) AS base FROM r),
k AS (SELECT *, row_number() OVER (ORDER BY raw - base DESC, p_type) AS place, 48 - sum(base) OVER () AS rest FROM b)
SELECT p_type, CAST(base + CASE WHEN place <= rest THEN 1 ELSE 0 END AS INT) AS slots, 8 AS even, n FROM k"""

QUERIES = {
    "episode_scan": (episode_scan, EPISODES_SQL),
    "json_lines": (json_lines, LINES_SQL),
    "vocabularies": (vocabularies, VOCABULARY_SQL),
    "summaries": (summaries, SUMMARY_SQL),
    "stats_and_manifests": (stats_and_manifests, STATS_SQL),
    "reports": (reports, REPORT_SQL),
    "text_rules": (text_rules, TEXT_SQL),
    "json_in_text": (json_in_text, JSON_SQL),
    "robot_states": (robot_states, STATES_SQL),
    "step_windows": (step_windows, WINDOWS_SQL),
    "list_faults": (list_faults, LIST_SQL),
    "policy_inputs": (policy_inputs, INPUTS_SQL),
    "mode_slots": (mode_slots, SLOTS_SQL),
}
