"""Queries of instructions: lines are prompts about their part, parts give the vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetide.operators import instructions as I

from .tables import _read

#: What prompts say, with {o} a part's name and {p} a place.
FORMS = (
    "Pick the {o} from the {p} and place it in the sink.", "pick up the {o} out of the {p} (1/2)", "Pick up {o}", "Place the {o} onto the {p} on the nearby counter", "put {o} into the left {p}", "Go back to the {p}", "navigate to the {p} on the dining counter",
    "Turn on the rear left burner of the stove", "switch off the burner at the right back", "Press the knob of the stove", "wash with the spout", "turn off the faucet", "open sink", "Rinse the sink basin", "stop the microwave", "lower the toaster oven dial", "increase the toaster oven timer",
    "push the lever of the electric kettle", "Close the cabinet doors", "pull open the right drawer of the cabinet", "slide the oven rack out", "Slide the dishwasher rack back in", "shut the refrigerator doors", "Grab {o} of the {p}", "scrub {o}", "Watch the {o}", "the {o} is there", "Pick up the {o} from the {p} of the kitchen",
    "place kettle on the front left burner of the stove", "open the left {o} door", "  ", "Take {o} , please !", "Place the {o} under the {p}.", "set {o} on counter", "walk to the {p} and pick {o}", "Turn the knob to preheat the oven", "Pick up the left {o}", "close the blender",
)
#: Instructions of the vocabulary.
SAID = ("Pick up the {o}.", "Place the {o} in the {p}.", "Grab the {o}.", "Pick the {o} from the {p} and place it in the sink.", "Turn on the sink faucet.", "Place the kettle on the stove burner.", "Navigate to the counter.", "Navigate to the {p}.", "Open the right drawer.", "Open the {o} door.", "Set the {o}.", "Scrub the {o}.", "Place the {o} on the {p}.")
PLACES = ("counter", "fridge", "left drawer", "shelf")
GOALS = (None, "Use the left drawer", "Tidy up")
HINTS = ("close", "pnp", None)


def _one(options: tuple, k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x).cast("string") for x in options]), (F.pmod(k, F.lit(len(options))) + 1).cast("int"))


def _filled(form: Column, name: Column, place: Column) -> Column:
    return F.replace(F.replace(form, F.lit("{o}"), name), F.lit("{p}"), place)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with an even key say each instruction about themselves and a place; sizes name the skill."""
    said = F.posexplode(F.array(*map(F.lit, SAID))).alias("place", "form")
    rows = _read(spark, sf_dir, "part").where("p_partkey % 2 = 0").select("p_partkey", "p_name", F.concat(F.lit("skill"), (F.col("p_size") % 5).cast("string")).alias("skill"), said)
    return rows.select(F.col("p_partkey").alias("file"), "place", "skill", _filled(F.col("form"), F.col("p_name"), _one(PLACES, F.col("p_partkey") / 2)).alias("text"))


def canonical_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines by prompt, hint and goal."""
    k = F.col("l_orderkey") + F.col("l_linenumber")
    lines = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.select(_filled(_one(FORMS, k), F.col("p_name"), _one(PLACES, F.col("l_suppkey"))).alias("prompt"), _one(HINTS, F.col("l_orderkey")).alias("hint"), _one(GOALS, F.col("l_partkey")).alias("goal"))
    made = I.canonical(rows, I.vocabulary(entries(spark, sf_dir)), "prompt", "hint", "goal")
    return made.groupBy("prompt", "hint", "goal", "instruction", F.array_join("skills", ",").alias("skills")).agg(F.count(F.lit(1)).alias("n"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(options: tuple, k: str) -> str:
    return f"[{', '.join('NULL' if x is None else _q(x) for x in options)}][CAST({k} AS BIGINT) % {len(options)} + 1]"


def _fill(form: str, name: str, place: str) -> str:
    return f"replace(replace({form}, '{{o}}', {name}), '{{p}}', {place})"


def _normal(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(regexp_replace({x}, '\\s*\\(\\s*\\d+\\s*/\\s*\\d+\\s*\\)\\s*$', '')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def _case(text: str, rules, position: str = "NULL") -> str:
    out = "CASE"
    for r in rules:
        fits = " AND ".join([f"regexp_matches({text}, {_q(p)})" for p in r.wants] + [f"NOT regexp_matches({text}, {_q(p)})" for p in r.unless])
        parts = []
        for piece in (r.says or "").replace("}", "{").split("{"):
            parts.append(f"regexp_extract({text}, {_q(r.wants[0])}, {piece})" if piece.isdigit() else position if piece == "position" else _q(piece))
        out += f" WHEN {fits} THEN " + ("NULL" if r.says is None else " || ".join(parts))
    return out + " END"


def _ruled(t: str, hint: str) -> str:
    rear = f"regexp_replace({t}, '\\bback\\b', 'rear', 'g')"
    at = [f"regexp_extract({rear}, {_q(I.BURNER)}, {k})" for k in range(1, 6)]
    position = f"CASE WHEN {at[4]} <> '' THEN {at[4]} ELSE {at[0]} || {at[3]} || ' ' || {at[1]} || {at[2]} END"
    way, fits = f"regexp_extract({t}, {_q(I.RACK)}, 1)", lambda p: f"regexp_matches({t}, {_q(p)})"
    opened, closed = _case(t, I.doors(False)), _case(t, I.doors(True))
    return f"""CASE WHEN NOT {fits(I.NO_ACTION)} THEN coalesce({_case(t, I.MOVES)}, CASE {way} WHEN 'in' THEN {closed} WHEN 'out' THEN {opened} END, CASE WHEN {fits(I.SWITCHING)} THEN {_case(rear, I.SWITCHES, f"({position})")} END,
CASE WHEN {fits(I.OPENING)} AND {hint} <> 'close' THEN {opened} END, CASE WHEN {fits(I.CLOSING)} OR {hint} = 'close' THEN {closed} END) END"""


def _repairs(t: str, goal: str) -> str:
    words = f"string_split({t}, ' ')"
    sides = f"list_transform(range(1, len({words}) + 1), lambda i: CASE WHEN {words}[i] IN ('left', 'right') AND NOT list_contains(string_split({goal}, ' '), {words}[i]) THEN array_to_string(list_concat({words}[1:i - 1], {words}[i + 1:]), ' ') END)"
    out = []
    for pattern, says in I.REPAIRS:
        if pattern is None:
            out.append(f"CASE WHEN {t} LIKE '%electric kettle%' THEN replace({t}, 'electric kettle', 'kettle') END")
        elif "(?!" in pattern:
            out.append(f"CASE WHEN len({words}) > 1 AND {words}[2] <> 'the' THEN {words}[1] || ' the ' || array_to_string({words}[2:], ' ') END")
        else:
            out.append(f"CASE WHEN regexp_matches({t}, {_q(pattern)}) THEN trim(regexp_replace({t}, {_q(pattern)}, {_q(says.replace('$1', chr(92) + '1'))})) END")
    return f"list_concat({sides}, [{', '.join(out)}])"


SQL = f"""WITH v AS MATERIALIZED (SELECT {_normal("text")} AS norm, text, skill, file, place FROM (SELECT p_partkey AS file, place, 'skill' || (p_size % 5) AS skill, {_fill(f"{_list(SAID, 'place')}", "p_name", _list(PLACES, "p_partkey / 2"))} AS text FROM part, range({len(SAID)}) r(place) WHERE p_partkey % 2 = 0)),
w AS MATERIALIZED (SELECT norm, arg_min(text, (file, place)) AS text FROM v GROUP BY norm),
k AS MATERIALIZED (SELECT text, array_to_string(list_sort(list(DISTINCT skill)), ',') AS skills FROM v GROUP BY text),
p AS MATERIALIZED (SELECT prompt, hint, goal, count(*) AS n FROM (SELECT {_fill(_list(FORMS, "(l_orderkey + l_linenumber)"), "p_name", _list(PLACES, "l_suppkey"))} AS prompt, {_list(HINTS, "l_orderkey")} AS hint, {_list(GOALS, "l_partkey")} AS goal FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ALL),
t AS MATERIALIZED (SELECT *, replace({_normal("prompt")}, 'refrigerator', 'fridge') AS t FROM p),
r AS MATERIALIZED (SELECT *, {_ruled("t", "coalesce(hint, '')")} AS said, {_normal("coalesce(goal, '')")} AS aim FROM t),
o AS MATERIALIZED (SELECT *, {_normal("said")} AS other FROM r),
c AS MATERIALIZED (SELECT *, list_concat([t, other], {_repairs("t", "aim")}, CASE WHEN other <> t THEN {_repairs("other", "aim")} ELSE [] END) AS tries FROM o),
h AS MATERIALIZED (SELECT prompt, hint, goal, arg_min(w.text, i) AS hit FROM (SELECT prompt, hint, goal, unnest(tries) AS x, unnest(range(1, len(tries) + 1)) AS i FROM c) e JOIN w ON w.norm = e.x GROUP BY ALL)
SELECT c.prompt, c.hint, c.goal, coalesce(h.hit, c.said, CASE WHEN regexp_matches(c.t, {_q(I.ACTION)}) AND NOT regexp_matches(c.t, {_q(I.NO_ACTION)}) THEN upper(c.t[1]) || c.t[2:] || '.' END, trim(c.prompt)) AS instruction, coalesce(k.skills, '') AS skills, n
FROM c LEFT JOIN h ON h.prompt = c.prompt AND h.hint IS NOT DISTINCT FROM c.hint AND h.goal IS NOT DISTINCT FROM c.goal LEFT JOIN k ON k.text = h.hit"""

QUERIES = {"canonical_instructions": (canonical_instructions, SQL)}
