"""instructions in the wording of a vocabulary, by a cascade in which a row leaves at its first hit.

Normal forms that are in the vocabulary are joined exactly. Of the others, ordered rules of patterns give a wording, and
seven repairs give candidates, each in its order; all candidates of a row are joined with the vocabulary at once and the
first that is there counts. What no candidate reaches keeps the rule's wording, or its own if it names an action. Everything
is an expression or a join, so neither prompts nor vocabulary are held by a task; distinct prompts go through once.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """Fits texts that all ``wants`` are found in and no ``unless``; says a wording with groups of the first of ``wants`` and
    named values, or None: then no later rule of its list is asked."""

    wants: tuple[str, ...]
    says: str | None
    unless: tuple[str, ...] = ()


# Patterns and wordings of instructions, in the order in which they apply.
ARTICLE = "(?:(?:the|a|an|either) )?"
INTO = "(?:(in|on)(?:to)?|(under))"
NO_ACTION = r"\b(?:wait|waiting|hold still|observe|watch|check if)\b"
ACTION = (
    "^(?:pick|place|put|set|open|close|shut|turn|press|push|pull|navigate|move|go|walk|stack|pour|slide|grab|grasp|lift|insert|remove|take|twist|flip|shake|stir|scrub|wipe|rinse|wash|drop|release|"
    r"adjust|preheat|lower|increase|decrease|fully|start|stop|activate)\b"
)
SWITCHING = r"\b(?:press|push|turn|twist|switch|start|stop|activate|deactivate|ignite|open|close|knob|lever|button|faucet|spout|preheat|increase|decrease|adjust|dial|timer)\b"
TURN_ON = r"\b(?:turn on|activate|ignite|light|switch on|start)\b"
TURN_OFF = r"\b(?:turn off|deactivate|switch off|extinguish|stop)\b|^close "
BURNER = r"\b(front|rear)\b.{0,12}?\b(left|right|center)\b|\b(left|right|center)\b.{0,12}?\b(front|rear)\b|\b(center)\b"
RACK = r"\bslide\b.*\brack\b.*\b(in|out)\b"
OPENING, CLOSING = r"\b(?:open|pull out|slide out|pull open)\b", r"\b(?:close|shut|slide in|push in)\b"
MOVES = (
    Rule((rf"\bpick(?: up)? {ARTICLE}(.+?) (?:from|out of|off) {ARTICLE}(.+?) and (?:place|put|set) (?:it|them) {INTO} {ARTICLE}(.+)$",), "Pick the {1} from the {2} and place it {3}{4} the {5}."),
    Rule((rf"\bpick(?: up)? {ARTICLE}(.+?) (?:from|out of|off) {ARTICLE}(.+)$",), "Pick up the {1} from the {2}.", (" and place", " and put")),
    Rule((rf"\bpick(?: up)? {ARTICLE}(.+)$",), "Pick up the {1}.", (" and place", " and put")),
    Rule((rf"\b(?:place|put|set) {ARTICLE}(.+?) {INTO} {ARTICLE}(.+)$",), "Place the {1} {2}{3} the {4}.", (" and place", " and put")),
    Rule((rf"\b(?:navigate|go|move|walk|drive) (?:back )?to {ARTICLE}(.+)$",), "Navigate to the {1}.", ("pick", "place")),
)
SWITCHES = (
    *[r for stove in (Rule(("burner|stove",), None), Rule(("knob",), None, ("oven",))) for r in (
        Rule((*stove.wants, BURNER, TURN_OFF), "Turn off the {position} burner of the stove.", (*stove.unless, TURN_ON)),
        Rule((*stove.wants, BURNER), "Turn on the {position} burner of the stove.", stove.unless),
        stove,
    )],
    Rule(("spout", "wash"), "Move the spout to wash all locations of the sink basin."),
    Rule(("faucet", TURN_OFF), "Turn off the sink faucet."),
    Rule(("faucet",), "Turn on the sink faucet."),
    Rule(("sink", TURN_OFF), "Turn off the sink faucet."),
    Rule(("sink", f"water|press|push|{TURN_ON}"), "Turn on the sink faucet."),
    Rule(("microwave", TURN_OFF), "Press the stop button on the microwave."),
    Rule(("microwave",), "Press the start button on the microwave."),
    Rule(("kettle",), "Press down the lever to turn on the electric kettle."),
    Rule(("toaster oven", "increase"), "Increase the toaster oven temperature."),
    Rule(("toaster oven", "decrease|lower"), "Decrease the toaster oven temperature."),
    Rule(("toaster oven",), "Turn on the toaster oven by setting the timer."),
    Rule(("toaster",), "Push down the lever of the toaster to turn it on."),
    Rule(("blender",), "Turn on the blender by pressing the power button."),
    Rule(("coffee",), "Press the button on the coffee machine to serve coffee."),
    Rule(("oven", "preheat|temperature|knob"), "Preheat the oven by turning the temperature knob."),
)
#: Both ways of a door: what it says with {Do}, {do} and {way}; or one wording for opening and one for closing.
DOORS = (
    (("(?:fridge|refrigerator) drawer",), "Fully {do} the fridge drawer."),
    (("dishwasher rack",), "Fully slide the top dishwasher rack {way}."),
    (("toaster oven", "rack|tray"), "Fully slide the toaster oven rack {way}."),
    (("oven rack",), "Fully slide the oven rack {way}."),
    (("kettle",), ("Press the button to open the lid of the electric kettle.", "Close the lid of the electric kettle.")),
    (("blender",), ("Open the blender by taking off the lid and placing it on the counter.", "Close the lid blender by securely placing the lid on top.")),
    (("stand mixer|mixer head",), "{Do} the stand mixer head."),
    (("cabinet", "doors"), "{Do} the cabinet doors."),
    (("cabinet",), "{Do} the cabinet door."),
    (("drawer", "left"), "{Do} the left drawer."),
    (("drawer", "right"), "{Do} the right drawer."),
    (("drawer",), "{Do} the drawer."),
    (("toaster oven",), "{Do} the toaster oven door."),
    (("fridge", "doors"), "{Do} the fridge doors."),
    (("fridge",), "{Do} the fridge door."),
    (("microwave",), "{Do} the microwave door."),
    (("dishwasher",), "{Do} the dishwasher door."),
    (("oven",), "{Do} the oven door."),
)
#: Repairs of a normal form: pattern and what takes its place, in order; those of sides come before them.
REPAIRS = (
    ("^(.+) of the .+$", "$1"),
    (None, None),  # an electric kettle is a kettle
    ("^(navigate to(?: .*?)?) (?:on|at) the (?:dining )?counter$", "$1"),
    ("^navigate to(?: .*?)? (?:on|at) the (?:dining )?counter$", "navigate to the counter"),
    ("^([^ ]+) (?!the(?: |$))(.+)$", "$1 the $2"),
    ("^(?:place|put|set) (?:the )?kettle (?:on|onto) (?:the )?(?:(?:front|rear|back|left|right|center) ){1,2}burner of (?:the )?stove$", "place the kettle on the stove burner"),
    ("^(?:open|start|turn on) (?:the )?sink$", "turn on the sink faucet"),
    ("^(?:wash|rinse) (?:the )?sink basin$", "move the spout to wash all locations of the sink basin"),
    ("^((?:place|put|set)(?: .*?)?) (?:on|at) (?:the )?(?:(?:nearby|dining|kitchen) )?counter$", "$1"),
)
SIDES = ("left", "right")


def doors(closing: bool) -> tuple[Rule, ...]:
    do, way = ("close", "in") if closing else ("open", "out")
    pick = lambda says: says if isinstance(says, str) else says[closing]
    return tuple(Rule(wants, pick(says).replace("{Do}", do.capitalize()).replace("{do}", do).replace("{way}", way)) for wants, says in DOORS)


def normal(c: Column) -> Column:
    """Without a trailing ordinal, in lower case, letters and digits only, single blanks."""
    bare = F.lower(F.regexp_replace(c, r"\s*\(\s*\d+\s*/\s*\d+\s*\)\s*$", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9 ]", " "), " +", " "))


def _said(text: Column, rule: Rule, values: dict[str, Column]) -> Column:
    """The rule's wording."""
    parts = []
    for piece in rule.says.replace("}", "{").split("{"):
        parts.append(F.regexp_extract(text, rule.wants[0], int(piece)) if piece.isdigit() else values[piece] if piece in values else F.lit(piece))
    return F.concat(*parts)


def by_rules(text: Column, rules: tuple[Rule, ...], values: dict[str, Column] | None = None) -> Column:
    """What the first rule that fits says; null if none fits."""
    out = None
    for r in rules:
        fits = reduce(lambda a, b: a & b, [text.rlike(p) for p in r.wants] + [~text.rlike(p) for p in r.unless])
        said = F.lit(None).cast("string") if r.says is None else _said(text, r, values or {})
        out = F.when(fits, said) if out is None else out.when(fits, said)
    return out


def ruled(text: Column, hint: Column) -> Column:
    """The wording that the rules give a normal form; null without one."""
    at = [F.regexp_extract(F.regexp_replace(text, r"\bback\b", "rear"), BURNER, k) for k in range(1, 6)]
    position = F.when(at[4] != "", at[4]).otherwise(F.concat(at[0], at[3], F.lit(" "), at[1], at[2]))
    rear = F.regexp_replace(text, r"\bback\b", "rear")
    shut = F.coalesce(hint == "close", F.lit(False))
    way = F.regexp_extract(text, RACK, 1)
    return F.when(
        ~text.rlike(NO_ACTION),
        F.coalesce(
            by_rules(text, MOVES),
            F.when(way == "in", by_rules(text, doors(True))).when(way == "out", by_rules(text, doors(False))),
            F.when(text.rlike(SWITCHING), by_rules(rear, SWITCHES, {"position": position})),
            F.when(text.rlike(OPENING) & ~shut, by_rules(text, doors(False))),
            F.when(text.rlike(CLOSING) | shut, by_rules(text, doors(True))),
        ),
    )


def repairs(text: Column, goal: Column) -> Column:
    """Candidates (an array with nulls) for a normal form: without a side that the goal does not name, then by REPAIRS."""
    words = F.split(text, " ")
    named = lambda w: F.coalesce(F.array_contains(F.split(goal, " "), w), F.lit(False))
    sides = F.transform(words, lambda w, i: F.when(w.isin(*SIDES) & ~named(w), F.array_join(F.filter(words, lambda x, j: j != i), " ")))
    out = []
    for pattern, says in REPAIRS:
        if pattern is None:
            out.append(F.when(F.contains(text, F.lit("electric kettle")), F.replace(text, F.lit("electric kettle"), F.lit("kettle"))))
        else:
            out.append(F.when(text.rlike(pattern), F.trim(F.regexp_replace(text, pattern, says))))
    return F.concat(sides, F.array(*out))


def vocabulary(entries: DataFrame) -> DataFrame:
    """norm, text, skills of rows (file, place, skill, text): of texts with the same normal form the first by file and place,
    with all skills that have this text. Texts of one word are no instruction."""
    rows = entries.where(F.contains("text", F.lit(" "))).select(normal(F.col("text")).alias("norm"), "text", "skill", "file", "place")
    first = rows.groupBy("norm").agg(F.min_by("text", F.struct("file", "place", "text")).alias("text"))
    skills = rows.groupBy(F.col("text").alias("_t")).agg(F.array_sort(F.collect_set("skill")).alias("skills"))  # as many as there are skills
    return first.join(skills, F.col("text") == F.col("_t")).select("norm", "text", "skills")


def canonical(df: DataFrame, words: DataFrame, prompt: str, hint: str | None = None, goal: str | None = None) -> DataFrame:
    """``df`` with ``instruction`` and ``skills``: its prompts in the wording of ``words`` (see vocabulary). Prompts that
    nothing fits stay as they are, stripped, without skills; a null prompt is empty. Each distinct triple of prompt, hint and
    goal goes through the cascade once."""
    column = lambda name: F.col(name).cast("string") if name else F.lit(None).cast("string")
    given = df.withColumn("_key", F.struct(F.regexp_replace(F.coalesce(column(prompt), F.lit("")), r"^\s+|\s+$", "").alias("raw"), F.coalesce(column(hint), F.lit("")).alias("hint"), F.coalesce(column(goal), F.lit("")).alias("goal")))
    rows = given.select("_key").distinct().select("_key", F.replace(normal(F.col("_key.raw")), F.lit("refrigerator"), F.lit("fridge")).alias("t"))
    exact = words.select(F.col("norm").alias("_n"), F.col("text").alias("hit"), F.col("skills").alias("hit_skills"))
    rows = rows.join(exact, F.col("t") == F.col("_n"), "left").drop("_n")
    done, rest = rows.where("hit is not null"), rows.where("hit is null").select("_key", "t", ruled(F.col("t"), F.col("_key.hint")).alias("said"))
    rest = rest.withColumns({"other": normal(F.col("said")), "aim": normal(F.col("_key.goal"))})
    more = F.when(F.col("other") != F.col("t"), repairs(F.col("other"), F.col("aim")))
    tries = F.concat(F.array("other"), repairs(F.col("t"), F.col("aim")), F.coalesce(more, F.array().cast("array<string>")))
    # The rule's own wording, if it is in the vocabulary, comes before all repairs.
    tries = F.filter(tries, lambda x, i: x.isNotNull() | (i == 0))  # a row stays even without a candidate
    tried = rest.select("_key", "t", "said", F.posexplode(tries).alias("place", "candidate"))
    tried = tried.join(exact, F.col("candidate") == F.col("_n"), "left")
    best = tried.groupBy("_key").agg(F.first("t").alias("t"), F.first("said").alias("said"), F.min_by(F.struct("hit", "hit_skills"), F.when(F.col("hit").isNotNull(), F.col("place"))).alias("b"))
    own = F.concat(F.upper(F.substring("t", 1, 1)), F.substring("t", 2, 1 << 30), F.lit("."))
    spoken = F.when(F.col("t").rlike(ACTION) & ~F.col("t").rlike(NO_ACTION), own)
    found = done.select("_key", F.col("hit").alias("instruction"), F.col("hit_skills").alias("skills")).unionByName(
        best.select("_key", F.coalesce("b.hit", "said", spoken, "_key.raw").alias("instruction"), F.coalesce("b.hit_skills", F.array().cast("array<string>")).alias("skills")))
    return given.join(found.withColumnRenamed("_key", "_k"), F.col("_key") == F.col("_k")).drop("_key", "_k")
