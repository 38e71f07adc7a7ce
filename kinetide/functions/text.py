"""Text and label functions as column expressions: normal forms, rules by prefix, cleaning, JSON in text."""

from __future__ import annotations

from string import Formatter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of skill descriptions and the prefixes that lead to them, in order.
PLACE_VERBS = ("place", "put")
LABEL_PREFIXES = (("move ", "move_to"), ("pick up", "pick_up_from"), ("open ", "open"), ("close ", "close"))
LABELS = ("move_to", "pick_up_from", "place_on", "place_in", "open", "close", "other")


def strip(c: Column) -> Column:
    """Without white space at either end (all of it, not only blanks)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def folded(c: Column) -> Column:
    """lower case, stripped."""
    return F.lower(strip(c))


def squeezed(c: Column) -> Column:
    """runs of white space become one blank, ends are stripped."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def bare_prompt(c: Column) -> Column:
    """without a trailing ordinal, punctuation and case; single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(without_ordinal(c)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def without_ordinal(c: Column) -> Column:
    """without a trailing "(i/n)"."""
    return F.trim(F.regexp_replace(c, r"\s*\(\d+/\d+\)\s*$", ""))


def bare_end(c: Column) -> Column:
    """without full stops and blanks at the end."""
    return F.rtrim(c, F.lit(". "))


def label(c: Column) -> Column:
    """The label of a description; the first rule that fits counts; null stays null."""
    text = folded(c)
    placed = F.startswith(text, F.lit(PLACE_VERBS[0])) | F.startswith(text, F.lit(PLACE_VERBS[1]))
    out = F.when(text.isNull(), F.lit(None).cast("string")).when(placed & F.contains(text, F.lit(" on ")), "place_on").when(placed, "place_in")
    for prefix, name in LABEL_PREFIXES:
        out = out.when(F.startswith(text, F.lit(prefix)), name)
    return out.otherwise("other")


def aliased(c: Column, aliases: dict[str, str]) -> Column:
    """by a map of names; others stay."""
    if not aliases:
        return c
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)


def number_at_end(c: Column, sep: str = "-") -> Column:
    """the number after the last ``sep``; without one, a hash below 2**31."""
    return F.coalesce(F.element_at(F.split(c, sep), -1).try_cast("bigint"), F.pmod(F.xxhash64(c), F.lit(1 << 31)))


def padded_id(prefix: str, n: Column, width: int = 4) -> Column:
    """F13."""
    return F.format_string(f"{prefix}%0{width}d", n)


def shortened(c: Column, most: int = 220) -> Column:
    """texts above ``most`` characters end in three dots."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def base64_size(c: Column) -> Column:
    """length of the base64 form of ``c`` bytes."""
    return (F.ceil(c / 3) * 4).cast("bigint")


def without_data_url(c: Column) -> Column:
    """a data URL keeps what comes before its comma."""
    return F.when(F.startswith(c, F.lit("data:")), F.concat(F.substring_index(c, ",", 1), F.lit(",<redacted>"))).otherwise(c)


def half_even(c: Column, digits: int = 0) -> Column:
    """halves to even, of the decimal text."""
    return F.rint(c) if digits == 0 else F.bround(c, digits)


def half_even_exact(c: Column, digits: int) -> Column:
    """to ``digits`` decimals by the exact value of the binary number, as it is seldom halfway although its decimals are;
    halves to even. For sizes below 2**52 / 10**digits.

    The product with the power of ten has an error, which splitting both factors gives exactly; it decides where the rounded
    product lies halfway or on an integer's far side."""
    scale = float(10**digits)
    split = lambda x: (x * 134217729.0) - ((x * 134217729.0) - x)
    product, high = c * scale, split(c)
    top = 134217729.0 * scale - (134217729.0 * scale - scale)
    low, rest = c - high, scale - top
    error = ((high * top - product) + high * rest + low * top) + low * rest
    floor = F.floor(product)
    over = product - floor - 0.5  # exact
    up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (floor % 2 != 0))))
    return (floor + F.when(up, 1).otherwise(0)) / scale


def now_prompt(task: Column, skill: Column, style: str = "task_then_now", bare: bool = True) -> Column:
    """"<task>. Now: <skill>.", both without full stops and blanks at their end; or only the skill, as it is unless ``bare``.
    Null texts are empty."""
    skill, task = F.coalesce(skill, F.lit("")), F.coalesce(task, F.lit(""))
    if style == "skill_only":
        return bare_end(skill) if bare else skill
    if style != "task_then_now":
        raise ValueError(f"no such style: {style}")
    return F.concat(bare_end(task), F.lit(". Now: "), bare_end(skill), F.lit("."))


def frame_path(task: Column, episode: Column, view: Column, frame: Column, suffix: str = "jpg") -> Column:
    """a frame's place below a cache: task, episode, view and frame, padded with zeros."""
    return F.concat_ws("/", F.format_string("task-%04d", task), F.format_string("episode_%08d", episode), view, F.format_string(f"dataset_%08d.{suffix}", frame))


def episode_path(pattern: str, episode: Column, chunk_size: int = 1000, **more: Column) -> Column:
    """a pattern with {episode_chunk:03d}, {episode_index:06d} and further names, filled in; an episode's chunk is its
    number over ``chunk_size``. A path that leads out of its folder is an error."""
    values = {"episode_index": episode, "episode_chunk": F.floor(episode / chunk_size), **more}
    parts = []
    for literal, name, spec, _ in Formatter().parse(pattern):
        parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.format_string(f"%{spec}", values[name]) if spec else values[name].cast("string"))
    path = F.concat(*parts)
    outside = F.startswith(path, F.lit("/")) | F.exists(F.split(path, "/"), lambda x: x == "..")
    return F.when(outside, F.raise_error(F.concat(F.lit("a path leaves its folder: "), path)).cast("string")).otherwise(path)


def _first_json(text: str | None) -> str | None:
    """The first balanced {...} or [...] outside which nothing of it is quoted."""
    if text is None:
        return None
    for start, c in enumerate(text):
        if c not in "{[":
            continue
        depth, quoted, skip = 0, False, False
        for i in range(start, len(text)):
            x = text[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = x == "\\", x != '"'
            elif x == '"':
                quoted = True
            elif x in "{[":
                depth += 1
            elif x in "}]":
                depth -= 1
                if depth == 0:
                    return text[start : i + 1]
        return None
    return None


def first_json(c: Column) -> Column:
    """the first JSON object or array in a text, as text; null without one. Nesting is beyond regular expressions, so
    this is a batch function; give what it returns to from_json."""

    @F.pandas_udf("string")
    def scan(x: pd.Series) -> pd.Series:
        return x.map(_first_json, na_action="ignore")

    return scan(c)


def parsed(c: Column, schema: str) -> Column:
    """JSON of the whole text, else of the first object within it."""
    return F.coalesce(F.from_json(F.when(strip(c).rlike(r"^[\{\[]"), c), schema), F.from_json(first_json(c), schema))


def prompt_text(c: Column) -> Column:
    """underscores and line ends become blanks, lower case, stripped."""
    return F.lower(strip(F.translate(c, "_\n", "  ")))


def merged_name(name: Column, aliases: dict[str, str], release: str = r"\brelease\b", into: str = r"(?i)\b(into|inside|in)\b", onto: str = r"(?i)\b(onto|on)\b", description: Column | None = None) -> Column:
    """Releases go by their description (into before onto) first, then the aliases apply."""
    said = name if description is None else description
    routed = F.when(name.rlike(release) & said.rlike(into), "place in").when(name.rlike(release) & said.rlike(onto), "place on").otherwise(name)
    return aliased(routed, aliases)
