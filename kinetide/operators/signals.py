"""lines of a report on a run's signals: openings, closings, their pairs and holds, stops and activity, in one order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of the two directions, longest gap of a pair in seconds, least length of a stop, and the order of sections.
OPENING, CLOSING = "open_to_close", "close_to_open"
PAIR_GAP, LEAST_STOP = 2.0, 0.3
SECTIONS = ("silent", "active", "stop", "grip")


def annotated(grips: DataFrame, keys: list[str], gap: float = PAIR_GAP) -> DataFrame:
    """``grips`` (keys, side, t, direction) with ``role`` and ``other``, by sorts of a key's side:

    ``paired``: an opening whose next of its side is a closing within ``gap``, and that closing, each with the other's time;
    ``held``: an opening that is not paired, with the next closing that is not;
    ``matched``: a closing that is not paired, with the last opening before it for which it is the next such closing;
    null: the rest. Rows without time, side or direction are left out, other directions stay without a role."""
    rows = grips.where("t is not null and side is not null and direction is not null")
    w = Window.partitionBy(*keys, "side").orderBy("t", "direction")
    opens, closes = F.col("direction") == OPENING, F.col("direction") == CLOSING
    to = F.lead(F.struct("t", "direction")).over(w)
    back = F.lag(F.struct("t", "direction")).over(w)
    ahead = opens & (to["direction"] == CLOSING) & (to["t"] - F.col("t") <= gap)
    behind = closes & (back["direction"] == OPENING) & (F.col("t") - back["t"] <= gap)
    rows = rows.withColumn("_pair", F.when(ahead, to["t"]).when(behind, back["t"]))
    free = Window.partitionBy(*keys, "side", F.col("_pair").isNull()).orderBy("t", "direction")
    following = F.first(F.when(closes, F.col("t")), ignorenulls=True).over(free.rowsBetween(1, Window.unboundedFollowing))
    # The last opening before a closing is its own if no other closing is between them.
    last = F.last(F.when(opens | closes, F.struct("t", "direction")), ignorenulls=True).over(free.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_next": following, "_last": last})
    role = F.when(F.col("_pair").isNotNull(), "paired").when(opens & F.col("_next").isNotNull(), "held").when(closes & (F.col("_last.direction") == OPENING), "matched")
    rows = rows.withColumn("role", role)
    return rows.withColumn("other", F.when(F.col("role") == "paired", F.col("_pair")).when(F.col("role") == "held", F.col("_next")).when(F.col("role") == "matched", F.col("_last.t"))).drop("_pair", "_next", "_last")


def _seconds(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", c)


def grip_line(t: Column, side: Column, direction: Column, role: Column, other: Column) -> Column:
    """One line of a grip with its pair or how long it held."""
    long = _seconds(F.abs(other - t), 1)
    said = F.when(role == "paired", F.concat(F.lit("PAIRED with t="), _seconds(other), F.lit("s")))
    said = said.when(role == "held", F.concat(F.lit("held until t="), _seconds(other), F.lit("s, grip duration "), long, F.lit("s")))
    said = said.when(role == "matched", F.concat(F.lit("matches grip that started at t="), _seconds(other), F.lit("s, grip duration "), long, F.lit("s")))
    return F.concat(F.lit("- t="), _seconds(t), F.lit("s  "), side, F.lit(" gripper "), direction, F.coalesce(F.concat(F.lit("  ("), said, F.lit(")")), F.lit("")))


def lines(grips: DataFrame, spans: DataFrame, keys: list[str], gap: float = PAIR_GAP, least_stop: float = LEAST_STOP) -> DataFrame:
    """keys, place, line: all lines of a key in their order: silent spans, active spans, stops and grips, each by time.
    ``spans``: keys, kind (silent, active or stop), name (a side, or a stop's), start, end. Stops below ``least_stop`` and spans
    without start or end have no line."""
    made = annotated(grips, keys, gap).select(*keys, F.lit(SECTIONS.index("grip")).alias("section"), "t", F.col("side").alias("_tie"), grip_line(F.col("t"), F.col("side"), F.col("direction"), F.col("role"), F.col("other")).alias("line"))
    good = spans.where(F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("kind").isin(*SECTIONS[:3]) & ~((F.col("kind") == "stop") & (F.col("end") - F.col("start") < least_stop)))
    name = F.coalesce("name", F.when(F.col("kind") == "stop", "base_zero").otherwise("?"))
    text = F.concat(F.lit("- "), name, F.lit(": ["), _seconds(F.col("start")), F.lit("s - "), _seconds(F.col("end")), F.lit("s]"), F.when(F.col("kind") == "stop", F.concat(F.lit(" dur="), _seconds(F.col("end") - F.col("start")), F.lit("s"))).otherwise(""))
    section = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("kind")).cast("int") - 1
    both = made.unionByName(good.select(*keys, section.alias("section"), F.col("start").alias("t"), name.alias("_tie"), text.alias("line")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("section", "t", "_tie", "line"))
    return both.select(*keys, place.alias("place"), F.element_at(F.array(*map(F.lit, SECTIONS)), F.col("section") + 1).alias("section"), "line")


def report(made: DataFrame, keys: list[str], titles: dict[str, str]) -> DataFrame:
    """keys, text: a key's lines (see lines), each section after its title; a section without lines has none."""
    first = F.row_number().over(Window.partitionBy(*keys, "section").orderBy("place")) == 1
    title = F.create_map(*[F.lit(x) for pair in titles.items() for x in pair])
    rows = made.withColumn("_line", F.when(first, F.concat_ws("\n", F.try_element_at(title, F.col("section")), "line")).otherwise(F.col("line")))
    listed = F.array_sort(F.collect_list(F.struct("place", "_line")))  # a key is one run, whose report is one text
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["_line"]), "\n").alias("text"))
