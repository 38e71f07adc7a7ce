"""what a planner proposes, mended by what came before in the run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetide.functions.control import SHUT, jaw_gap

# The task, the two wordings, stages and the recovery's intents.
TASK = "KettleBoiling"
PICK, PLACE = "Pick up the kettle from the counter.", "Place the kettle on the stove burner."
INTENTS = {"navigate": ("Navigate to the sink.", "move_to"), "spout": ("Move the spout to wash all locations of the sink basin.", "manipulate")}


def stage_of(stage: Column, skills: Column) -> Column:
    """Opening and closing is manipulation where the vocabulary knows the instruction as that and not as a switch."""
    acts = F.array_contains(skills, "manipulate") & ~F.array_contains(skills, "switch")
    return F.when(stage == "open_close", F.when(F.coalesce(acts, F.lit(False)), "manipulate").otherwise("switch")).otherwise(stage)


def repaired(plans: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``plans`` (keys, order, task, prompt, stage, sketch, outcome, state (16 numbers at the time of the plan), intent) with
    prompt, stage and sketch as they are carried out, and ``rule``, which says why:

    ``burner``: a switch after a completed placing goes to the one burner that the placing's sketch turns on;
    ``regrasp``: a placing of the kettle after a failed pick, with jaws that hold nothing, is that pick again;
    ``recovery``: an intent comes before all else.

    The row before counts as it was carried out, so a regrasp can follow a regrasp. A run of rows that would be regrasps is
    one if the row before the run is the pick: that is one look back over the run, not a walk."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(F.struct("outcome", "stage", "prompt", "sketch", "intent")).over(w)
    gap = jaw_gap(F.col("state"))
    mine = F.col("task") == TASK
    free = F.col("intent").isNull()
    rows = plans.withColumn("_before", before)
    fits = mine & free & (F.col("_before.outcome") == "failed") & (F.col("prompt") == PLACE) & (gap <= SHUT)
    rows = rows.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    # As carried out, the last row that is no such placing is what all of them since then go back to.
    anchor = F.last(F.when(~F.col("_fits"), F.struct("stage", "prompt", "sketch", F.col("intent").isNotNull().alias("said"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_anchor", anchor)
    again = F.col("_fits") & (F.col("_anchor.stage") == "pick_up_from") & (F.col("_anchor.prompt") == PICK) & ~F.col("_anchor.said")
    rows = rows.withColumn("_again", F.coalesce(again, F.lit(False)))
    placed = (F.col("_before.outcome") == "complete") & (F.col("_before.stage") == "place_on") & F.col("_before.intent").isNull() & ~F.coalesce(F.lag("_again").over(w), F.lit(False))
    burners = F.array_distinct(F.filter("_before.sketch", lambda s: F.startswith(s, F.lit("Turn on ")) & F.contains(s, F.lit(" burner"))))
    rows = rows.withColumn("_burner", F.when(mine & free & placed & (F.col("stage") == "switch") & (F.size(burners) == 1), F.get(burners, F.lit(0))))
    said = F.create_map(*[x for name, (text, stage) in INTENTS.items() for x in (F.lit(name), F.struct(F.lit(text).alias("prompt"), F.lit(stage).alias("stage")))])
    rows = rows.withColumn("_said", F.try_element_at(said, F.col("intent")))
    rule = F.when(F.col("_said").isNotNull(), "recovery").when(F.col("_again"), "regrasp").when(F.col("_burner").isNotNull(), "burner")
    prompt = F.coalesce("_said.prompt", F.when(F.col("_again"), F.col("_anchor.prompt")), "_burner", "prompt")
    stage = F.coalesce("_said.stage", F.when(F.col("_again"), F.col("_anchor.stage")), "stage")
    sketch = F.when(F.col("_said").isNotNull(), F.array("_said.prompt")).when(F.col("_again"), F.col("_anchor.sketch")).when(F.col("_burner").isNotNull(), F.array("_burner")).otherwise(F.col("sketch"))
    return rows.withColumns({"rule": rule, "_p": prompt, "_s": stage, "_k": sketch}).withColumns({"prompt": F.col("_p"), "stage": F.col("_s"), "sketch": F.col("_k")}).drop("_before", "_fits", "_anchor", "_again", "_burner", "_said", "_p", "_s", "_k")
