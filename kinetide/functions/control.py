"""Rules of robot control, attempts and policy inputs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import half_even, strip

# Stages and the kind of action they are, retries by kind and at most, verdicts and followups of a judge.
KINDS = {"pick_up_from": "pick", "pick": "pick", "place_in": "place", "place_on": "place", "place": "place", "move_to": "navigate", "manipulate": "action"}
ACTION_WORDS = ("move ", "stir ", "scrub ", "wash ")
WINDOWS = {"pick": 50, "place": 43, "navigate": 27, "open": 83, "close": 61, "switch": 72, "action": 98}
LONGER = {"pick up the bread from the toaster.": 65, "wait for the toaster to finish and the lever to pop up": 120}
#: A placing with jaws at least this wide in mm takes so few steps at once.
WIDE, FEW_STEPS, CAREFUL = 25.0, 3, "KettleBoiling"
STAGES = {"action", "navigate", "switch", "open", "close", *KINDS}
RETRIES, MOST_RETRIES = {"navigate": 1, "switch": 2, "action": 1}, 2
VERDICTS = ("complete", "incomplete", "error")
FOLLOWUPS = ("next", "retry", "replan_keep_pose", "replan_plan_deviated", "")
# Fixed value in mm: jaws at most this wide hold nothing.
SHUT = 5.0


def jaw_gap(state: Column) -> Column:
    """distance of the fingers in mm, from a state of 16 finite numbers; else null."""
    good = (F.size(state) == 16) & F.forall(state, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.abs(F.get(state, F.lit(14)) - F.get(state, F.lit(15))) * 1000)


def gripper_word(n: Column) -> Column:
    """a gripper's opening in words."""
    return F.when(n > 0.6, "OPEN").when(n > 0, "PARTLY-OPEN").when(n > -0.6, "PARTLY-CLOSED").when(n.isNull(), F.lit(None).cast("string")).otherwise("CLOSED")


def action_kind(stage: Column, prompt: Column) -> Column:
    """the kind of action of a stage."""
    low = F.lower(F.coalesce(prompt, F.lit("")))
    acts = F.startswith(low, F.lit(ACTION_WORDS[0]))
    for w in ACTION_WORDS[1:]:
        acts = acts | F.startswith(low, F.lit(w))
    out = F.when(stage == "pnp", F.when(F.startswith(low, F.lit("place")), "place").otherwise("pick")).when(stage == "open_close", F.when(acts, "action").otherwise("switch"))
    for name, kind in KINDS.items():
        out = out.when(stage == name, kind)
    return out.otherwise(stage)


def step_budget(chunks: Column, steps: Column) -> Column:
    """chunks of ``steps`` actions that do what ``chunks`` of five do; one at least."""
    return F.greatest(F.lit(1), F.ceil(chunks * 5 / steps)).cast("bigint")


def window_budget(stage: Column, prompt: Column, steps: Column, windows: dict[str, int] | None = None) -> Column:
    """how many chunks of ``steps`` actions a stage may take: those of its kind, more for some prompts. A kind without
    any is an error."""
    kind, own = action_kind(stage, prompt), WINDOWS | (windows or {})
    chunks = F.when(F.lit(False), F.lit(0))
    for name, n in own.items():
        chunks = chunks.when(kind == name, F.lit(n))
    chunks = chunks.otherwise(F.raise_error(F.concat(F.lit("no window for "), F.coalesce(kind, F.lit("null")))).cast("int"))
    for text, least in LONGER.items():
        chunks = F.when(F.lower(prompt) == text, F.greatest(chunks, F.lit(least))).otherwise(chunks)
    return step_budget(chunks, steps)


def steps_at_once(task: Column, stage: Column, state: Column, steps: Column) -> Column:
    """actions of a chunk that are carried out: fewer for a careful placing with wide jaws."""
    careful = (task == CAREFUL) & (action_kind(stage, F.lit("")) == "place") & (jaw_gap(state) >= WIDE)
    return F.when(F.coalesce(careful, F.lit(False)), F.least(steps, F.lit(FEW_STEPS))).otherwise(steps)


def retry_budget(kind: Column, requested: Column) -> Column:
    """retries that were asked for, at most those of the kind; those of the kind where none were."""
    cap = F.lit(MOST_RETRIES)
    for name, n in RETRIES.items():
        cap = F.when(kind == name, F.lit(n)).otherwise(cap)
    return F.when(requested > 0, F.least(requested, cap)).otherwise(cap)


def deltas(state: Column, before: Column, start: int, n: int) -> Column:
    """F32: change of ``n`` numbers of a state since the one before; null without it."""
    return F.when(before.isNotNull(), F.zip_with(F.slice(state, start + 1, n), F.slice(before, start + 1, n), lambda a, b: a - b))


def robot_info(state: Column, before: Column) -> Column:
    """F32: what a state of 16 finite numbers says, and its changes since one before, null without it; null for another state."""
    good = lambda s: jaw_gap(s).isNotNull()
    part = lambda a, n: F.slice(state, a + 1, n)
    prior = F.when(good(before), before)
    made = F.struct(
        part(0, 3).alias("end_effector_position_relative"), part(3, 4).alias("end_effector_rotation_relative"), part(7, 3).alias("base_position"), part(10, 4).alias("base_rotation"), part(14, 2).alias("gripper_finger_positions"),
        jaw_gap(state).alias("jaw_gap_mm"), deltas(state, prior, 0, 3).alias("delta_end_effector_position"), deltas(state, prior, 7, 3).alias("delta_base_position"), (jaw_gap(state) - jaw_gap(prior)).alias("delta_jaw_gap_mm"),
    )
    return F.when(good(state), made)


def carrying(outcome: Column, stage: Column, prompt: Column, window) -> Column:
    """the prompt of the last completed pick that no completed place follows, over a window of the history so far."""
    done = outcome == "complete"
    last = F.last(F.when(done & stage.isin("pick_up_from", "place_in", "place_on", "place"), F.struct(stage.alias("stage"), F.coalesce(prompt, F.lit("the picked-up item")).alias("prompt"))), ignorenulls=True).over(window)
    return F.when(last["stage"] == "pick_up_from", last["prompt"])


def carry_side(left: Column, right: Column) -> Column:
    """the closed gripper, if just one is."""
    return F.when((left < 0.5) & (right >= 0.5), "LEFT").when((right < 0.5) & (left >= 0.5), "RIGHT")


def inference_mode(size: Column, seconds: Column, most_bytes: int, most_seconds: float) -> Column:
    """whole videos go as they are unless they are too large or too long."""
    return F.when((size > most_bytes) | (seconds > most_seconds), "frames").otherwise("full_video")


def verdict_of(verdict: Column, followup: Column, stage: Column, gap: Column, observations: Column) -> Column:
    """verdict and followup of a judge in their fixed forms; complete needs three different observations, and a pick
    open jaws: else it is incomplete and tried again."""
    said, then = F.lower(strip(F.coalesce(verdict, F.lit("")))), F.lower(strip(F.coalesce(followup, F.lit(""))))
    said, then = F.when(said.isin(*VERDICTS), said).otherwise("incomplete"), F.when(then.isin(*FOLLOWUPS), then).otherwise("")
    weak = (said == "complete") & ((observations < 3) | (stage.isin("pick_up_from", "pick") & F.coalesce(gap <= SHUT, F.lit(False))))
    return F.struct(F.when(weak, "incomplete").otherwise(said).alias("verdict"), F.when(weak, "retry").otherwise(then).alias("followup"))


def video_context(frames: Column, fps: Column, packed_frames: Column, packed_fps: Column, scale: float) -> Column:
    """seconds of a video and of its compressed form, and the time scale that is measured from them (``scale`` without
    them), all rounded to two digits."""
    whole, packed = F.when((fps > 0) & (frames > 0), frames / fps), F.when((packed_fps > 0) & (packed_frames > 0), packed_frames / packed_fps)
    return F.struct(half_even(whole, 2).alias("source"), half_even(packed, 2).alias("compressed"), F.coalesce(half_even(whole / packed, 2), F.lit(scale)).alias("time_scale"))


def signal_lines(kind: Column, start: Column, end: Column, least_stop: float = 0.3) -> Column:
    """one line of a prompt for each signal; stops below ``least_stop`` have none."""
    line = F.format_string("%s %.2f-%.2f (%.2fs)", kind, start, end, end - start)
    return F.when((kind == "stop") & (end - start < least_stop), F.lit(None).cast("string")).otherwise(line)


SUBTASK = "id string, prompt string, stage_hint string, target_object_name string, rationale string, plan_sketch array<string>"


def subtask(c: Column) -> Column:
    """a subtask from its JSON, flat or within {"subtask": ...}: stage in lower case, prompt and sketch stripped, blank
    parts of the sketch dropped; null where the prompt is blank."""
    flat, inner = F.from_json(c, SUBTASK), F.from_json(c, f"subtask struct<{SUBTASK.replace(' ', ':').replace(',:', ',')}>")["subtask"]
    s = F.coalesce(inner, flat)
    sketch = F.filter(F.transform(F.coalesce(s["plan_sketch"], F.array().cast("array<string>")), strip), lambda x: F.length(x) > 0)
    made = F.struct(s["id"].alias("id"), strip(s["prompt"]).alias("prompt"), F.lower(strip(s["stage_hint"])).alias("stage_hint"), s["target_object_name"].alias("target_object_name"), sketch.alias("plan_sketch"))
    return F.when(F.length(strip(s["prompt"])) > 0, made)


def image_of(pixels: Column) -> Column:
    """Bytes as numbers from -1 to 1."""
    return F.transform(pixels, lambda x: x / 255.0 * 2 - 1)


def token_fields(tokens: Column, mask: Column) -> Column:
    """Tokens and their mask come together or not at all; one alone is an error."""
    wrong = tokens.isNull() != mask.isNull()
    return F.when(wrong, F.raise_error(F.lit("tokens and mask must both be given")).cast("boolean")).otherwise(tokens.isNotNull())


def policy_input(state: Column, images: dict[str, Column], actions: Column | None = None, prompt: Column | None = None) -> Column:
    """State, images, a mask of those that are there, and actions and prompt if they are given, as one struct."""
    parts = [state.alias("state"), F.struct(*[c.alias(k) for k, c in images.items()]).alias("image"), F.struct(*[c.isNotNull().alias(k) for k, c in images.items()]).alias("image_mask")]
    return F.struct(*parts, *([actions.alias("actions")] if actions is not None else []), *([prompt.alias("prompt")] if prompt is not None else []))


def rgb(pixels: Column) -> Column:
    """an image (rows of pixels of channels) with three channels and bytes: a fourth channel is dropped, one channel is
    repeated, and numbers of [0, 1] become bytes."""
    three = F.transform(pixels, lambda row: F.transform(row, lambda p: F.when(F.size(p) == 1, F.array_repeat(F.get(p, F.lit(0)), 3)).otherwise(F.slice(p, 1, 3))))
    most = F.array_max(F.flatten(F.flatten(three)))
    return F.transform(three, lambda row: F.transform(row, lambda p: F.transform(p, lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.when(most <= 1.0, x * 255).otherwise(x)))).cast("int"))))


def first_of_fields(obs: Column, names: list[str]) -> Column:
    """the first field that is there, of a map."""
    return F.coalesce(*[F.try_element_at(obs, F.lit(n)) for n in names])


def expert_of(hint: Column, given: Column, experts: dict[str, int]) -> Column:
    """The expert of a stage, only where none is given."""
    table = F.create_map(*[F.lit(x) for pair in experts.items() for x in pair])
    return F.coalesce(given, F.try_element_at(table, hint))


def meta_summary(c: Column) -> Column:
    """Task, scene and steps of an episode's JSON, whose ``config`` is JSON as text."""
    outer = F.from_json(c, "config string, n_steps bigint")
    inner = F.from_json(outer["config"], "task struct<activity_name:string>, scene struct<scene_instance:string>")
    return F.struct(inner["task"]["activity_name"].alias("task_name"), inner["scene"]["scene_instance"].alias("scene_instance"), F.coalesce(outer["n_steps"], F.lit(0).cast("bigint")).alias("n_steps"))


def padded_tokens(tokens: Column, n: int) -> Column:
    """tokens cut or padded with zeros to ``n``, with their mask."""
    have = F.slice(tokens, 1, n)
    gap = F.greatest(F.lit(0), F.lit(n) - F.size(have))
    return F.struct(F.concat(have, F.array_repeat(F.lit(0).cast("bigint"), gap)).alias("tokens"), F.concat(F.transform(have, lambda x: F.lit(True)), F.array_repeat(F.lit(False), gap)).alias("mask"))


def mixed_radix(digits: Column, levels: list[int]) -> Column:
    """digits (each from 0 to its level - 1) as one number, the first digit the smallest place."""
    places = [1]
    for n in levels[:-1]:
        places.append(places[-1] * n)
    return F.aggregate(F.zip_with(digits, F.array(*[F.lit(p).cast("bigint") for p in places]), lambda d, p: d * p), F.lit(0).cast("bigint"), lambda s, x: s + x)


def digitised(x: Column, levels: int) -> Column:
    """a number of [-1, 1] as the nearest of ``levels`` even steps."""
    return F.rint((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) + 1) / 2 * (levels - 1)).cast("bigint")
