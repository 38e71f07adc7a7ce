"""codecs of states and actions as column expressions: cosine transform and quantisation, mixed radix, bins in text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels of the digits of a code, by the number of codes; bins of a state; tokens at the end of a vocabulary that
# have other uses.
LEVELS = {2**8: (8, 6, 5), 2**10: (8, 5, 5, 5), 2**12: (7, 5, 5, 5, 5), 2**14: (8, 8, 8, 6, 5), 2**16: (8, 8, 8, 5, 5, 5)}
BINS, SPECIAL = 256, 128
#: Steps of a unit of a cosine coefficient.
SCALE = 10.0


def cosine_matrix(n: int) -> list[list[float]]:
    """The orthonormal cosine transform (second kind) of ``n`` values: row k has the weights of coefficient k."""
    return [[math.sqrt((2 if k else 1) / n) * math.cos(math.pi * (2 * t + 1) * k / (2 * n)) for t in range(n)] for k in range(n)]


def _times(matrix: list[list[float]], chunk: Column, width: int) -> Column:
    """A fixed matrix times a chunk (an array of rows of ``width`` numbers)."""
    rows = F.array(*[F.array(*map(F.lit, r)) for r in matrix])
    dot = lambda r, d: F.aggregate(F.zip_with(r, chunk, lambda a, row: a * F.get(row, d)), F.lit(0.0), lambda s, x: s + x)
    return F.transform(rows, lambda r: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda d: dot(r, d)))


def cosine_tokens(chunk: Column, n: int, width: int, scale: float = SCALE) -> Column:
    """An action chunk of ``n`` steps as integers: each dimension's cosine coefficients, times ``scale``, to the nearest (halves
    to even), those of low frequency first. Chunks of another shape or with a missing number are null."""
    whole = (F.size(chunk) == n) & F.forall(chunk, lambda r: (F.size(r) == width) & F.forall(r, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return F.when(whole, F.transform(F.flatten(_times(cosine_matrix(n), chunk, width)), lambda x: F.rint(x * scale).cast("bigint")))


def cosine_chunk(tokens: Column, n: int, width: int, scale: float = SCALE) -> Column:
    """The chunk of cosine_tokens(); zeros where there are too few tokens, as many as fit where there are more. No number is
    further from the original than half a step times sqrt(n), and encoding again gives the same tokens."""
    there = F.size(tokens) >= n * width
    rows = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: F.transform(F.slice(tokens, t * width + 1, width), lambda x: x / scale))
    back = [list(column) for column in zip(*cosine_matrix(n), strict=True)]
    none = F.array_repeat(F.array_repeat(F.lit(0.0), width), n)
    return F.when(there, _times(back, rows, width)).when(tokens.isNotNull(), none)


def places(levels: tuple[int, ...]) -> list[int]:
    """The value of each digit's place, the first the smallest."""
    out = [1]
    for n in levels[:-1]:
        out.append(out[-1] * n)
    return out


def code_of(x: Column, levels: tuple[int, ...]) -> Column:
    """Numbers of [-1, 1] (one for each of ``levels``) as one code: each to the nearest of its even steps, then mixed radix.
    Numbers beyond go to the end; an array of another length is null."""
    size = F.array(*[F.lit(n) for n in levels])
    digits = F.zip_with(x, size, lambda v, n: F.rint((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)) + 1) * (n - 1) / 2).cast("bigint"))
    return F.when(F.size(x) == len(levels), F.aggregate(F.zip_with(digits, F.array(*[F.lit(p).cast("bigint") for p in places(levels)]), lambda d, p: d * p), F.lit(0).cast("bigint"), lambda s, v: s + v))


def digits_of(code: Column, levels: tuple[int, ...]) -> Column:
    """The digits of a code; those of a code that is out of range wrap round."""
    each = F.array(*[F.struct(F.lit(p).cast("bigint").alias("p"), F.lit(n).cast("bigint").alias("n")) for p, n in zip(places(levels), levels, strict=True)])
    return F.when(code.isNotNull(), F.transform(each, lambda e: F.pmod(F.floor(code / e["p"]), e["n"])))


def values_of(code: Column, levels: tuple[int, ...]) -> Column:
    """The numbers of [-1, 1] that a code stands for."""
    return F.zip_with(digits_of(code, levels), F.array(*[F.lit(n) for n in levels]), lambda d, n: d / (n - 1) * 2 - 1)


def state_bin(x: Column, bins: int = BINS) -> Column:
    """The last of ``bins`` even edges from -1 on (1 left out) that a number is not below; -1 below all."""
    return F.greatest(F.lit(-1).cast("bigint"), F.least(F.lit(bins - 1).cast("bigint"), F.floor((x + 1) / (2.0 / bins))))


def state_prompt(prompt: Column, state: Column, bins: int = BINS) -> Column:
    """a prompt in lower case without underscores, and the state's bins, as the beginning of a sequence."""
    clean = F.replace(F.regexp_replace(F.lower(prompt), r"^\s+|\s+$", ""), F.lit("_"), F.lit(" "))
    return F.concat(F.lit("Task: "), clean, F.lit(", State: "), F.array_join(F.transform(state, lambda x: state_bin(x, bins).cast("string")), " "), F.lit(";\n"))


def vocabulary_token(action: Column, size: int) -> Column:
    """An action token's place in a text vocabulary of ``size``, from its end on; the same the other way round."""
    return F.lit(size - 1 - SPECIAL) - action


def sequence(prefix: Column, postfix: Column, n: int) -> Column:
    """Tokens of both parts, cut or padded to ``n``, with what is there (``mask``), what attends to its past only (``causal``)
    and what is learnt (``loss``): the postfix."""
    first, second = F.coalesce(prefix, F.array().cast("array<bigint>")), F.coalesce(postfix, F.array().cast("array<bigint>"))
    fill = lambda a, x: F.slice(F.concat(a, F.array_repeat(F.lit(x), n)), 1, n)
    marks = lambda a, x: F.transform(a, lambda _: F.lit(x))
    return F.struct(
        fill(F.concat(first, second), 0).alias("tokens"), fill(F.concat(marks(first, True), marks(second, True)), False).alias("mask"),
        fill(F.concat(marks(first, 0), marks(second, 1)), 0).alias("causal"), fill(F.concat(marks(first, False), marks(second, True)), False).alias("loss"),
    )


def binned_actions(tokens: Column, n: int, width: int, bins: int = BINS) -> Column:
    """Actions of bin numbers, ``n`` rows of ``width`` in [-1, 1]; zeros where there are too few."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: F.transform(F.slice(tokens, t * width + 1, width), lambda x: x / bins * 2 - 1))
    return F.when(F.size(tokens) >= n * width, rows).otherwise(F.array_repeat(F.array_repeat(F.lit(0.0), width), n))
