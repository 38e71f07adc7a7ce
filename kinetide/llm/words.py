"""Words of a batch of texts as arrays of places, without a step of Python for each word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .shingle import LOWER


@dataclass
class Words:
    """The texts' bytes with A-Z in lower case, one after another; start and end of each word in them; its row."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    def bytes(self, at: int) -> bytes:
        return self.data[self.start[at] : self.end[at]].tobytes()


def cut(texts: pa.Array, word: np.ndarray) -> Words:
    """Words of a string column (no nulls): maximal runs, within a text, of the bytes of which ``word`` (256 booleans) is true."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    at = offsets - offsets[0]
    inside = word[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]  # where a text begins, the byte before it is another's
    before[first] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[first[1:] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(at, start, side="right") - 1)


def as_arrow(words: Words) -> pa.LargeBinaryArray:
    """The words as an Arrow array."""
    size = words.end - words.start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    within = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)
    kept = words.data[np.repeat(words.start, size) + within]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
