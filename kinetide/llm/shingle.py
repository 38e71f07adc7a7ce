"""Words of whole texts as 64-bit hashes, without a step of Python for each word."""

from __future__ import annotations

import numpy as np

_R = np.random.RandomState(20)
#: Random values of the 256 bytes (two independent sets), odd bases, and multipliers of a shingle's words.
BYTES = _R.randint(0, 2**63, (2, 256)).astype(np.uint64) * np.uint64(2) + _R.randint(0, 2, (2, 256)).astype(np.uint64)
BASE = (_R.randint(0, 2**62, 2).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
STEPS = (_R.randint(0, 2**62, 64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
SEPARATE = np.zeros(256, bool)
SEPARATE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Powers:
    """Powers of a base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 2**64))
        self.up, self.down = _powers(self.base, 1), _powers(self.inverse, 1)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 16)
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self.up[:n], self.down[:n]


POWERS = [Powers(b) for b in BASE]


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words between ASCII white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SEPARATE[np.frombuffer(data, np.uint8)]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: bytes, lower: bool, which: int = 0) -> np.ndarray:
    """A hash of each word, with A-Z in lower case if ``lower``: a polynomial of its bytes modulo 2**64, mixed."""
    start, end = spans(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    b = np.frombuffer(data, np.uint8)
    up, down = POWERS[which].to(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTES[which][LOWER[b] if lower else b] * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * STEPS[63])


def shingles(data: bytes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``n`` consecutive words in lower case; of all words if there are fewer; none without."""
    w = word_hashes(data, True)
    if not len(w):
        return w
    k = min(n, len(w))
    out = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        out += w[j : len(w) - k + 1 + j] * STEPS[j]
    return np.unique(mix(out + np.uint64(k)))
