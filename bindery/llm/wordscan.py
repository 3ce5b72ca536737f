"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""
from __future__ import annotations

import numpy as np

#: lower-cased byte of each byte; digits, letters and everything from 0x80 on are word bytes
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[65:91] = IS_WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15
#: a fixed odd weight of each lower-cased byte
WEIGHTS = (np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1))[LOWER]
WEIGHTS[~IS_WORD] = 0


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self, base: int = _BASE):
        self.bases = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64)
                                  for b in self.bases)
        return self.up, self.down


class Words:
    """start, end: byte positions of each word; first: index of each text's first word, and the total; hash: of the
    lower-cased word (equal words have equal hashes)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, powers: Powers):
        inside = IS_WORD[data]
        before = np.r_[False, inside[:-1]]
        starts_text = offsets[:-1][offsets[:-1] < len(data)]
        before[starts_text] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.r_[inside[1:], False]
        ends_text = offsets[1:][offsets[1:] > 0] - 1
        after[ends_text] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        powers.reach(len(data))
        if len(self.start):
            weighed = WEIGHTS[data] * powers.up[:len(data)]
            self.hash = np.add.reduceat(weighed, self.start) * powers.down[self.start]
        else:
            self.hash = np.zeros(0, np.uint64)
