"""A lookup table on arrays."""

from __future__ import annotations

import numpy as np


class Table:
    """From keys (uint64) to places in an array, by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        self.keys = keys
        at, rest = self.home(keys), np.arange(len(keys))
        while len(rest):
            free = self.slots[at] < 0
            self.slots[at[free]] = rest[free]  # of those that want a slot the last one gets it
            lost = self.slots[at] != rest
            at, rest = (at[lost] + 1) & self.mask, rest[lost]

    def home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those that are not there."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int32)
        at = self.home(keys)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            out[open_] = self.slots[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[out[open_]] != keys[open_])]
        return out
