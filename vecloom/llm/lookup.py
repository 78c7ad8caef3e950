"""A hash table of 64-bit keys in numpy arrays, for vectorised lookups in tasks."""

from __future__ import annotations

import numpy as np

from vecloom.llm.base import mix

FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Lookup:
    """Values of distinct keys; ``get`` returns them for an array of keys, and which keys are known."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 16
        while size < 2 * len(keys):
            size *= 2
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, FREE, np.uint64)
        self.values = np.zeros(size, values.dtype)
        waiting, slot = np.arange(len(keys)), mix(keys) & self.mask
        while len(waiting):
            _, first = np.unique(slot, return_index=True)
            first = first[self.keys[slot[first]] == FREE]
            self.keys[slot[first]] = keys[waiting[first]]
            self.values[slot[first]] = values[waiting[first]]
            rest = np.ones(len(waiting), bool)
            rest[first] = False
            waiting, slot = waiting[rest], (slot[rest] + np.uint64(1)) & self.mask

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = mix(keys) & self.mask
        held = self.keys[slot]
        known = held == keys
        found = np.where(known, self.values[slot], np.zeros(1, self.values.dtype))
        open_ = np.flatnonzero(~known & (held != FREE))
        slot = slot[open_]
        while len(open_):
            slot = (slot + np.uint64(1)) & self.mask
            held = self.keys[slot]
            hit = held == keys[open_]
            known[open_[hit]] = True
            found[open_[hit]] = self.values[slot[hit]]
            go = ~hit & (held != FREE)
            open_, slot = open_[go], slot[go]
        return found, known
