"""Ids of texts put together from the ids of their parts, a batch of texts at a time.

Texts repeat their parts (words with the separator before them). The distinct parts of a batch are told by a 64-bit hash
of their bytes; those that the worker has not met lately are encoded together, and the ids of all texts are gathered
from them by array indexing. What a worker keeps lies in flat arrays of at most MOST_PARTS parts; when they are full,
the parts that have not been met again go.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

MOST_PARTS, MOST_IDS = 1_000_000, 8_000_000


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], .. start[0] + size[0] - 1, start[1], ..."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class PartCodes:
    def __init__(self, encode: Callable, most_parts: int = MOST_PARTS, most_ids: int = MOST_IDS):
        """encode(places of parts among those of a batch, ...) -> (number of ids of each, all their ids)."""
        self._encode, self._most_parts, self._most_ids = encode, most_parts, most_ids
        self._forget()

    def _forget(self) -> None:
        self._keys, self._begin, self._count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._again, self._ids = np.zeros(0, bool), np.zeros(0, np.uint32)

    def _make_room(self, parts: int, ids: int) -> None:
        if len(self._keys) + parts <= self._most_parts and len(self._ids) + ids <= self._most_ids:
            return
        stay = np.flatnonzero(self._again)
        if 2 * len(stay) > self._most_parts or 2 * int(self._count[stay].sum()) > self._most_ids:
            self._forget()
            return
        self._ids = self._ids[ranges(self._begin[stay], self._count[stay])]
        self._keys, self._count = self._keys[stay], self._count[stay]
        self._begin, self._again = np.cumsum(self._count) - self._count, np.zeros(len(stay), bool)

    def _learn(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self._make_room(len(keys), len(ids))
        at = np.searchsorted(self._keys, keys)
        self._begin = np.insert(self._begin, at, np.cumsum(counts) - counts + len(self._ids))
        self._count = np.insert(self._count, at, counts)
        self._again = np.insert(self._again, at, False)
        self._keys = np.insert(self._keys, at, keys)
        self._ids = np.concatenate([self._ids, ids])

    def gather(self, keys: np.ndarray, *context) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each part, all ids) of the parts with some keys."""
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        place = np.searchsorted(self._keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self._keys)
        known[inside] = self._keys[place[inside]] == distinct[inside]
        old = place[known]
        self._again[old] = True
        counts, begin, ids = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64), self._ids
        counts[known], begin[known] = self._count[old], self._begin[old]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            n, new = self._encode(first[fresh], *context)
            counts[fresh], begin[fresh] = n, np.cumsum(n) - n + len(ids)
            ids = np.concatenate([ids, new])
            if len(fresh) <= self._most_parts // 2 and len(new) <= self._most_ids // 2:
                self._learn(distinct[fresh], n, new)
        sizes = counts[which]
        return sizes, ids[ranges(begin[which], sizes)]
