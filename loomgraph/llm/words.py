"""Words of texts as 64-bit values, without a Python step for each word."""

from __future__ import annotations

import numpy as np

from .shared import GOLDEN, mix64
from .spans import powers

#: The separators of ``[^\x20\x09-\x0D]+`` (fixed values); bytes.split() uses the same.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: 64-bit values of the 256 bytes, and of the bytes with A-Z as a-z.
BYTE_VALUES = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1000)) * GOLDEN)
_folded = np.arange(256)
_folded[65:91] += 32
FOLDED_VALUES = BYTE_VALUES[_folded]


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a byte array start and end."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = SEPARATOR[data]
    change = np.flatnonzero(gap[1:] != gap[:-1])
    return change[::2], change[1::2]


def word_values(texts: list[bytes], fold: bool = False) -> list[np.ndarray]:
    """For each text the 64-bit values of its words; ``fold`` takes A-Z as a-z."""
    out: list[np.ndarray] = []
    table, begin = FOLDED_VALUES if fold else BYTE_VALUES, 0
    while begin < len(texts):
        size, stop = 0, begin
        while stop < len(texts) and (stop == begin or size < 1 << 20):
            size += len(texts[stop]) + 1
            stop += 1
        data = np.frombuffer(b" ".join(texts[begin:stop]) + b" ", np.uint8)
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=sums[1:])
        starts, ends = word_edges(data)
        values = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * GOLDEN)
        limits = np.cumsum([len(t) + 1 for t in texts[begin:stop]])
        at = np.searchsorted(starts, limits)
        out += np.split(values, at[:-1])
        begin = stop
    return out
