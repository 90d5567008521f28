"""Hamming comparison of 64-bit words by bit planes, for the rows of one block of candidates.

A lane word holds one bit of 64 candidates. Comparing a row with those 64 takes one XOR per plane; the differing bits
are counted in three carry-save bit counters per lane, with a sticky bit for lanes past the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LANES = 64
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Planes between two looks at which blocks may be abandoned.
STRIDE = 8
#: (row, lane word) pairs compared at once: bounds the memory of a task.
BATCH = 1 << 16


def planes_of(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bit planes of every lane block; blocks never cross one of ``starts`` (first rows of groups).

    Returns planes (64 x blocks), the first row of each block and the number of rows in it.
    """
    ends = np.append(starts[1:], len(words))
    counts = -(-(ends - starts) // LANES)
    group = np.repeat(np.arange(len(starts)), counts)
    nth = np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = starts[group] + nth * LANES
    filled = np.minimum(ends[group] - first, LANES)
    lanes = np.zeros((len(first), LANES), np.uint64)
    inside = np.arange(LANES)[None, :] < filled[:, None]
    lanes[inside] = words
    bits = np.unpackbits(lanes.view(np.uint8).reshape(len(first), LANES, 8), axis=2, bitorder="little")
    packed = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)[:, :, 0], first, filled


def close_lanes(rows: np.ndarray, blocks: np.ndarray, planes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (row word, block number): the pairs with a lane within ``radius`` bits, and their lanes as a bit set.

    ``radius`` is at most 7, what three counters hold. Pairs of which every lane is past the radius are abandoned.
    """
    alive = np.arange(len(rows))
    one, two, four, past = (np.zeros(len(rows), np.uint64) for _ in range(4))
    for plane in range(64):
        bit = np.zeros(len(rows), np.uint64) - ((rows >> np.uint64(plane)) & np.uint64(1))
        differs = planes[plane][blocks] ^ bit
        carry = one & differs
        one ^= differs
        again = two & carry
        two ^= carry
        past |= four & again
        four ^= again
        if plane % STRIDE == STRIDE - 1:
            over = past | _over(one, two, four, radius)
            keep = over != ALL
            if not keep.all():
                alive, rows, blocks = alive[keep], rows[keep], blocks[keep]
                one, two, four, over = one[keep], two[keep], four[keep], over[keep]
            past = over
            if not len(alive):
                break
    return alive, ~past


def _over(one: np.ndarray, two: np.ndarray, four: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is above ``radius``."""
    above, equal = np.zeros_like(one), np.full_like(one, ALL)
    for value, counter in ((4, four), (2, two), (1, one)):
        if radius & value:
            equal = equal & counter
        else:
            above = above | (equal & counter)
            equal = equal & ~counter
    return above


def close_pairs(words: np.ndarray, starts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches (left, right) of row numbers, left < right, of one group and within ``radius`` bits of each other.

    ``words`` are grouped; ``starts`` are the first rows of the groups.
    """
    if not len(words):
        return
    planes, first, filled = planes_of(words, starts)
    group_of_block = np.searchsorted(starts, first, side="right") - 1
    block_from = np.searchsorted(group_of_block, np.arange(len(starts)))
    block_to = np.searchsorted(group_of_block, np.arange(len(starts)), side="right")
    group = np.searchsorted(starts, np.arange(len(words)), side="right") - 1
    mine = block_from[group] + (np.arange(len(words)) - starts[group]) // LANES
    todo = block_to[group] - mine  # a row looks at its own block and those after it
    ends = np.cumsum(todo)
    begin = 0
    while begin < len(words):
        upto = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + BATCH, side="right")))
        row = np.repeat(np.arange(begin, upto), todo[begin:upto])
        nth = np.arange(len(row)) - np.repeat(np.cumsum(todo[begin:upto]) - todo[begin:upto], todo[begin:upto])
        for at in range(0, len(row), BATCH):
            r, n = row[at : at + BATCH], nth[at : at + BATCH]
            block = mine[r] + n
            alive, lanes = close_lanes(words[r], block, planes, radius)
            if len(alive):
                bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                pair, lane = np.nonzero(bits)
                left, to = r[alive[pair]], block[alive[pair]]
                right = first[to] + lane
                real = (lane < filled[to]) & (right > left)
                if real.any():
                    yield left[real], right[real]
        begin = upto


class Forest:
    """Which rows are linked, directly or through others; minimum labels, hooked in whole arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        while len(left):
            a, b = self.parent[left], self.parent[right]
            open_ = a != b
            left, right, a, b = left[open_], right[open_], a[open_], b[open_]
            if not len(left):
                return
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            self._flatten()

    def _flatten(self) -> None:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return
            self.parent = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """One link per row to the smallest row of its component."""
        child = np.nonzero(self.parent != np.arange(len(self.parent)))[0]
        return child, self.parent[child]
