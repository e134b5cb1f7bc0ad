"""Hamming comparison of fingerprints of 64 bits, or of several such words, in bit slices.

Fingerprints are stored vertically: plane b holds bit b of 64 fingerprints in each machine word. A word operation on two
planes therefore works on 64 comparisons, and their distances are counted in a few words of bitwise counters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Planes between two looks at which blocks of 64 comparisons can be abandoned.
STEP = 8


def to_planes(fingerprints: np.ndarray, spare: int = 2) -> np.ndarray:
    """Planes (bits x words) of a run of fingerprints (n, or n x 64-bit words each), with some empty words at the end."""
    n = len(fingerprints)
    words = -(-n // 64) + spare
    each = fingerprints.astype("<u8").reshape(n, -1).view(np.uint8)
    rows = np.zeros((words * 64, each.shape[1]), np.uint8)
    rows[:n] = each
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


class Counters:
    """64 distances in each word, as bitwise counters that saturate."""

    def __init__(self, words: int, radius: int):
        self.radius = radius
        self.bits = [np.zeros(words, np.uint64) for _ in range(max(1, radius.bit_length()))]
        self.beyond = np.zeros(words, np.uint64)

    def add(self, differences: np.ndarray) -> None:
        """Add planes of differences two at a time: a carry-save adder takes both into the lowest counter bit."""
        for x, y in zip(differences[0::2], differences[1::2]):
            low = self.bits[0]
            half = low ^ x
            carry = (low & x) | (half & y)
            self.bits[0] = half ^ y
            for k in range(1, len(self.bits)):
                self.bits[k], carry = self.bits[k] ^ carry, self.bits[k] & carry
            self.beyond |= carry

    def exceeded(self) -> np.ndarray:
        """Ones where the distance is above the radius."""
        above, equal = np.zeros_like(self.beyond), np.full_like(self.beyond, ONES)
        for k in reversed(range(len(self.bits))):
            if self.radius >> k & 1:
                equal &= self.bits[k]
            else:
                above |= equal & self.bits[k]
                equal &= ~self.bits[k]
        return above | self.beyond

    def keep(self, blocks: np.ndarray) -> None:
        self.bits = [b[blocks] for b in self.bits]
        self.beyond = self.beyond[blocks]


def within(planes: np.ndarray, words: np.ndarray, shift: int, wanted: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Compare item i with item i + shift for the items of ``words`` whose bit in ``wanted`` is one.

    Returns the words that still hold a pair within the radius, and those pairs as bits. Blocks of which every wanted
    pair is beyond the radius are abandoned on the way.
    """
    far, r = divmod(shift, 64)
    left, right = np.uint64(r), np.uint64(64 - r)
    counters = Counters(len(words), radius)
    for k in range(0, len(planes), STEP):
        other = planes[k : k + STEP, words + far]
        if r:
            other = (other >> left) | (planes[k : k + STEP, words + far + 1] << right)
        counters.add(planes[k : k + STEP, words] ^ other)
        alive = wanted & ~counters.exceeded()
        if not alive.all():
            blocks = np.flatnonzero(alive)
            if len(blocks) < len(words):
                words, wanted = words[blocks], wanted[blocks]
                counters.keep(blocks)
                if not len(words):
                    return words, wanted
    return words, wanted & ~counters.exceeded()


def _near_pairs(planes: np.ndarray, at: np.ndarray, shift: int, radius: int) -> np.ndarray:
    """Those items i of ``at`` that are within the radius of item i + shift."""
    lanes = np.zeros(planes.shape[1] * 64, bool)
    lanes[at] = True
    wanted = np.packbits(lanes, bitorder="little").view("<u8")
    words = np.flatnonzero(wanted)
    words, found = within(planes, words, shift, wanted[words], radius)
    word, bit = np.unpackbits(found.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).nonzero()
    return words[word] * 64 + bit


def _merge(root: np.ndarray, near: np.ndarray, shift: int) -> tuple[np.ndarray, list[int]]:
    """The roots after joining i with i + shift for all ``near``, and those i that joined two groups."""
    joined = []
    for i in near.tolist():
        a, b = i, i + shift
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)
            joined.append(i)
    while True:
        up = root[root]
        if np.array_equal(up, root):
            return root, joined
        root = up


def group_within(fingerprints: np.ndarray, ends: np.ndarray, radius: int) -> np.ndarray:
    """For fingerprints sorted by bucket, the smallest index in each one's group.

    ``ends[i]`` is the end of i's bucket. Two fingerprints of a bucket are in one group if a chain of pairs within the
    radius joins them there. Every pair of a bucket is compared unless both are known to be in one group already; found
    pairs are merged on the spot and never stored.
    """
    return _forest(to_planes(fingerprints), ends, radius, np.arange(len(fingerprints)))[0]


def _forest(planes: np.ndarray, ends: np.ndarray, radius: int, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Roots after merging all pairs within the radius, and the pairs that joined two groups."""
    live = np.arange(len(root))
    shift = 0
    left: list[int] = []
    right: list[int] = []
    while True:
        shift += 1
        live = live[ends[live] > live + shift]
        apart = live[root[live] != root[live + shift]]
        if not len(apart):
            if not len(live) or shift % 64 == 0 and not _differ(root, live, ends):
                return root, np.array(left, np.int64), np.array(right, np.int64)
            continue
        near = _near_pairs(planes, apart, shift, radius)
        if len(near):
            root, joined = _merge(root, near, shift)
            left += joined
            right += [i + shift for i in joined]


def forest_within(fingerprints: np.ndarray, ends: np.ndarray, radius: int, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius that join all groups of their bucket, at most one for each fingerprint; equal labels are one group."""
    _, first, which = np.unique(labels, return_index=True, return_inverse=True)
    return _forest(to_planes(fingerprints), ends, radius, first[which])[1:]


def all_within(fingerprints: np.ndarray, ends: np.ndarray, radius: int, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of different labels within the radius, a run at a time."""
    planes = to_planes(fingerprints)
    live = np.arange(len(fingerprints))
    shift = 0
    while True:
        shift += 1
        live = live[ends[live] > live + shift]
        if not len(live) or shift % 64 == 1 and not _differ(labels, live, ends):
            return
        apart = live[labels[live] != labels[live + shift]]
        if len(apart) and len(near := _near_pairs(planes, apart, shift, radius)):
            yield near, near + shift


def _differ(root: np.ndarray, live: np.ndarray, ends: np.ndarray) -> bool:
    """Whether any bucket that still has pairs to compare holds more than one group."""
    last = ends[live] - 1
    changes = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
    return bool((changes[last] != changes[live]).any())
