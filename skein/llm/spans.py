"""Runs of bytes, such as words, on arrays: each different run is looked at once, whatever their number."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Runs whose values a worker remembers: so many before a chunk, of those met last. Chunks without a new run don't count.
KNOWN = 300_000


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def different(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """The different runs that offsets cut the bytes into, and for each run which of them it is."""
    runs = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    coded = runs.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def buffers(runs: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all runs, and how long each is."""
    if not len(runs):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    _, offsets, data = runs.buffers()
    at = np.frombuffer(offsets, np.int32)[runs.offset : runs.offset + len(runs) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8))[at[0] : at[-1]], np.diff(at)


def gather(values: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[bounds[k] : bounds[k + 1]] of each k in which, one after the other, and where each begins (one more at the end)."""
    counts = np.diff(bounds)[which]
    begins = offsets_of(counts)
    return values[np.repeat(bounds[which] - begins[:-1], counts) + np.arange(begins[-1])], begins


class Remembered:
    """Values of runs, given by ``learn``; what was met last is remembered.

    ``learn`` takes different runs and returns the values of all, one after the other, and where each run's begin (one more at
    the end).
    """

    def __init__(self, learn: Callable[[pa.BinaryArray], tuple[np.ndarray, np.ndarray]], most: int | None = None):
        self.learn = learn
        self.most = KNOWN if most is None else most
        self.runs = pa.array([], pa.binary())
        self.values, self.bounds = learn(self.runs)
        self.met = np.empty(0, np.int64)  # the chunk in which each was met last
        self.now = 0

    def of(self, runs: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """values, bounds and, for each of the different runs, its place in them."""
        self.now += 1
        if len(self.runs) > self.most:
            stay = np.sort(np.argsort(-self.met, kind="stable")[: self.most // 2])
            self.runs, self.met = self.runs.take(pa.array(stay)), self.met[stay]
            self.values, self.bounds = gather(self.values, self.bounds, stay)
        at = pc.index_in(runs, value_set=self.runs).fill_null(-1).to_numpy().astype(np.int64)
        self.met[at[at >= 0]] = self.now
        new = at < 0
        if new.any():
            fresh = runs.filter(pa.array(new))
            values, bounds = self.learn(fresh)
            at[new] = len(self.runs) + np.arange(len(fresh))
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]])
            self.values = np.concatenate([self.values, values])
            self.runs = pa.concat_arrays([self.runs, fresh])
            self.met = np.concatenate([self.met, np.full(len(fresh), self.now)])
        return self.values, self.bounds, at
