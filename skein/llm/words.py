"""Words of UTF-8 texts as 64-bit hashes, a batch at a time in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Text bytes that are taken apart at once, so that a batch's Python objects stay small.
PIECE_BYTES = 2_000_000
#: Words that a worker remembers; beyond, it starts again.
MEMORY = 400_000

#: Lower-cases A-Z and leaves all other bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Also turns every ASCII byte that is neither letter nor digit into a space.
ALNUM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)


class WordHashes(dict):
    """word -> unsigned XXH64, computed once for each word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The texts of a binary array in runs of about ``most`` bytes; a null is an empty text."""
    run: list[bytes] = []
    size = 0
    for t in texts:
        text = t.as_py() or b""
        run.append(text)
        size += len(text)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def hash_words(split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one more entry at the end)."""
    counts = np.fromiter(map(len, split), np.int64, len(split))
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(starts[-1], np.uint64)
    get = _hashes.__getitem__
    for words, at in zip(split, starts.tolist()):
        out[at : at + len(words)] = np.fromiter(map(get, words), np.uint64, len(words))
    return out, starts


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words; runs may cross from one text to the next, which the caller masks."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = mix(h) + words[k : len(words) - n + 1 + k]
    return mix(h)
