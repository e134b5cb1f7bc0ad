"""Benchmark passages inside documents.

For every benchmark item, windows of the item's own length slide over a document. A window's SimHash fingerprint looks up items
of that length in a multi-index: a table for each of ``BLOCKS`` blocks of the fingerprint, in which an item is listed under its
block's value and all values within ``RADIUS // BLOCKS`` bits. An item within the radius is that near in one block at least, so no
such item is missed. What is found is verified by the exact weighted similarity of shingles (each weighing its number of
occurrences).

Windows are fingerprinted only where enough of their shingles occur in the benchmark at all: any other has too small a
similarity with every item. At similarity 0.8 about 10 of 64 bits differ, and the radius is 20.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage, unused
from .words import ALNUM, hash_words, pieces, shingle_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCKS = 8
#: Words of benchmark items that are sent to every task at once; a larger benchmark is taken in such blocks.
BLOCK_WORDS = 2_000_000
#: Places whose windows are fingerprinted at once, and pairs of a window and an item that a look-up may give at once.
WINDOWS = 1 << 13
LOOKED_UP = 1 << 21
_LOW = np.uint64((1 << 22) - 1)


def _shingles(words: np.ndarray) -> np.ndarray:
    """Shingle hashes of one text: all runs of SHINGLE_WORDS words, or the whole of a shorter text."""
    return shingle_hashes(words, min(SHINGLE_WORDS, len(words))) if len(words) else words


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over the sum of the larger number of occurrences, over all shingles of either."""
    values, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(which[: len(a)], minlength=len(values))
    y = np.bincount(which[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _prints(sets: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(2 * sets > n, axis=-1, bitorder="little").view("<u8").ravel()


#: For each byte the bytes within RADIUS // BLOCKS bits of it.
_NEIGHBOURS = [np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8) ^ np.uint8(b)) <= RADIUS // BLOCKS) for b in range(256)]


class MultiIndex:
    """Fingerprints by the values of their blocks and all values near these."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        near = np.stack([np.isin(np.arange(256), n) for n in _NEIGHBOURS])
        blocks = prints.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
        #: for each block where the items of each value begin, and the items
        self.begins, self.items = [], []
        for b in range(BLOCKS):
            item, value = np.nonzero(near[blocks[:, b]])
            self.items.append(item[np.argsort(value, kind="stable")].astype(np.int32))
            self.begins.append(np.searchsorted(np.sort(value), np.arange(257)))

    def within(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(print asked for, own print) of all pairs within the radius, looked up a part at a time."""
        blocks = prints.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
        n = len(self.prints)
        most = max(1, LOOKED_UP // max(1, n))
        for low in range(0, len(prints), most):
            found = []
            for b in range(BLOCKS):
                values = blocks[low : low + most, b].astype(np.int64)
                first = self.begins[b][values]
                counts = self.begins[b][values + 1] - first
                asked = np.repeat(np.arange(len(values)), counts)
                place = np.arange(len(asked)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
                found.append(asked * n + self.items[b][place])
            asked, own = np.divmod(np.unique(np.concatenate(found)), n)
            close = np.bitwise_count(prints[low + asked] ^ self.prints[own]) <= RADIUS
            yield low + asked[close], own[close]


class BenchmarkIndex:
    """Items by their lengths in words, each length with a multi-index of the items' fingerprints."""

    def __init__(self, items: list[tuple[int, bytes]]):
        words, starts = hash_words([t.translate(ALNUM).split() for _, t in items])
        bounds = list(zip(starts.tolist(), starts[1:].tolist()))
        kept = [(i, words[a:b]) for (i, _), (a, b) in zip(items, bounds) if b > a]
        self.ids = [i for i, _ in kept]
        self.shingles = [_shingles(w) for _, w in kept]
        lengths = np.array([len(w) for _, w in kept], np.int64)
        prints = np.array([_prints(_bits(s).sum(0, dtype=np.int64), len(s))[0] for s in self.shingles], np.uint64)
        #: by length: which items, and the index of their fingerprints
        self.lengths = {int(n): (own := np.flatnonzero(lengths == n), MultiIndex(prints[own])) for n in np.unique(lengths)}
        #: by shingle length, as items of fewer words than a shingle are one shingle themselves: all shingles, and a filter of
        #: their lowest bits
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({min(m, SHINGLE_WORDS) for m in self.lengths}):
            values = np.unique(np.concatenate([s for s, m in zip(self.shingles, lengths) if min(m, SHINGLE_WORDS) == n]))
            bits = np.zeros(1 << 22, bool)
            bits[(values & _LOW).astype(np.int64)] = True
            self.known[n] = values, bits

    def needed(self, n_shingles: int) -> int:
        """Shingles, repeats counted, that a window similar to an item of so many shingles shares with it at least."""
        return math.ceil(n_shingles * SIMILARITY - 1e-9)

    def _hits(self, shingles: np.ndarray, n: int) -> np.ndarray:
        """Whether each shingle occurs in the benchmark, added up from the left (one more entry at the beginning)."""
        values, bits = self.known[n]
        at = np.flatnonzero(bits[(shingles & _LOW).astype(np.int64)])
        at = at[values[np.minimum(np.searchsorted(values, shingles[at]), len(values) - 1)] == shingles[at]]
        sums = np.zeros(len(shingles) + 1, np.int32)
        sums[at + 1] = 1
        return np.cumsum(sums, out=sums)

    def scan(self, texts: list[bytes]) -> list[list[tuple]]:
        """For each text the items found in it, as (item id, similarity, first word, words)."""
        words, starts = hash_words([t.translate(ALNUM).split() for t in texts])
        best: dict[tuple[int, int], tuple[float, int]] = {}
        shingles = {n: shingle_hashes(words, n) for n in self.known}
        hits = {n: self._hits(shingles[n], n) for n in self.known if len(shingles[n])}
        text_of = np.repeat(np.arange(len(texts)), np.diff(starts))
        for length, (own, index) in self.lengths.items():
            n = min(length, SHINGLE_WORDS)
            if n not in hits or not hits[n][-1]:
                continue
            for begins, per in self._windows(starts, text_of, length, n, hits[n]):
                for at, prints in self._fingerprints(shingles[n], begins, per):
                    for w, k in ((w, own[k]) for asked, found in index.within(prints) for w, k in zip(asked.tolist(), found.tolist())):
                        begin = int(at[w])
                        sim = weighted_similarity(shingles[n][begin : begin + per], self.shingles[k])
                        key = int(text_of[begin]), int(k)
                        if sim >= SIMILARITY and (key not in best or (sim, -begin) > (best[key][0], -best[key][1])):
                            best[key] = sim, begin
        found: list[list[tuple]] = [[] for _ in texts]
        n_words = {int(k): length for length, (own, _) in self.lengths.items() for k in own}
        for (d, k), (sim, begin) in best.items():
            found[d].append((self.ids[k], sim, begin - int(starts[d]), n_words[k]))
        return [sorted(f, key=lambda x: (x[0] is None, x[0] or 0, x[2], x[3])) for f in found]

    def _windows(self, starts: np.ndarray, text_of: np.ndarray, length: int, n: int, hits: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """(places where windows begin, their number of shingles) of windows with enough shingles of the benchmark.

        A text shorter than the length is itself the only window.
        """
        needed = self.needed(length - n + 1)
        per = length - n + 1
        if len(text_of) >= length:
            begins = np.flatnonzero(hits[per:] - hits[: len(hits) - per] >= needed)
            begins = begins[begins + length <= starts[text_of[begins] + 1]]
            yield begins, per
        sizes = np.diff(starts)
        short = np.flatnonzero((sizes < length) & (sizes - n + 1 >= needed))
        for d in short.tolist():
            own = int(sizes[d]) - n + 1
            if hits[starts[d] + own] - hits[starts[d]] >= needed:
                yield starts[d : d + 1], own

    def _fingerprints(self, shingles: np.ndarray, begins: np.ndarray, per: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The windows' places and fingerprints, a run of neighbouring windows at a time."""
        for run in np.split(begins, np.flatnonzero(np.diff(begins) > per) + 1) if len(begins) else ():
            for part in np.split(run, np.flatnonzero(np.diff((run - run[0]) // WINDOWS)) + 1):
                low = int(part[0])
                sums = np.zeros((int(part[-1]) - low + per + 1, 64), np.int32)
                np.cumsum(_bits(shingles[low : int(part[-1]) + per]), axis=0, out=sums[1:])
                at = part - low
                yield part, _prints(sums[at + per] - sums[at], per)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of bounded size; one block is in the driver's memory at a time."""
    rows = benchmark.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("binary")).where(F.col(f"`{text_col}`").isNotNull())
    block: list[tuple[int, bytes]] = []
    size = 0
    for item_id, text in rows.distinct().toLocalIterator():
        block.append((item_id, bytes(text)))
        size += len(text) // 4
        if size >= BLOCK_WORDS:
            yield sorted(block, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
            block, size = [], 0
    if block:
        yield sorted(block, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


FOUND = "array<struct<item_id:bigint,similarity:double,first_word:bigint,n_words:bigint>>"


def _scanner(index: Broadcast) -> Callable[[pa.Array], pa.Array]:
    kind = pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])
    names = [f.name for f in kind]

    def scan(texts: pa.Array) -> pa.Array:
        rows = (r for part in pieces(texts) for r in index.value.scan(part))
        return pa.array([[dict(zip(names, x)) for x in r] for r in rows], pa.list_(kind))

    return scan


def with_leaks(docs: DataFrame, benchmark: DataFrame, name: str, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with one more column: the items found in each whole text, one entry per item (its best window).

    Words are runs of letters and digits with A-Z lower-cased. A text shorter than an item is compared whole. Null and
    empty texts, and items without words, match nothing; equal items of one id count once, a null item id is kept. Columns
    of ``docs`` stay as they are, whatever their names. The benchmark, in blocks of a bounded number of words, goes to every
    task. One block needs no shuffle. With more, a worker holds one at a time: of each block only what was found is written, by
    two hashes of the text, and joined to the rows at the end.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    blocks = _blocks(benchmark, item_id_col, item_text_col)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs.withColumn(name, F.from_json(F.lit("[]"), FOUND))

    def found(block: list[tuple[int, bytes]]) -> tuple[Broadcast, Column]:
        index = spark.sparkContext.broadcast(BenchmarkIndex(block))
        return index, F.arrow_udf(_scanner(index), FOUND).asNondeterministic()(text.cast("binary"))

    if second is None:
        return docs.withColumn(name, found(first)[1])
    keys = [unused(docs, "text_hash"), unused(docs, "text_hash2")]
    hashed = [F.xxhash64(text).alias(keys[0]), F.xxhash64(F.lit(1), text).alias(keys[1])]
    parts = []
    for block in chain([first, second], blocks):
        index, leaks = found(block)
        some = docs.select(*hashed, leaks.alias("leaks")).where(F.size("leaks") > 0)
        parts.append(stage(some.groupBy(*keys).agg(F.first("leaks").alias("leaks")), "leaks"))
        index.destroy()
    every = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.flatten(F.collect_list("leaks")).alias("leaks"))
    own = every.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("leaks").alias(name))
    joined = docs.withColumns(dict(zip(keys, hashed))).join(own, [F.col(keys[0]) == F.col(f"{keys[0]}_"), F.col(keys[1]) == F.col(f"{keys[1]}_")], "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(f"`{name}`"), F.from_json(F.lit("[]"), FOUND)).alias(name))


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, similarity, first_word, n_words."""
    text_col = columns.get("text_col", "text")
    part = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    columns["text_col"] = "text"
    return with_leaks(part, benchmark, "leaks", **columns).select("doc_id", F.inline("leaks"))
