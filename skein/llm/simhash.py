"""SimHash fingerprints, and groups of documents whose fingerprints are near."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitslice import group_within
from .components import connected_components
from .staging import stage
from .words import LOWER, pieces

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Fingerprints that should share a bucket by chance, at most, when the number of blocks is chosen.
CHANCE_BUCKET = 64
#: Fingerprints of a bucket that are compared with each other at once; larger buckets are cut by more bits.
MOST_COMPARED = 1 << 16
#: Bits of which a bucket's fingerprints can't make more than MOST_COMPARED different ones.
SMALL_BITS = 16
#: Rows of the multi-index that a task sorts.
TASK_ROWS = 4_000_000


def bit_majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of hashes (none may be empty): the bits that are set in over half of them."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sets = np.add.reduceat(bits, starts, axis=0, dtype=np.uint32)
    sizes = np.diff(np.concatenate([starts, [len(hashes)]]))
    return np.packbits(2 * sets > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(texts: list[bytes], n: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """Fingerprints of whole texts over all their n-word shingles, repeats included; zero for a text without words."""
    digest = xxhash.xxh64_intdigest
    found: list[int] = []
    starts: list[int] = []
    owners: list[int] = []
    for k, text in enumerate(texts):
        words = text.translate(LOWER).split()
        if not words:
            continue
        owners.append(k)
        starts.append(len(found))
        joined = b" ".join(words)
        if len(words) <= n:
            found.append(digest(joined, seed))
            continue
        begins = list(accumulate([len(w) + 1 for w in words], initial=0))
        found.extend([digest(joined[a : b - 1], seed) for a, b in zip(begins, begins[n:])])
    out = np.zeros(len(texts), np.uint64)
    if owners:
        out[owners] = bit_majority(np.array(found, np.uint64), np.array(starts))
    return out


def _fingerprints(texts: pa.Array) -> pa.Array:
    parts = [fingerprints(p) for p in pieces(texts)]
    return pa.array(np.concatenate([*parts, np.empty(0, np.uint64)]).view(np.int64))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column, as a signed long."""
    return F.arrow_udf(_fingerprints, "long").asNondeterministic()(text.cast("binary"))


def block_tables(n: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """Multi-index of blocks: each table is a list of (first bit, width) that make its key.

    The 64 bits are cut into radius + k blocks, and every choice of k of them is a table: a pair that differs in at most
    ``radius`` bits has at least k blocks without a difference, so it shares a bucket of some table. k grows with the
    number of fingerprints n, so that chance buckets stay small; it changes the work and never the result.
    """
    for k in range(1, 5):
        blocks = radius + k
        cuts = [64 * i // blocks for i in range(blocks + 1)]
        spans = list(zip(cuts, np.diff(cuts).tolist()))
        width = sum(sorted(w for _, w in spans)[:k])
        if k == 4 or n >> width < 1 or n / 2.0**width <= CHANCE_BUCKET / 16:
            return [list(c) for c in combinations(spans, k)]
    raise AssertionError


def _pack(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint, side by side."""
    out = np.zeros(len(fp), np.int64)
    for i, bit in enumerate(bits):
        out |= (fp >> bit & 1) << i
    return out


class Buckets:
    """Buckets of one level of the multi-index, read in order by a task that holds a bounded number of rows.

    Buckets of at most ``most`` fingerprints are compared. A larger one is cut by the bits that its key doesn't have yet: in
    radius + 1 blocks, of which any pair within the radius shares one. At ``SMALL_BITS`` free bits a bucket can't be large.
    """

    def __init__(self, tables: list[list[tuple[int, int]]], level: int, radius: int, most: int):
        self.tables, self.level, self.radius, self.most = tables, level, radius, most
        self.free: dict[int, list[int]] = {}

    def free_bits(self, t: int) -> list[int]:
        """Bits that are not in the keys of a table. A table's number ends with the blocks chosen at each level."""
        if t not in self.free:
            table, chosen = t, []
            for _ in range(self.level):
                table, j = divmod(table, self.radius + 1)
                chosen.append(j)
            taken = {b for first, w in self.tables[table] for b in range(first, first + w)}
            bits = [b for b in range(64) if b not in taken]
            for j in reversed(chosen):
                gone = set(self.cut(bits)[j])
                bits = [b for b in bits if b not in gone]
            self.free[t] = bits
        return self.free[t]

    def cut(self, bits: list[int]) -> list[list[int]]:
        parts = self.radius + 1
        return [bits[len(bits) * i // parts : len(bits) * (i + 1) // parts] for i in range(parts)]

    def passed_on(self, t: int, key: int, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The rows of a large bucket under the next level's keys."""
        for j, bits in enumerate(self.cut(self.free_bits(t))):
            keys = np.int64(key) << np.int64(len(bits)) | _pack(fp, bits)
            yield _rows(fp, keys, np.full(len(fp), t * (self.radius + 1) + j))

    def compared(self, fp: np.ndarray, firsts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.repeat([*firsts[1:].tolist(), len(fp)], np.diff([*firsts.tolist(), len(fp)]))
        root = group_within(fp.view(np.uint64), ends, self.radius)
        linked = np.flatnonzero(root != np.arange(len(root)))
        if len(linked):
            yield _rows(fp[linked], fp[root[linked]], np.full(len(linked), -1))

    def read(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``batches``: fp, t, key, in order of t and key. Gives links (t is -1) and rows of the next level."""
        held = np.empty((3, 0), np.int64)
        parts: list[np.ndarray] = []
        passing = None  # the large bucket whose rows are on their way
        for batch in chain(batches, [None]):
            if batch is not None:
                parts.append(np.stack([batch.column(k).to_numpy() for k in range(3)]))
                if held.shape[1] + sum(p.shape[1] for p in parts) <= 2 * self.most:
                    continue
            held, parts = np.concatenate([held, *parts], axis=1), []
            fp, t, key = held
            firsts = np.flatnonzero(np.concatenate([[len(t) > 0], (t[1:] != t[:-1]) | (key[1:] != key[:-1])])[: len(t)])
            sizes = np.diff([*firsts.tolist(), len(t)])
            small = np.ones(len(t), bool)
            for k, (at, size) in enumerate(zip(firsts.tolist(), sizes.tolist())):
                name = (int(t[at]), int(key[at]))
                if name == passing or size > self.most and len(self.free_bits(name[0])) > SMALL_BITS:
                    yield from self.passed_on(*name, fp[at : at + size])
                    small[at : at + size] = False
                    passing = name
            last = int(firsts[-1]) if len(firsts) and batch is not None else len(t)
            now = np.flatnonzero(small[:last])
            places = np.cumsum(small) - 1
            begun = firsts[(firsts < last) & small[firsts]] if len(firsts) else firsts
            if len(now):
                yield from self.compared(np.ascontiguousarray(fp[now]), places[begun])
            held = np.ascontiguousarray(held[:, last:][:, small[last:]])


def _rows(a: np.ndarray, b: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (a, b, t)], ["a", "b", "t"])


def near_links(distinct: DataFrame, radius: int = RADIUS, most: int = MOST_COMPARED) -> DataFrame:
    """``distinct``: one row per fingerprint (column fp, long). Returns links a, b that join all near fingerprints.

    The pairs of each bucket are compared bit-sliced in one task, which hands on at most one link per fingerprint. A bucket
    of more than ``most`` fingerprints isn't compared at once: its rows go to smaller buckets, level by level, until none is
    left. Tasks read sorted rows and hold no more than a few times ``most`` of them; their number grows with the rows.
    """
    spark = distinct.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = distinct.count()
    tables = block_tables(n, radius)
    keys = []
    for t, spans in enumerate(tables):
        key, width = F.lit(0).cast("long"), 0
        for first, w in spans:
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << w) - 1)), width))
            width += w
        keys.append(F.struct(F.lit(t).cast("long").alias("t"), key.alias("key")))
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.key")
    size, level, links = n * len(tables), 0, None
    while True:
        found = stage(
            rows.repartition(max(least, -(-size // TASK_ROWS)), "t", "key")
            .sortWithinPartitions("t", "key")
            .mapInArrow(Buckets(tables, level, radius, most).read, "a long, b long, t long"),
            "near",
        )
        new = found.where("t < 0").select("a", "b")
        links = new if links is None else links.unionByName(new)
        rows = found.where("t >= 0").select(F.col("a").alias("fp"), "t", F.col("b").alias("key"))
        size = rows.count()
        level += 1
        if not size:
            return links


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp (the fingerprint as a signed long), component_id.

    ``component_id`` is the smallest id reachable over links of at most ``radius`` differing bits. Equal fingerprints are
    first brought together (a minimum, combined before the shuffle), so copies are never compared or expanded into pairs.
    A null text is an empty one; empty texts have fingerprint zero and are linked like any other. A null id takes part in
    links but names a group only if the group has no other id (then null). Repeated rows stay repeated; other columns are
    not looked at; an empty table gives none.
    """
    prints = stage(
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), fingerprint(F.col(f"`{text_col}`")).alias("fp")), "fingerprints"
    )
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = connected_components(near_links(distinct.select("fp"), radius))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
