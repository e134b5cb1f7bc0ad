"""SimHash near-dedup at a similarity: groups of documents with similar sets of word shingles, and one document of each.

Each different shingle set has a fingerprint of WORDS x 64 bits, of which two sets of Jaccard similarity s differ in about
arccos(2 s / (1 + s)) / pi: at 0.8 in 15 %. Sets that agree in the sampled bits of some table share a bucket, in which they
are compared bit-sliced; pairs within RADIUS bits are candidates, and their exact similarity decides.

At a similarity of exactly 0.8 a pair differs in 19.4 of 128 bits on average (standard deviation 4.1). A pair of d bits is
missed if no table's bits are free of differences: below 2e-5 at 19 bits, 0.002 at FAR_BITS, none up to 15 bits. Above 0.8
fewer bits differ. ``tests/llm/test_brute.py`` measures the recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bitslice
from .components import connected_components
from .simhash import bit_majority
from .staging import drop_staged, stage, unused
from .words import LOWER, hash_words, mix, pieces, shingle_hashes

SHINGLE_WORDS = 5
#: Documents with a Jaccard similarity of NUMERATOR / DENOMINATOR or more are near copies.
NUMERATOR, DENOMINATOR = 4, 5
WORDS = 2
BITS = 64 * WORDS
RADIUS = 36
#: Pairs of different groups are also asked for this many differing bits at most of a fingerprint of WIDE x 64 other bits: 94 %
#: of pairs at 0.8 have no more, and 1 % of pairs at 0.6. Most members of a group are linked by more than one pair.
WIDE, WIDE_RADIUS = 8, 90
#: Differing bits for which the number of tables is chosen, and the share of such pairs that may be missed.
FAR_BITS, MISSED = 26, 0.002
#: Bits of a table's key, at least; more from 256 x 1024 sets on, so that buckets of unlike sets don't grow.
LEAST_KEY, BUCKET_BITS = 8, 10
#: Sets of a bucket that are compared at once; a larger bucket is cut into cells of two of CUTS parts each.
MOST_COMPARED = 1 << 18
CUTS = 8
#: Rows of the tables that a task sorts.
TASK_ROWS = 2_000_000

_NAMES = "a b f0 f1 n label bucket".split()
_WIDE = [f"w{k}" for k in range(WIDE)]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted hashes of each text's different shingles: one of the whole text if it is shorter, none if it has no words."""
    split = [t.translate(LOWER).split() for t in texts]
    words, starts = hash_words(split)
    out = []
    for k, s in enumerate(split):
        if len(s) >= SHINGLE_WORDS:
            out.append(np.unique(shingle_hashes(words[starts[k] : starts[k + 1]], SHINGLE_WORDS)))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(s), 1)][: len(s)], np.uint64))
    return out


def set_fingerprints(sets: list[np.ndarray], lanes: range = range(WORDS)) -> np.ndarray:
    """Fingerprints (sets x 64-bit words, one for each lane) of shingle sets, none of which may be empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([bit_majority(mix(flat + np.uint64(w)), starts) for w in lanes], axis=1)


def _prints(texts: pa.Array) -> pa.Array:
    keys: list[int] = []
    sizes: list[int] = []
    prints: list[np.ndarray] = [np.empty((0, WORDS), np.uint64)]
    for piece in pieces(texts):
        found = shingle_sets(piece)
        filled = np.array([len(s) > 0 for s in found])
        bits = np.zeros((len(found), WORDS), np.uint64)
        if filled.any():
            bits[filled] = set_fingerprints([s for s in found if len(s)])
        prints.append(bits)
        keys += [xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in found]
        sizes += map(len, found)
    bits = np.concatenate(prints).view(np.int64)
    columns = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.array(sizes, np.int64)), pa.array(bits[:, 0]), pa.array(bits[:, 1])]
    return pa.StructArray.from_arrays(columns, ["key", "n", "f0", "f1"])


def prints(text: Column) -> Column:
    """key (names the shingle set; 0: empty), n (its size), f0 and f1 (its fingerprint)."""
    return F.arrow_udf(_prints, "struct<key:long,n:long,f0:long,f1:long>").asNondeterministic()(text.cast("binary"))


def _hashes(texts: pa.Array) -> pa.Array:
    sets: list[np.ndarray] = []
    wide = [np.empty((0, WIDE), np.uint64)]
    for piece in pieces(texts):
        sets += (found := shingle_sets(piece))
        wide.append(set_fingerprints(found, range(WORDS, WORDS + WIDE)))
    offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    hashes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)))
    return pa.StructArray.from_arrays([hashes, *map(pa.array, np.ascontiguousarray(np.concatenate(wide).view(np.int64).T))], ["hashes", *_WIDE])


def hashes(text: Column) -> Column:
    """The hashes of the shingle set of a text with words, and its wide fingerprint."""
    kind = "struct<hashes:array<long>," + ",".join(f"{w}:long" for w in _WIDE) + ">"
    return F.arrow_udf(_hashes, kind).asNondeterministic()(text.cast("binary"))


def tables_for(n_sets: int) -> np.ndarray:
    """The sampled bits of each table (tables x bits of a key) for so many sets; parts of some permutations of all bits."""
    width = min(40, max(LEAST_KEY, math.ceil(math.log2(max(2, n_sets))) - BUCKET_BITS))
    free = math.prod((BITS - FAR_BITS - i) / (BITS - i) for i in range(width))
    n_tables = math.ceil(math.log(MISSED) / math.log1p(-free))
    drawn = np.random.default_rng(42)
    each = BITS // width
    rounds = [drawn.permutation(BITS)[: each * width].reshape(each, width) for _ in range(-(-n_tables // each))]
    return np.concatenate(rounds)[: max(n_tables, each)]


def _batch(*columns: np.ndarray | None, wide: np.ndarray | None) -> pa.RecordBatch:
    n = len(next(c for c in columns if c is not None))
    columns = [*columns, *([None] * WIDE if wide is None else wide)]
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else pa.array(c) for c in columns], [*_NAMES, *_WIDE])


_ROW = ", ".join(f"{c} long" for c in [*_NAMES, *_WIDE])


def _table_rows(tables: np.ndarray):
    """Rows (a, f0, f1, n, label, and the wide words if there are any) to one row for each table, with its bucket."""
    weights = np.int64(1) << np.arange(tables.shape[1], dtype=np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 4096):
                a, f0, f1, n, label, *wide = (c.to_numpy() for c in whole.slice(at, 4096).columns)
                bits = np.unpackbits(np.stack([f0, f1], axis=1).view(np.uint8), axis=1, bitorder="little").astype(np.int64)
                for t, where in enumerate(tables):
                    bucket = (bits[:, where] @ weights) * np.int64(1 << 20) + t
                    yield _batch(a, None, f0, f1, n, label, bucket, wide=wide or None)

    return rows


def _cells(bucket: int, a: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their new bucket) of a large bucket: each row goes to the CUTS - 1 cells of its part and another, so every pair meets."""
    part = (mix(a.view(np.uint64) + np.uint64(level)) % np.uint64(CUTS)).astype(np.int64)
    name = np.uint64(bucket & 0xFFFFFFFFFFFFFFFF)
    for x in range(CUTS):
        for y in range(x + 1, CUTS):
            cell = mix(mix(np.array([name])) + np.uint64(x * CUTS + y))[0] >> np.uint64(1)
            rows = np.flatnonzero((part == x) | (part == y))
            yield rows, np.full(len(rows), np.int64(cell))


def _compared(how: str, level: int, most: int, tables: np.ndarray):
    """Sorted rows (by bucket and n) to links a, b and, with a bucket, rows of large buckets for the next level.

    A task reads its rows as a stream and holds about ``most`` of them. Pairs of the later rounds come from the first table
    alone in which they share a bucket (of cells from any).
    """

    def first_met(prints: np.ndarray, bucket: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if level:
            return np.ones(len(i), bool)
        differ = np.unpackbits((prints[i] ^ prints[j]).view(np.uint8), axis=1, bitorder="little")
        met = np.stack([~differ[:, where].any(1) for where in tables], axis=1)
        return met.argmax(1) == bucket[i] % (1 << 20)

    def pairs(prints: np.ndarray, ends: np.ndarray, label: np.ndarray, wide: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if how == "forest":
            yield bitslice.forest_within(prints, ends, RADIUS, label)
            return
        best = np.full(len(label), WIDE_RADIUS + 1)
        nearest = np.full(len(label), -1)
        for i, j in bitslice.all_within(prints, ends, RADIUS, label):
            d = np.bitwise_count(wide[:, i] ^ wide[:, j]).sum(0, dtype=np.int64)
            if how == "all":
                yield i[d <= WIDE_RADIUS], j[d <= WIDE_RADIUS]
                continue
            for x, y in ((i, j), (j, i)):
                better = d < best[x]
                best[x[better]] = d[better]
                nearest[x[better]] = y[better]
        i = np.flatnonzero(nearest >= 0)
        yield i, nearest[i]

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, f0, f1, n, label, bucket = rows[:6]
        firsts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.empty(len(a), np.int64)
        for x, y in zip(firsts.tolist(), [*firsts[1:].tolist(), len(a)]):
            # sets whose sizes differ by more can't be similar
            ends[x:y] = x + np.searchsorted(n[x:y], n[x:y] * DENOMINATOR // NUMERATOR, "right")
        prints = np.stack([f0, f1], axis=1).view(np.uint64)
        for i, j in pairs(prints, ends, label, rows[6:].view(np.uint64)):
            if len(i) and how != "forest":
                first = first_met(prints, bucket, i, j)
                i, j = i[first], j[first]
            if len(i):
                yield _batch(np.minimum(a[i], a[j]), np.maximum(a[i], a[j]), *[None] * 5, wide=None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 6 + (WIDE if how != "forest" else 0)
        held = np.empty((width, 0), np.int64)
        parts: list[np.ndarray] = []
        passing = None  # the large bucket whose rows are on their way
        for batch in chain(batches, [None]):
            if batch is not None:
                parts.append(np.stack([batch.column(k).to_numpy() for k in range(width)]))
                if held.shape[1] + sum(p.shape[1] for p in parts) <= most:
                    continue
            held, parts = np.concatenate([held, *parts], axis=1), []
            bucket = held[5]
            # the last bucket may go on in the next batch
            last = int(np.searchsorted(bucket, bucket[-1], "left")) if batch is not None else len(bucket)
            if passing is not None:
                cut = int(np.searchsorted(bucket, passing, "right"))
                yield from passed_on(held[:, :cut], passing)
                held, last = held[:, cut:], max(0, last - cut)
                if held.shape[1]:
                    passing = None
            elif batch is not None and len(bucket) - last > most:
                passing = int(bucket[-1])
                yield from passed_on(held[:, last:], passing)
                held = held[:, :last]
            if last:
                yield from links(np.ascontiguousarray(held[:, :last]))
            held = np.ascontiguousarray(held[:, last:])

    def passed_on(rows: np.ndarray, bucket: int) -> Iterator[pa.RecordBatch]:
        for which, cell in _cells(bucket, rows[0], level) if rows.shape[1] else ():
            a, f0, f1, n, label, _, *wide = rows[:, which]
            yield _batch(a, None, f0, f1, n, label, cell, wide=wide or None)

    return read


def candidate_pairs(rows: DataFrame, how: str, most: int = MOST_COMPARED) -> DataFrame:
    """``rows``: a, f0, f1, n, label of different sets. Returns pairs a < b within the radius that share a bucket.

    ``how``: forest (enough pairs to join what is near, one for each row and bucket at most), or by the columns w0, w1, ... too:
    nearest (each row's nearest of another label) or all (of different labels). Buckets of one label give none.
    """
    spark = rows.sparkSession
    n_sets = rows.count()
    tables = tables_for(n_sets)
    columns = ["a", "f0", "f1", "n", "label"]
    wide = _WIDE if how != "forest" else []
    spread = rows.select(*columns, *wide).mapInArrow(_table_rows(tables), _ROW)
    size, level, pairs = n_sets * len(tables), 0, None
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        found = stage(
            spread.select(*columns, "bucket", *wide)
            .repartition(max(least, -(-size // TASK_ROWS)), "bucket")
            .sortWithinPartitions("bucket", "n")
            .mapInArrow(_compared(how, level, most, tables), _ROW),
            "compared",
        )
        new = found.where("bucket is null").select("a", "b").distinct()
        pairs = new if pairs is None else pairs.unionByName(new).distinct()
        spread = found.where("bucket is not null")
        size = spread.count()
        level += 1
        if not size:
            return pairs


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose sets are similar enough, by their exact similarity."""
    left = sets.select(F.col("key").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    enough = both * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (F.size("x") + F.size("y"))
    return pairs.join(left, "a").join(right, "b").where(enough).select("a", "b")


def similar_links(marked: DataFrame, most: int = MOST_COMPARED) -> DataFrame:
    """``marked``: key, n, f0, f1, text; sets may repeat. Returns links a, b of similar sets that join each group.

    First a forest of near pairs is verified, which joins large groups without their pairs; then each set's nearest of
    another group; then every near pair of different groups. Only sets with a near one go on after the first round.
    """
    rows = stage(
        marked.where("n > 0").groupBy(F.col("key").alias("a")).agg(*[F.min(c).alias(c) for c in ("f0", "f1", "n")]), "rows"
    )
    sets = links = tried = None
    for how in ("forest", "nearest", "all"):
        if links is None:
            named = rows.withColumn("label", F.col("a"))
        else:
            labels = connected_components(links).select(F.col("node").alias("a"), "component")
            named = stage(rows.join(labels, "a", "left").withColumn("label", F.coalesce("component", "a")), "named")
        pairs = candidate_pairs(named.join(sets, named["a"] == sets["key"]) if sets is not None else named, how, most)
        pairs = stage(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        if sets is None:  # every set with a near one is in a pair of the forest
            ends = stage(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "ends")
            texts = marked.join(ends, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
            sets = stage(texts.select("key", hashes(F.col("text")).alias("h")).select("key", "h.*"), "sets")
            whole, rows = rows, stage(rows.join(ends, rows["a"] == ends["key"], "left_semi"), "near_rows")
            drop_staged(whole)
        else:
            drop_staged(named)
        new = stage(_similar(pairs, sets), "similar")
        links = new if links is None else links.unionByName(new)
    for done in (sets, rows):
        drop_staged(done)
    return links


def near_copies_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies, with all its columns.

    Near copies have sets of SHINGLE_WORDS-word shingles (whole text if shorter, A-Z lower-cased) with a Jaccard similarity of
    0.8 or more, which is computed exactly for every candidate pair; a group is what links join. The row of the smallest
    id stays; a null id only where the whole group has none; of several rows with that id, one. Texts without words (null
    too) are one group. An empty table stays empty.
    """
    mark, number, key, named = (unused(docs, c) for c in ("kept_print", "kept_n", "kept_key", "kept_id"))
    marked = stage(docs.withColumn(mark, prints(F.col(f"`{text_col}`"))), "prints")
    distinct = stage(marked.select(F.col(f"`{mark}`.key").alias("key"), F.col(f"`{id_col}`").alias("id")).groupBy("key").agg(F.min("id").alias("first_id")), "distinct")
    sets = marked.select(f"`{mark}`.*", F.col(f"`{text_col}`").alias("text"))
    found = connected_components(similar_links(sets)).withColumnRenamed("node", "key")
    rooted = distinct.join(found, "key", "left").withColumn("root", F.coalesce("component", "key"))
    first = F.min(F.struct(F.col("first_id").isNull().alias("without"), "first_id", "key"))
    kept = stage(rooted.groupBy("root").agg(first.alias("f")).select(F.col("f.key").alias(key), F.col("f.first_id").alias(named)), "kept")
    drop_staged(distinct)
    same = (F.col(f"`{mark}`.key") == F.col(key)) & F.col(f"`{id_col}`").eqNullSafe(F.col(named))
    stay = marked.join(kept, same, "left_semi")
    out = [F.col(f"`{c}`") for c in docs.columns]
    if not stay.groupBy(F.col(f"`{mark}`.key")).agg(F.count("*").alias("count")).where("count > 1").isEmpty():
        order = Window.partitionBy(F.col(mark)).orderBy(F.col(f"`{text_col}`").asc_nulls_last())
        stay = stay.select(*out, F.col(f"`{mark}`.key").alias(mark)).withColumn(number, F.row_number().over(order)).where(F.col(number) == 1)
    result = stage(stay.select(*out), "near_copies_removed")
    drop_staged(marked)
    return result
