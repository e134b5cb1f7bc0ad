"""Alignment of two tokenizers' tokens over the same bytes.

A (byte-level BPE of the tokenizers library, given a space and the text) and B (a sentencepiece model, which adds the space
itself) cut the same bytes differently. B's tokens are a static interval index, the sorted array of their ends: for each A token
two bisections find the B tokens that its bytes stab. Gaps between tokens that no token of either side spans are the boundaries
of groups. Neither side's tokens cross the units of ``units.py``, so each different unit is coded once; the tokens of many texts
are then gathered and aligned together.

How often an id pair is linked in the whole corpus is counted by Spark. Pairs of which there are many go to all tasks, up to
``SENT_PAIRS``; the counts of all others are joined by shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import Remembered, different, gather, offsets_of
from .staging import stage, unused
from .token_store import _LETTERS as BYTE_LETTERS
from .units import CHUNK_BYTES, plain, runs

#: Pairs whose counts are sent to all tasks, at most (about 20 MB).
SENT_PAIRS = 500_000
#: Units of which a worker remembers the tokens before a chunk, units that the libraries take at once, and tokens of both sides
#: that are aligned together.
KNOWN = 400_000
LEARNED = 2048
BATCH_TOKENS = 1 << 18
#: A pair is a's id times this, plus b's.
PAIR = 1 << 32

_BYTE = re.compile("<0x([0-9A-F]{2})>")
#: A letter or digit with a sign after it, which no token of either side holds: a unit's last signs are a unit of their own.
_BEFORE_SIGNS = re.compile("[0-9A-Za-zÀ-ÖØ-öø-ÿ][!-/:-@[-`{-~]")
_IS_SIGN = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_IS_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])


def _last_signs(data: np.ndarray) -> np.ndarray:
    """Where signs at the end of a unit begin, after a letter or digit; the bytes are units that begin with a space or line feed."""
    sign = _IS_SIGN[data]
    begins, ends = np.flatnonzero(sign[1:] & ~sign[:-1]) + 1, np.flatnonzero(sign[:-1] & ~sign[1:]) + 1
    after = data[ends]
    if len(begins) > len(ends):  # at the end of all
        after = np.append(after, 32)
    before = data[begins - 1]
    latin = (before >= 0x80) & (before < 0xC0) & (before != 0x97) & (before != 0xB7) & (data[np.maximum(begins - 2, 0)] == 0xC3)
    return begins[((after == 32) | (after == 10)) & (_IS_ALNUM[before] | latin)]


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens that lie side by side, given where they end: the places i and j of linked pairs (whose bytes overlap), in A's
    order, and the places of A's tokens with which a group ends."""
    last = np.searchsorted(b_ends, a_ends)
    ended = b_ends[last] == a_ends
    first = np.concatenate([[0], (last + ended)[:-1]])[: len(a_ends)]
    counts = last - first + 1
    i = np.repeat(np.arange(len(a_ends)), counts)
    j = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    return i, j, np.flatnonzero(ended)


class Aligner:
    """Both tokenizers, and the tokens of the units met last: a unit's values are 2 x id of A's and then 2 x id + 1 of B's tokens,
    none if their bytes aren't the unit's."""

    def __init__(self, a_file: str, b_file: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True  # their strings are plain text
        letters = {letter: byte for byte, letter in enumerate(BYTE_LETTERS)}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b = SentencePieceProcessor(model_file=b_file)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.bytes_of = [(np.frombuffer(b"".join(t), np.uint8), offsets_of(np.array([len(x) for x in t]))) for t in (self.a_bytes, self.b_bytes)]
        self.sizes = [np.diff(bounds) for _, bounds in self.bytes_of]
        # each id with each sign that can stand after it
        shown = [f"{k}{sign}".encode() for k in range(max(len(self.a_bytes), len(pieces))) for sign in (",", "|", ";", "")]
        self.shown = np.frombuffer(b"".join(shown), np.uint8), offsets_of(np.array([len(x) for x in shown]))
        self.known = Remembered(self._learn, KNOWN)
        # B's tokens keep within units if no piece goes on over a space, and none has a line feed
        self.apart = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        merged = [self.a_bytes[k].decode("utf-8", "ignore") for k in self.a.get_vocab(with_added_tokens=False).values()]
        self.signs_apart = not any(_BEFORE_SIGNS.search(t) for t in [*merged, *(p for p in pieces if not _BYTE.fullmatch(p) and p not in ("<s>", "</s>", "<unk>"))])

    def _learn(self, found: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Units one after the other are a text whose tokens keep within them; those with a space, which B adds, come first."""
        units = found.cast(pa.string()).to_pylist()
        first = np.array([ord(u[0]) for u in units], np.int64)
        order = [k for kind in (32, 10) for k in np.flatnonzero(first == kind).tolist() if plain(units[k])]
        values, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for low in range(0, len(order), LEARNED):
            v, n = self._coded([units[k] for k in order[low : low + LEARNED]])
            values.append(v)
            counts.append(n)
        signs = np.flatnonzero((first != 32) & (first != 10)).tolist()
        for low in range(0, len(signs), LEARNED):
            part = signs[low : low + LEARNED]
            v, n = self._coded([u for k in part for u in (" a", units[k])])
            v, starts = gather(v, offsets_of(n), np.arange(1, len(n), 2))
            values.append(v)
            counts.append(np.diff(starts))
        order += signs
        place = np.full(len(units), len(order))
        place[order] = np.arange(len(order))
        return gather(np.concatenate(values), offsets_of(np.concatenate([*counts, [0]])), place)

    def _coded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The values of units that follow each other, and how many each has."""
        text = "".join(units)
        spaced = text if text[0] == " " else " " + text  # a line feed at the beginning: the space, its token on both sides, goes again
        lead = len(spaced) - len(text)
        a = np.array(self.a.encode_batch_fast([spaced], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self.b.encode(spaced[1:]), np.int64)
        data = np.frombuffer(spaced.encode(), np.uint8)
        ends = lead + (np.cumsum([len(u) for u in units]) if len(data) == len(spaced) else np.cumsum([len(u.encode()) for u in units]))
        same = all(np.array_equal(gather(*known, x)[0], data) for known, x in zip(self.bytes_of, (a, b)))
        if same:
            sides = [np.cumsum(size[x]) for size, x in zip(self.sizes, (a, b))]
            same = all((side[np.searchsorted(side, ends)] == ends).all() for side in sides) and (not lead or sides[0][0] == sides[1][0] == lead)
        if not same:
            half = len(units) // 2
            if not half:
                return np.empty(0, np.int32), np.zeros(1, np.int64)
            return tuple(map(np.concatenate, zip(self._coded(units[:half]), self._coded(units[half:]))))
        unit = np.concatenate([np.searchsorted(ends, side[lead:]) for side in sides])
        order = np.argsort(unit, kind="stable")  # A's tokens of a unit before B's
        values = np.concatenate([2 * a[lead:], 2 * b[lead:] + 1])[order].astype(np.int32)
        return values, np.bincount(unit, minlength=len(units))

    def coded(self, texts: list[str]) -> list[np.ndarray]:
        """The values of each text: those of its units, none if it has no tokens."""
        if not self.apart:
            return [self._whole(t) for t in texts]
        spaced = [b" " + t.encode() if t else b"" for t in texts]
        data = np.frombuffer(b"".join(spaced), np.uint8)
        begin = (data == 32) | (data == 10)
        if self.signs_apart:
            begin[_last_signs(data)] = True
        begins = np.flatnonzero(begin)
        found, which = different(data, np.append(begins, len(data)))
        values, bounds, at = self.known.of(found)
        which = at[which]
        flat, starts = gather(values, bounds, which)
        first = np.searchsorted(begins, offsets_of(np.array([len(t) for t in spaced], np.int64)))
        none = offsets_of(starts[1:] == starts[:-1])[first]
        # white space beside white space, or a unit whose bytes differ: the text as a whole
        whole, cuts = (np.diff(none) > 0).tolist(), starts[first].tolist()
        return [self._whole(t) if w else flat[a:b] for t, w, a, b in zip(texts, whole, cuts, cuts[1:])]

    def _whole(self, text: str) -> np.ndarray:
        return self._coded([" " + text])[0] if text else np.empty(0, np.int32)

    def rows(self, held: list[np.ndarray]) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links, groups, pairs and times of texts, given their values."""
        n = len(held)
        values = np.concatenate([np.empty(0, np.int32), *held])
        text = np.repeat(np.arange(n), [len(v) for v in held])
        of_a = values % 2 == 0
        a, b, text_a = (values[of_a] >> 1).astype(np.int64), (values[~of_a] >> 1).astype(np.int64), text[of_a]
        a_ends, b_ends = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        i, j, group_ends = align(a_ends, b_ends)
        counts = [np.bincount(x, minlength=n) for x in (text_a, text[~of_a], text_a[group_ends], text_a[i])]
        # ids in the order in which groups are written, each with the sign after it
        last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last[0][group_ends] = last[1][np.searchsorted(b_ends, a_ends[group_ends])] = 1
        key = np.concatenate([2 * (np.cumsum(x) - x) + side for side, x in enumerate(last)])
        order = np.argsort(key, kind="stable")
        key = key[order]
        sign = np.where(np.append(key[1:], -1) == key, 0, 1 + key % 2)[: len(key)]
        stops = offsets_of(counts[0] + counts[1])
        sign[stops[1:][np.diff(stops) > 0] - 1] = 3
        shown, begins = gather(*self.shown, 4 * np.concatenate([a, b])[order] + sign)
        groups = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(begins[stops].astype(np.int32)), pa.py_buffer(shown)])
        linked, links = a[i] * PAIR + b[j], offsets_of(counts[3]).tolist()
        found = [np.unique(linked[x:y], return_counts=True) for x, y in zip(links, links[1:])]
        offsets = pa.array(np.cumsum([0, *(len(p) for p, _ in found)], dtype=np.int32))
        pairs = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([p for p, _ in found])))
        times = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([t for _, t in found]).astype(np.int32)))
        return [*map(pa.array, counts), groups, pairs, times]


_aligners: dict[tuple, Aligner] = {}


def _aligner(*key: str) -> Aligner:
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def align_tokens(docs: DataFrame, a_file: str, b_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, pairs and times of every whole text, one row for each of ``docs``.

    ``groups`` is written ``a1,a2|b1;a3|b2``. ``pairs`` are the different linked id pairs (a's id x PAIR + b's id) and
    ``times`` how often each is linked in the text. Texts that are null, empty, or whose joined bytes of either side differ
    from a space and the text have no tokens. Null and repeated ids are kept; other columns aren't looked at; an empty table
    gives no rows. A task holds a chunk of texts, or the longest text, and a bounded number of remembered units.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_file, b_file)
        names = [x.split()[0] for x in _ALIGNED.split(", ")]
        for batch in batches:
            for begin, texts in runs(batch.column(1), CHUNK_BYTES):
                held: list[np.ndarray] = []
                size, at = 0, begin
                for k, values in enumerate(aligner.coded(texts)):
                    held.append(values)
                    size += len(values)
                    if size >= BATCH_TOKENS or k == len(texts) - 1:
                        yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(held)], *aligner.rows(held)], names)
                        at, held, size = at + len(held), [], 0

    part = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return part.mapInArrow(rows, _ALIGNED)


def with_corpus_counts(aligned: DataFrame, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """``aligned`` (pairs, times and any other columns) without these two, with n_best and count_sum.

    A pair's count is how many links of all rows hold it. count_sum adds it up over a row's links; n_best is how many of the
    links have a count that no other pair of their b id exceeds. Rows without pairs have zeros.
    """
    row = unused(aligned, "row")
    rows = stage(aligned.withColumn(row, F.monotonically_increasing_id()), "aligned")
    links = rows.select(F.col(row).alias("row"), F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", "p.pairs", "p.times")
    totals = stage(links.groupBy("pairs").agg(F.sum("times").alias("count")), "totals")
    b = F.pmod("pairs", F.lit(PAIR)).alias("b")
    most = totals.groupBy(b).agg(F.max("count").alias("most"))  # a row for each of B's ids at most
    counts = totals.select("pairs", "count", b).join(F.broadcast(most), "b").select("pairs", "count", (F.col("count") == F.col("most")).alias("best"))
    # powers of two of counts, of which there are 63: the least one from which on few enough pairs are left
    power = F.length(F.bin("count")).cast("int")
    n_pairs = {r.power: r.n for r in totals.groupBy(power.alias("power")).agg(F.count("*").alias("n")).collect()}
    least = max(n_pairs, default=0) + 1
    sent = 0
    while least > 1 and sent + n_pairs.get(least - 1, 0) <= sent_pairs:
        least -= 1
        sent += n_pairs.get(least, 0)
    often = counts.where(power >= least).withColumnRenamed("pairs", "pair")
    by_row = [F.sum(F.col("times") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")]
    found = links.join(F.broadcast(often), F.col("pairs") == F.col("pair"), "left")
    if least > 1:
        seldom = links.join(F.broadcast(often.select("pair")), F.col("pairs") == F.col("pair"), "left_anti")
        rest = seldom.join(counts.where(power < least), "pairs").groupBy("row").agg(*by_row)
        sums = found.groupBy("row").agg(*by_row).unionByName(rest).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    else:
        sums = found.groupBy("row").agg(*by_row)
    sums = sums.select(F.col("row").alias("sum_row"), *[F.col(c).alias(f"sum_{c}") for c in ("n_best", "count_sum")])
    kept = [F.col(f"`{c}`") for c in aligned.columns if c not in ("pairs", "times")]
    added = [F.coalesce(f"sum_{c}", F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return rows.drop("pairs", "times").join(sums, F.col(row) == F.col("sum_row"), "left").select(*kept, *added)
