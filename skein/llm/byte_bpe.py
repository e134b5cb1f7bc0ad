"""Byte-level BPE of a corpus by replaying its merges.

As in training, but with merges that are known: every different word of the corpus stands once in a flat sequence of
symbols, and an inverted index leads from the rank of a pair of symbols to the places where it stands. The ranks that stand
anywhere are applied in ascending order, each at its places in all words at once, and only the two neighbours of a merged
place are looked up again. Words don't depend on each other, so Spark cuts the corpus into chunks (``CHUNK_BYTES``)
whose different new words are replayed together, and nothing is shuffled; a worker remembers what it has coded.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import units
from .spans import Remembered, buffers, different, gather, offsets_of
from .units import runs

#: Text bytes whose different new words are replayed together, and ids of a batch that is handed on or decoded.
CHUNK_BYTES = 4 << 20
BATCH_IDS = 1 << 19


def read_ranks(file: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from lines of base64 and a number; the ranks are the ids."""
    with open(file, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Ranks:
    """A vocabulary by ranks, which are the ids, and which pairs of its tokens are a token together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        get = ranks.get
        pairs = sorted(
            (get(token[:k]) << 32 | get(token[k:]), rank)
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        )
        self.pairs = np.array([p for p, _ in pairs], np.int64)
        self.together = np.array([r for _, r in pairs], np.int32)
        self.tokens = pa.array(list(ranks), pa.binary())
        self.ids = np.array(list(ranks.values()), np.int32)

    def replayed(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, given the bytes of all and how many each has, and how many ids each has."""
        if not len(lengths):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        words = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets_of(lengths).astype(np.int32)), pa.py_buffer(data)])
        token = pc.index_in(words, value_set=self.tokens).fill_null(-1).to_numpy()
        rest = (token < 0) & (lengths > 0)
        counts = (token >= 0).astype(np.int64)
        if not rest.any():
            return self.ids[token[token >= 0]], counts
        ids, counts[rest] = _replay(data[np.repeat(rest, lengths)], lengths[rest], self)
        out = np.empty(counts.sum(), np.int32)
        own = np.repeat(rest, counts)
        out[own], out[~own] = ids, self.ids[token[token >= 0]]
        return out, counts

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens taken together; -1 if it is no token."""
        if not len(self.pairs):
            return np.full(len(left), -1, np.int32)
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.together[at], np.int32(-1))


def replay_merges(words: list[bytes], vocabulary: Ranks) -> list[bytes]:
    """The ids, as little-endian 32-bit integers, of different words.

    In each word the pair of the lowest rank is merged first, of equal ones the leftmost. A word that is a token is that token.
    """
    data, lengths = buffers(pa.array(words, pa.binary()))
    ids, counts = vocabulary.replayed(data, lengths)
    stops = (4 * np.cumsum(counts)).tolist()
    flat = ids.astype("<u4").tobytes()
    return [flat[a:b] for a, b in zip([0, *stops], stops)]


def _replay(data: np.ndarray, lengths: np.ndarray, vocabulary: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words that are no tokens, one after the other, and how many each has."""
    word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)  # of each place
    n = len(word)
    symbols = vocabulary.single[data]  # -1 once part of the one before
    after = np.arange(1, n + 1, dtype=np.int32)  # the next place of the word; -1 at its end
    before = np.arange(-1, n - 1, dtype=np.int32)
    ends = np.cumsum(lengths)
    after[ends - 1] = -1
    before[ends - lengths] = -1
    pair = np.full(n, -1, np.int32)  # the rank of the place's token and the next one together
    index: dict[int, list[np.ndarray]] = {}  # rank of a pair -> its places, some of which may no longer hold it
    heap: list[int] = []

    def look_up(places: np.ndarray) -> None:
        """Sets the pairs at the places and lists them in the index."""
        following = after[places]
        found = vocabulary.of_pairs(symbols[places], symbols[following])
        found[following < 0] = -1
        pair[places] = found
        listed = found >= 0
        found, places = found[listed], places[listed]
        order = np.argsort(found, kind="stable")
        found, places = found[order], places[order]
        cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
        begins = [0, *cuts.tolist()]
        for rank, a, b in zip(found[begins].tolist() if len(found) else (), begins, [*begins[1:], len(found)]):
            if rank in index:
                index[rank].append(places[a:b])
            else:
                index[rank] = [places[a:b]]
                heappush(heap, rank)

    look_up(np.arange(n, dtype=np.int32))
    while heap:
        rank = heappop(heap)
        listed = index.pop(rank)
        places = np.unique(np.concatenate(listed)) if len(listed) > 1 else np.sort(listed[0])
        places = places[pair[places] == rank]
        if not len(places):
            continue
        own = word[places]
        first = np.empty(len(places), bool)
        first[0] = True
        np.not_equal(own[1:], own[:-1], out=first[1:])
        if not first.all():  # a word's other places wait, as its first may bring a pair that goes before them
            index[rank] = [places[~first]]
            heappush(heap, rank)
            places = places[first]
        taken = after[places]
        following = after[taken]
        symbols[places], symbols[taken], pair[taken], after[places] = rank, -1, -1, following
        going = following >= 0
        before[following[going]] = places[going]
        earlier = before[places]
        look_up(np.concatenate([places, earlier[earlier >= 0]]))
    left = symbols >= 0
    return symbols[left], np.bincount(word[left], minlength=len(lengths))


#: The pattern that ``Words`` follows.
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE, _LETTER, _NUMBER, _SIGN, _END = range(5)


class Words:
    """Cuts texts into the matches of a pattern; GPT2's are found on arrays of code points, others' by the regex library."""

    def __init__(self, pattern: str):
        self.find = None if pattern == GPT2 else regex.compile(pattern).findall
        if not self.find:
            self.kinds = np.full(0x110000, _SIGN, np.uint8)
            for low in range(0, 0x110000, 0x800):
                if not 0xD800 <= low < 0xE000:
                    block = "".join(map(chr, range(low, low + 0x800)))
                    for kind, members in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
                        for m in regex.finditer(members, block):
                            self.kinds[low + m.start() : low + m.end()] = kind

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all words, how many each word has, and the words before each text (one more at the end)."""
        if self.find:
            found = [self.find(t) for t in texts]
            words = [w.encode() for split in found for w in split]
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            return np.frombuffer(b"".join(words), np.uint8), lengths, offsets_of(np.array([len(split) for split in found], np.int64))
        points = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le"), "<u4")
        stops = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64)) - 1
        kinds = self.kinds[points]
        kinds[stops] = _END
        first = np.ones(len(points), bool)
        np.not_equal(kinds[1:], kinds[:-1], out=first[1:])
        first[stops] = True
        # the last of some white space before anything else: a space goes with what follows, others stand alone
        followed = np.flatnonzero((kinds[:-1] == _SPACE) & (kinds[1:] != _SPACE) & (kinds[1:] != _END))
        first[followed] = True
        first[followed[points[followed] == 32] + 1] = False
        quotes = np.flatnonzero((points == 39) & first)
        if len(quotes):
            one, two = points[quotes + 1], points[np.minimum(quotes + 2, len(points) - 1)]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for begins, length in ((quotes[short], 2), (quotes[long], 3)):
                first[begins + 1] = False
                first[begins + length] = True
        begins = np.flatnonzero(first)
        ended = kinds[begins] == _END
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        if len(data) + len(texts) == len(points):
            lengths = np.diff(begins, append=len(points))
        else:
            widths = 1 + (points >= 0x80).view(np.uint8) + (points >= 0x800).view(np.uint8) + (points >= 0x10000).view(np.uint8)
            lengths = np.add.reduceat(widths, begins, dtype=np.int64)
        before = np.flatnonzero(ended) - np.arange(len(texts))
        return data, lengths[~ended], np.concatenate([[0], before])


class ByteEncoder:
    """Ids of texts by ranks and the pattern that cuts texts into words; each different word of a chunk is looked up once."""

    def __init__(self, file: str, pattern: str):
        self.vocabulary = Ranks(read_ranks(file))
        self.words = Words(pattern)
        self.known = Remembered(self._learn, 2 * units.KNOWN)

    def _learn(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        data, lengths = buffers(words)
        ids, counts = self.vocabulary.replayed(data, lengths)
        return ids, offsets_of(counts)

    def chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin (one more at the end)."""
        data, lengths, before = self.words.of(texts)
        words, which = different(data, offsets_of(lengths))
        values, bounds, at = self.known.of(words)
        ids, begins = gather(values, bounds, at[which])
        return ids, begins[before]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, begins = self.chunk(texts)
        for a, b in zip(begins.tolist(), begins[1:].tolist()):
            yield ids[a:b].astype("<u4").tobytes()


_encoders: dict[tuple, ByteEncoder] = {}


def _encoder(*key: str) -> ByteEncoder:
    if key not in _encoders:
        _encoders[key] = ByteEncoder(*key)
    return _encoders[key]


def _batches(begins: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold BATCH_IDS ids or fewer, or one row; where each row's ids begin is given, one more at the end."""
    low, n = 0, len(begins) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(begins, begins[low] + BATCH_IDS, "right")) - 1)
        yield low, min(high, n)
        low = high


def encode_texts(docs: DataFrame, file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every whole text, one row for each of ``docs``.

    A null or empty text has no ids; special tokens aren't known, so their strings are plain text. Null and repeated ids
    are kept. Other columns aren't looked at. An empty table gives no rows. A task holds a chunk of texts, or the longest
    text, and a bounded number of remembered words.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(file, pattern)
        for batch in batches:
            for row, texts in runs(batch.column(1), CHUNK_BYTES):
                ids, begins = encoder.chunk(texts)
                for low, high in _batches(begins):
                    offsets = pa.array((begins[low : high + 1] - begins[low]).astype(np.int32))
                    column = pa.ListArray.from_arrays(offsets, pa.array(ids[begins[low] : begins[high]]))
                    yield pa.RecordBatch.from_arrays([batch.column(0)[row + low : row + high], column], ["doc_id", "ids"])

    part = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return part.mapInArrow(encode, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, file: str) -> DataFrame:
    """doc_id, ids and data (the bytes of the ids) of rows with doc_id and ids; null ids are none. An unknown id fails."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, bounds, known = _decoder(file)
        for batch in batches:
            ids = batch.column(1)
            counts = np.diff(ids.offsets.to_numpy())
            if ids.null_count:
                counts = np.where(ids.is_valid().to_numpy(zero_copy_only=False), counts, 0)
            values, begins = ids.flatten().to_numpy(), offsets_of(counts)
            for low, high in _batches(begins):
                own = values[begins[low] : begins[high]]
                if len(own) and not (own.min() >= 0 and own.max() < len(known) and known[own].all()):
                    raise KeyError("an id that is no token")
                data, at = gather(flat, bounds, own)
                at = at[begins[low : high + 1] - begins[low]]
                texts = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], ids[low:high], texts], ["doc_id", "ids", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids array<int>, data binary")


_decoders: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _decoder(file: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids one after the other, where each id's begin (one more at the end), and whether it is a token."""
    if file not in _decoders:
        tokens = {rank: token for token, rank in read_ranks(file).items()}
        n = max(tokens, default=-1) + 1
        lengths = offsets_of(np.array([len(tokens.get(k, b"")) for k in range(n)], np.int64))
        flat = np.frombuffer(b"".join(tokens.get(k, b"") for k in range(n)), np.uint8)
        _decoders[file] = flat, lengths, np.array([k in tokens for k in range(n)], bool)
    return _decoders[file]
