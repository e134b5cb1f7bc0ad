"""Token ids in a file format of directly addressable codes.

An id is cut into chunks of ``CHUNK_BITS`` bits. Level 0 holds the lowest chunk of every id, level 1 the next chunk of
those ids that have one, and so on. Each level has a continuation bitmap (1: the id goes on in the next level) and a
rank directory (ones before each block of the bitmap). The place of id i in the next level is the rank of i, so any id
is read by a few look-ups, and nothing else is decoded.

A store is a Parquet table whose rows are segments: a run of whole documents in ascending order, their ids as one code,
and their lengths. Parquet is only the container, so a store can lie wherever Spark reads and writes, and a lost
executor's files are written again by Spark's own committer.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spans import Remembered, buffers, different, gather, offsets_of
from .staging import table_path
from .words import LOWER, pieces

CHUNK_BITS = 8
RANK_BLOCK = 512
MAGIC = b"DAC1"
#: Text bytes that are encoded together, and different splits that the library takes at once.
CHUNK_BYTES = 8_000_000
LEARNED = 1024


def encode_codes(ids: np.ndarray) -> bytes:
    """The code of a sequence of unsigned 32-bit ids."""
    rest = np.ascontiguousarray(ids, np.uint32)
    levels: list[bytes] = []
    counts: list[int] = []
    while True:
        more = rest >= (1 << CHUNK_BITS)
        bitmap = np.packbits(more, bitorder="little")
        blocks = np.zeros(-(-len(rest) // RANK_BLOCK) + 1, np.uint32)
        if len(rest):
            blocks[1:] = np.cumsum(np.add.reduceat(more, np.arange(0, len(rest), RANK_BLOCK), dtype=np.uint32))
        levels.append((rest & 0xFF).astype(np.uint8).tobytes() + bitmap.tobytes() + blocks.astype("<u4").tobytes())
        counts.append(len(rest))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(CHUNK_BITS)
    return MAGIC + struct.pack(f"<I{len(counts)}Q", len(counts), *counts) + b"".join(levels)


class Codes:
    """Random access to an encoded sequence."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token code")
        (n,) = struct.unpack_from("<I", data, 4)
        self.counts = struct.unpack_from(f"<{n}Q", data, 8)
        self.levels = []
        at = 8 + 8 * n
        for count in self.counts:
            size, n_blocks = -(-count // 8), -(-count // RANK_BLOCK) + 1
            self.levels.append(
                (
                    np.frombuffer(data, np.uint8, count, at),
                    np.frombuffer(data, np.uint8, size, at + count),
                    np.frombuffer(data, "<u4", n_blocks, at + count + size),
                )
            )
            at += count + size + 4 * n_blocks

    def __len__(self) -> int:
        return self.counts[0]

    def rank(self, level: int, i: int) -> int:
        """Ids before the i-th of a level that go on in the next."""
        _, bitmap, blocks = self.levels[level]
        block = i // RANK_BLOCK
        first = block * RANK_BLOCK // 8
        ones = int(blocks[block]) + int(np.bitwise_count(bitmap[first : i // 8]).sum())
        return ones + (int(bitmap[i // 8] & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * level)
            if not bitmap[i // 8] >> (i % 8) & 1:
                break
            i = self.rank(level, i)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, read at their places in each level."""
        out = np.zeros(max(0, stop - start), np.uint32)
        where = np.arange(len(out))
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if not len(where):
                break
            out[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            bits = np.unpackbits(bitmap[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start]
            where = where[bits.astype(bool)]
            start = self.rank(level, start)
            stop = start + len(where)
        return out


#: What each byte of a lower-cased text is: white space, part of a letter, a digit or a sign. This holds for ASCII and for letters
#: that no neighbour can combine with (À-ÖØ-öø-įı-ſ, two bytes from C3 to C5 on): their splits are known beforehand.
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_KINDS = bytes(
    _SPACE if b in b"\x09\x0a\x0b\x0c\x0d\x20" else _DIGIT if b in b"0123456789" else _LETTER if b >= 128 or chr(b).isalpha() else _SIGN for b in range(256)
)
#: The settings of a tokenizer file under which _PLAIN and _SPLITS hold.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def splits_known(settings: dict) -> bool:
    """Whether a tokenizer file lower-cases, drops white space and codes each run of letters, digit and run of signs alone."""
    model = settings.get("model") or {}
    plain_model = model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
    added = settings.get("added_tokens") or []
    literal = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    same = settings.get("normalizer") == _NORMALIZER and settings.get("pre_tokenizer") == _PRE_TOKENIZER
    return bool(same and plain_model and literal and not settings.get("truncation") and not settings.get("padding"))


def _byte_letters() -> str:
    """The letter by which byte-level models write each byte: printable bytes stand for themselves, others come from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(others)) for b in range(256))


_LETTERS = _byte_letters()
_WRITTEN = np.array([ord(c) for c in _LETTERS], "<u2")
_WRITTEN[32] = 32  # between words


def _uncertain(data: np.ndarray) -> np.ndarray:
    """Places of bytes that are no ASCII and not part of one of the letters whose splits are known."""
    high = np.flatnonzero(data >= 128)
    own = data[high]
    before = np.where(high > 0, data[high - 1], 0)
    after = np.where(high + 1 < len(data), data[np.minimum(high + 1, len(data) - 1)], 0)
    lead = (own >= 0xC3) & (own <= 0xC5) & (after >= 0x80) & (after < 0xC0)
    lead &= ~((own == 0xC3) & ((after == 0x97) | (after == 0xB7))) & ~((own == 0xC4) & (after == 0xB0))
    return high[~(lead | (own < 0xC0) & (before >= 0xC3) & (before <= 0xC5))]


def _splits(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all splits of lower-cased text, how long each is and where it begins.

    A split is 's, 't, 're, 've, 'm, 'll or 'd, else a run of letters, a digit, or a run of signs.
    """
    kinds = np.frombuffer(data.translate(_KINDS), np.uint8)
    own = np.frombuffer(data, np.uint8)
    n = len(own)
    first = kinds == _DIGIT
    first[:1] = True
    first[1:] |= kinds[1:] != kinds[:-1]
    quotes = np.flatnonzero((own == 39) & first)
    if len(quotes):
        one, two = (np.where(quotes + k < n, own[np.minimum(quotes + k, n - 1)], 0) for k in (1, 2))
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        for begins, length in ((quotes[short], 2), (quotes[long], 3)):
            first[begins + 1] = False
            after = begins + length
            first[after[after < n]] = True
    begins = np.flatnonzero(first)
    lengths = np.diff(begins, append=n)
    split = kinds[begins] != _SPACE
    return own[kinds != _SPACE], lengths[split], begins[split]


class Encoder:
    """Ids of texts, as the tokenizers library gives them, each different split (a run of letters, a digit, signs) encoded once.

    The splits of a chunk of texts are found on arrays, and those that aren't remembered go to the library's model some thousands
    at a time. Texts with an added token or with bytes of which the splits aren't certain, and all texts if the file's settings
    aren't known, are encoded whole.
    """

    def __init__(self, file: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(file, encoding="utf-8") as f:
            settings = json.load(f)
        self.tokenizer = Tokenizer.from_file(file)
        self.splits_known = splits_known(settings)
        self.added = [t["content"].encode() for t in settings.get("added_tokens") or []]
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.model = Tokenizer(self.tokenizer.model)  # of normal, byte-level text with a space between splits
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = settings["model"].get("end_of_word_suffix") or "" if self.splits_known else ""
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each token, which it has as letters
        self.sizes[list(vocabulary.values())] = [len(t.removesuffix(suffix)) for t in vocabulary]
        self.known = Remembered(self._learn)

    def _learn(self, splits: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of splits, one after the other, and where each split's begin (one more at the end)."""
        ids, counts = [np.empty(0, self.dtype)], [np.empty(0, np.int64)]
        for low in range(0, len(splits), LEARNED):
            data, lengths = buffers(splits.slice(low, LEARNED))
            spaced = np.full(len(data) + len(lengths), 32, np.uint8)
            spaced[np.arange(len(data)) + np.repeat(np.arange(len(lengths)), lengths)] = data
            text = spaced.tobytes()
            if not text.isascii():
                text = text.decode().lower().encode()
            letters = _WRITTEN[np.frombuffer(text, np.uint8)].tobytes().decode("utf-16-le")
            found = np.array(self.model.encode_batch_fast([letters], add_special_tokens=False)[0].ids, np.int64)
            stops, ends = np.cumsum(self.sizes[found]), np.cumsum(lengths)
            last = np.searchsorted(stops, ends)
            if len(found) and stops[-1] == ends[-1] and (stops[last] == ends).all():
                counts.append(np.diff(last, prepend=-1))
            else:  # a byte that is no token: each split by itself
                single = [[t.id for t in self.tokenizer.model.tokenize(w)] for w in letters.split()]
                found = np.array([k for own in single for k in own], np.int64)
                counts.append(np.array([len(own) for own in single]))
            ids.append(found.astype(self.dtype))
        return np.concatenate(ids), offsets_of(np.concatenate(counts))

    def _by_splits(self, texts: list[bytes]) -> list[bytes | None]:
        """Each text's ids, little-endian, in ``dtype``; None for one that has to be encoded whole."""
        certain = [not any(a in t for a in self.added) for t in texts]
        for _ in range(2):  # once more without the uncertain texts
            taken = [t if c else b"" for t, c in zip(texts, certain)]
            starts = offsets_of(np.array([len(t) + 1 for t in taken]))[:-1]
            joined = b" ".join(taken).translate(LOWER)
            doubtful = np.unique(np.searchsorted(starts, _uncertain(np.frombuffer(joined, np.uint8)), "right") - 1).tolist()
            if not doubtful:
                break
            for k in doubtful:
                certain[k] = False
        data, lengths, begins = _splits(joined)
        splits, which = different(data, offsets_of(lengths))
        values, bounds, at = self.known.of(splits)
        ids, starts_of_ids = gather(values, bounds, at[which])
        stops = starts_of_ids[np.searchsorted(begins, [*starts[1:], len(joined)])].tolist()
        return [ids[a:b].tobytes() if c else None for a, b, c in zip([0, *stops], stops, certain)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids and the end id, little-endian, in ``dtype``."""
        found = self._by_splits(texts) if self.splits_known and texts else [None] * len(texts)
        rest = [t.decode("utf-8", "replace") for t, ids in zip(texts, found) if ids is None]
        whole = iter(self.tokenizer.encode_batch(rest, add_special_tokens=False)) if rest else iter(())
        return [(np.array(next(whole).ids, self.dtype).tobytes() if ids is None else ids) + self.end for ids in found]


_encoders: dict[tuple, Encoder] = {}


def _encoder(*key) -> Encoder:
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    end_id: int,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    docs_per_shard: int = 8192,
    max_shards: int = 20_000,
    segment_tokens: int = 1 << 20,
) -> None:
    """Encode every whole text and write the store at ``path``, documents in ascending order of their integer id.

    Each task encodes its texts and sends only ids, two bytes each where the vocabulary allows, to the shard that owns
    the document's range of ids. Ranges come from quantiles of the id column alone, so texts are read and encoded once.
    ``docs_per_shard`` and ``max_shards`` set the parallelism and drop nothing. A null text is empty: it has the end id
    alone. A null id comes first. Rows of equal id stay apart, ordered by their ids. Other columns are not looked at. An
    empty table makes an empty store.
    """
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    n = ids.count()
    shards = max(1, min(max_shards, -(-n // docs_per_shard)))
    cuts = np.array(
        ids.agg(F.percentile_approx("doc_id", [k / shards for k in range(1, shards)] or [0.5], 10 * shards)).first()[0] or [],
        np.int64,
    )[: shards - 1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file, end_id)
        narrow = encoder.dtype.itemsize == 2
        for batch in batches:
            owner = batch.column(0).fill_null(-(1 << 63)).to_numpy()
            shard = np.searchsorted(cuts, owner, "left")
            at = 0
            for texts in pieces(batch.column(1), CHUNK_BYTES):
                coded = encoder.encode(texts)
                rows = slice(at, at + len(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], pa.array(shard[rows], pa.int32()), pa.array([narrow] * len(texts)), pa.array(coded, pa.binary())],
                    ["doc_id", "shard", "narrow", "ids"],
                )
                at += len(texts)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = size = number = 0
        shard, held, owners, lengths = 0, [], [], []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([size], pa.int64()),
                    pa.array([owners], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([encode_codes(np.concatenate(held))], pa.binary()),
                ],
                ["shard", "segment", "first", "n_tokens", "doc_ids", "lengths", "codes"],
            )

        for batch in batches:
            for owner, at, narrow, data in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = np.frombuffer(data, np.uint16 if narrow else np.uint32)
                shard = at
                held.append(tokens)
                owners.append(owner)
                lengths.append(len(tokens))
                size += len(tokens)
                if size >= segment_tokens:
                    yield close()
                    before, size, number, held, owners, lengths = before + size, 0, number + 1, [], [], []
        if held:
            yield close()

    (
        docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
        .mapInArrow(encode, "doc_id long, shard int, narrow boolean, ids binary")
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
        .mapInArrow(
            segments, "shard int, segment int, first long, n_tokens long, doc_ids array<long>, lengths array<long>, codes binary"
        )
        .write.options(compression="zstd", **{"parquet.block.size": 16 << 20})
        .parquet(path)
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A segment's ids are read once, each document's by its place among them. Totals of shards are added up in one window over a row
    per shard (``max_shards`` at most) and sent to all tasks.
    """
    store = spark.read.parquet(path)
    totals = store.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select(
        "shard", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, owners, lengths, data in zip(*(c.to_pylist() for c in batch.columns)):
                codes = Codes(data)
                starts = np.concatenate([[0], np.cumsum(lengths)]).tolist()
                ids = memoryview(codes.slice(0, len(codes)).astype("<u4")).cast("B")
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * len(owners), pa.int32()),
                        pa.array(owners, pa.int64()),
                        pa.array([first + s for s in starts[:-1]], pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["shard", "doc_id", "offset", "n_tokens", "ids_crc32"],
                )

    return (
        store.select("shard", "first", "doc_ids", "lengths", "codes")
        .mapInArrow(documents, "shard int, doc_id long, offset long, n_tokens long, ids_crc32 long")
        .join(F.broadcast(bases), "shard")
        .select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_store(docs: DataFrame, tokenizer_file: str, end_id: int = 2, *, path: str | None = None, **options) -> DataFrame:
    """Write the store of ``docs`` (to the shared folder if no path is given) and return what ``read_store`` finds in it."""
    spark = docs.sparkSession
    path = path or table_path(spark, "tokens")
    write_store(docs, path, tokenizer_file, end_id, **options)
    return read_store(spark, path)
