"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import hash_words, mix, pieces

#: Weights; n-grams are hashed to them.
SIZE = 1 << 18
#: Labelled documents that train the model, at most: those of the smallest hashed ids. The model has a fixed size, so
#: more rows would cost time and hardly change it.
MAX_TRAIN = 8000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.1
#: Factor of the n-grams' shares of a text, so that typical values are near one.
SCALE = 8.0
THRESHOLD = 0.3
#: Slot of a pair of equal words, whatever the word: repetition says more than the word does.
TWICE = 1
#: Words are runs of letters, of digits, and of other signs; case is kept.
_WORDS = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\x09-\x0d\x20A-Za-z0-9\x80-\xff]+")


def ngram_slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words and of the pairs of neighbouring words of each text, and where each text's slots begin.

    A text's n words are followed by its n - 1 pairs; a text without words has no slots.
    """
    words, starts = hash_words([_WORDS.findall(t) for t in texts])
    counts = np.diff(starts)
    begins = np.concatenate([[0], np.cumsum(counts + np.maximum(counts - 1, 0))])
    slots = np.empty(begins[-1], np.int64)
    mask = np.uint64(SIZE - 1)
    one = (mix(words) & mask).astype(np.int64)
    two = (mix(mix(words[:-1]) + words[1:]) & mask).astype(np.int64) if len(words) > 1 else one[:0]
    two[words[:-1] == words[1:]] = TWICE
    within = np.arange(len(words)) - np.repeat(starts[:-1], counts)
    slots[np.repeat(begins[:-1], counts) + within] = one
    pair = within[1:] > 0
    at = np.repeat(begins[:-1] + counts, counts)[1:] + within[1:] - 1
    slots[at[pair]] = two[pair]
    return slots, begins


class Ftrl:
    """Follow the regularised leader, one sparse document at a time; the bias is not regularised."""

    def __init__(self) -> None:
        self.z = np.zeros(SIZE)
        self.n = np.zeros(SIZE)
        self.bias = np.zeros(2)  # z and n

    def weights(self, slots: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    @property
    def intercept(self) -> float:
        return -self.bias[0] * ALPHA / (BETA + np.sqrt(self.bias[1]))

    def update(self, slots: np.ndarray, values: np.ndarray, label: float) -> None:
        w = self.weights(slots)
        g = 1 / (1 + np.exp(-np.clip(w @ values + self.intercept, -35, 35))) - label
        gs = g * values
        n = self.n[slots]
        self.z[slots] += gs - (np.sqrt(n + gs * gs) - np.sqrt(n)) / ALPHA * w
        self.n[slots] = n + gs * gs
        b, m = self.intercept, self.bias[1]
        self.bias += (g - (np.sqrt(m + g * g) - np.sqrt(m)) / ALPHA * b, g * g)


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Weights and intercept after EPOCHS passes over (slots, values, label) in the given order."""
    model = Ftrl()
    for _ in range(EPOCHS):
        for row in rows:
            model.update(*row)
    return model.weights(slice(None)).astype(np.float32), float(model.intercept)


def is_held_out(id_column) -> F.Column:
    """The fifth of all ids that is kept for evaluation; a null id is kept too."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """Fit the classifier on labelled documents that are not held out.

    Labels other than 0 and 1 are passed over; a repeated id has the majority of its labels (1 in a tie). The rows go
    through one task in the order of their hashed ids, so reruns agree. Without labelled rows the model is empty and every
    score is one half.
    """
    y = F.col(f"`{label_col}`")
    chosen = (
        labels.select(F.col(f"`{id_col}`").alias("doc_id"), y.cast("double").alias("y"))
        .where(y.isin(0, 1) & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("y") >= 0.5).cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_TRAIN)
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in pieces(batch.column(2)):
                slots, begins = ngram_slots(texts)
                packed = []
                for a, b in zip(begins.tolist(), begins[1:].tolist()):
                    which, times = np.unique(slots[a:b], return_counts=True)
                    packed.append((which.astype("<i4").tobytes(), (times * (SCALE / max(1, b - a))).astype("<f4").tobytes()))
                rows = slice(at, at + len(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], batch.column(1)[rows], *(pa.array([p[k] for p in packed], pa.binary()) for k in (0, 1))],
                    ["place", "y", "slots", "counts"],
                )
                at += len(texts)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for y, s, v in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                rows.append((np.frombuffer(s, "<i4"), np.frombuffer(v, "<f4").astype(np.float64), y))
        weights, bias = fit(rows)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])

    row = (
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # MAX_TRAIN rows of two numbers at most
        .select(F.xxhash64("doc_id").alias("place"), "y", "text")
        .mapInArrow(features, "place long, y double, slots binary, counts binary")
        .repartition(1)
        .sortWithinPartitions("place", "slots", "counts")
        .mapInArrow(learn, "weights binary, bias double")
        .first()
    )
    return (np.frombuffer(row[0], "<f4"), row[1]) if row else (np.zeros(SIZE, np.float32), 0.0)


def with_score(docs: DataFrame, model: tuple[np.ndarray, float], name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the model's probability of label 1 for every whole text; null and empty texts have the intercept's.

    A score is the sparse dot product of the weights and the text's n-gram shares; no shuffle, other columns untouched.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        weights, bias = shared.value
        out = []
        for part in pieces(texts):
            slots, begins = ngram_slots(part)
            sums = np.concatenate([[0.0], np.cumsum(weights[slots], dtype=np.float64)])
            total = sums[begins[1:]] - sums[begins[:-1]]
            margin = bias + SCALE * total / np.maximum(1, np.diff(begins))
            out.append(1 / (1 + np.exp(-np.clip(margin, -35, 35))))
        return pa.array(np.concatenate([*out, np.empty(0)]))

    return docs.withColumn(name, F.arrow_udf(score, "double").asNondeterministic()(F.col(f"`{text_col}`").cast("binary")))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Train on ``labels`` and score every document: doc_id, held_out, score, predicted (1 if score >= THRESHOLD)."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    part = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return with_score(part, model, "score").select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
