"""Streams of messages and events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """A folder of Parquet files as a stream; times without a zone become instants, as watermarks need them."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumns({c: F.col(c).cast("timestamp") for c, t in stream.dtypes if t == "timestamp_ntz"})


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str | None = None, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums per window and key. ``late``: how far behind an event may be; given for streams."""
    if late:
        events = events.withWatermark("ts", late)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        events.groupBy(w.alias("w"), *keys)
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")
    )


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark("ts", late)
    return (
        events.groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def join_within(left: DataFrame, right: DataFrame, key: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """Stream-stream join: right rows of the same key up to ``seconds`` after the left row. Both have a column ts."""
    a = left.withWatermark("ts", late).alias("a")
    b = right.withWatermark("ts", late).alias("b")
    near = F.expr(f"a.{key} = b.{key} and b.ts >= a.ts and b.ts <= a.ts + interval {int(seconds)} seconds")
    return a.join(b, near).select(F.col(f"a.{key}").alias(key), F.col("a.ts").alias("ts"), F.col("b.ts").alias("later"))


def concat_tokens(chunks: DataFrame) -> DataFrame:
    """Batch: chunks (thread_id, msg_id, seq, text) joined in order, empty ones skipped."""
    parts = F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("seq", "text"))))
    return chunks.groupBy("thread_id", "msg_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("content"))


#: How long state is kept of a message or item that gets nothing, in milliseconds.
IDLE_MS = 86_400_000


def concat_tokens_stream(chunks: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Stream: after every trigger the text so far of each message that got chunks (update mode).

    A message's chunks are kept in state by seq, so late ones take their place. The state of a message that got nothing for
    ``idle_ms`` is dropped; None keeps it, for a run over what is available, which a time-out would never let end.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seqs, texts = state.get if state.exists else ([], [])
        held = dict(zip(seqs, texts))
        for pdf in frames:
            held.update((int(s), t) for s, t in zip(pdf["seq"], pdf["text"]) if t)
        ordered = sorted(held)
        state.update((ordered, [held[s] for s in ordered]))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"thread_id": [key[0]], "msg_id": [key[1]], "content": ["".join(held[s] for s in ordered)]})

    return chunks.groupBy("thread_id", "msg_id").applyInPandasWithState(
        fold,
        "thread_id long, msg_id long, content string",
        "seqs array<long>, texts array<string>",
        "update",
        GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout,
    )


def fold_events_stream(events: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Stream of interface events (thread_id, item_id, seq, action add/remove, value): the live value, null once removed.

    A removal is remembered, so that an older event that comes late doesn't bring the item back; the state of an item that
    got nothing for ``idle_ms`` is dropped (None: kept, for a run over what is available).
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seq, value = state.get if state.exists else (-1, None)
        for pdf in frames:
            for s, action, v in zip(pdf["seq"], pdf["action"], pdf["value"]):
                if s >= seq:
                    seq, value = int(s), None if action == "remove" else str(v)
        state.update((seq, value))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"thread_id": [key[0]], "item_id": [key[1]], "value": [value]})

    return events.groupBy("thread_id", "item_id").applyInPandasWithState(
        fold, "thread_id long, item_id long, value string", "seq long, value string", "update", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    )


def unanswered_calls(calls: DataFrame, answers: DataFrame, seconds: int, late: str | None = None) -> DataFrame:
    """thread_id, call_id and ts of calls (thread_id, call_id, ts) that no answer (call_id, ts) follows within so many seconds.

    With ``late``, as a stream: an outer join that gives a call once, as soon as no answer can come in time any more.
    """
    if late:
        calls, answers = calls.withWatermark("ts", late), answers.withWatermark("ts", late)
    a, b = calls.alias("a"), answers.select(F.col("call_id").alias("answered_id"), F.col("ts").alias("answered")).alias("b")
    near = F.expr(f"call_id = answered_id and answered >= ts and answered <= ts + interval {int(seconds)} seconds")
    return a.join(b, near, "left_outer").where("answered_id is null").select("thread_id", "call_id", "ts")


class MessageEnds(StatefulProcessor):
    """Keeps the chunks of a message until it ends, gives it once, and tells chunks that come after that.

    State: ``progress`` (time of the newest chunk, number of the last chunk if it has come, whether the message was given) and
    ``chunks`` (number to text). A timer of event time gives what there is of a message that got nothing for ``idle_ms``; as
    long after it was given it is forgotten.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "newest long, last long, given boolean")
        self.chunks = handle.getMapState("chunks", "seq long", "text string")

    def _put(self, newest: int, last: int | None, given: bool) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.progress.update((newest, last, given))
        self.handle.registerTimer(newest + self.idle_ms)

    def _message(self, key: tuple) -> pd.DataFrame:
        held = sorted((k[0], v[0]) for k, v in self.chunks.iterator())
        self.chunks.clear()
        return pd.DataFrame({"thread_id": [key[0]], "msg_id": [key[1]], "kind": ["message"], "seq": [len(held)], "content": ["".join(t or "" for _, t in held)]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, last, given = self.progress.get() if self.progress.exists() else (0, None, False)
        late = []
        for pdf in rows:
            for seq, text, is_last, ts in zip(pdf["seq"], pdf["text"], pdf["is_last"], pdf["ts"]):
                newest = max(newest, int(ts.timestamp() * 1000))
                if given:
                    late.append((int(seq), text))
                    continue
                self.chunks.updateValue((int(seq),), (text,))
                last = int(seq) if is_last else last
        out = self._message(key) if not given and last is not None and all(self.chunks.containsKey((k,)) for k in range(last + 1)) else None
        self._put(newest, last, given or out is not None)
        if out is not None:
            yield out
        if late:
            yield pd.DataFrame({"thread_id": key[0], "msg_id": key[1], "kind": "late", "seq": [s for s, _ in late], "content": [t for _, t in late]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, last, given = self.progress.get()
        if given:
            self.progress.clear()
            return
        yield self._message(key)
        self._put(max(newest, expiredTimerInfo.getExpiryTimeInMs()), last, True)

    def close(self) -> None:
        pass


def message_ends(chunks: DataFrame, late: str = "1 hour", idle_ms: int = IDLE_MS) -> DataFrame:
    """Stream: thread_id, msg_id, kind, seq and content of chunks (thread_id, msg_id, seq from 0, text, is_last, ts), in append mode.

    A ``message`` is given once: when all chunks up to its last have come, else when the watermark passes ``idle_ms`` after its newest
    chunk; seq is then its number of chunks. A chunk that comes after its message was given is given as ``late``, with its own seq
    and text. Chunks behind the watermark are dropped by Spark, which counts them. It needs the RocksDB state store
    (``ROCKSDB``) and resumes from the query's checkpoint.
    """
    return (
        chunks.withWatermark("ts", late)
        .groupBy("thread_id", "msg_id")
        .transformWithStateInPandas(MessageEnds(idle_ms), "thread_id long, msg_id long, kind string, seq long, content string", "Append", "EventTime")
    )


#: The setting and value with which a session keeps streams' state in RocksDB.
ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
