"""Streams against their batch twins."""

import pytest
from pyspark.sql import functions as F

from skein.operators import state
from skein.sources.tables import table
from skein.streaming import streams


def run(df, mode, name, spark):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@pytest.fixture(scope="module")
def parts(spark, small, tmp_path_factory):
    """Events in four files, by time."""
    folder = str(tmp_path_factory.mktemp("events"))
    spark.read.parquet(f"{small}/events.parquet").repartitionByRange(4, "ts").write.mode("overwrite").parquet(folder)
    return folder


def test_tumbling_windows_in_append_mode_are_the_closed_ones(spark, small, parts):
    schema = spark.read.parquet(parts).schema
    stream = streams.windowed(streams.read_events(spark, parts, schema, 4), "1 day", late="1 hour", keys=())
    got = {tuple(r) for r in run(stream, "append", "tumbling", spark).collect()}
    batch = {tuple(r) for r in streams.windowed(table(spark, small, "events"), "1 day", keys=()).collect()}
    assert got and got < batch and len(batch) - len(got) <= 1


def test_session_windows(spark, small, parts):
    stream = streams.session_counts(streams.read_events(spark, parts, spark.read.parquet(parts).schema, 4), late="1 hour")
    got = {tuple(r) for r in run(stream, "append", "sessions", spark).collect()}
    assert got and got <= {tuple(r) for r in streams.session_counts(table(spark, small, "events")).collect()}


def test_tokens_are_joined_in_order_across_triggers(spark, tmp_path):
    rows = [(1, 1, k, "" if k == 3 else f"{k};") for k in (4, 0, 2, 1, 3, 5)]
    folder = str(tmp_path / "chunks")
    schema = "thread_id long, msg_id long, seq long, text string"
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = run(streams.concat_tokens_stream(stream, None), "update", "tokens", spark).collect()
    batch = streams.concat_tokens(spark.createDataFrame(rows, schema)).first().content
    assert max((r.content for r in out), key=len) == batch == "0;1;2;4;5;"


def test_event_fold_agrees_with_batch(spark, tmp_path):
    schema = "thread_id long, item_id long, seq long, action string, value string"
    rows = [(1, 1, 0, "add", "a"), (1, 2, 1, "add", "b"), (1, 1, 2, "remove", None), (1, 2, 3, "add", "c")]
    folder = str(tmp_path / "ui")
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    last = {r.item_id: r.value for r in run(streams.fold_events_stream(stream, None), "update", "ui", spark).collect()}
    batch = state.fold_events(spark.createDataFrame(rows, schema), ["thread_id", "item_id"], ["seq"], F.col("action") == "remove").collect()
    assert {k: v for k, v in last.items() if v} == {r.item_id: r.value for r in batch} == {2: "c"}


def test_stream_join(spark, parts):
    schema = spark.read.parquet(parts).schema
    e = streams.read_events(spark, parts, schema, 4)
    clicks = e.where("event_type = 'click'").select("user_id", "ts")
    buys = streams.read_events(spark, parts, schema, 4).where("event_type = 'purchase'").select("user_id", "ts")
    got = run(streams.join_within(clicks, buys, "user_id", 86400), "append", "joined", spark).count()
    assert got > 0


def test_messages_are_given_once_and_late_chunks_apart(spark, tmp_path):
    """Over three runs from one checkpoint: a message that ends, one out of order, one that never ends, and chunks that come late."""
    from datetime import datetime, timedelta

    schema = "thread_id long, msg_id long, seq long, text string, is_last boolean, ts timestamp"
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    rounds = [
        [(1, 1, 0, "a", False, at(0)), (1, 1, 1, "b", True, at(1)), (1, 2, 2, "z", True, at(2)), (1, 2, 0, "x", False, at(2)), (2, 1, 0, "never ", False, at(3))],
        [(1, 1, 2, "after", False, at(4)), (1, 2, 1, None, False, at(5)), (2, 1, 1, "ends", False, at(6))],
        [(9, 9, 0, "much later", False, at(300))],
        [(9, 9, 1, "", True, at(301)), (2, 1, 2, "too late", False, at(302))],
    ]
    folder, out, state_at = (str(tmp_path / n) for n in ("chunks", "out", "state"))
    before = spark.conf.get(streams.ROCKSDB[0], None)
    spark.conf.set(*streams.ROCKSDB)
    try:
        for rows in rounds:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
            chunks = spark.readStream.schema(schema).parquet(folder)
            q = streams.message_ends(chunks, "10 minutes", 3_600_000).writeStream.format("parquet").option("checkpointLocation", state_at)
            q.trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.set(streams.ROCKSDB[0], before) if before else spark.conf.unset(streams.ROCKSDB[0])
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    want = {(1, 1, "message", 2, "ab"), (1, 1, "late", 2, "after"), (1, 2, "message", 3, "xz"), (2, 1, "message", 2, "never ends"), (9, 9, "message", 2, "much later"), (2, 1, "late", 2, "too late")}
    assert got == want
    batch = spark.createDataFrame([r[:4] for rows in rounds for r in rows if r[3] not in ("after", "too late")], "thread_id long, msg_id long, seq long, text string")
    assert {tuple(r) for r in streams.concat_tokens(batch).collect()} == {(w[0], w[1], w[4]) for w in want if w[2] == "message"}
