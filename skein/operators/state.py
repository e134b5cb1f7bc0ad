"""Thread state as a log of updates: folding, defaults, checkpoints and branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, drop_checkpointed


def fold_updates(updates: DataFrame, tie: str = "id") -> DataFrame:
    """thread_id, key, value of the last update of each field (by seq, then ``tie``); a value is replaced as a whole."""
    return updates.groupBy("thread_id", "key").agg(F.max_by("value", F.struct("seq", tie)).alias("value"))


def as_state(folded: DataFrame, keys: list[str]) -> DataFrame:
    """One row per thread with a column per declared key; an absent key is null."""
    return folded.groupBy("thread_id").pivot("key", keys).agg(F.first("value"))


def seeded(seeds: DataFrame, updates: DataFrame) -> DataFrame:
    """Initial values as updates before all others."""
    return seeds.withColumn("seq", F.lit(-1).cast("long")).withColumn("id", F.lit(-1).cast("long")).unionByName(updates)


def read_or(value: Column, fallback: str) -> Column:
    """A field, or the fallback where it is missing."""
    return F.coalesce(value, F.lit(fallback))


def map_or(value: Column, fallback: str) -> Column:
    """A map field as JSON; an empty map counts as missing."""
    return F.when(F.size(value) > 0, F.to_json(value)).otherwise(F.lit(fallback))


def siblings(checkpoints: DataFrame) -> DataFrame:
    """thread_id, checkpoint_id, n_options and option (from 1) among the children of one parent."""
    from pyspark.sql import Window

    w = Window.partitionBy("thread_id", "parent_id")
    return checkpoints.select(
        "thread_id",
        "checkpoint_id",
        F.count("*").over(w).alias("n_options"),
        F.row_number().over(w.orderBy("seq", "checkpoint_id")).cast("long").alias("option"),
    )


def branch_paths(checkpoints: DataFrame) -> DataFrame:
    """thread_id, checkpoint_id, depth and path (ids from the root, joined by /) of every checkpoint that hangs from a root.

    Pointer doubling: each node knows an ancestor and the path below it, and in each round takes over its ancestor's pointer,
    so the rounds grow with the logarithm of the depth, which isn't bounded. Nodes below a missing parent or a cycle never
    reach a root and aren't given. Rounds are written to the shared folder, and the last but one deleted.
    """
    state = checkpointed(
        checkpoints.select(
            "thread_id", "checkpoint_id", F.col("parent_id").alias("up"), F.lit(0).cast("long").alias("depth"), F.col("checkpoint_id").cast("string").alias("path")
        )
    )
    longest = state.groupBy("thread_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(longest.bit_length()):
        going = state.where("up is not null")
        if going.isEmpty():
            break
        above = state.select("thread_id", F.col("checkpoint_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("path").alias("path2"))
        further = going.join(above, ["thread_id", "up"]).select(
            "thread_id", "checkpoint_id", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2") + 1).alias("depth"), F.concat_ws("/", "path2", "path").alias("path")
        )
        after = checkpointed(state.where("up is null").unionByName(further))
        drop_checkpointed(state)
        state = after
    return state.where("up is null").drop("up")


def write_fields(writes: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """What tools write to the state: the updates, and a tool message for each call, which the log needs as its answer.

    ``writes``: thread_id, seq, id, tool_call_id, key, value. A field is replaced as a whole when updates are folded.
    """
    updates = writes.select("thread_id", "key", "value", "seq", "id")
    answers = writes.select("thread_id", "seq", "tool_call_id").distinct()
    return updates, answers.select("thread_id", "seq", F.lit("tool").alias("role"), F.lit(text).alias("content"), "tool_call_id")


def fold_events(events: DataFrame, key: list[str], order: list[str], removed: Column) -> DataFrame:
    """The list that adding and removing events leave: each key's last event, unless it is a removal."""
    last = F.max_by(F.struct("*", removed.alias("__removed")), F.struct(*order))
    return events.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(last.alias("e")).select("e.*").where(~F.col("__removed")).drop("__removed")
