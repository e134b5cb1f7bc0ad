"""State of any checkpoint of a forked thread.

Each checkpoint gets a place where a tour of its thread's tree enters it and one where the tour leaves it, so one checkpoint lies
above another if its places lie around the other's: a test of two numbers, with no path written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, drop_checkpointed
from .scan import CUT_ROWS, prefix_scan


def tour_labels(checkpoints: DataFrame) -> DataFrame:
    """thread_id, checkpoint_id, entered and left of every checkpoint that hangs from a root.

    ``checkpoints``: thread_id, checkpoint_id (unique in its thread), parent_id (null: a root), seq. The tour is a linked list:
    from where a checkpoint is entered to its first child, from where it is left to its next sibling, or else its parent.
    Each step's distance to the end is found by pointer doubling, in as many rounds as the logarithm of the largest thread;
    rounds are written to the shared folder. Labels rise along the tour. Below a missing parent or a cycle no end is reached,
    and those checkpoints aren't given.
    """
    tree = checkpoints.select("thread_id", "checkpoint_id", "parent_id", "seq")
    among = Window.partitionBy("thread_id", "parent_id").orderBy("seq", "checkpoint_id")
    placed = tree.select("*", F.lead("checkpoint_id").over(among).alias("next"), F.row_number().over(among).alias("n"))
    first = placed.where("n = 1 and parent_id is not null").select("thread_id", F.col("parent_id").alias("checkpoint_id"), F.col("checkpoint_id").alias("child"))
    nodes = checkpointed(placed.join(first, ["thread_id", "checkpoint_id"], "left"))
    step = lambda node, leaves: F.struct(node.alias("node"), leaves.alias("leaves"))
    entering = step(F.coalesce("child", "checkpoint_id"), F.col("child").isNull())
    leaving = F.when(F.col("next").isNotNull(), step(F.col("next"), F.lit(False))).when(F.col("parent_id").isNotNull(), step(F.col("parent_id"), F.lit(True)))
    both = F.array(F.struct(F.lit(False).alias("leaves"), entering.alias("to")), F.struct(F.lit(True).alias("leaves"), leaving.alias("to")))
    tour = nodes.select("thread_id", "checkpoint_id", F.explode(both).alias("e")).select("thread_id", F.col("checkpoint_id").alias("node"), "e.leaves", "e.to")
    state = checkpointed(tour.withColumn("steps", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long")))
    most = state.groupBy("thread_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(most.bit_length()):
        going = state.where("to is not null").select("thread_id", "node", "leaves", F.col("to.node").alias("to_node"), F.col("to.leaves").alias("to_leaves"), "steps")
        if going.isEmpty():
            break
        ahead = state.select("thread_id", F.col("node").alias("to_node"), F.col("leaves").alias("to_leaves"), "to", F.col("steps").alias("more"))
        further = going.join(ahead, ["thread_id", "to_node", "to_leaves"]).select("thread_id", "node", "leaves", "to", (F.col("steps") + F.col("more")).alias("steps"))
        after = checkpointed(state.where("to is null").unionByName(further))
        drop_checkpointed(state)
        state = after
    ended = state.where("to is null")
    place = lambda leaves: F.max(F.when(F.col("leaves") == leaves, -F.col("steps")))
    return ended.groupBy("thread_id", F.col("node").alias("checkpoint_id")).agg(place(False).alias("entered"), place(True).alias("left"))


def is_above(upper_entered: Column, upper_left: Column, entered: Column) -> Column:
    """Whether a checkpoint lies on the branch of another (or is it), by the labels of one thread."""
    return entered.between(upper_entered, upper_left)


def state_at(checkpoints: DataFrame, updates: DataFrame, asked: DataFrame | None = None, cut_rows: int = CUT_ROWS) -> DataFrame:
    """thread_id, checkpoint_id, key and value of each field that the branch of a checkpoint (all, or those of ``asked``) has set.

    ``updates``: thread_id, checkpoint_id, key, value, seq. A field has the value of the nearest update on the way to the root;
    of several at one checkpoint the one of the highest seq, then value. A null value is a value. Updates of unknown checkpoints
    are left out.

    Along the tour an update opens where its checkpoint is entered and closes where it is left, so updates of a field nest: how
    many are open at a place, and the last that made it so many, is the field's value there. Both are prefix scans.
    """
    labels = checkpointed(tour_labels(checkpoints))
    last = F.max_by(F.struct("value"), F.struct("seq", "value")).alias("v")
    changes = checkpointed(updates.groupBy("thread_id", "checkpoint_id", "key").agg(last).join(labels, ["thread_id", "checkpoint_id"]))
    keys = changes.select("thread_id", "key").distinct()
    points = labels if asked is None else labels.join(asked.select("thread_id", "checkpoint_id").distinct(), ["thread_id", "checkpoint_id"])
    ends = F.array(
        F.struct(F.col("entered").alias("at"), F.lit(1).alias("opens"), F.col("v").alias("v")),
        F.struct(F.col("left").alias("at"), F.lit(-1).alias("opens"), F.when(F.lit(False), F.col("v")).alias("v")),
    )
    brackets = changes.select("thread_id", "key", F.explode(ends).alias("e")).select("thread_id", "key", "e.*")
    questions = points.join(keys, "thread_id").select("thread_id", "key", F.col("entered").alias("at"), F.lit(0).alias("opens"), "checkpoint_id")
    events = brackets.unionByName(questions, allowMissingColumns=True).withColumn("asks", (F.col("opens") == 0).cast("int"))
    order = ["at", "asks"]  # an update counts at its own checkpoint
    level = checkpointed(prefix_scan(events, ["thread_id", "key"], order, sums={"level": F.col("opens")}, cut_rows=cut_rows).where("opens >= 0 and level > 0"))
    found = prefix_scan(level, ["thread_id", "key", "level"], order, lasts={"set": F.col("v")}, cut_rows=cut_rows)
    return found.where("opens = 0").select("thread_id", "checkpoint_id", "key", F.col("set.value").alias("value"))
