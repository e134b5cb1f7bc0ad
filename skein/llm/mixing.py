"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1. A source's weight is a straight schedule over it; integrated, the schedule gives the
words demanded of the source up to any time, ``target * (t + slope * (t * t - t))``. A source's documents stand in a fixed
shuffled order, and are passed over again while the target isn't met. The word at place x of that sequence is trained on
at the time at which demand reaches x, which is the inverse of the integral. Sorting by time mixes the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage, unused

#: A source's words are used so many times at most.
MAX_PASSES = 3
#: Documents that one task adds up in order; larger sources are cut into more ranges of the shuffled order.
RANGE_DOCS = 1000
#: Slopes of the schedules, repeating over the sources: steady, fading, rising.
SLOPES = (0.0, -0.5, 0.5)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes``: source, n_docs, source_size. Adds target, slope and n_ranges.

    Sources in code-point order (null last) weigh 1, 2, 3, repeating. Targets are weight times a common level, stopped at
    MAX_PASSES times the source's size, and add up to all words: what sharing the excess again and again ends at. The
    level is found in one pass over sources ordered by the level at which they stop. There is a row per source here.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    by_stop = Window.orderBy("stop", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(everything) - 1)
    weighed = (
        ranked.withColumn("weight", (F.col("rank") % 3 + 1).cast("double"))
        .withColumn("cap", (F.col("source_size") * MAX_PASSES).cast("double"))
        .withColumn("stop", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
    )
    below = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    left = by_stop.rowsBetween(0, Window.unboundedFollowing)
    reached = F.when(F.col("level") <= F.col("stop"), F.col("level"))  # of such levels the first, and highest, holds
    leveled = weighed.withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(left)
    ).withColumn("level", F.coalesce(F.max(reached).over(whole), F.max("stop").over(whole)))
    slope = F.element_at(F.array(*map(F.lit, SLOPES)), (F.col("rank") % len(SLOPES) + 1).cast("int"))
    return leveled.select(
        "source",
        "source_size",
        F.least("cap", F.col("weight") * F.col("level")).alias("target"),
        slope.alias("slope"),
        F.ceil(F.col("n_docs") / RANGE_DOCS).cast("long").alias("n_ranges"),
    )


def time_of(place: Column, target: Column, slope: Column) -> Column:
    """The time at which a source's demand reaches ``place`` words: the inverse of the integrated schedule."""
    y = F.coalesce(F.try_divide(place.cast("double"), target), F.lit(0.0))
    b = 1 - slope
    root = F.sqrt(F.greatest(b * b + 4 * slope * y, F.lit(0.0)))
    return F.coalesce(F.try_divide(2 * y, b + root), F.lit(0.0))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, whole_documents: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken, position (null if nothing is taken), positions.

    ``taken`` counts the words that the mix takes, repeats counted: whole passes over the source, then its first words in
    the shuffled order. With ``whole_documents`` the last pass takes a document if most of it is demanded, else the last
    one may be cut. ``positions`` has the time at which each use of the document begins. Texts are read once, for their
    sizes. Running sums are taken within ranges of the order and over the sums of ranges, so that a large source is no
    single task. The order is a hash of the id, then id and size, so reruns agree and repeated rows are interchangeable. A
    null or empty text has size 0 and nothing is taken of it; a null source is a source of its own; other columns aren't
    looked at; an empty table gives no rows.
    """
    rows = stage(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size")
        ),
        "sizes",
    )
    sizes = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    targets = stage(source_targets(sizes), "targets")
    few = targets.count() <= 200_000
    small = F.broadcast(targets) if few else targets
    t = small.withColumnRenamed("source", "s")
    ordered = (
        rows.join(t, rows["source"].eqNullSafe(F.col("s")), "left" if few else "inner")
        .drop("s")
        .withColumn("h", F.xxhash64("doc_id"))
        .withColumn("range", F.floor((F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) * F.col("n_ranges")).cast("long"))
    )
    ranges = ordered.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    bases = ranges.select(
        F.col("source").alias("rs"),
        F.col("range").alias("rr"),
        F.coalesce(
            F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("base"),
    )
    within = (
        Window.partitionBy("source", "range")
        .orderBy("h", F.col("doc_id").asc_nulls_first(), "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        ordered.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(bases, F.col("source").eqNullSafe(F.col("rs")) & (F.col("range") == F.col("rr")))
        .withColumn("before", F.col("before") + F.col("base"))
    )
    demand = F.round("target").cast("long")
    passes = F.floor(F.coalesce(F.try_divide(demand.cast("double"), F.col("source_size").cast("double")), F.lit(0.0))).cast("long")
    placed = placed.withColumn("passes", passes).withColumn("left", F.col("passes") * -F.col("source_size") + demand)
    size, before, left = F.col("size"), F.col("before"), F.col("left")
    last = F.when(2 * (left - before) >= size, size).otherwise(F.lit(0)) if whole_documents else F.least(size, F.greatest(left - before, F.lit(0)))
    placed = placed.withColumn("last", last.cast("long"))
    times = F.when((size > 0), F.col("passes") + (F.col("last") > 0).cast("long")).otherwise(F.lit(0))
    positions = F.when(
        times > 0,
        F.transform(
            F.sequence(F.lit(0).cast("long"), times - 1), lambda k: time_of(k * F.col("source_size") + before, F.col("target"), F.col("slope"))
        ),
    ).otherwise(F.array().cast("array<double>"))
    return placed.select(
        "doc_id",
        "size",
        "source",
        "source_size",
        "target",
        (F.col("passes") * size + F.col("last")).alias("taken"),
        F.get(positions, F.lit(0)).alias("position"),
        positions.alias("positions"),
    )


def mixed(plan: DataFrame) -> DataFrame:
    """A plan's rows range-sorted by position, documents of which nothing is taken last."""
    return stage(plan, "plan").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Whole documents in training order, each as often as it is used, with the columns of ``docs``.

    The plan is joined by id; rows of one id share the first such row's plan.
    """
    key, all_places, place = (unused(docs, n) for n in ("mix_id", "mix_positions", "mix_position"))
    plan = plan_mix(docs, id_col, text_col, source_col, whole_documents=True)
    uses = (
        stage(plan.select(F.col("doc_id").alias(key), "positions"), "plan")
        .groupBy(key)
        .agg(F.max("positions").alias(all_places))
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]
    used = docs.join(uses, F.col(f"`{id_col}`").eqNullSafe(F.col(key)))
    return (
        used.select(*columns, F.explode(all_places).alias(place))
        .repartitionByRange(place, F.col(f"`{id_col}`"))
        .sortWithinPartitions(place, F.col(f"`{id_col}`"))
        .select(*columns)
    )
