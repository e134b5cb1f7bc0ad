"""Relational shapes that the engine offers beside SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, right_cols: list[str]) -> DataFrame:
    """Each left row with the columns of the latest right row of its key at or before its time; null without one.

    Both sides are put in one order per key and the last right row is carried on: one shuffle, no range join.
    """
    value = F.struct(*right_cols)
    marked = left.withColumn("__at", F.col(left_ts)).withColumn("__r", F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType)).withColumn("__side", F.lit(1))
    ticks = right.select(F.col(key), F.col(right_ts).alias("__at"), value.alias("__r"), F.lit(0).alias("__side"))
    both = marked.unionByName(ticks, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return filled.select(*left.columns, *[F.col("__r")[c].alias(c) for c in right_cols])


def interval_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, seconds: int) -> DataFrame:
    """Pairs of equal key of which the right one comes at most so many seconds after the left one (at once counts too).

    Time is cut into bins of that length: a left row looks into its own bin and the next, so the join is on key and bin, and
    a frequent key is spread over its bins. ``right`` has the key under the same name.
    """
    bin_of = lambda c: F.floor(F.unix_micros(c) / F.lit(seconds * 1_000_000)).cast("long")
    a = left.withColumn("__bin", F.explode(F.array(bin_of(F.col(left_ts)), bin_of(F.col(left_ts)) + 1)))
    b = right.withColumn("__bin", bin_of(F.col(right_ts)))
    later = F.unix_micros(F.col(right_ts)) - F.unix_micros(F.col(left_ts))
    return a.join(b, [key, "__bin"]).where(later.between(0, seconds * 1_000_000)).drop("__bin")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Runs of events of a key with no pause as long as the gap."""
    return events.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
