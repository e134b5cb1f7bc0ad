"""Running values of keys of any size: a prefix scan on two levels.

A window puts all rows of a key in one task. Here a key with many rows is cut at quantiles of its order, running values are
computed within cuts, and what a cut begins with is carried over from the totals of the cuts before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Rows of a key from which on it is cut, and rows of a cut, about.
CUT_ROWS = 1_000_000
#: Keys that are cut, at most, and cuts of all of them, at most that many more: beyond, cuts grow with the rows.
MOST_CUTS = 10_000
#: Quantiles of a key's order from which its cuts are chosen.
GRID = 1000


def _same(pairs: list[tuple[str, str]]) -> Column:
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs])


def with_cuts(df: DataFrame, key: list[str], order: str, cut_rows: int = CUT_ROWS) -> tuple[DataFrame, bool]:
    """``df`` with ``__cut``, which rises with ``order`` within a key and is 0 for keys of few rows; and whether any key is cut.

    Rows of a key with equal ``order`` share a cut. The table of cuts, which goes to all tasks, has at most MOST_CUTS keys.
    """
    counts = df.groupBy(*key).agg(F.count("*").alias("__n"))
    n_rows = df.count()
    cut_rows = max(cut_rows, -(-n_rows // MOST_CUTS))
    named = [(k, f"__k{i}") for i, k in enumerate(key)]
    large = checkpointed(counts.where(F.col("__n") > cut_rows).select(*[F.col(k).alias(n) for k, n in named], "__n"))
    if large.isEmpty():
        return df.withColumn("__cut", F.lit(0)), False
    grid = F.percentile_approx(order, [k / GRID for k in range(1, GRID)], 10 * GRID)
    quantiles = df.join(F.broadcast(large), _same(named)).groupBy(*[n for _, n in named]).agg(F.first("__n").alias("__n"), grid.alias("__grid"))
    parts = F.least(F.ceil(F.col("__n") / cut_rows), F.lit(GRID))
    step = lambda i: F.floor(i * parts / GRID)
    chosen = F.array_distinct(F.filter("__grid", lambda _, i: step(i + 1) > step(i)))
    cuts = checkpointed(quantiles.select(*[n for _, n in named], chosen.alias("__cuts")))
    # how many cuts lie below, by halving; a place beyond the last cut is null and not below
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(GRID.bit_length()))])
    cut = F.aggregate(halves, F.lit(0), lambda n, half: F.when(F.get("__cuts", n + half - 1) < F.col(order), n + half).otherwise(n))
    return df.join(F.broadcast(cuts), _same(named), "left").withColumn("__cut", cut).drop("__cuts", *[n for _, n in named]), True


def prefix_scan(
    df: DataFrame, key: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, cut_rows: int = CUT_ROWS
) -> DataFrame:
    """``df`` with running values of each key up to and with each row.

    ``sums``: names and what is added up (nulls add nothing; null before the first value). ``lasts``: names and what is carried
    on where it is null. ``order`` must tell the rows of a key apart; its first column is numeric or a time, by which large keys
    are cut. A null key is a key. Columns that begin with ``__`` are reserved. An empty table gives no rows.
    """
    sums, lasts = sums or {}, lasts or {}
    named = df.withColumns({f"__s_{n}": c for n, c in sums.items()} | {f"__l_{n}": c for n, c in lasts.items()})
    cut, some = with_cuts(named, key, order[0], cut_rows)
    within = Window.partitionBy(*key, "__cut").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = {n: F.sum(f"__s_{n}").over(within) for n in sums} | {n: F.last(f"__l_{n}", ignorenulls=True).over(within) for n in lasts}
    inner = [f"__s_{n}" for n in sums] + [f"__l_{n}" for n in lasts]
    if not some:
        return cut.withColumns(local).drop("__cut", *inner)
    place = F.struct(*order)
    totals = cut.groupBy(*key, "__cut").agg(
        *[F.sum(f"__s_{n}").alias(n) for n in sums], *[F.max_by(f"__l_{n}", F.when(F.col(f"__l_{n}").isNotNull(), place)).alias(n) for n in lasts]
    )
    # only keys that are cut have a cut but 0, so the carries are as bounded as the cuts
    before = Window.partitionBy(*key).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(n).over(before).alias(f"__c_{n}") for n in sums] + [F.last(n, ignorenulls=True).over(before).alias(f"__c_{n}") for n in lasts]
    names = [(k, f"__k{i}") for i, k in enumerate(key)]
    carries = totals.select(*[F.col(k).alias(a) for k, a in names], F.col("__cut").alias("__begin"), *carried).where("__begin > 0")
    both = cut.withColumns(local).join(F.broadcast(checkpointed(carries)), _same([*names, ("__cut", "__begin")]), "left")
    added = {n: F.when(F.col(n).isNull(), F.col(f"__c_{n}")).otherwise(F.col(n) + F.coalesce(f"__c_{n}", F.lit(0))) for n in sums}
    filled = {n: F.coalesce(n, f"__c_{n}") for n in lasts}
    return both.withColumns(added | filled).drop("__cut", "__begin", *inner, *[a for _, a in names], *[f"__c_{n}" for n in [*sums, *lasts]])


def asof_scan(left: DataFrame, right: DataFrame, key: str, left_order: list[str], right_order: list[str], right_cols: list[str], cut_rows: int = CUT_ROWS) -> DataFrame:
    """Each left row with the columns of the last right row of its key whose time is at or before its own; null without one.

    The first column of either order is the time; the others break ties within a side. No key is too large for it.
    """
    value = F.struct(*right_cols)
    kind = right.select(value.alias("v")).schema["v"].dataType
    order = ["__at", "__side", *[f"__o{i}" for i in range(max(len(left_order), len(right_order)) - 1)]]

    def side(number: int, columns: list[str]) -> dict[str, Column]:
        ties = [F.col(c) for c in columns[1:]] + [F.lit(None)] * (len(order) - 1 - len(columns))
        return {"__at": F.col(columns[0]), "__side": F.lit(number)} | dict(zip(order[2:], ties))

    asked = left.withColumns(side(1, left_order) | {"__r": F.lit(None).cast(kind)})
    ticks = right.select(F.col(key), *[c.alias(n) for n, c in side(0, right_order).items()], value.alias("__r"))
    both = asked.unionByName(ticks, allowMissingColumns=True)
    found = prefix_scan(both, [key], order, lasts={"__v": F.col("__r")}, cut_rows=cut_rows).where("__side = 1")
    return found.select(*left.columns, *[F.col("__v")[c].alias(c) for c in right_cols])
