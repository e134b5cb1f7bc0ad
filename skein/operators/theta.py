"""Joins on inequalities alone.

Either side is cut into parts of equal numbers of rows by its first column. A pair of parts is a region of the sorted cross
product; the least and greatest values of the parts' columns tell which regions can hold a match. Rows go to the regions of
their part, and a join on the region compares them there, so each pair of rows meets once and no region is larger than others.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Pairs of rows of a region, about, and parts of a side, at most.
REGION_PAIRS = 4_000_000
MOST_PARTS = 500

_HOLDS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def cut_side(side: DataFrame, column: str, parts: int, seed: str) -> DataFrame:
    """``side`` with ``__part``: equal numbers of rows by the column's order, equal values spread over all parts that they reach.

    Rows with a null there match nothing and go. The result is written, as the spread isn't a function of a row's values.
    """
    known = side.where(F.col(column).isNotNull())
    cuts = known.agg(F.percentile_approx(column, [k / parts for k in range(1, parts)] or [0.5], 10 * MOST_PARTS)).first()[0] or []
    cuts = cuts[: parts - 1]
    first = F.size(F.filter(F.lit(cuts), lambda c: c < F.col(column))) if cuts else F.lit(0)
    several = sorted(v for v, n in Counter(cuts).items() if n > 1)
    place = first
    if several:
        counted = known.groupBy(first.alias("place"), F.when(F.col(column).isin(several), F.col(column)).alias("value")).count().collect()
        filled = Counter({r["place"]: r["count"] for r in counted if r["value"] is None})
        size = sum(r["count"] for r in counted) / parts
        borders = []
        for r in sorted((r for r in counted if r["value"] is not None), key=lambda r: r["value"]):
            # a value's parts are those between the cuts before it and the cuts up to it; each is filled up, the last takes the rest
            own, rest, shares = range(bisect_left(cuts, r["value"]), bisect_right(cuts, r["value"]) + 1), r["count"], []
            for k in own:
                share = rest if k == own[-1] else min(rest, max(0.0, size - filled[k]))
                filled[k] += share
                rest -= share
                shares.append(1 - rest / r["count"])
            borders += [F.lit(r["value"]), F.lit(shares[:-1])]
        drawn = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(1 << 30)) / (1 << 30)
        place = first + F.size(F.filter(F.coalesce(F.try_element_at(F.create_map(*borders), F.col(column)), F.array()), lambda x: x <= F.col("__drawn")))
        known = known.withColumn("__drawn", drawn)
    return checkpointed(known.withColumn("__part", place.cast("int")).drop("__drawn"))


def _extent(side: DataFrame, columns: list[str]) -> dict[int, list[tuple]]:
    """Of each part (least, greatest) of each column."""
    edges = [f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max))]
    return {r["__part"]: [(r[f"a{i}"], r[f"b{i}"]) for i in range(len(columns))] for r in side.groupBy("__part").agg(*edges).collect()}


def _possible(conditions: list[tuple[str, str, str]], left: list[tuple], right: list[tuple]) -> bool:
    for (_, op, _), (a, b), (c, d) in zip(conditions, left, right):
        if a is None or c is None:
            return False
        x, y = (a, d) if op.startswith("<") else (b, c)
        if x == x and y == y and not _HOLDS[op](x, y):  # a part that holds NaN is left to the join's own condition
            return False
    return True


def regions(left: DataFrame, right: DataFrame, conditions: list[tuple[str, str, str]], region_pairs: int = REGION_PAIRS) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``__region``, a row for each region that it goes to; only regions that can hold a match."""
    n, m = left.count(), right.count()
    width = math.isqrt(region_pairs)
    parts = [max(1, min(MOST_PARTS, -(-rows // width))) for rows in (n, m)]
    sides = [cut_side(left, conditions[0][0], parts[0], "left"), cut_side(right, conditions[0][2], parts[1], "right")]
    extents = [_extent(sides[0], [c[0] for c in conditions]), _extent(sides[1], [c[2] for c in conditions])]
    held = [(i, j) for i, x in extents[0].items() for j, y in extents[1].items() if _possible(conditions, x, y)]
    out = []
    for k, side in enumerate(sides):
        lists: dict[int, list[int]] = {}
        for pair in held:
            lists.setdefault(pair[k], []).append(pair[0] * MOST_PARTS + pair[1])
        of_part = left.sparkSession.createDataFrame(list(lists.items()), "__own int, __regions array<int>")  # MOST_PARTS rows at most
        joined = side.join(F.broadcast(of_part), F.col("__part") == F.col("__own"))
        out.append(joined.withColumn("__region", F.explode("__regions")).drop("__part", "__own", "__regions"))
    return out[0], out[1]


def theta_join(left: DataFrame, right: DataFrame, conditions: list[tuple[str, str, str]], region_pairs: int = REGION_PAIRS) -> DataFrame:
    """Pairs of rows for which all conditions (left column, one of < <= > >=, right column) hold.

    The sides must not share column names. Nulls match nothing. Repeated rows give repeated pairs. Regions are sized from
    quantiles of the first condition's columns; the other conditions rule out regions too, so a band costs what it covers.
    """
    a, b = regions(left, right, conditions, region_pairs)
    holds = [_HOLDS[op](F.col(x), F.col(y)) for x, op, y in conditions]
    joined = a.join(b.withColumnRenamed("__region", "__other"), F.col("__region") == F.col("__other"))
    for h in holds:
        joined = joined.where(h)
    return joined.drop("__region", "__other")
