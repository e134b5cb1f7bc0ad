"""Connected components of links too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import drop_staged, stage


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links``: columns a, b (long). Returns node, component (the smallest node reachable) for every linked node.

    Alternating large-star and small-star steps: each node hands the smallest neighbour to its larger, then to its smaller
    neighbours, until nothing changes; rounds grow with the logarithm of the longest chain. Nulls and loops are no links,
    repeated links count once, and no links give no rows. A node with very many links is a large group only as the input
    of a minimum, which is taken before the shuffle, and of a join. Minima are written before they are joined, so that both
    sides of the join are shuffled for it alone and Spark splits its large partitions.
    """
    edges = stage(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    before = None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = stage(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large"
        )
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        after = stage(small, "links")
        for done in (edges, least, large, low):
            drop_staged(done)
        edges = after
    else:
        raise RuntimeError("components didn't settle; raise max_rounds")
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component").distinct())
