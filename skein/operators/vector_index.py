"""Nearest vectors by inverted lists, short codes and exact re-ranking.

Each vector goes to the list of its nearest centroid. A store holds, partitioned by list, tiles of one-byte codes and the
vectors themselves. A search reads the tiles of probed lists alone. A code's score is known to be off by no more than its
rounding error, so every vector that can be among the k best of the probed lists is re-ranked exactly: the only loss is that
of lists that aren't probed, and none if all are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .retrieval import cosine

#: Vectors from which centroids are trained, about, and lists of a store, at most.
MAX_TRAIN = 100_000
MOST_LISTS = 4096
#: Vectors of a tile and queries of a block, about; rows of a file of a list.
TILE, BLOCK, FILE_ROWS = 512, 256, 1_000_000
#: Similarities are compared at six decimals, so so much more may lie between them.
SLACK = 2e-6


def _matrix(vectors: pa.Array) -> np.ndarray:
    """The vectors of a list array as rows of length one."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _searchable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector of the rows that a cosine is defined for: neither null nor of length zero."""
    part = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return part.where("id is not null and exists(vector, x -> x <> 0) and forall(vector, x -> x is not null)")


def _nearest_lists(centroids: np.ndarray, n: int) -> Column:
    def found(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.list_(pa.int32()))
        scores = _matrix(vectors) @ centroids.T
        order = np.argsort(-scores, axis=1, kind="stable")[:, :n]
        return pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))

    return F.arrow_udf(found, "array<int>")("vector")


def _codes(vectors: pa.Array) -> pa.Array:
    if not len(vectors):
        return pa.array([], pa.struct([("code", pa.binary()), ("scale", pa.float64()), ("error", pa.float64())]))
    rows = _matrix(vectors)
    scale = np.abs(rows).max(axis=1) / 127
    codes = np.rint(rows / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(rows - codes * scale[:, None], axis=1) + 1e-9
    return pa.StructArray.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(error)], ["code", "scale", "error"])


def _spread(rows: DataFrame, group: str, id_col: str, size: int, name: str) -> DataFrame:
    """``rows`` with a number, by which each group falls into parts of about ``size`` rows; groups are lists, so few."""
    counts = rows.groupBy(group).agg(F.ceil(F.count("*") / size).alias("__parts"))
    return rows.join(F.broadcast(counts), group).withColumn(name, F.pmod(F.xxhash64(id_col), F.col("__parts"))).drop("__parts")


def build_index(vectors: DataFrame, path: str, n_lists: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
    """Write the store of all ``vectors`` to ``path``: centroids, tiles and vectors.

    Centroids are trained on about MAX_TRAIN vectors, chosen by a hash of their ids; all vectors are indexed. ``n_lists``: the square
    root of their number unless given. Vectors that are null, of length zero, or without id are left out. A large list is
    written in several files.
    """
    rows = _searchable(vectors, id_col, vector_col)
    n = rows.count()
    n_lists = min(MOST_LISTS, n_lists or max(1, math.isqrt(n)), max(1, n))
    sample = rows.where(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1_000_000)) < math.ceil(1e6 * min(1, MAX_TRAIN / max(1, n))))
    centroids = np.zeros((1, 1))
    if n_lists > 1:
        model = KMeans(k=n_lists, seed=42, maxIter=10, distanceMeasure="cosine", featuresCol="point").fit(sample.select(array_to_vector("vector").alias("point")))
        centroids = np.array(model.clusterCenters())
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-300)
    spark = vectors.sparkSession
    spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centroids)], "list int, centroid array<double>").write.parquet(f"{path}/centroids")
    own = F.get(_nearest_lists(centroids, 1), F.lit(0)) if n_lists > 1 else F.lit(0)
    coded = F.arrow_udf(_codes, "struct<code:binary,scale:double,error:double>")
    placed = _spread(rows.withColumn("list", own), "list", "id", FILE_ROWS, "file")
    placed.repartition("list", "file").drop("file").write.partitionBy("list").parquet(f"{path}/vectors")
    written = spark.read.schema("id long, vector array<double>, list int").parquet(f"{path}/vectors")
    tiles = _spread(written.withColumn("c", coded("vector")), "list", "id", TILE, "tile")
    member = F.struct("id", "c.code", "c.scale", "c.error")
    tiles.groupBy("list", "tile").agg(F.collect_list(member).alias("members")).write.partitionBy("list").parquet(f"{path}/tiles")


def _bounds(k: int):
    """Rows of a list with queries and members to the pairs that can be among the k best of the tile, and their bounds."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                asked, members = (batch.column(c)[at].values for c in ("asked", "members"))
                q_ids, ids = asked.field("query_id").to_numpy(), members.field("id").to_numpy()
                q = _matrix(asked.field("vector"))
                codes = np.frombuffer(b"".join(members.field("code").to_pylist()), np.int8).reshape(len(ids), -1)
                scores = (q @ codes.T.astype(np.float64)) * members.field("scale").to_numpy()
                error = members.field("error").to_numpy()
                low = np.where(q_ids[:, None] == ids, -np.inf, scores - error)
                least = np.partition(low, len(ids) - k, axis=1)[:, [len(ids) - k]] if k < len(ids) else np.full((len(q_ids), 1), -np.inf)
                row, col = ((scores + error + SLACK >= least) & np.isfinite(low)).nonzero()
                where = batch.column("list")[at].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[row]), pa.array(ids[col]), pa.array(np.full(len(row), where, np.int32)), pa.array(low[row, col]), pa.array((scores + error)[row, col])],
                    ["query_id", "id", "list", "low", "high"],
                )

    return pairs


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 4, probes: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, id, similarity and rank of the k nearest other vectors of each query in its ``probes`` nearest lists.

    Blocks of queries are joined to tiles by list, so neither side passes through the driver; the numbers of the probed lists do,
    of which there are MOST_LISTS at most, so that only their partitions are read. Ties go by id. Queries that are null or of
    length zero find nothing.
    """
    centroids = np.array([r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()])
    asked = _searchable(queries, id_col, vector_col).withColumnRenamed("id", "query_id")
    lists = _nearest_lists(centroids, probes) if len(centroids) > 1 else F.array(F.lit(0))
    probed = checkpointed(asked.withColumn("list", F.explode(lists)))
    read = [r["list"] for r in probed.select("list").distinct().collect()]
    blocks = _spread(probed, "list", "query_id", BLOCK, "block").groupBy("list", "block").agg(F.collect_list(F.struct("query_id", "vector")).alias("asked"))
    stored = spark.read.parquet(f"{path}/tiles").where(F.col("list").isin(read))
    bounds = stored.select("list", "members").join(blocks, "list").mapInArrow(_bounds(k), "query_id long, id long, list int, low double, high double")
    best = checkpointed(bounds)
    ranked = best.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))).where(F.col("n") <= k)
    least = ranked.groupBy("query_id").agg(F.min("low").alias("least"), F.count("*").alias("found"))
    near = best.join(least, "query_id").where((F.col("high") + SLACK >= F.col("least")) | (F.col("found") < k)).select("query_id", "id", "list")
    vectors = spark.read.schema("id long, vector array<double>, list int").parquet(f"{path}/vectors").where(F.col("list").isin(read))
    exact = near.join(vectors, ["list", "id"]).join(asked.withColumnRenamed("vector", "q"), "query_id").select("query_id", "id", F.round(cosine(F.col("vector"), F.col("q")), 6).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")).cast("long")
    return exact.withColumn("rank", rank).where(F.col("rank") <= k)
