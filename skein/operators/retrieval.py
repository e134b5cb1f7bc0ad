"""Chunks, embeddings and nearest vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK, OVERLAP = 1000, 200
SEPARATORS = ["\n\n", "\n", ". ", " "]
#: Queries of a block and vectors of a tile, about, and tiles of a shard.
QUERY_BLOCK, TILE, SHARD = 256, 512, 64


def chunks_fixed(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_no, start_index, chunk: pieces of ``size`` characters, each beginning ``overlap`` before the last one's end."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - overlap - 1, F.lit(0)), F.lit(step))
    return docs.select("doc_id", "text", F.posexplode(starts).alias("chunk_no", "at")).select(
        "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("at").cast("long").alias("start_index"), F.substring("text", F.col("at") + 1, F.lit(size)).alias("chunk")
    )


def _bound(x: Column, f) -> Column:
    """f(x), of which x is computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _next_chunk(text: Column, n: Column, at: Column, size: int, overlap: int) -> Column:
    """Of the chunk that begins at ``at``: where it ends and where the next begins (-1: it is the last)."""
    most = F.least(n, at + size)
    reach = F.substring(text, at + overlap + 2, F.greatest(most - at - overlap - 1, F.lit(0)))

    def end(back: Column) -> Column:
        found = F.when(most >= n, n)
        for sep in SEPARATORS:
            place = F.locate(sep[::-1], back)
            found = found.when(place > 0, most - place + 1)
        return found.otherwise(most)

    def after(e: Column) -> Column:
        least = F.greatest(at + 1, e - overlap)
        begin = lambda blank: F.when((blank > 0) & (least + blank < e), least + blank).otherwise(least)
        nearest = _bound(F.locate(" ", F.substring(text, least + 1, e - least)), begin)
        return F.struct(e.alias("end"), F.when(e >= n, -1).otherwise(nearest).alias("next"))

    return _bound(_bound(F.reverse(reach), end), after)


def chunks_recursive(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """As ``chunks_fixed``, but cut at natural borders: a chunk ends at the coarsest separator within reach (paragraph, line,
    sentence, word), else anywhere, and the next begins at a word of the overlap. Null and empty texts give no chunks.

    A text's chunks follow from one another, so they are folded over one text; no more steps are taken than chunks can be.
    """
    n = F.coalesce(F.char_length("text"), F.lit(0))
    least = max(1, min(2, size - overlap))

    def step(held: Column, _: Column) -> Column:
        row = lambda c: F.struct(c["next"].alias("at"), F.concat(held["spans"], F.array(F.struct(held["at"].alias("at"), c["end"].alias("end")))).alias("spans"))
        return F.when(held["at"] < 0, held).otherwise(_bound(_next_chunk(F.col("text"), n, held["at"], size, overlap), row))

    begin = F.struct(F.when(n == 0, -1).otherwise(0).alias("at"), F.array().cast("array<struct<at:int,end:int>>").alias("spans"))
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.ceil(n / least), F.lit(1)).cast("int")), begin, step)
    spans = docs.select("doc_id", "text", F.posexplode(folded["spans"]).alias("chunk_no", "span"))
    start, length = F.col("span.at"), F.col("span.end") - F.col("span.at")
    return spans.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), start.cast("long").alias("start_index"), F.substring("text", start + 1, length).alias("chunk"))


def with_ids(chunks: DataFrame) -> DataFrame:
    """A chunk's id from where it came from, the same at every run."""
    return chunks.withColumn("chunk_id", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("start_index").cast("string")), 256))


def embed_stub(text: Column, dims: int = 64) -> Column:
    """Stands in for an embedding model: counts of a text's words by the first bits of their MD5, normalised. ``dims``: 256 at most."""
    words = F.filter(F.split(F.lower(text), "\\s+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 2), 16, 10).cast("int") % dims)
    numbers = F.sequence(F.lit(0), F.lit(dims - 1))
    counts = F.get(F.transform(F.array(slots), lambda all: F.transform(numbers, lambda k: F.size(F.filter(all, lambda s: s == k)).cast("double"))), F.lit(0))
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  so that x is computed once
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    divided = lambda c: bound(norm(c), lambda n: F.transform(c, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)).cast("float")))
    return bound(counts, divided)


def store_chunks(chunks: DataFrame, path: str, dims: int = 64) -> None:
    """Embed chunks (chunk_id, chunk, other columns) and append them to the vector store at ``path``, a Parquet table."""
    chunks.withColumn("embedding", embed_stub(F.col("chunk"), dims)).write.mode("append").parquet(path)


def search_store(spark: SparkSession, path: str, text: str, k: int = 4) -> DataFrame:
    """The k chunks of a store nearest to a text: chunk_id, similarity."""
    store = spark.read.parquet(path)
    vector = spark.range(1).select(embed_stub(F.lit(text)).alias("v")).first()["v"]
    return nearest(store, list(vector), k, "chunk_id")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector of length zero."""
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def nearest(vectors: DataFrame, query: list[float], k: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k vectors nearest to one query by cosine; ties by id. Each task keeps k rows, and k are merged."""
    q = F.array(*[F.lit(float(x)) for x in query])
    sim = F.round(cosine(F.col(vector_col), q), 6)
    return vectors.select(F.col(id_col), sim.alias("similarity")).orderBy(F.desc_nulls_last("similarity"), id_col).limit(k)


def _blocks(rows: DataFrame, size: int, n_rows: int, name: str) -> DataFrame:
    """``rows`` (id, vector) in blocks of about ``size``, chosen by a hash of the id: the block's number and its members."""
    number = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n_rows // size)))).cast("int").alias(name)
    return rows.groupBy(number).agg(F.collect_list(F.struct("id", "vector")).alias(f"{name}s"))


def _members(column: pa.Array, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, brought to length one, of a block."""
    members = column[at].values
    flat = members.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(members), -1)
    return members.field("id").to_numpy(), flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-300)


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For every query the k nearest other vectors: query_id, id, similarity, rank; ties by id. Null vectors and ids are left out.

    Both sides are put together in blocks by a hash of the id, the vectors' blocks in shards; a block of queries is joined to
    each shard, and a task keeps k candidates of each of its queries while it goes through the shard. So k rows of each query
    and shard are shuffled, and nothing goes through the driver.
    """
    part = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    rows, asked = part(vectors), part(queries)
    n_rows, n_asked = rows.count(), asked.count()
    n_shards = max(1, -(-n_rows // (TILE * SHARD)))
    tiles = _blocks(rows, TILE, n_rows, "tile").withColumn("shard", F.col("tile") % n_shards)
    blocks = _blocks(asked, QUERY_BLOCK, n_asked, "query").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, q_ids, q = None, np.empty(0, np.int64), np.empty((0, 0))
        none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        found = none  # the query's place in the block, id and similarity

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(q_ids[found[0]]), pa.array(found[1]), pa.array(found[2])], ["query_id", "id", "similarity"])

        for batch in batches:
            for at in range(len(batch)):
                key = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                if key != held:
                    if held is not None:
                        yield out()
                    held, found = key, none
                    q_ids, q = _members(batch.column(2), at)
                own, tile = _members(batch.column(3), at)
                sims = np.round(q @ tile.T, 6)
                sims[q_ids[:, None] == own] = -np.inf
                least = np.partition(sims, len(own) - k, axis=1)[:, [len(own) - k]] if k < len(own) else -np.inf
                row, col = ((sims >= least) & np.isfinite(sims)).nonzero()  # the k best of the tile and their ties
                merged = [np.concatenate(x) for x in zip(found, (row, own[col], sims[row, col]))]
                order = np.lexsort((merged[1], -merged[2], merged[0]))
                row = merged[0][order]
                order = order[np.arange(len(row)) - np.searchsorted(row, row, "left") < k]
                found = tuple(x[order] for x in merged)
        if held is not None:
            yield out()

    joined = blocks.join(tiles, "shard").select("shard", "query", "querys", "tiles").sortWithinPartitions("shard", "query")
    pairs = joined.mapInArrow(best, "query_id long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")).cast("long")
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def best_passage(ranked: DataFrame, chunks: DataFrame, id_col: str) -> DataFrame:
    """The text of rank 1; no row where nothing was found."""
    return ranked.orderBy(F.desc_nulls_last("similarity"), id_col).limit(1).join(chunks, id_col, "left")


def joined_passages(passages: DataFrame, text: str = "chunk", order: str = "rank") -> DataFrame:
    """All passages of a result in order, joined by line feeds."""
    return passages.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n").alias("passages"))
