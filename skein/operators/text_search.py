"""Ranked text search over an inverted index with BM25.

Postings are kept by term and range of document ids, each with the largest share that a document of the range can take from the
term. A search first scores the ranges with the highest sums of such shares; of the others only those are read whose sum
reaches the k-th score found, so the result is that of scoring everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed, drop_checkpointed

K1, B = 1.2, 0.75
#: Document ids of a range, and ranges of a query that are scored first, for each wanted row.
RANGE, FIRST = 64, 2
#: Postings of a task that groups them, about, at most: they are held in memory.
TASK = 2_000_000


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; none of a null text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _entries(words_of: DataFrame) -> DataFrame:
    """doc_id, size, entries (term and tf) and n, their number, of rows doc_id and words, which are counted where they are; none without words."""
    w, size, starts = F.col("w"), F.col("size"), F.col("starts")
    ordered = words_of.select("doc_id", F.sort_array("words").alias("w")).select("doc_id", "w", F.size("w").alias("size")).where("size > 0")
    begins = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
    runs = ordered.select("doc_id", "size", "w", begins.alias("starts"))
    entries = F.transform(starts, lambda s, j: F.struct(F.get(w, s).alias("term"), (F.coalesce(F.get(starts, j + 1), size) - s).alias("tf")))
    return runs.select("doc_id", "size", F.size("starts").alias("n"), entries.alias("entries"))


def build_text_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", id_range: int = RANGE) -> None:
    """Write the index of all ``docs`` to ``path``: postings with their bounds, and terms.

    Rows of equal id are one document; rows with a null id are left out. Postings of a term are split by range, so that a
    frequent term is many rows. Both tables are sorted by term, so that a reader skips what a query doesn't ask for; bounds are
    read without the postings, as tables are kept by column. A text's terms are counted where it is read, so that postings are
    shuffled once; only texts of repeated ids are counted by a shuffle more.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("words"))
    again = checkpointed(texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    one_row = checkpointed(_entries(texts.join(again, "doc_id", "left_anti")))
    tokens = texts.join(again, "doc_id", "left_semi").select("doc_id", F.explode("words").alias("term"))
    rest = checkpointed(tokens.groupBy("doc_id", "term").agg(F.count("*").cast("int").alias("tf")))
    rest_sizes = rest.groupBy("doc_id").agg(F.sum("tf").cast("int").alias("size"), F.count("*").alias("n"))
    sizes = one_row.select("size", "n").unionByName(rest_sizes.select("size", "n"))
    corpus = sizes.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("size"), F.lit(1.0)).alias("mean_size"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    rows = one_row.select("doc_id", "size", F.inline("entries")).unionByName(rest.join(rest_sizes.drop("n"), "doc_id"))
    rows = rows.select("term", F.floor(F.col("doc_id") / id_range).alias("range"), "doc_id", "tf", "size")
    tasks = corpus["n"] // TASK
    enough = tasks <= int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange("term", "range") if enough else rows.repartitionByRange(tasks, "term", "range")
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(corpus["mean_size"])))
    by_range = dealt.groupBy("term", "range").agg(F.max(share).alias("most"), F.collect_list(F.struct("doc_id", share.alias("share"))).alias("postings"))
    by_range.withColumn("n", F.size("postings")).sortWithinPartitions("term", "range").write.parquet(f"{path}/postings")
    drop_checkpointed(one_row)
    drop_checkpointed(rest)
    terms = docs.sparkSession.read.parquet(f"{path}/postings").groupBy("term").agg(F.sum("n").alias("n_docs"))
    idf = F.log(1 + (corpus["n_docs"] - F.col("n_docs") + 0.5) / (F.col("n_docs") + 0.5))
    terms.select("term", idf.alias("idf")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")


def _scored(asked: DataFrame, ranges: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, doc_id and score of the documents of some ranges of each query."""
    wanted = checkpointed(asked.join(ranges.select("query_id", "range"), "query_id"))
    rows = wanted.join(postings, ["term", "range"])
    found = rows.select("query_id", F.explode("postings").alias("p"), "idf").select("query_id", "p.doc_id", (F.col("idf") * F.col("p.share")).alias("part"))
    return found.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))


def search_parts(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, id_col: str = "query_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """What ``search_text`` gives, and query_id, range, most, part (1: scored first, 2: scored later, 0: skipped) of all ranges."""
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.explode(F.array_distinct(words(F.col(text_col)))).alias("term"))
    asked = checkpointed(asked.distinct().join(spark.read.parquet(f"{path}/terms"), "term"))
    # tables are written before they are joined, so that their size is known and a small one goes to all tasks without a shuffle of postings
    index = spark.read.parquet(f"{path}/postings").join(checkpointed(asked.select("term").distinct()), "term", "left_semi")
    bounds = asked.join(index.select("term", "range", "most"), "term").groupBy("query_id", "range").agg(F.sum(F.col("idf") * F.col("most")).alias("most"))
    order = Window.partitionBy("query_id").orderBy(F.desc("most"), "range")
    ranges = checkpointed(bounds.withColumn("n", F.row_number().over(order)))
    postings = index.select("term", "range", "postings")
    first = checkpointed(_scored(asked, ranges.where(F.col("n") <= FIRST * k), postings))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    kth = first.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("query_id", F.col("score").alias("least"))
    later = F.coalesce(F.col("most") + 1e-6 >= F.col("least"), F.lit(True))
    parted = ranges.join(kth, "query_id", "left").select("query_id", "range", "most", F.when(F.col("n") <= FIRST * k, 1).when(later, 2).otherwise(0).alias("part"))
    rest = _scored(asked, parted.where("part = 2"), postings)
    rank = F.row_number().over(best).cast("long")
    return first.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k), parted


def search_text(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """query_id, doc_id, score (six decimals) and rank of the k best documents that hold a term of the query; ties by doc_id.

    A term counts once in a query; terms that no document has count nothing, and a query without others finds nothing.
    """
    return search_parts(spark, path, queries, k, id_col, text_col)[0]
