"""A pipeline from raw documents to a token store, each stage applied to all that its predecessor kept.

1. quality: documents that the classifier rejects go.
2. near_dedup: of each group with a similarity of 0.8 or more over five-word shingles, the document of the smallest id stays.
3. decontaminate: documents that hold a benchmark passage go.
4. mix: whole documents in training order, as often as the target weights ask for.
5. tokens: the token store's rows, one per document, in order of doc_id: of the mix only how often each is used takes effect,
   not its training order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.decontaminate import with_leaks
from skein.llm.mixing import curriculum
from skein.llm.near_copies import near_copies_removed
from skein.llm.quality_model import THRESHOLD, train, with_score
from skein.llm.staging import stage, unused
from skein.llm.token_store import token_store

#: SQL can't express the stages' models and hashes; each is tested against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score reaches THRESHOLD, rows and columns as they are.

    A null or empty text is scored like any other, by what the model makes of no words; repeated rows have equal scores. An empty
    table, and labels of no document, leave a model that knows nothing and scores 0.5, so that all rows stay.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs, "score")
    return with_score(docs, model, score).where(F.col(score) >= THRESHOLD).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id, with its columns.

    Texts without words, null ones too, are one group. A null id stays only where its whole group has none; of rows that are
    repeated one stays. Columns of any name pass through; an empty table stays empty.
    """
    return near_copies_removed(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item is found, rows and columns as they are.

    Null and empty texts hold none and stay; repeated rows share their fate. An empty benchmark removes nothing.
    """
    leaks = unused(docs, "leaks")
    found = with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), leaks)
    return found.where(F.size(leaks) == 0).drop(leaks)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, with its columns; none more than three times.

    A null source is one of its own, last in order. Documents of size 0 (null, empty and blank texts) bring nothing and go. Repeated
    rows are documents of their own. An empty table stays empty.
    """
    return curriculum(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, read back from the written store.

    A null or empty text has the end id alone; a null id comes first; rows of equal id follow each other by their ids. Other
    columns aren't looked at; an empty table gives no rows.
    """
    return token_store(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
