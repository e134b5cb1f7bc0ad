"""Tables by name, and the catalog as rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; times without a zone are read as instants of the session's zone, as watermarks need them."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def open_database(spark: SparkSession, uri: str, names: Iterable[str] = TABLES) -> list[str]:
    """Register the tables of a database as temporary views; returns their names.

    ``parquet:<folder>`` holds one Parquet table for each name. A ``jdbc:`` URI is read through Spark's JDBC source.
    """
    names = list(names)
    for name in names:
        if uri.startswith("jdbc:"):
            df = spark.read.format("jdbc").option("url", uri).option("dbtable", name).load()
        else:
            df = table(spark, uri.removeprefix("parquet:"), name)
        df.createOrReplaceTempView(name)
    return names


def table_info(spark: SparkSession, names: Iterable[str]) -> DataFrame:
    """One row per column of each view: table_name, ordinal, column_name, data_type."""
    rows = [(n, i, c, t) for n in names for i, (c, t) in enumerate(spark.table(n).dtypes, 1)]
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, data_type string")


def register_master(spark: SparkSession, view: str = "sqlite_master") -> DataFrame:
    """The catalog under the name by which SQLite's users look for it: name, type."""
    rows = [(t.name, "view" if t.tableType == "VIEW" else "table") for t in spark.catalog.listTables() if t.name != view]
    df = spark.createDataFrame([(n, "table") for n, _ in rows], "name string, type string")
    df.createOrReplaceTempView(view)
    return df


def binary_pages(spark: SparkSession, path: str, split) -> DataFrame:
    """One row per page of each file under ``path``: source, page, text. ``split`` maps a file's bytes to its pages' texts."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def pages(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, k, t) for p, c in zip(pdf["path"], pdf["content"]) for k, t in enumerate(split(bytes(c)))]
            yield pd.DataFrame(rows, columns=["source", "page", "text"])

    return files.mapInPandas(pages, "source string, page long, text string")
