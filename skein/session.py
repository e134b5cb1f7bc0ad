"""The session's fixed settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .sources.shared import drop_table, new_table_path

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, name: str = "skein", **settings: str) -> SparkSession:
    """A session with SETTINGS and ``settings`` (dots written as double underscores); the cluster's master if none is named."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, so that it is computed once and its lineage is cut."""
    path = new_table_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_checkpointed(df: DataFrame) -> None:
    """Delete a table that ``checkpointed`` wrote and no later plan reads."""
    drop_table(df)
