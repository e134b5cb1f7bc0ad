"""Calls of remote sources: budgets, retries, uploads, thread lists."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the one remote error code that is worth another try.
RETRY_CODE = -32603
ATTEMPTS = 3
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Types that may be uploaded.
MIME_TYPES = ["image/jpeg", "image/png", "image/gif", "image/webp", "application/pdf"]


class RemoteError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Outcome:
    value: object
    attempts: int
    status: str  # ok, refused or exhausted


def call_with_retries(call: Callable[[], object], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> Outcome:
    """Call until it works. A remote error with another code than RETRY_CODE ends at once; between tries the wait doubles from 1 s."""
    for n in range(1, attempts + 1):
        try:
            return Outcome(call(), n, "ok")
        except RemoteError as e:
            if e.code != RETRY_CODE:
                return Outcome(str(e), n, "refused")
            last = e
        except Exception as e:  # noqa: BLE001  any other failure is worth another try
            last = e
        if n < attempts:
            sleep(2.0 ** (n - 1))
    return Outcome(str(last), attempts, "exhausted")


def retry_outcomes(log: DataFrame, key: str, order: str, failed: Column, attempts: int = ATTEMPTS) -> DataFrame:
    """A log of attempts folded to one row per key: attempts used (up to the first success) and status."""
    tries = log.select(F.col(key).alias("call_id"), F.col(order).alias("at"), failed.alias("failed"))
    ranked = tries.withColumn("n", F.row_number().over(Window.partitionBy("call_id").orderBy("at"))).where(F.col("n") <= attempts)
    first = F.min(F.when(~F.col("failed"), F.col("n")))
    return ranked.groupBy("call_id").agg(
        F.coalesce(first, F.max("n")).cast("long").alias("attempts"),
        F.when(first.isNotNull(), "ok").when(F.max("n") >= attempts, "exhausted").otherwise("open").alias("status"),
    )


def with_budget(calls: DataFrame, thread: str, order: list[str], most: int) -> DataFrame:
    """Number each thread's calls and say which the budget allows: n_call, allowed, note."""
    n = F.row_number().over(Window.partitionBy(thread).orderBy(*order))
    return (
        calls.withColumn("n_call", n.cast("long"))
        .withColumn("allowed", F.col("n_call") <= most)
        .withColumn("note", F.when(F.col("allowed"), F.lit(None).cast("string")).otherwise(F.lit("search budget is used up")))
    )


def keyword_search(pages: DataFrame, text: str, words: list[str], k: int = 5) -> DataFrame:
    """The offline stand-in of a web search: the k pages with most of the words; ties by page_id."""
    hits = sum((F.contains(F.lower(F.col(text)), F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    return pages.withColumn("hits", hits).where("hits > 0").orderBy(F.desc("hits"), "page_id").limit(k)


def threads_of(threads: DataFrame, assistant: str, limit: int = 100) -> DataFrame:
    """Threads of an assistant: by assistant_id if the name is a UUID, else by graph_id; newest first."""
    import re

    key = "assistant_id" if re.match(UUID, assistant) else "graph_id"
    return threads.where(F.col(key) == assistant).orderBy(F.desc("updated_at"), "thread_id").limit(limit)


def new_uploads(batch: DataFrame, stored: DataFrame, within_batch: bool = False) -> DataFrame:
    """Uploads of allowed types that aren't stored: a PDF is known by its name, an image by name and type.

    Duplicates inside one batch pass, unless ``within_batch``. Columns: filename, mime_type.
    """
    key = F.concat_ws("|", F.when(F.col("mime_type") != "application/pdf", F.col("mime_type")).otherwise("pdf"), "filename")
    fresh = batch.where(F.col("mime_type").isin(MIME_TYPES)).withColumn("upload_key", key)
    known = stored.select(key.alias("upload_key")).distinct()
    left = fresh.join(known, "upload_key", "left_anti")
    return (left.dropDuplicates(["upload_key"]) if within_batch else left).drop("upload_key")
