"""A table of the last row of each key, in a folder, merged batch by batch.

Rows lie in buckets by a hash of their key. A merge rewrites the buckets that a batch touches, into a folder of its own, and
then writes a manifest: the next version's list of buckets, and the last batch number of each writer. What no manifest names
isn't part of the table, so a merge that breaks off leaves the table as it was, and a batch that comes again is passed over.
"""

from __future__ import annotations

import json
import threading
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpointed, drop_checkpointed

#: Times that a merge begins again after another writer was faster.
ATTEMPTS = 20
_commits: dict[str, threading.Lock] = {}


class KeyedTable:
    """The table at ``path``: ``key`` names a row, ``order`` says which of a key's rows is the last. ``n_buckets`` holds for a new table."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: list[str], n_buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.n_buckets = spark, path.rstrip("/"), key, order, n_buckets
        self.folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions")
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest whole manifest: version, n_buckets, schema, buckets (number: folder) and batches (writer: number)."""
        empty = {"version": 0, "n_buckets": self.n_buckets, "schema": None, "buckets": {}, "batches": {}}
        if not self.fs.exists(self.folder):
            return empty
        names = sorted((s.getPath() for s in self.fs.listStatus(self.folder)), key=lambda p: p.getName(), reverse=True)
        for name in (n for n in names if n.getName().endswith(".json")):
            stream = self.fs.open(name)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return json.loads(text)
            except ValueError:  # another writer is at it
                continue
        return empty

    def _commit(self, manifest: dict) -> bool:
        """Whether this writer made the version; False if another has."""
        name = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder, f"{manifest['version']:012d}.json")
        with _commits.setdefault(self.path, threading.Lock()):  # a local file system tests and creates in two steps
            try:
                stream = self.fs.create(name, False)
            except Py4JJavaError as e:
                if "AlreadyExists" in str(e.java_exception):
                    return False
                raise
            try:
                stream.write(bytearray(json.dumps(manifest).encode()))
            finally:
                stream.close()
            return True

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame | None:
        folders = [f for b, f in manifest["buckets"].items() if buckets is None or int(b) in buckets]
        if not folders:
            return None
        return self.spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame | None:
        """All rows of the newest version; None before the first merge."""
        return self._rows(self.manifest())

    def merge(self, updates: DataFrame, batch: int, writer: str = "") -> bool:
        """Put in each key's last row by ``order``, of the table and the batch; equal order: the batch's. False if the writer's batch
        (or a later one) is in the table already. Rows with a null key are kept under it. All batches have the same columns."""
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.manifest()["n_buckets"])).alias("__bucket")
        last = lambda rows, *more: rows.groupBy(*[F.col(k).alias(f"__{k}") for k in self.key]).agg(F.max_by(F.struct(*updates.columns, "__bucket"), F.struct(*self.order, *more)).alias("r")).select("r.*")
        latest = checkpointed(last(updates.select("*", bucket)))
        touched = [r["__bucket"] for r in latest.select("__bucket").distinct().collect()]
        try:
            for _ in range(ATTEMPTS):
                now = self.manifest()
                if now["batches"].get(writer, -1) >= batch:
                    return False
                old = self._rows(now, touched)
                rows = latest.withColumn("__new", F.lit(1))
                if old is not None:
                    rows = rows.unionByName(old.select("*", bucket, F.lit(0).alias("__new")))
                folder = f"data/{now['version'] + 1:012d}-{uuid.uuid4().hex}"
                last(rows, "__new").repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
                found = {str(b): f"{folder}/__bucket={b}" for b in touched}
                after = {"version": now["version"] + 1, "n_buckets": now["n_buckets"], "schema": json.loads(updates.schema.json()), "buckets": now["buckets"] | found}
                if self._commit(after | {"batches": now["batches"] | {writer: batch}}):
                    return True
        finally:
            drop_checkpointed(latest)
        raise RuntimeError("other writers were faster each time")


def merge_all(table: KeyedTable, batches: list[tuple[int, DataFrame]]) -> DataFrame:
    """The table after some batches, by number."""
    return reduce(lambda _, b: (table.merge(b[1], b[0]), table.read())[1], batches, None)
