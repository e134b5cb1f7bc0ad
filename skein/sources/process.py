"""A program's output as a table: each line is a row."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class ProcessSource(DataSource):
    """``spark.read.format("process").option("commands", <JSON list of argument lists>)``: a task for each command.

    Rows are command (its place), line_no and line. A program that fails, or takes longer than ``timeout_s``, fails its
    task, which Spark repeats; programs must therefore only read.
    """

    @classmethod
    def name(cls) -> str:
        return "process"

    def schema(self) -> str:
        return "command int, line_no bigint, line string"

    def reader(self, schema) -> DataSourceReader:
        return ProcessReader(json.loads(self.options["commands"]), float(self.options.get("timeout_s", "60")))


class ProcessReader(DataSourceReader):
    def __init__(self, commands: list[list[str]], timeout_s: float):
        self.commands, self.timeout_s = commands, timeout_s

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(len(self.commands))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        k = partition.value
        done = subprocess.run(self.commands[k], stdin=subprocess.DEVNULL, capture_output=True, text=True, timeout=self.timeout_s, check=True)
        for n, line in enumerate(done.stdout.splitlines()):
            yield k, n, line


def process_lines(spark: SparkSession, commands: list[list[str]], timeout_s: float = 60) -> DataFrame:
    spark.dataSource.register(ProcessSource)
    return spark.read.format("process").option("commands", json.dumps(commands)).option("timeout_s", str(timeout_s)).load()
