"""Tools: Python functions as Spark functions with a row in a registry; resources and prompts as rows."""

from __future__ import annotations

import inspect
import typing
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SQL = {int: "bigint", float: "double", str: "string", bool: "boolean"}


class Tool:
    """A function with a name, a description (its docstring) and an argument schema from its type hints.

    An argument named ``runtime`` is bound by the engine and not part of the schema.
    """

    def __init__(self, function: Callable, name: str | None = None, description: str | None = None, source: str = "local"):
        self.function = function
        self.name = name or function.__name__
        self.description = description or inspect.getdoc(function) or ""
        self.source = source
        hints = typing.get_type_hints(function)
        self.returns = _SQL.get(hints.pop("return", str), "string")
        self.arguments = {k: _SQL.get(t, "string") for k, t in hints.items() if k != "runtime"}
        self.needs_runtime = "runtime" in inspect.signature(function).parameters

    def invoke(self, arguments: dict, runtime: object = None) -> object:
        return self.function(**arguments, **({"runtime": runtime} if self.needs_runtime else {}))

    def register(self, spark: SparkSession, runtime: object = None) -> None:
        """The tool as an SQL function: rows go to Python in Arrow batches. ``runtime`` is bound here for functions that take one."""
        function = partial(self.function, runtime=runtime) if self.needs_runtime else self.function
        names = list(self.arguments)
        spark.udf.register(self.name, F.udf(lambda *values: function(**dict(zip(names, values))), self.returns, useArrow=True))


def tool(name: str | Callable | None = None, description: str | None = None):
    """Decorator: ``@tool``, ``@tool("name")`` or ``@tool("name", description="...")``."""
    if callable(name):
        return Tool(name)
    return lambda f: Tool(f, name, description)


def registry(spark: SparkSession, tools: list[Tool]) -> DataFrame:
    rows = [(t.source, t.name, t.description, ", ".join(f"{k} {v}" for k, v in t.arguments.items()), t.returns) for t in tools]
    return spark.createDataFrame(rows, "source string, name string, description string, arguments string, returns string")


def merge_registries(registries: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, registries)


def prompt_of(prompts: DataFrame, name: str) -> DataFrame:
    """The first message of a prompt (columns name, messages)."""
    return prompts.where(F.col("name") == name).select(F.get("messages", F.lit(0)).alias("prompt"))


def resources_of(rows: DataFrame, uri: str, body: str, order: str) -> DataFrame:
    """uri, body and error of resources kept as rows: of rows with one uri the first by ``order``; a null body is an error."""
    first = rows.where(F.col(uri).isNotNull()).groupBy(F.col(uri).alias("uri")).agg(F.min_by(F.struct(F.col(body).alias("body")), order).alias("r"))
    return first.select("uri", "r.body", F.when(F.col("r.body").isNull(), "timed out").alias("error"))


def read_resources(resources: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, uri and content of each request (request_id, uri): the resource's body, or a text that begins with ``Error:``."""
    said = F.concat(F.lit("Error: "), F.coalesce("error", F.lit("no such resource")))
    return requests.join(resources, "uri", "left").select("request_id", "uri", F.coalesce("body", said).alias("content"))
