"""SQL text in, rows or an error out.

A query is parsed first and refused unless its plan is made of reading nodes that are known by name, reads allowed tables as a
whole, and calls only built-in functions of allowed groups. Names follow Spark's rules: case is ignored, and a name that the query
itself defines hides a table only where Spark would see it so. The analysed plan is checked once more: it reads views of allowed
tables and holds no code of users. It then runs with a row cap and, if asked, a time limit.
Errors of planning and of running come back as values.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .lineage import lineage

#: Groups of built-in functions that compute from their arguments alone.
FUNCTION_GROUPS = {
    f"{g}_funcs"
    for g in "agg array bitwise collection conditional conversion csv datetime generator hash json lambda map math predicate string struct url window xml".split()
}
#: Further built-in functions that are allowed.
FUNCTIONS = {"assert_true", "equal_null", "raise_error", "typeof", "uuid"}
#: Plan nodes that a reading query is made of; any other is refused.
READING = set(
    "UnresolvedWith UnresolvedRelation Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Join LateralJoin SubqueryAlias "
    "UnresolvedSubqueryColumnAliases Distinct Union Intersect Except OneRowRelation UnresolvedInlineTable LocalRelation "
    "WithWindowDefinition UnresolvedHaving Pivot Unpivot UnpivotTransformer Generate Sample UnresolvedHint NameParameterizedQuery "
    "PosParameterizedQuery UnresolvedTableOrAlias AsOfJoin RepartitionByExpression Repartition".split()
)


class Refused(Exception):
    """A query that the guard doesn't let run."""


@dataclass
class Result:
    ok: bool
    rows: list[Row] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    error: str | None = None
    #: whether the query has more rows than the cap let through
    truncated: bool = False

    def __str__(self) -> str:
        return str([tuple(r) for r in self.rows]) if self.ok else self.error or ""


def _items(sequence) -> list:
    found = []
    it = sequence.iterator()
    while it.hasNext():
        found.append(it.next())
    return found


@dataclass
class Names:
    """What a parsed query names: relations that it doesn't define itself, functions, and kinds of plan nodes."""

    relations: set[tuple[str, ...]] = field(default_factory=set)
    functions: set[str] = field(default_factory=set)
    kinds: set[str] = field(default_factory=set)


class _Walk:
    """A walk through everything that plan nodes hold, expressions, maps, tuples, options and sequences included."""

    _kinds: dict[str, tuple[str, frozenset[str]]] = {}

    def __init__(self, spark: SparkSession):
        load = spark._jvm.java.lang.Class.forName
        self.types = {
            "plan": load("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"),
            "tree": load("org.apache.spark.sql.catalyst.trees.TreeNode"),
            "items": load("scala.collection.IterableOnce"),
            "product": load("scala.Product"),
            "type": load("org.apache.spark.sql.types.DataType"),
        }
        self.names = Names()

    def kind(self, x) -> tuple[str, frozenset[str]]:
        """A JVM object's class and which of ``types`` it is; asked of the JVM once a class."""
        cls = x.getClass()
        name = cls.getName()
        if name not in self._kinds:
            self._kinds[name] = cls.getSimpleName().rstrip("$"), frozenset(k for k, c in self.types.items() if c.isInstance(x))
        return self._kinds[name]

    def held(self, x, of: frozenset[str]) -> list:
        """What an object holds that may be or hold a node."""
        if "type" in of:
            return []
        if "tree" in of or "items" not in of and "product" in of:
            return [y for y in _items(x.productIterator()) if hasattr(y, "getClass")]
        return [y for y in _items(x) if hasattr(y, "getClass")] if "items" in of else []

    def visit(self, root, scope: frozenset[str]) -> None:
        stack = [(root, scope)]
        while stack:
            x, scope = stack.pop()
            kind, of = self.kind(x)
            if "plan" in of or "UnresolvedIdentifier" in kind:  # the latter is a name that is computed
                self.names.kinds.add(kind)
            if kind == "UnresolvedRelation":
                parts = tuple(str(p) for p in _items(x.multipartIdentifier()))
                if len(parts) > 1 or parts[0].lower() not in scope:
                    self.names.relations.add(parts)
            elif kind == "UnresolvedFunction":
                self.names.functions.add(x.nameParts().mkString(".").lower())
            elif kind == "UnresolvedGenerator":
                self.names.functions.add(x.name().unquotedString().lower())
            elif kind == "UnresolvedTableValuedFunction":
                self.names.functions.add("table function " + x.name().mkString(".").lower())
            elif kind == "UnresolvedWith":
                recursive = bool(x.allowRecursion())
                for pair in _items(x.cteRelations()):
                    name = pair._1().lower()
                    self.visit(pair._2(), scope | {name} if recursive else scope)
                    scope = scope | {name}
                stack.append((x.child(), scope))
                continue
            stack += [(y, scope) for y in self.held(x, of)]

    def read(self, root) -> None:
        """Of an analysed plan: the views that it reads, whose own plans aren't entered, other leaves, and code of users."""
        stack = [root]
        while stack:
            x = stack.pop()
            kind, of = self.kind(x)
            if "plan" in of and kind == "View":
                self.names.relations.add((x.desc().identifier().table(),))
                continue
            if "plan" in of and x.children().isEmpty():
                self.names.kinds.add(kind)
            if "tree" in of and re.search("UDF|UDAF|UDTF|UserDefined|Reflection|InputFile|ScalaAggregator", kind):
                self.names.functions.add(kind)
            stack += self.held(x, of)


def _allowed_function(spark: SparkSession, name: str) -> bool:
    """Whether a name is a built-in function of an allowed group, and no function of the session hides it."""
    jvm = spark._jvm.org.apache.spark.sql.catalyst
    bare = re.sub(r"^(system\.)?builtin\.", "", name)
    if name.startswith("table function") or "." in bare:
        return False
    identifier = jvm.FunctionIdentifier(bare)
    info = jvm.analysis.FunctionRegistry.builtin().lookupFunction(identifier)
    if info.isEmpty() or not (info.get().getGroup() in FUNCTION_GROUPS or bare in FUNCTIONS):
        return False
    own = spark._jsparkSession.sessionState().functionRegistry().lookupFunction(identifier)
    return not own.isEmpty() and own.get().getClassName() == info.get().getClassName()


#: Leaves of an analysed plan that read nothing stored.
_OWN_LEAVES = {"OneRowRelation", "LocalRelation", "CTERelationRef", "UnionLoopRef"}


def parsed_names(spark: SparkSession, query: str) -> Names:
    walk = _Walk(spark)
    walk.visit(spark._jsparkSession.sessionState().sqlParser().parsePlan(query), frozenset())
    return walk.names


def _check_names(spark: SparkSession, names: Names, allowed: set[str] | None) -> None:
    known = {t.name for t in spark.catalog.listTables()} if allowed is None else allowed
    known = {name.lower() for name in known}
    if unknown := sorted(".".join(r) for r in names.relations if ".".join(r).lower() not in known):
        raise Refused(f"table {unknown[0]} is not allowed")


def check_query(spark: SparkSession, query: str, allowed: set[str] | None) -> None:
    """Raise Refused if the query does more than read allowed tables (None: all views of the session)."""
    names = parsed_names(spark, query)
    if others := sorted(k for k in names.kinds if k not in READING):
        raise Refused(f"only reading is allowed, not {others[0]}")
    if denied := sorted(f for f in names.functions if not _allowed_function(spark, f)):
        raise Refused(f"{denied[0]} is not allowed")
    _check_names(spark, names, allowed)


def check_analysed(df: DataFrame, allowed: set[str] | None) -> None:
    """Raise Refused if what the names of a checked query turned out to be reads anything but views of allowed tables."""
    walk = _Walk(df.sparkSession)
    walk.read(df._jdf.queryExecution().analyzed())
    if walk.names.functions:
        raise Refused(f"{min(walk.names.functions)} is not allowed")
    if others := sorted(walk.names.kinds - _OWN_LEAVES):
        raise Refused(f"{others[0]} is not allowed")
    _check_names(df.sparkSession, walk.names, allowed)


def sqlite_compat(query: str) -> str:
    """Rewrite what differs and can be tested: LIKE ignores case there. Quoted text is left alone."""
    parts = re.split(r"('(?:[^']|'')*')", query)
    return "".join(p if k % 2 else re.sub(r"(?i)\blike\b", "ILIKE", p) for k, p in enumerate(parts))


class SqlTool:
    """The guarded tool: an allowlist of tables (None: all views), a row cap, a time limit and an audit log.

    ``columns`` gives the columns that may be read of some tables; a query that depends on another, in a filter or a window as
    well as in its result, is refused.
    """

    def __init__(
        self, spark: SparkSession, allowed: set[str] | None = None, cap: int = 100, timeout_s: float | None = None, prefix: str = "Error: ", compat: bool = False,
        columns: dict[str, set[str]] | None = None,
    ):
        self.columns = {t.lower(): {c.lower() for c in names} for t, names in (columns or {}).items()}
        self.spark, self.allowed, self.cap, self.timeout_s, self.prefix, self.compat = spark, allowed, cap, timeout_s, prefix, compat
        self.log: list[tuple[str, float, bool, str | None, int]] = []

    def _checked(self, query: str, args: dict | list | None) -> DataFrame:
        query = sqlite_compat(query) if self.compat else query
        check_query(self.spark, query, self.allowed)
        df = self.spark.sql(query, args=args) if args else self.spark.sql(query)
        check_analysed(df, self.allowed)
        if self.columns and (denied := sorted(f"{t}.{c}" for t, c in lineage(df).every if t in self.columns and c not in self.columns[t])):
            raise Refused(f"column {denied[0]} is not allowed")
        return df

    def plan(self, query: str, args: dict | list | None = None) -> DataFrame:
        """The checked query as a capped DataFrame; raises what check or analysis raise."""
        return self._checked(query, args).limit(self.cap)

    def run(self, query: str, args: dict | list | None = None) -> Result:
        """The query's rows up to the cap (``truncated`` says if there are more), or its error."""
        began = time.time()
        timer = None
        tag = f"sqltool-{uuid.uuid4().hex}"
        try:
            df = self._checked(query, args).limit(self.cap + 1)
            if self.timeout_s:
                self.spark.addTag(tag)
                timer = threading.Timer(self.timeout_s, self.spark.interruptTag, [tag])
                timer.start()
            rows = df.collect()
            result = Result(True, rows[: self.cap], df.columns, truncated=len(rows) > self.cap)
        except (PySparkException, Refused) as e:
            result = Result(False, error=self.prefix + str(e))
        except Exception as e:  # noqa: BLE001  the tool's contract: any failure is a value
            result = Result(False, error=self.prefix + str(e))
        finally:
            if timer:
                timer.cancel()
                self.spark.removeTag(tag)
        self.log.append((query, began, result.ok, result.error, len(result.rows)))
        return result

    def __call__(self, query: str) -> str:
        return str(self.run(query))

    def audit(self) -> DataFrame:
        """What ran and when: query, started, ok, error, n_rows."""
        return self.spark.createDataFrame(self.log, "query string, started double, ok boolean, error string, n_rows int").withColumn(
            "started", F.timestamp_seconds("started")
        )
