"""Read-only SQL over named tables.

A statement is judged by its parsed plan, not by its text: only queries pass, and
functions that reach outside the session are refused.  Every node and expression of the
plan is looked at, with all subqueries, so neither length nor nesting hides one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..session import isolated
from . import sql_functions

MAX_ROWS = 200
#: Functions that run arbitrary code or read files.
REFUSED_FUNCTIONS = {"reflect", "java_method", "try_reflect", "input_file_name", "read_files"}
TREE, PLAN = "org.apache.spark.sql.catalyst.trees.TreeNode", "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"
#: Calls of functions, and names that only running an expression would tell.
FUNCTIONS = {"UnresolvedFunction", "UnresolvedTableValuedFunction", "UnresolvedGenerator"}
NAMED_AT_RUN_TIME = {"ExpressionWithUnresolvedIdentifier", "PlanWithUnresolvedIdentifier"}
#: Nodes of plans that pass on some of their rows, by their order.
LIMITS = {"GlobalLimit", "LocalLimit", "Offset"}
#: Nodes of plans that do more than read.
COMMANDS = ("Command", "InsertInto", "CreateTable", "CreateView", "Drop", "Alter", "Delete", "Update", "Merge", "Truncate", "Repair", "SetCatalog", "SetNamespace", "Explain", "Describe", "Show", "Cache", "Uncache", "Refresh", "Analyze", "Load", "CreateFunction", "CreateVariable", "SetVariable", "CompoundBody", "Replace", "Call")


def check(spark: SparkSession, query: str) -> str | None:
    """Why a statement is refused, or None."""
    text = (query or "").strip()
    if not text:
        return "SQL query cannot be empty."
    if text.endswith(";"):
        text = text[:-1].rstrip()
    sessions, before = spark._jvm.SparkSession, spark._jvm.SparkSession.getActiveSession()
    sessions.setActiveSession(spark._jsparkSession)  # the parser follows the active session's settings
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:  # the parser's own error says where
        return f"Only one SELECT statement is allowed; it could not be parsed: {' '.join(str(e).split())[:200]}"
    finally:
        if before.isDefined():
            sessions.setActiveSession(before.get())
    for kind, node in parts_of(spark, plan):
        if kind in NAMED_AT_RUN_TIME:
            return "Names made by expressions are not allowed."
        if kind == "UnresolvedRelation" and node.multipartIdentifier().size() > 1:
            return f"Table {node.multipartIdentifier().mkString('.')} is not one of the session's."
        if kind in FUNCTIONS:
            name = [x.lower() for x in _items(spark, node.nameParts() if kind == "UnresolvedFunction" else node.name())]
            if len(name) > 1 or name[-1] in REFUSED_FUNCTIONS:
                return f"Function '{'.'.join(name)}' is not allowed."
        if any(kind.startswith(c) or kind.endswith("Command") for c in COMMANDS) and is_instance_of(spark.sparkContext._gateway, node, PLAN):
            return "Only SELECT or WITH queries are allowed."
    return None


def _items(spark: SparkSession, found) -> list[str]:
    """The items of a Scala collection, or the one name that it is instead."""
    if not is_instance_of(spark.sparkContext._gateway, found, "scala.collection.Iterable"):
        return [found.toString()]
    out, each = [], found.iterator()
    while each.hasNext():
        out.append(str(each.next()))
    return out


def parts_of(spark: SparkSession, plan: JavaObject) -> Iterator[tuple[str, JavaObject]]:
    """(class, object) of every node and expression of a plan, wherever it stands: all fields are followed."""
    gateway = spark.sparkContext._gateway
    todo = [plan]
    while todo:
        node = todo.pop()
        if not isinstance(node, JavaObject):
            continue
        full = node.getClass().getName()
        if is_instance_of(gateway, node, TREE):
            yield full.rpartition(".")[2].rpartition("$")[2] or full, node
        if full.startswith("org.apache.spark.sql.types."):
            continue
        if is_instance_of(gateway, node, "scala.collection.Iterable"):
            each = node.iterator()
        elif is_instance_of(gateway, node, "scala.Product"):
            each = node.productIterator()
        else:
            continue
        while each.hasNext():
            todo.append(each.next())


def query(tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """The result of a checked query over the tables, lazily; raises ValueError if it is refused."""
    if not tables:
        raise ValueError("No tables.")
    spark = next(iter(tables.values())).sparkSession
    own = isolated(spark)
    why = check(own, sql)
    if why:
        raise ValueError(why)
    sql_functions.install(own)
    views = []  # that the query's own session can see, until the query is analysed
    try:
        for name, df in tables.items():
            views.append(f"millrace_{uuid.uuid4().hex}")
            df.createOrReplaceGlobalTempView(views[-1])
            own.sql(f"CREATE OR REPLACE TEMPORARY VIEW `{name}` AS SELECT * FROM global_temp.{views[-1]}")
        return _ordered_limits(own, own.sql(sql.strip().rstrip(";")))
    finally:
        for view in views:
            spark.catalog.dropGlobalTempView(view)


def _ordered_limits(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` with every limit right above its sort, in subqueries too.

    For an ORDER BY over columns that are not selected the analyser puts a projection between both.  A
    correlated limit then numbers the rows of each outer value in the order in which they happen to arrive.
    """
    plan = df._jdf.queryExecution().analyzed()
    lifted = _lifted(spark, plan)
    return df if lifted is plan else DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, lifted), spark)


def _lifted(spark: SparkSession, part):
    """A part of a plan in which projections between a sort and its limits stand above these; the same object if there are none."""
    gateway = spark.sparkContext._gateway
    if not isinstance(part, JavaObject) or part.getClass().getName().startswith("org.apache.spark.sql.types."):
        return part
    if is_instance_of(gateway, part, TREE):
        args = list(_each(part.productIterator()))
        new = [_lifted(spark, a) for a in args]
        if any(a is not b for a, b in zip(args, new)):
            array = gateway.new_array(spark._jvm.Object, len(new))
            for k, a in enumerate(new):
                array[k] = a
            part = part.makeCopy(array)
        below = part.child() if _kind(part) in LIMITS else None
        if below is not None and _kind(below) == "Project" and _kind(_under_limits(below.child())) == "Sort":
            return below.withNewChildren(_sequence(spark, [part.withNewChildren(_sequence(spark, [below.child()]))]))
        return part
    if is_instance_of(gateway, part, "scala.collection.immutable.Seq"):
        old = list(_each(part.iterator()))
        new = [_lifted(spark, a) for a in old]
        return _sequence(spark, new) if any(a is not b for a, b in zip(old, new)) else part
    if is_instance_of(gateway, part, "scala.Some"):
        new = _lifted(spark, part.get())
        return part if new is part.get() else spark._jvm.scala.Option.apply(new)
    return part


def _kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName()


def _under_limits(node: JavaObject) -> JavaObject:
    while _kind(node) in LIMITS:
        node = node.child()
    return node


def _each(found) -> Iterator:
    while found.hasNext():
        yield found.next()


def _sequence(spark: SparkSession, items: list):
    return spark._jvm.PythonUtils.toSeq(items)


def run_sql_query(tables: dict[str, DataFrame], sql: str) -> dict:
    """status, query, tables_available, row_count, returned_rows, truncated, columns, rows; errors as values."""
    try:
        out = query(tables, sql)
        rows = out.limit(MAX_ROWS + 1).collect()
        truncated = len(rows) > MAX_ROWS
        total = out.count() if truncated else len(rows)
    except (ValueError, PySparkException) as e:
        return {"error": str(e).splitlines()[0][:500]}
    shown = rows[:MAX_ROWS]
    return {
        "status": "success", "query": sql, "tables_available": sorted(tables), "row_count": total, "returned_rows": len(shown),
        "truncated": truncated, "columns": out.columns, "rows": [r.asDict(recursive=True) for r in shown],
    }
