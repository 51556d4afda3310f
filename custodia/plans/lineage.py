"""Which tables and columns a query reads, from its analysed plan.

The plan is Spark's own; this module only walks it: its leaves are compared
with those of the tables a policy has granted, and each result column is
followed down to the columns of the granted views.
"""

from __future__ import annotations

from typing import Iterable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

# Leaves that read nothing: rows that stand in the query itself.
_CONSTANT = ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef")
_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical"
_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions"


def _items(seq) -> Iterator:
    for k in range(seq.size()):
        yield seq.apply(k)


def _plans(root) -> list:
    """A plan and all plans of its subqueries."""
    return [root, *_items(root.subqueriesAll())]


def _nodes(root) -> Iterator:
    """All nodes of a plan, children first."""
    for child in _items(root.children()):
        yield from _nodes(child)
    yield root


def _is(spark: SparkSession, thing, name: str) -> bool:
    return spark._jvm.java.lang.Class.forName(name).isInstance(thing)


def only_reads(spark: SparkSession, sql: str) -> None:
    """Refuse a text that is not a query (a command or a write), unrun."""
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    for node in _nodes(parsed):
        if any(_is(spark, node, f"{_LOGICAL}.{c}") for c in ("Command", "ParsedStatement")):
            raise PermissionError(f"a governed plan may only read, not run {node.nodeName()}")


def _leaves(df: DataFrame) -> Iterator:
    for plan in _plans(df._jdf.queryExecution().analyzed()):
        yield from _items(plan.collectLeaves())


def _of_catalog(leaf) -> bool:
    return leaf.nodeName().startswith("LogicalRelation") and leaf.catalogTable().isDefined()


def foreign_leaves(df: DataFrame, granted: Iterable[DataFrame]) -> list[str]:
    """What ``df`` reads besides the granted tables, as plan text."""
    allowed = [leaf for table in granted for leaf in _leaves(table)]
    out = []
    for leaf in _leaves(df):
        if leaf.nodeName() in _CONSTANT:
            continue
        if not any(mine.sameResult(leaf) and _of_catalog(mine) == _of_catalog(leaf) for mine in allowed):
            out.append(leaf.simpleString(10))
    return out


def confine(df: DataFrame, granted: Mapping[str, DataFrame]) -> DataFrame:
    """``df`` if it reads nothing but the granted tables; no job has run."""
    other = foreign_leaves(df, granted.values())
    if other:
        raise PermissionError(f"the plan reads tables that the policy did not name: {other}")
    return df


def column_sources(df: DataFrame, views: Iterable[str]) -> list[tuple[str, str, str]]:
    """(result column, view, view column): the view columns that each result
    column is computed from, sorted. Columns that only filter, join or sort
    rows are not among them."""
    spark, views = df.sparkSession, {v.lower(): v for v in views}
    root = df._jdf.queryExecution().analyzed()
    made: dict[int, set[int]] = {}          # attribute -> attributes it is made from
    source: dict[int, tuple[str, str]] = {}

    def uses(expression) -> set[int]:
        found = {a.exprId().id() for a in _items(expression.references().toSeq())}
        for part in _walk(expression):
            if _is(spark, part, f"{_EXPRESSIONS}.PlanExpression"):
                found |= {a.exprId().id() for a in _items(part.plan().output())}
        return found

    def _walk(expression) -> Iterator:
        yield expression
        for child in _items(expression.children()):
            yield from _walk(child)

    def define(attribute, parts: set[int]) -> None:
        made.setdefault(attribute.exprId().id(), set()).update(parts - {attribute.exprId().id()})

    ctes: dict[int, list] = {}
    nodes = [n for plan in _plans(root) for n in _nodes(plan)]
    for node in nodes:
        kind = node.nodeName()
        if kind == "View" and node.desc().identifier().table().lower() in views:
            name = views[node.desc().identifier().table().lower()]
            for a in _items(node.output()):
                source[a.exprId().id()] = (name, a.name())
        elif kind == "CTERelationDef":
            ctes[node.id()] = list(_items(node.output()))
        elif kind in ("Union", "Intersect", "Except", "Intersect All", "Except All"):
            for child in _items(node.children()):
                for a, b in zip(_items(node.output()), _items(child.output())):
                    define(a, {b.exprId().id()})
        elif kind == "Generate":
            parts = uses(node.generator())
            for a in _items(node.generatorOutput()):
                define(a, parts)
        for expression in _items(node.expressions()):
            if _is(spark, expression, f"{_EXPRESSIONS}.Alias"):
                define(expression.toAttribute(), uses(expression))
    for node in nodes:
        if node.nodeName() == "CTERelationRef" and node.cteId() in ctes:
            for a, b in zip(_items(node.output()), ctes[node.cteId()]):
                define(a, {b.exprId().id()})

    def trace(attribute: int, seen: set[int]) -> set[tuple[str, str]]:
        if attribute in source:
            return {source[attribute]}
        found: set[tuple[str, str]] = set()
        for part in made.get(attribute, ()):
            if part not in seen:
                seen.add(part)
                found |= trace(part, seen)
        return found

    return sorted((a.name(), view, column) for a in _items(root.output())
                  for view, column in trace(a.exprId().id(), {a.exprId().id()}))
