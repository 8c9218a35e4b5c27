"""The only module that touches Catalyst's objects: parsed and analyzed plans as Python sees them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession


class PlanError(ValueError):
    """SQL text that is no single query."""


def kind(node) -> str:
    return node.getClass().getSimpleName()


def items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def parsed(spark: SparkSession, sql: str):
    """The parsed plan of one query; commands are refused here, before anything could run them."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise PlanError(f"SQL can't be parsed: {str(e).strip().splitlines()[0]}") from e
    if not is_query(plan):
        raise PlanError(f"not a query: {kind(plan)}")
    return plan


_QUERY_NODES = {"Project", "Aggregate", "Filter", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "UnresolvedWith", "UnresolvedHaving", "Union", "Intersect", "Except", "SubqueryAlias", "UnresolvedRelation", "UnresolvedInlineTable", "LocalRelation", "OneRowRelation", "WithWindowDefinition", "Join", "UnresolvedSubqueryColumnAliases", "Pivot", "Unpivot", "UnresolvedTableValuedFunction", "Generate", "LateralJoin", "UnresolvedHint", "Sample"}


def is_query(plan) -> bool:
    return kind(plan) in _QUERY_NODES


def analyzed(df: DataFrame):
    return df._jdf.queryExecution().analyzed()


def span(node) -> tuple[int, int] | None:
    """First and last character of a node's text."""
    o = node.origin()
    return (o.startIndex().get(), o.stopIndex().get()) if o.startIndex().isDefined() and o.stopIndex().isDefined() else None


def inside(expression) -> Iterator:
    """An expression and all below it, without descending into subqueries' plans."""
    yield expression
    for child in items(expression.children()):
        yield from inside(child)


def subplan(expression):
    """The plan of a subquery expression, else None."""
    return expression.plan() if kind(expression) in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery", "UnresolvedScalarSubquery") and hasattr(expression, "plan") and kind(expression) != "InSubquery" else None


def expr_id(attribute) -> int:
    return attribute.exprId().id()


def select_list(plan) -> list:
    return items(plan.projectList() if kind(plan) == "Project" else plan.aggregateExpressions())


def output_name(item) -> str | None:
    """The name that a select item gives, None for a star or an unnamed expression."""
    k = kind(item)
    if k == "Alias":
        return item.name()
    return items(item.nameParts())[-1] if k == "UnresolvedAttribute" else None


def with_relations(plan) -> list[tuple[str, object]]:
    """The named queries of a WITH, in order, each without its alias."""
    return [(t._1(), t._2().child()) for t in items(plan.cteRelations())]
