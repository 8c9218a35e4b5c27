"""Runs a candidate in a session of its own and captures what goes wrong."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..functions.values import plain
from ..plans import adapter, frontend
from . import contract, stable

PREVIEW = 5


@dataclass
class Execution:
    """A query's result as a DataFrame, None if it failed, and a report without rows."""

    result: DataFrame | None
    report: dict[str, Any]
    #: What a contract counts, without distinct values, of the result.
    seen: dict[str, int] | None = None


def execute(spark: SparkSession, sql: str, rules: contract.Contract | None = None) -> Execution:
    """Any failure, of text, analysis or a task, is a FAIL report. Only queries run: commands are refused before.

    The result is written once; its rows, and what the contract counts, are observed on the way.
    """
    try:
        text = frontend.ready(spark, sql)
        adapter.parsed(spark, text)
        found, counts = contract.watched(spark.sql(text), rules or contract.Contract("rows"))
        result = stable.kept(found)  # gates and comparison read it, not the query again
        seen = counts()
        head = [{c: plain(v) for c, v in zip(result.columns, r, strict=True)} for r in result.limit(PREVIEW).collect()]
    except (PySparkException, adapter.PlanError, frontend.TemplateError, ValueError, StopIteration) as e:
        return Execution(None, {"gate": "runtime", "status": "FAIL", "error_type": type(e).__name__, "message": str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__})
    return Execution(result, {"gate": "runtime", "status": "PASS", "columns": result.columns, "row_count": seen["rows"], "preview": head}, seen if rules else None)
