"""Ordered equivalence of two results with numeric tolerance."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import plain, same
from . import digests, stable
from .positions import with_position

ISSUES = 3
#: Differing blocks that are looked into at first, and up to which they are broadcast (8 bytes each).
BLOCKS, SENT = 64, 1_000_000


class Placed:
    """Two results with their rows numbered and the blocks that may differ, for several questions."""

    def __init__(self, candidate: DataFrame, expected: DataFrame):
        self.width = len(expected.columns)
        self.kinds = [f.dataType for f in candidate.schema.fields], [f.dataType for f in expected.schema.fields]
        self.sides = [with_position(df.toDF(*(f"{s}{i}" for i in range(self.width)))) for df, s in ((candidate, "a"), (expected, "b"))]
        own = [digests.digests(df, [f"{s}{i}" for i in range(self.width)], k, o) for df, s, k, o in zip(self.sides, "ab", self.kinds, self.kinds[::-1], strict=True)]
        self.blocks = stable.kept(digests.differing(*own))

    def differences(self, within: DataFrame | Column) -> DataFrame:
        """row_number, actual and wanted of rows that differ, among those of some blocks: a table of blocks, or a condition on `block`."""
        sides = []
        for df, mark in zip(self.sides, ("_a", "_b"), strict=True):
            own = df.withColumn("block", digests.block_of(F.col("row_number")))
            own = own.where(within) if isinstance(within, Column) else own.join(within, "block", "left_semi")
            sides.append(own.drop("block").withColumn(mark, F.lit(True)))
        both, equal = sides[0].join(sides[1], "row_number", "full_outer"), F.lit(True)
        for i, (x, y) in enumerate(zip(*self.kinds, strict=True)):
            equal = equal & same(F.col(f"a{i}"), F.col(f"b{i}"), x, y)
        differs = F.col("_a").isNull() | F.col("_b").isNull() | ~F.coalesce(equal, F.lit(False))
        return both.where(differs).select("row_number", *(F.struct(*(f"{s}{i}" for i in range(self.width))).alias(n) for s, n in (("a", "actual"), ("b", "wanted"))))

    def first(self, issues: int) -> DataFrame:
        """The first differences by place. Blocks are looked into in their order, each time four times as many, until there are enough."""
        after, many, found, schema = -1, BLOCKS, [], None
        while len(found) < issues:
            some = [r["block"] for r in self.blocks.where(F.col("block") > after).orderBy("block").limit(many).collect()]
            if some:
                more = self.differences(F.col("block").isin(some)).orderBy("row_number").limit(issues - len(found))
                found, schema = found + more.collect(), more.schema
            if len(some) < many:
                break
            after, many = some[-1], min(4 * many, 4096)
        return self.blocks.sparkSession.createDataFrame(found, schema or self.differences(F.lit(False)).schema)


def row_differences(candidate: DataFrame, expected: DataFrame) -> DataFrame:
    """row_number and both rows (structs `actual`, `wanted`) wherever the rows at one place differ, or one side has none."""
    both = Placed(candidate, expected)
    return both.differences(F.broadcast(both.blocks) if both.blocks.count() <= SENT else both.blocks)


def first_differences(candidate: DataFrame, expected: DataFrame, issues: int = ISSUES) -> DataFrame:
    """The first of row_differences(), with only the first differing blocks' rows brought together."""
    return Placed(candidate, expected).first(issues)


def compare(candidate: DataFrame | None, expected: DataFrame) -> dict[str, Any]:
    """The gate's report: columns by folded name and order, row counts, then rows by place; three issues at most."""
    if candidate is None:
        return {"gate": "result", "status": "SKIPPED", "issues": [], "message": "The candidate did not run."}
    issues: list[dict[str, Any]] = []
    if [c.casefold() for c in candidate.columns] != [c.casefold() for c in expected.columns]:
        issues.append({"type": "column_contract_mismatch", "expected": expected.columns, "actual": candidate.columns})
    n, m = candidate.count(), expected.count()
    if n != m:
        issues.append({"type": "row_count_mismatch", "expected": m, "actual": n})
    elif not issues:
        for r in first_differences(candidate, expected).orderBy("row_number").collect():
            issues.append({"type": "row_value_mismatch", "row_number": r["row_number"], "expected": [plain(v) for v in r["wanted"]], "actual": [plain(v) for v in r["actual"]]})
    return {"gate": "result", "status": "FAIL" if issues else "PASS", "expected_columns": expected.columns, "expected_row_count": m, "issues": issues, "message": "The candidate differs from the reference." if issues else "The candidate matches the reference."}
