"""Numbers rows 1, 2, ... in the order of a result, without moving them to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stable


def with_position(df: DataFrame, name: str = "row_number") -> DataFrame:
    """Each row's place: rows before its partition (a number per partition, collected) and its place within.

    The marked rows are kept, so that both reads see the same partitions.
    """
    marked = stable.kept(df.withColumn("_mark", F.monotonically_increasing_id()))
    part = F.shiftright("_mark", 33)
    sizes, before, at = {r["p"]: r["n"] for r in marked.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}, [], 0
    for p in sorted(sizes):
        before.append((p, at))
        at += sizes[p]
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_part long, _before long"))
    placed = marked.withColumn("_part", part).join(offsets, "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_mark").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_before", "_mark")
