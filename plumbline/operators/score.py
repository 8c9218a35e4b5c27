"""Benchmark scoring: outcomes of gates rolled up by mode, gate and world."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GATES = ["schema", "runtime", "governance", "result"]


def skipped() -> list[dict[str, str]]:
    """The gates of a candidate that isn't there."""
    return [{"gate": g, "status": "SKIPPED"} for g in GATES]


def rate(passed, total):
    """0.0 where there is nothing to rate."""
    return F.coalesce(F.try_divide(passed.cast("double"), total.cast("double")), F.lit(0.0))


def readiness(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ready: all gates of a candidate passed. outcomes: a row per candidate and gate with `status`."""
    return outcomes.groupBy(*keys).agg(F.bool_and(F.col("status") == "PASS").alias("ready"))


def rollups(outcomes: DataFrame) -> DataFrame:
    """level, mode, gate, world, passed, total, pass_rate over (world, task_id, mode, gate, status) in grouping sets.

    A candidate's readiness counts as one more gate, `ready`; other gates are rolled up by mode, readiness also by world.
    """
    ready = readiness(outcomes, ["world", "task_id", "mode"]).select("world", "mode", F.lit("ready").alias("gate"), F.col("ready").alias("ok"))
    facts = ready.unionByName(outcomes.select("world", "mode", "gate", (F.col("status") == "PASS").alias("ok")))
    sets = facts.groupingSets([["mode", "gate"], ["mode", "gate", "world"]], "mode", "gate", "world")
    out = sets.agg(F.grouping("world").alias("whole"), F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"))
    out = out.where("whole = 1 or gate = 'ready'").withColumn("level", F.when(F.col("whole") == 0, "world").when(F.col("gate") == "ready", "mode").otherwise("gate"))
    return out.select("level", "mode", "gate", "world", "passed", "total", F.round(rate(F.col("passed"), F.col("total")), 6).alias("pass_rate"))


def repairs(records: DataFrame) -> DataFrame:
    """Per mode: repairs attempted and passed, from repair_attempts and repair_status."""
    return records.groupBy("mode").agg(F.coalesce(F.sum("repair_attempts"), F.lit(0)).cast("long").alias("repairs_attempted"), F.count_if(F.col("repair_status") == "PASS").alias("repairs_passed"))


def paired(records: DataFrame, first: str, second: str) -> DataFrame:
    """world, task_id, ready in both modes, and whether the second mode gained or lost the task."""
    a = records.where(F.col("mode") == first).select("world", "task_id", F.col("ready").alias("ready_first"))
    b = records.where(F.col("mode") == second).select("world", "task_id", F.col("ready").alias("ready_second"))
    change = F.when(F.col("ready_first") == F.col("ready_second"), "same").when(F.col("ready_second"), "gained").otherwise("lost")
    return a.join(b, ["world", "task_id"]).withColumn("change", change)


def with_missing(tasks: DataFrame, modes: list[str], found: DataFrame) -> DataFrame:
    """Every task in every mode with its status, SKIPPED where nothing was found: it stays in the denominator."""
    grid = tasks.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    return grid.join(found, [*tasks.columns, "mode"], "left").withColumn("status", F.coalesce("status", F.lit("SKIPPED")))


def failure_actions(outcomes: DataFrame) -> DataFrame:
    """The failed gates of each candidate, in one row, in the gates' order."""
    order = F.array_position(F.array(*map(F.lit, GATES)), F.col("gate"))
    failed = outcomes.where("status <> 'PASS'").groupBy("world", "task_id", "mode").agg(F.sort_array(F.collect_list(F.struct(order.alias("at"), "gate", "status"))).alias("f"))
    return failed.select("world", "task_id", "mode", F.transform("f", lambda x: F.struct(x["gate"].alias("gate"), x["status"].alias("status"))).alias("failures"))
