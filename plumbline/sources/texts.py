"""Stored texts as tables: candidates' files against the grid of tasks, and JSON lines with what can't be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


def whole_texts(spark: SparkSession, folder: str, pattern: str = "*.sql") -> DataFrame:
    """path and text of a folder's files, one row a file, at any depth; a folder without such files gives none."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).schema("value string")
    return files.load(folder).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def candidates(texts: DataFrame, tasks: DataFrame, modes: list[str]) -> DataFrame:
    """tasks (task_id and more) in every mode with sql and state: present, empty or missing. Files are named <task_id>__<mode>.sql.

    A task without a file stays in the table, as does one whose file is blank; files of no task are left out.
    """
    stem = F.url_decode(F.regexp_extract("path", r"([^/]+)\.sql$", 1))
    named = texts.select(F.substring_index(stem, "__", -1).alias("mode"), F.regexp_extract(stem, r"^(.*)__[^_].*$|^(.*)__$", 1).alias("task_id"), "text")
    grid = tasks.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    both = grid.join(named, ["task_id", "mode"], "left")
    state = F.when(F.col("text").isNull(), "missing").when(F.trim(F.regexp_replace("text", r"\s+", " ")) == "", "empty").otherwise("present")
    return both.select(*grid.columns, F.when(state == "present", F.col("text")).alias("sql"), state.alias("state"))


def json_rows(lines: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON texts by a schema, and the texts that don't hold one (with all other columns of theirs)."""
    parsed: Column = F.from_json(column, f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    read = lines.withColumn("_read", parsed)
    bad = F.col("_read").isNull() | F.col(f"_read.{CORRUPT}").isNotNull()
    rest = [c for c in lines.columns if c != column]
    return read.where(~bad).select(*rest, "_read.*").drop(CORRUPT), read.where(bad).select(*lines.columns)
