"""Idempotent appends of evidence and tags, checked by reading them back."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

READS = 5


def description(run_id: str, task: str, note: str, at: datetime.datetime) -> str:
    return f"Run: {run_id}\nTask: {task}\nNote: {note}\nGenerated: {at.astimezone(datetime.UTC).isoformat(timespec='seconds')}"


def _after(text: str, mark: str, most: str) -> Column:
    """What follows each occurrence of a mark (which can't overlap itself), up to `most` characters."""
    n = F.size(F.split(text, mark, -1)) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.left(F.call_function("substring_index", F.col(text), F.lit(mark), -i), F.col(most))))


def _starts(texts: str, lengths: str) -> Column:
    """The distinct beginnings of texts that have one of the lengths."""
    cut = F.transform(lengths, lambda n: F.transform(F.filter(texts, lambda x: F.length(x) >= n), lambda x: F.left(x, n)))
    return F.explode(F.array_distinct(F.flatten(cut)))


def absent(entries: DataFrame, log: DataFrame) -> DataFrame:
    """The entries (url, task, note) that no element of the log (url, description) already holds.

    An element holds an entry if its description contains `Task: ` and the task, and `Note: ` and the note. So what follows
    these marks begins with them, and beginnings of the lengths that tasks and notes have are equi-joined with them.
    """
    tasks = entries.groupBy(F.col("url").alias("_url"), F.col("task").alias("_task")).agg(F.collect_set(F.length("note")).alias("_sizes"))
    most = entries.agg(F.collect_set(F.length("task")).alias("_lengths"), F.max(F.length("task")).alias("_longest"), F.max(F.length("note")).alias("_most"))
    own = log.select(F.col("url").alias("_url"), F.col("description").alias("_held")).crossJoin(F.broadcast(most))
    own = own.select("_url", "_lengths", _after("_held", "Task: ", "_longest").alias("_tasks"), _after("_held", "Note: ", "_most").alias("_notes"))
    own = own.select("_url", "_notes", _starts("_tasks", "_lengths").alias("_task")).join(tasks, ["_url", "_task"])
    own = own.select("_url", "_task", _starts("_notes", "_sizes").alias("_note")).distinct()
    return entries.join(own, (F.col("url") == F.col("_url")) & (F.col("task") == F.col("_task")) & (F.col("note") == F.col("_note")), "left_anti")


def append(entries: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], pause: float = 0.2) -> str:
    """UNCHANGED if the log holds all entries, else APPENDED once a later read shows them; entries: url, task, note, description."""
    fresh = absent(entries, read())
    if not fresh.limit(1).count():
        return "UNCHANGED"
    write(fresh.select("url", "description"))
    for _ in range(READS):
        if not absent(entries, read()).limit(1).count():
            return "APPENDED"
        time.sleep(pause)
    raise RuntimeError("appended entries can't be read back")


def missing_tags(requested: DataFrame, tagged: DataFrame) -> DataFrame:
    """(field, tag) pairs asked for and not there."""
    return requested.join(tagged, ["field", "tag"], "left_anti")


def with_tags(requested: DataFrame, tagged: DataFrame, columns: DataFrame) -> DataFrame:
    """tagged with the missing pairs added; unknown fields are an error and nothing is added."""
    unknown = [r[0] for r in requested.select("field").distinct().join(columns, "field", "left_anti").limit(20).collect()]
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    return tagged.unionByName(missing_tags(requested, tagged).distinct())


def ensured_tags(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """existing (tag, description) with the wanted tags that aren't there, each once; tags that exist keep their description."""
    fresh = wanted.groupBy("tag").agg(F.min("description").alias("description")).join(existing, "tag", "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def upserted(expected: DataFrame, actual: DataFrame, key: str = "urn") -> DataFrame:
    """actual with the expected assets (one row each) put in: new ones added, known ones replaced, others left alone."""
    return actual.join(expected.select(key), key, "left_anti").select(*actual.columns).unionByName(expected.select(*actual.columns))


def upsert_graph(expected: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], pause: float = 0.2) -> DataFrame:
    """Writes the upserted assets and reads them back until nothing is missing or differs; what still does is returned."""
    columns = [c for c in expected.columns if c != "urn"]
    write(upserted(expected, read()))
    for _ in range(READS):
        left = graph_mismatches(expected, read(), columns)
        if not left.limit(1).count():
            break
        time.sleep(pause)
    return left


def graph_mismatches(expected: DataFrame, actual: DataFrame, compared: list[str]) -> DataFrame:
    """urn and problem: expected assets that are missing or differ in a compared column."""
    both = expected.join(actual.select("urn", F.lit(True).alias("_there"), *(F.col(c).alias(f"_{c}") for c in compared)), "urn", "left")
    differs = F.lit(False)
    for c in compared:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return both.select("urn", F.when(F.col("_there").isNull(), "missing").when(differs, "mismatched").alias("problem")).where("problem is not null")
