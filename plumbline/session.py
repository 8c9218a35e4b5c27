"""Session factory with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Results depend on these: UTC, errors instead of silent nulls, double quotes for identifiers, adaptive plans.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

#: Of the application as a whole: checkpoints go when nothing refers to them any more.
APPLICATION = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}


def session(name: str = "plumbline", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=APPLICATION | SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def isolated(spark: SparkSession) -> SparkSession:
    """A session with temporary views and settings of its own, for one candidate query."""
    own = spark.newSession()
    for key, value in SETTINGS.items():
        own.conf.set(key, value)
    return own
