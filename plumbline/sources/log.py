"""An append log in a folder: Parquet parts, and numbered commits that only one appender can make each."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory, stable

#: How often an append is tried again after others have been first, and parts from which a commit merges them.
ATTEMPTS, PARTS = 50, 64
SCHEMA = "url string, description string"


class LogError(RuntimeError):
    """A log that can't be appended to."""


class AppendLog:
    """Entries (url, description). A version is the parts that its commit lists; readers see whole versions only.

    Commits are files by number, each made by moving a finished file to a name that must be new, which local and HDFS folders
    do at once. An appender whose number is taken looks at what was appended meanwhile and tries the next.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, stable.address(folder).rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._store.mkdirs(self._path(f"{self.folder}/_commits"))

    def _name(self, version: int) -> str:
        return f"{self.folder}/_commits/{version:012d}.json"

    def version(self) -> int:
        """The last commit's number, 0 before the first."""
        names = [x.getPath().getName() for x in self._store.listStatus(self._path(f"{self.folder}/_commits"))]
        return max((int(n[:-5]) for n in names if n[:-5].isdigit() and n.endswith(".json")), default=0)

    def parts(self, version: int) -> list[str]:
        if not version:
            return []
        stream = self._store.open(self._path(self._name(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()))["parts"]
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """url and description of a version, the last if none is named."""
        parts = self.parts(self.version() if version is None else version)
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*(f"{self.folder}/{p}" for p in parts))

    def _commit(self, version: int, parts: list[str]) -> bool:
        """Makes a version unless there is one of its number."""
        draft = self._path(f"{self.folder}/_commits/.{uuid.uuid4().hex}")
        out = self._store.create(draft, False)
        out.write(json.dumps({"parts": parts}).encode())
        out.close()
        name = self._name(version)
        try:
            if self.folder.startswith("file:"):  # where a move would replace a file that is there, a link wouldn't
                own = self.folder.removeprefix("file://")
                try:
                    os.link(f"{own}/_commits/{draft.getName()}", f"{own}/_commits/{version:012d}.json")
                except FileExistsError:
                    return False
                return True
            return not self._store.exists(self._path(name)) and self._store.rename(draft, self._path(name))
        finally:
            self._store.delete(draft, False)

    def _written(self, rows: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{part}")
        return part

    def append(self, entries: DataFrame) -> tuple[str, int]:
        """UNCHANGED or APPENDED, and the version that holds all entries (url, task, note, description).

        Of entries with one url, task and note the smallest description is taken. What the log holds already isn't appended again.
        """
        once = entries.groupBy("url", "task", "note").agg(F.min("description").alias("description"))
        for _ in range(ATTEMPTS):
            base = self.version()
            part = self._written(memory.absent(once, self.read(base)).select("url", "description"))
            parts = self.parts(base)
            if not self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{part}").limit(1).count():
                self._drop(part)
                return "UNCHANGED", base
            listed = [*parts, part]
            if len(listed) > PARTS:
                listed = [self._written(self.spark.read.schema(SCHEMA).parquet(*(f"{self.folder}/{p}" for p in listed)))]
            if self._commit(base + 1, listed):
                return "APPENDED", base + 1
            for p in {part, *listed} - set(parts):
                self._drop(p)
        raise LogError("others were always first")

    def _drop(self, part: str) -> None:
        self._store.delete(self._path(f"{self.folder}/{part}"), True)
