"""Shared plumbing: tables, scratch tables in the shared folder, Arrow helpers."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of applications on one machine that name none.
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Only where that is unset (as in tests on one machine) a temporary folder is used.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = context.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
        found = _own_dirs[app]
    return found.rstrip("/")


#: Applications whose scratch folder is marked for removal when the driver's JVM ends.
_marked: set[str] = set()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder's path. Whatever an application leaves in its folders goes when its driver ends."""
    app = spark.sparkContext.applicationId
    top = f"{shared_dir(spark)}/plumbline/{app}"
    if app not in _marked:
        path, files = _files(spark, top)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _marked.add(app)
    return f"{top}/{label}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class _Made(threading.local):
    """Scratch folders that the calling thread has made and not yet removed: calls in other threads own theirs."""

    def __init__(self):
        self.folders: list[str] = []


_made = _Made()


def own(folder: str) -> str:
    """Notes a folder as made by the calling thread, so that drop_since() there removes it."""
    _made.folders.append(folder)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    path, files = _files(spark, folder)
    files.delete(path, True)
    if folder in _made.folders:
        _made.folders.remove(folder)


#: Spark's setting that removes an execution's shuffle files when it ends; how many threads write now, and what held before.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing, _writers = threading.Lock(), {"n": 0, "before": None}


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """While any thread is in here, an execution's shuffle files go when it ends; afterwards the setting is as before."""
    with _writing:
        if not _writers["n"]:
            _writers["before"] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _writers["n"] += 1
    try:
        yield
    finally:
        with _writing:
            _writers["n"] -= 1
            if not _writers["n"]:
                spark.conf.set(_CLEANUP, _writers["before"]) if _writers["before"] else spark.conf.unset(_CLEANUP)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, own(scratch_path(df.sparkSession, label))
    with _shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _read_by(*tables: DataFrame) -> set[str]:
    """Names of the folders whose files tables read."""
    return {x.rpartition("/")[0].rpartition("/")[2] for df in tables for x in df.inputFiles()}


def drop_scratch(spark: SparkSession, df: DataFrame) -> None:
    """Removes the files of a stored() table that no one reads any more."""
    names = _read_by(df)
    for folder in [x for x in _made.folders if x.rpartition("/")[2] in names]:
        remove(spark, folder)


def release(result: DataFrame) -> None:
    """Removes the stored() tables that an operator's result still reads, once the result isn't needed; from any thread."""
    spark = result.sparkSession
    top = f"{shared_dir(spark)}/plumbline/{spark.sparkContext.applicationId}"
    own_files = [x for x in result.inputFiles() if f"/plumbline/{spark.sparkContext.applicationId}/" in x]
    for name in {x.rpartition("/")[0].rpartition("/")[2] for x in own_files}:
        remove(spark, f"{top}/{name}")


def mark() -> set[str]:
    """The scratch folders that the calling thread has by now, for drop_since()."""
    return set(_made.folders)


def drop_since(spark: SparkSession, before: set[str], *keep: DataFrame) -> None:
    """Removes the stored() tables that the calling thread has made since, but for those that the results still read."""
    kept = _read_by(*keep)
    for folder in [x for x in _made.folders if x not in before and x.rpartition("/")[2] not in kept]:
        remove(spark, folder)


def arrow_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Bounds what Spark sends to a Python worker at once, so that batches of long texts stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(megabytes << 9))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def give_back() -> None:
    """Gives memory that is free in this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(run: Callable) -> Callable:
    """A function over Arrow batches that gives its memory back to the system when its task ends: workers are reused, and idle ones count.

    Meanwhile the search for cycles rests: the functions make millions of strings and arrays, and no cycles.
    """

    @functools.wraps(run)
    def tidied(batches):
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
        give_back()

    return tidied


#: What a worker keeps from task to task of one call: its name and the thing.
_kept: list = [None, None]


def worker_state(call: str, make: Callable):
    """A worker's state for a call. There is one at a time: a reused worker forgets what earlier calls have left in it."""
    if _kept[0] != call:
        _kept[:] = [None, None]
        _kept[:] = [call, make()]
    return _kept[1]


def private(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores until no column of df is called so (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def ids_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def hot_rows(spark: SparkSession, total: int) -> int:
    """Rows from which a key is hot among `total`: a fourth of a shuffled partition, and at least 1000.

    There are at most four times as many hot keys as shuffle partitions (and a thousand at least, a million at most), which
    bounds what is broadcast of them.
    """
    share = min(1_000_000, max(1000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return max(1000, -(-total // share))


def hot_split(df: DataFrame, counts: DataFrame, keys: list[str], payload: list[str], total: int) -> DataFrame:
    """df left-joined to counts (one row per key, with its number of rows `rows`) without a hot key in any task.

    The hot keys' rows are broadcast; the others meet in an ordinary shuffled join.
    """
    least = hot_rows(df.sparkSession, total)
    hot = F.broadcast(counts.where(F.col("rows") >= least).select(*keys, *[F.col(c).alias(f"hot_{c}") for c in payload], F.lit(True).alias("is_hot")))
    tagged = df.join(hot, keys, "left")
    cold = tagged.where("is_hot is null").drop("is_hot", *[f"hot_{c}" for c in payload]).join(counts.where(F.col("rows") < least).select(*keys, *payload), keys, "left")
    warm = tagged.where("is_hot").select(*df.columns, *[F.col(f"hot_{c}").alias(c) for c in payload])
    return warm.unionByName(cold.select(*warm.columns))
