"""Results that several actions read: computed once, with partitions that stay as they are; and folders that executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset, on one machine, a temporary folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='plumbline-')}")
    return context._jsc.sc().getCheckpointDir().get()


def address(folder: str) -> str:
    """A folder with its scheme, as Hadoop writes paths (nothing escaped): a bare path is a local one."""
    return re.sub(r"^file:/+", "file:///", folder) if re.match(r"[a-zA-Z][\w+.-]*:/", folder) else f"file://{Path(folder).resolve()}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder for files that go when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(own)
    files.deleteOnExit(own)
    return address(path)


def kept(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder, in its order. Lost executors neither recompute nor renumber it.

    Spark's cleaner removes what no DataFrame refers to any more, as session() sets it to.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
