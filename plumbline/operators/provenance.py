"""Tamper-evident manifests of a run's files."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import re
import stat
import subprocess
from importlib import metadata
from pathlib import Path
from typing import Any
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stable

MANIFEST = "manifest.json"


def canonical_json(value: Any) -> bytes:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


#: Bytes that are read of a file at once.
CHUNK = 1 << 20


def chunked_digest(stream, chunk: int = CHUNK) -> tuple[str, int]:
    """SHA-256 and length of a stream, read a chunk at a time."""
    chain, size = hashlib.sha256(), 0
    while data := stream.read(chunk):
        chain.update(data)
        size += len(data)
    return chain.hexdigest(), size


def opened(path: str):
    """A listed file as a stream, by Arrow's file systems."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_stream(re.sub("^file:/+", "/", path), compression=None)
    store, own = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_stream(own, compression=None)


def _digested(chunk: int):
    def run(batches):
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                with opened(path) as stream:
                    out.append(chunked_digest(stream, chunk))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([x for x, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], ["path", "sha256", "bytes"])

    return run


def file_digests(spark: SparkSession, folder: str, chunk: int = CHUNK) -> DataFrame:
    """path (below the folder), sha256, bytes of every file but manifests.

    Spark lists the files, on the driver as for any read; a task streams each of its files through a digest, a chunk at a time, so that a file may be of any
    size. Files are dealt by path. The folder's file system must be one that Arrow reads (local, HDFS, S3, GCS, Azure).
    """
    base = stable.address(folder).rstrip("/") + "/"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).inputFiles()  # with empty ones, which a scan leaves out
    named = [(p,) for p in map(unquote, listed) if p.rpartition("/")[2] != MANIFEST]
    found = spark.createDataFrame(named, "path string").repartition("path").mapInArrow(_digested(chunk), "path string, sha256 string, bytes long")
    own = F.regexp_replace("path", "^file:/+", "file:///")
    return found.withColumn("path", F.when(F.startswith(own, F.lit(base)), F.substring(own, len(base) + 1, 1 << 20)).otherwise(own))


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path and problem of (path, sha256, bytes) tables: missing, unexpected or changed files."""
    both = expected.select("path", F.col("sha256").alias("e"), F.col("bytes").alias("eb")).join(actual.select("path", F.col("sha256").alias("a"), F.col("bytes").alias("ab")), "path", "full_outer")
    problem = F.when(F.col("a").isNull(), "missing_file").when(F.col("e").isNull(), "unexpected_file").when((F.col("a") != F.col("e")) | (F.col("ab") != F.col("eb")), "file_digest_mismatch")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def dependency_versions(names: tuple[str, ...] = ("pyspark", "pyarrow", "pandas")) -> dict[str, str | None]:
    out = {}
    for name in names:
        try:
            out[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            out[name] = None
    return out


def git_snapshot(folder: str | Path) -> dict[str, Any]:
    """Commit, branch and whether anything is changed, of the work tree that holds a folder; without one `available` is False."""

    def git(*words: str) -> str | None:
        try:
            run = subprocess.run(["git", "-C", str(folder), *words], capture_output=True, text=True, timeout=30, check=False)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return run.stdout.strip() if run.returncode == 0 else None

    commit = git("rev-parse", "HEAD")
    changed = git("status", "--porcelain")
    return {"available": commit is not None, "commit": commit, "branch": git("rev-parse", "--abbrev-ref", "HEAD"), "dirty": bool(changed) if changed is not None else None}


def seal(spark: SparkSession, folder: str, run_id: str, **facts: Any) -> dict[str, Any]:
    """Writes the manifest with a digest of itself and makes the files read-only."""
    files = {r["path"]: {"sha256": r["sha256"], "bytes": r["bytes"]} for r in file_digests(spark, folder).orderBy("path").collect()}
    body = {"manifest_version": 2, "run_id": run_id, "sealed": True, "tamper_evident": True, "write_once_run_id": True, "environment": {"python": platform.python_version(), "system": platform.system(), "dependencies": dependency_versions()}, "files": files, **facts}
    manifest = body | {"manifest_sha256": digest(canonical_json(body))}
    with open(Path(folder) / MANIFEST, "x", encoding="utf-8") as out:
        json.dump(manifest, out, indent=2, ensure_ascii=False)
    for p in Path(folder).rglob("*"):
        if p.is_file():
            os.chmod(p, stat.S_IRUSR | stat.S_IRGRP | stat.S_IROTH)
    return manifest


def verify(spark: SparkSession, folder: str) -> dict[str, Any]:
    """PASS, or the problems: the manifest's own digest, and missing, unexpected or changed files."""
    manifest = json.loads((Path(folder) / MANIFEST).read_text(encoding="utf-8"))
    problems = []
    if digest(canonical_json({k: v for k, v in manifest.items() if k != "manifest_sha256"})) != manifest.get("manifest_sha256"):
        problems.append({"path": MANIFEST, "problem": "manifest_digest_mismatch"})
    listed = spark.createDataFrame([(p, f["sha256"], f["bytes"]) for p, f in manifest.get("files", {}).items()], "path string, sha256 string, bytes long")
    problems += [r.asDict() for r in differences(listed, file_digests(spark, folder)).orderBy("path").collect()]
    return {"status": "FAIL" if problems else "PASS", "run_id": manifest.get("run_id"), "violations": problems}
