"""Context bundles, policies, contracts and benchmark worlds from JSON."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import context_schema
from ..operators.contract import Contract
from ..operators.impact import checked_policy as checked_impact_policy
from ..plans.frontend import quoted
from ..plans.governance import checked_policy as checked_governance_policy
from ..plans.governance import field_tokens

#: A context bundle as a table; tags of any shape become `classifications` before.
CONTEXT_SCHEMA = (
    "table_name string, urn string, lineage_max_hops int,"
    " fields array<struct<fieldPath:string,nativeDataType:string,nullable:boolean,description:string,classifications:array<string>>>,"
    " upstream_tables array<string>,"
    " downstream_assets array<struct<urn:string,name:string,type:string,platform:string,degree:int,criticality:string,"
    "classifications:array<string>,is_representation:boolean,lineage_path:array<struct<urn:string,type:string>>>>"
)


class SourceError(ValueError):
    """A file that isn't what it should be."""


def json_object(path: str | Path, label: str = "file") -> dict[str, Any]:
    try:
        value = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, json.JSONDecodeError) as e:
        raise SourceError(f"{label} can't be read: {e}") from e
    if not isinstance(value, dict):
        raise SourceError(f"{label} must be a JSON object")
    return value


def checked_context(context: dict[str, Any], need_urn: bool = False) -> dict[str, Any]:
    fields = context.get("fields")
    if not isinstance(context.get("table_name"), str) or not isinstance(fields, list) or not fields:
        raise SourceError("a context needs table_name and fields")
    if not all(isinstance(f, dict) and isinstance(f.get("fieldPath"), str) and f["fieldPath"] for f in fields):
        raise SourceError("every field needs a fieldPath")
    if need_urn and not isinstance(context.get("urn"), str):
        raise SourceError("a context needs a urn")
    return context


def load_context(path: str | Path, need_urn: bool = False) -> dict[str, Any]:
    return checked_context(json_object(path, "context"), need_urn)


def load_governance_policy(path: str | Path) -> dict[str, Any]:
    return checked_governance_policy(json_object(path, "policy"))


def load_impact_policy(path: str | Path) -> dict[str, Any]:
    return checked_impact_policy(json_object(path, "impact policy"))


def load_contract(path: str | Path) -> Contract:
    return Contract.of(json_object(path, "contract"))


def context_table(spark: SparkSession, contexts: list[dict[str, Any]]) -> DataFrame:
    """Bundles as a DataFrame of one row each."""
    plain = [c | {"fields": [f | {"classifications": sorted(field_tokens(f))} for f in c["fields"]]} for c in contexts]
    lines = spark.createDataFrame([(json.dumps(c),) for c in plain], "value string")
    return lines.select(F.from_json("value", CONTEXT_SCHEMA).alias("c")).select("c.*")


def load_benchmark(path: str | Path) -> list[dict[str, Any]]:
    """Worlds with their contexts; rows must be as wide as the schema, tasks need id, prompt and reference_sql."""
    worlds = json_object(path, "benchmark").get("worlds")
    if not isinstance(worlds, list) or not worlds:
        raise SourceError("a benchmark needs worlds")
    out = []
    for w in worlds:
        context = load_context(Path(path).parent / w["context_file"])
        if any(len(r) != len(context["fields"]) for r in w.get("rows", [])):
            raise SourceError(f"a row of world {w.get('id')} is not as wide as its schema")
        if not all(all(isinstance(t.get(k), str) for k in ("id", "prompt", "reference_sql")) for t in w.get("tasks", [])):
            raise SourceError(f"a task of world {w.get('id')} lacks id, prompt or reference_sql")
        out.append(w | {"context": context})
    return out


def world_table(spark: SparkSession, context: dict[str, Any], rows: list[list[Any]]) -> DataFrame:
    """Literal rows as the context's table, cast to its declared types, registered as a view of its name."""
    schema = context_schema(context["fields"])
    text = [tuple(None if v is None else str(v) for v in r) for r in rows]
    raw = spark.createDataFrame(text, ", ".join(f"c{i} string" for i in range(len(schema)))) if text else spark.createDataFrame([], ", ".join(f"c{i} string" for i in range(len(schema))))
    table = raw.select(*(F.col(f"c{i}").cast(f.dataType).alias(f.name, metadata=f.metadata) for i, f in enumerate(schema.fields)))
    table.createOrReplaceTempView(quoted(context["table_name"]))
    return table


def parquet_views(spark: SparkSession, folder: str, names: list[str]) -> None:
    """The tables of a folder as views; a missing one is an error."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(quoted(name))
