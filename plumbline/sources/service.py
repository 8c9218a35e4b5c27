"""What a metadata service returns: tool results, pages of schema fields, search hits and lineage."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators import graph

PAGE = 5
ENTITY_SCHEMA = "urn string, name string, type string, platform string, degree int, tokens array<string>, paths array<array<struct<urn:string,type:string>>>"


class ServiceError(RuntimeError):
    """An answer that can't be used."""


def tool_json(blocks: list[dict[str, Any]]) -> dict[str, Any]:
    """The JSON object in a tool's text blocks, joined."""
    try:
        value = json.loads("".join(b.get("text", "") for b in blocks if b.get("type", "text") == "text"))
    except json.JSONDecodeError as e:
        raise ServiceError(f"a tool's answer is no JSON: {e}") from e
    if not isinstance(value, dict):
        raise ServiceError("a tool's answer is no object")
    return value


def schema_fields(fetch: Callable[[int, int], dict[str, Any]]) -> Iterator[dict[str, Any]]:
    """All fields of a dataset, page by page: fetch(offset, limit) gives fields, offset, and totalFields or remainingCount."""
    at = 0
    while True:
        page = fetch(at, PAGE)
        fields = page.get("fields")
        if not isinstance(fields, list):
            raise ServiceError("a page without fields")
        yield from fields
        then = int(page.get("offset", at)) + len(fields)
        left = page["remainingCount"] if "remainingCount" in page else page.get("totalFields", then) - then
        if left <= 0:
            return
        if then <= at:
            raise ServiceError("pages make no progress while fields remain")
        at = then


def build_context(spark: SparkSession, keyword: str, search: Callable[[str], list[dict[str, Any]]], fetch: Callable[[str, int, int], dict[str, Any]], upstream: Callable[[str], list[str]], downstream: Callable[[str], DataFrame], hops: int = graph.MAX_HOPS) -> dict[str, Any]:
    """A context bundle for the dataset that a keyword means; downstream gives entities of ENTITY_SCHEMA with their paths, so that no path needs a call of its own."""
    hits = spark.createDataFrame([(h.get("urn"), h.get("name"), i) for i, h in enumerate(search(keyword))], "urn string, name string, position int")
    found = graph.preferred(hits, keyword).first()
    if found is None:
        raise ServiceError(f"no dataset for {keyword!r}")
    names = spark.createDataFrame([(n, i) for i, n in enumerate(upstream(found["urn"]))], "name string, position int")
    assets = graph.assets(downstream(found["urn"]), found["name"]).orderBy("degree", "urn").limit(graph.MAX_RESULTS)
    return {
        "table_name": found["name"].rpartition(".")[2],
        "urn": found["urn"],
        "fields": list(schema_fields(lambda offset, limit: fetch(found["urn"], offset, limit))),
        "upstream_tables": [r["short_name"] for r in graph.ordered_distinct(names, "name", "position").orderBy("first_position").collect()],
        "downstream_assets": [r.asDict(recursive=True) for r in assets.collect()],
        "lineage_max_hops": hops,
    }
