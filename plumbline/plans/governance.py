"""A classification policy over output lineage: which outputs carry denied sources, and what may be done."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import classification_key
from . import lineage

#: Keys of a field under which catalogues keep tags and terms, in many shapes.
TAG_KEYS = ["tags", "globalTags", "editedTags", "glossaryTerms", "editedGlossaryTerms", "classifications"]


class PolicyError(ValueError):
    """A policy that can't be applied."""


def checked_policy(policy: dict[str, Any]) -> dict[str, Any]:
    denied, repair = policy.get("denied_classifications"), policy.get("repair")
    if not isinstance(policy.get("policy_id"), str) or not isinstance(denied, list) or not all(isinstance(x, str) for x in denied):
        raise PolicyError("a policy needs policy_id and denied_classifications")
    if not isinstance(repair, dict) or repair.get("strategy") != "drop_projection":
        raise PolicyError("the only repair strategy is drop_projection")
    return policy


def tokens(value: Any) -> list[str]:
    """Classification tokens in a tag of any shape, each once in order: a string, a urn, a name, a property's name, or lists and wrappers of these."""
    out: list[str] = []

    def take(x: Any) -> None:
        if isinstance(x, str):
            if x and x not in out:
                out.append(x)
        elif isinstance(x, list):
            for y in x:
                take(y)
        elif isinstance(x, dict):
            for key in ("urn", "name"):
                if isinstance(x.get(key), str):
                    take(x[key])
            if isinstance(x.get("properties"), dict):
                take(x["properties"].get("name"))
            for key in ("tag", "term", "tags", "terms"):
                take(x.get(key))

    take(value)
    return out


def field_tokens(field: dict[str, Any]) -> set[str]:
    return {t for key in TAG_KEYS for t in tokens(field.get(key))}


def violations(pairs: DataFrame, tagged: DataFrame, denied: list[str]) -> DataFrame:
    """output_column, source_column, classification: lineage pairs whose source holds a denied classification."""
    bad = tagged.where(F.lower("token").isin([x.casefold() for x in denied])).select(F.lower("column_name").alias("_column"), F.col("token").alias("classification"))
    return pairs.join(bad, F.lower("source_column") == F.col("_column")).select(*pairs.columns, "classification")


def allowed_actions(found: DataFrame, by_class: dict[str, list[str]]) -> DataFrame:
    """found (tokens) with actions: what the policy allows for its classifications, each once, in the order in which their classes appear."""
    table = F.create_map(*(x for k, v in by_class.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    keys = F.array_distinct(F.transform("tokens", classification_key))
    lists = F.transform(keys, lambda k: F.coalesce(F.try_element_at(table, k), F.array().cast("array<string>")))
    return found.withColumn("actions", F.array_distinct(F.flatten(lists)))


def evaluate(spark: SparkSession, sql: str, context: dict[str, Any], policy: dict[str, Any]) -> dict[str, Any]:
    """The gate's report for one query."""
    checked_policy(policy)
    denied = {x.casefold() for x in policy["denied_classifications"]}
    fields = {f["fieldPath"].casefold(): f for f in context["fields"]}
    bad = {k: sorted(t for t in field_tokens(f) if t.casefold() in denied) for k, f in fields.items()}
    found, unresolved, reached = [], [], []
    try:
        outputs = lineage.of_sql(spark, sql, context)
    except lineage.LineageError as e:
        outputs, unresolved = [], [{"output_column": None, "source_columns": [], "unresolved_sources": [str(e)]}]
    for o in outputs:
        found.append({"output_column": o.name, "source_columns": sorted(o.sources), "unresolved_sources": ["unknown_plan_node"] if o.unresolved else []})
        if o.unresolved:
            unresolved.append(found[-1])
        for s in sorted(o.sources):
            if s.casefold() not in fields:
                unresolved.append({"output_column": o.name, "source_columns": [s], "unresolved_sources": ["not_in_context_schema"]})
            elif bad[s.casefold()]:
                reached.append({"output_column": o.name, "source_column": fields[s.casefold()]["fieldPath"], "matched_classifications": bad[s.casefold()], "reason": "sensitive_source_reaches_final_output"})
    closed = bool(policy.get("fail_closed_on_unresolved_lineage", True))
    failed = bool(reached or (closed and unresolved))
    return {
        "gate": "governance",
        "status": "FAIL" if failed else "PASS",
        "policy_id": policy["policy_id"],
        "policy_scope": policy.get("scope", "final_output"),
        "table_name": context["table_name"],
        "sensitive_fields": [{"field": fields[k]["fieldPath"], "matched_classifications": v} for k, v in sorted(bad.items()) if v],
        "output_lineage": found,
        "violations": reached,
        "unresolved_outputs": unresolved,
        "repairable": bool(reached) and not unresolved,
        "message": "Some outputs violate the policy." if failed else "All outputs comply with the policy.",
    }
