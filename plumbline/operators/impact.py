"""Routing by downstream impact: criticality, verified paths, and the strictest required action."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels and actions in rising order, and what an action means for status and exit code.
CRITICALITIES = ["LOW", "MEDIUM", "HIGH"]
ACTIONS = ["AUTO_PR", "REVIEW_REQUIRED", "BLOCK_AUTO_MERGE"]
STATUS = {"AUTO_PR": "PASS", "REVIEW_REQUIRED": "REVIEW", "BLOCK_AUTO_MERGE": "BLOCK"}
EXIT = {"AUTO_PR": 0, "REVIEW_REQUIRED": 3, "BLOCK_AUTO_MERGE": 1}
EXIT_ERROR = 2
MESSAGE = {"AUTO_PR": "Known downstream assets allow an automatic change.", "REVIEW_REQUIRED": "A person has to review the downstream impact.", "BLOCK_AUTO_MERGE": "The downstream impact forbids an automatic merge."}
ASSET_SCHEMA = "urn string, name string, type string, platform string, degree int, criticality string, classifications array<string>, is_representation boolean, lineage_path array<struct<urn:string,type:string>>"


class ImpactError(ValueError):
    """A policy or an asset that can't be routed."""


def checked_policy(policy: dict[str, Any]) -> dict[str, Any]:
    actions = policy.get("actions")
    if not isinstance(actions, dict) or sorted(actions) != sorted(CRITICALITIES) or any(a not in ACTIONS for a in actions.values()):
        raise ImpactError("actions must give an action for LOW, MEDIUM and HIGH")
    if policy.get("default_criticality") not in CRITICALITIES or policy.get("no_downstream_action") not in ACTIONS:
        raise ImpactError("default_criticality or no_downstream_action is unknown")
    return policy


def rank(col: Column, order: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), col)


def path_verified(path: Column, source: Column | str, target: Column) -> Column:
    """At least two nodes, from the source to the target."""
    ends = (F.try_element_at(path, F.lit(1))["urn"] == source) & (F.try_element_at(path, F.lit(-1))["urn"] == target)
    return F.coalesce((F.size(path) >= 2) & ends, F.lit(False))


def routed(assets: DataFrame, source_urn: Column | str, policy: dict[str, Any]) -> DataFrame:
    """assets with ignored, criticality and where it came from, path_verified and required_action."""
    checked_policy(policy)
    source = F.lit(source_urn) if isinstance(source_urn, str) else source_urn
    declared = F.coalesce(F.col("criticality").isin(CRITICALITIES), F.lit(False))
    action = F.element_at(F.create_map(*(x for k, v in policy["actions"].items() for x in (F.lit(k), F.lit(v)))), F.col("criticality"))
    ignored = F.coalesce(F.col("is_representation"), F.lit(False)) if policy.get("ignore_representation_copies") else F.lit(False)
    out = assets.withColumn("ignored", ignored).withColumn("criticality_source", F.when(declared, "datahub").otherwise("policy_default"))
    out = out.withColumn("criticality", F.when(declared, F.col("criticality")).otherwise(policy["default_criticality"]))
    out = out.withColumn("path_verified", path_verified(F.col("lineage_path"), source, F.col("urn"))).withColumn("required_action", action)
    if policy.get("require_verified_paths", True):
        lifted = ~F.col("path_verified") & (rank(F.col("required_action"), ACTIONS) < ACTIONS.index("REVIEW_REQUIRED") + 1)
        out = out.withColumn("required_action", F.when(lifted, "REVIEW_REQUIRED").otherwise(F.col("required_action")))
    return out


def decision(route: DataFrame, policy: dict[str, Any], by: list[str] | None = None) -> DataFrame:
    """One row (or one per `by`): affected, highest_criticality, admission_action, status."""
    live = ~F.col("ignored")
    out = route.groupBy(*(by or [])).agg(
        F.count_if(live).alias("affected"),
        F.max_by(F.when(live, F.col("criticality")), F.when(live, rank(F.col("criticality"), CRITICALITIES))).alias("highest_criticality"),
        F.coalesce(F.max_by(F.when(live, F.col("required_action")), F.when(live, rank(F.col("required_action"), ACTIONS))), F.lit(policy["no_downstream_action"])).alias("admission_action"),
    )
    return out.withColumn("status", F.element_at(F.create_map(*(x for k, v in STATUS.items() for x in (F.lit(k), F.lit(v)))), F.col("admission_action")))


def assess(spark, context: dict[str, Any], policy: dict[str, Any]) -> dict[str, Any]:
    """The gate's report for one context bundle."""
    source = context.get("urn")
    raw = context.get("downstream_assets", [])
    if not isinstance(source, str) or not source or not isinstance(raw, list):
        raise ImpactError("a context needs a urn and a list of downstream_assets")
    rows = []
    for a in raw:
        if not isinstance(a, dict):
            continue
        copy = bool(policy.get("ignore_representation_copies") and a.get("is_representation"))
        if not copy and not (isinstance(a.get("urn"), str) and isinstance(a.get("name"), str)):
            raise ImpactError("every downstream asset needs urn and name")
        path = a.get("lineage_path")
        rows.append((a.get("urn"), a.get("name"), a.get("type", "UNKNOWN"), a.get("platform"), a.get("degree"), a.get("criticality"), a.get("classifications"), bool(a.get("is_representation")), [(p.get("urn"), p.get("type")) for p in path if isinstance(p, dict)] if isinstance(path, list) else None))
    route = routed(spark.createDataFrame(rows, ASSET_SCHEMA), source, policy)
    last = decision(route, policy).first()
    listed = route.collect()  # the assets of one bundle
    affected = [{"urn": r["urn"], "name": r["name"], "type": r["type"], "degree": r["degree"], "criticality": r["criticality"], "criticality_source": r["criticality_source"], "lineage_path": [p.asDict() for p in r["lineage_path"] or []], "lineage_path_verified": r["path_verified"], "required_action": r["required_action"]} for r in listed if not r["ignored"]]
    return {"gate": "downstream_impact", "status": last["status"], "policy_id": policy.get("policy_id", "unknown"), "source_urn": source, "lineage_max_hops": context.get("lineage_max_hops"), "may_affect": [a["name"] for a in affected], "affected_assets": affected, "ignored_assets": [{"urn": r["urn"], "name": r["name"], "reason": "representation_copy"} for r in listed if r["ignored"]], "highest_criticality": last["highest_criticality"], "admission_action": last["admission_action"], "message": MESSAGE[last["admission_action"]]}
