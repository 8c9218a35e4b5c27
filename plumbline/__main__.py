"""Command lines over files: python -m plumbline COMMAND ... ; exit codes 0 pass, 1 block, 2 error, 3 review."""

from __future__ import annotations

import argparse
import datetime
import importlib
import json
import sys
from pathlib import Path
from typing import Any

from .functions.values import plain
from .operators import admission, contract, impact, provenance, runtime, score
from .plans import governance, repair, schema_gate
from .session import session
from .sources import config, sinks, texts

PASSED, BLOCKED, ERROR = 0, 1, impact.EXIT_ERROR


def _parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("plumbline", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *files: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        for f in files:
            p.add_argument(f"--{f}", required=True)
        p.add_argument("--report", help="a file for the report; standard output without it")
        p.add_argument("--master", help="Spark's master")
        return p

    command("schema", "column references against a context", "sql", "context")
    command("governance", "a classification policy over lineage", "sql", "context", "policy").add_argument("--repaired", help="a file for the query without violating projections")
    command("impact", "routing by downstream assets", "context", "policy")
    command("result", "a contract over a query's result", "sql", "contract", "tables")
    command("admit", "schema, governance, one projection repair, impact", "sql", "context", "policy", "impact-policy").add_argument("--task", default="")
    command("verify", "a sealed run's manifest", "run")
    for name, text, files in (("assure", "blind and grounded candidates of one task, all gates, one repair, a sealed run", ("task-file", "context", "policy", "contract", "tables", "runs")), ("benchmark", "all tasks of a benchmark in all modes, and the published score", ("benchmark", "policy", "runs"))):
        p = command(name, text, *files)
        p.add_argument("--generate", required=True, help="MODULE:FUNCTION that answers (task, system prompt) with SQL")
        p.add_argument("--repair", help="MODULE:FUNCTION that mends (sql, failure report, context, task); violating projections are dropped without it")
        p.add_argument("--run-id", default=datetime.datetime.now(datetime.UTC).strftime("%Y%m%dT%H%M%SZ"))
        if name == "benchmark":
            p.add_argument("--workers", type=int, default=3)
    command("score", "stored candidates TASK__MODE.sql of a benchmark", "benchmark", "candidates", "policy").add_argument("--modes", nargs="+", default=["blind", "context", "assurance"])
    return out


def _named(what: str):
    """A function by MODULE:FUNCTION."""
    module, _, name = what.partition(":")
    return getattr(importlib.import_module(module), name)


def _verdict(report: dict[str, Any]) -> int:
    return PASSED if report["status"] == "PASS" else BLOCKED


def _run(args: argparse.Namespace) -> tuple[dict[str, Any], int]:
    spark = session("plumbline", args.master)
    text = lambda path: Path(path).read_text(encoding="utf-8")
    if args.command == "schema":
        report = schema_gate.validate(spark, text(args.sql), config.load_context(args.context))
    elif args.command == "governance":
        sql, context, policy = text(args.sql), config.load_context(args.context), config.load_governance_policy(args.policy)
        report = governance.evaluate(spark, sql, context, policy)
        if args.repaired and report["status"] == "FAIL":
            report = repair.governed_repair(spark, sql, context, policy)
            sinks.write_new_text(args.repaired, report["repaired_sql"])
    elif args.command == "impact":
        report = impact.assess(spark, config.load_context(args.context, need_urn=True), config.load_impact_policy(args.policy))
        return report, impact.EXIT[report["admission_action"]]
    elif args.command == "result":
        config.parquet_views(spark, args.tables, [p.name.removesuffix(".parquet") for p in sorted(Path(args.tables).glob("*.parquet"))])
        ran = runtime.execute(spark, text(args.sql))
        found = contract.evaluate(ran.result, config.load_contract(args.contract))
        report = {"status": "PASS" if ran.report["status"] == found["status"] == "PASS" else "FAIL", "runtime": ran.report, "result": found}
    elif args.command == "admit":
        policy = config.load_governance_policy(args.policy)
        report = admission.admit(spark, text(args.sql), config.load_context(args.context, need_urn=True), policy, config.load_impact_policy(args.impact_policy), args.task, admission.projection_repair(spark, policy), str(Path(args.sql).resolve()))
        return report, report["exit_code"]
    elif args.command in ("assure", "benchmark"):
        policy = config.load_governance_policy(args.policy)
        generate, repair_ = _named(args.generate), _named(args.repair) if args.repair else admission.projection_repair(spark, policy)
        if args.command == "benchmark":
            found = admission.benchmark_run(spark, args.benchmark, generate, repair_, policy, args.runs, args.run_id, args.workers)
            return {"status": "PASS", "run_id": found["run_id"], "tasks": found["tasks"], "ready": found["ready"], "repairs": found["repairs"]}, PASSED
        config.parquet_views(spark, args.tables, [p.name.removesuffix(".parquet") for p in sorted(Path(args.tables).glob("*.parquet"))])
        report = admission.assurance_run(spark, args.runs, args.run_id, text(args.task_file).strip(), config.load_context(args.context), policy, config.load_contract(args.contract), generate, repair_)
    elif args.command == "verify":
        report = provenance.verify(spark, args.run)
    else:
        tasks = [t["id"] for w in config.load_benchmark(args.benchmark) for t in w["tasks"]]
        stored = texts.candidates(texts.whole_texts(spark, args.candidates), spark.createDataFrame([(t,) for t in tasks], "task_id string"), args.modes)
        there = {(r["task_id"], r["mode"]): r["sql"] or "" for r in stored.where("state <> 'missing'").collect()}  # as many as the benchmark has tasks
        found = admission.outcomes(spark, args.benchmark, there | {("", m): "" for m in args.modes}, config.load_governance_policy(args.policy))
        report = {"status": "PASS", "rollups": [r.asDict() for r in score.rollups(found).orderBy("level", "mode", "gate", "world").collect()]}
    return report, _verdict(report)


def main(words: list[str] | None = None) -> int:
    args = _parser().parse_args(words)
    try:
        report, code = _run(args)
    except Exception as e:  # noqa: BLE001  whatever goes wrong is exit code 2
        report, code = {"status": "ERROR", "error_type": type(e).__name__, "message": str(e)}, ERROR
    if args.report:
        sinks.write_json(args.report, admission.relative_paths(report, Path.cwd()))
    else:
        print(json.dumps(report, indent=2, ensure_ascii=False, default=plain))
    return code


if __name__ == "__main__":
    sys.exit(main())
