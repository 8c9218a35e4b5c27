"""Contracts, comparison, routing, scoring, graphs, provenance, memory and admission."""

import contextlib
import datetime
import decimal
import io
import json
import random
import re

import pytest

from plumbline.operators import admission, compare, contract, graph, impact, memory, provenance, runtime, score
from plumbline.operators.positions import with_position
from plumbline.sources import config, service, sinks

RULES = {"contract_id": "c", "required_columns": ["customer_key", "lifetime_value", "value_quintile"], "exact_row_count": 2, "non_null_columns": ["lifetime_value"], "null_defaults": {"lifetime_value": {"value": 0, "expected_replacements": 1}}, "unique_columns": ["customer_key"], "numeric_ranges": {"value_quintile": {"min": 1, "max": 2}}, "value_counts": {"value_quintile": {"1": 1, "2": 1}}}
SCHEMA = "customer_key int, lifetime_value double, value_quintile int"


@pytest.mark.parametrize(
    ("rows", "types"),
    [
        ([(1, 0.0, 1), (2, 12.5, 2)], set()),
        ([(1, None, 1), (2, 12.5, 2)], {"unexpected_nulls", "null_default_count_mismatch"}),
        ([(1, -1.0, 1), (2, 12.5, 2)], {"null_default_count_mismatch"}),
        ([(1, 0.0, 1), (1, 12.5, 3)], {"uniqueness_violation", "numeric_range_violation", "value_count_mismatch"}),
        ([], {"row_count_mismatch", "null_default_count_mismatch", "value_count_mismatch"}),
    ],
)
def test_contract(spark, rows, types):
    report = contract.evaluate(spark.createDataFrame(rows, SCHEMA), RULES)
    assert {v["type"] for v in report["violations"]} == types
    assert report["status"] == ("FAIL" if types else "PASS")


def test_contract_details(spark):
    assert contract.evaluate(None, RULES)["status"] == "SKIPPED"
    df = spark.createDataFrame([(None, "x"), (None, "y"), (1, None)], "a int, B string").coalesce(1)
    report = contract.evaluate(df, {"contract_id": "c", "unique_columns": ["A"], "numeric_ranges": {"b": {"min": 0}}, "non_null_columns": ["a"], "value_counts": {"a": {"None": 2, "1": 1}}, "allow_extra_columns": False, "required_columns": ["a"]})
    by = {v["type"]: v for v in report["violations"]}
    assert by["uniqueness_violation"]["duplicate_count"] == 1  # nulls are one value
    assert by["numeric_range_violation"]["invalid_count"] == 2  # text is out of any range
    assert by["unexpected_nulls"]["sample_row_numbers"] == [1, 2]
    assert by["unexpected_output_columns"]["columns"] == ["B"] and "value_count_mismatch" not in by
    twice = spark.sql("select 1 as a, 2 as A")
    assert contract.evaluate(twice, {"contract_id": "c"})["violations"][0]["type"] == "duplicate_output_columns"
    for bad in ({}, {"contract_id": "c", "exact_row_count": -1}, {"contract_id": "c", "unique_columns": "x"}):
        with pytest.raises(contract.ContractError):
            contract.evaluate(twice, bad)


def test_compare(spark):
    want = spark.createDataFrame([("HIGH", 2), ("LOW", 3)], "segment string, customer_count int").orderBy("segment")
    assert compare.compare(want, want)["status"] == "PASS"
    assert compare.compare(want.toDF("SEGMENT", "n"), want)["issues"][0]["type"] == "column_contract_mismatch"
    assert [i["row_number"] for i in compare.compare(want.orderBy("customer_count", ascending=False), want)["issues"]] == [1, 2]
    assert compare.compare(want.limit(1), want)["issues"][0]["type"] == "row_count_mismatch"
    assert compare.compare(None, want)["status"] == "SKIPPED"
    a = spark.createDataFrame([(decimal.Decimal("1.50"), datetime.date(2026, 1, 1), None)], "x decimal(12,2), d date, n int")
    b = spark.createDataFrame([(1.5 + 1e-10, datetime.datetime(2026, 1, 1), None)], "x double, d timestamp_ntz, n int")
    assert compare.compare(a, b)["status"] == "PASS"


def test_positions_follow_the_order(spark):
    df = spark.range(1000).repartition(7).orderBy("id")
    assert all(r["row_number"] == r["id"] + 1 for r in with_position(df).collect())


POLICY = {"policy_id": "p", "ignore_representation_copies": True, "require_verified_paths": True, "default_criticality": "MEDIUM", "no_downstream_action": "AUTO_PR", "actions": {"LOW": "AUTO_PR", "MEDIUM": "REVIEW_REQUIRED", "HIGH": "BLOCK_AUTO_MERGE"}}


def asset(level, copy=False, path=True):
    return {"urn": f"u{level}", "name": f"n{level}", "criticality": level, "is_representation": copy, "lineage_path": [{"urn": "src"}, {"urn": f"u{level}"}] if path else []}


@pytest.mark.parametrize(
    ("assets", "action", "highest"),
    [
        ([asset("LOW")], "AUTO_PR", "LOW"),
        ([asset("MEDIUM")], "REVIEW_REQUIRED", "MEDIUM"),
        ([asset("LOW"), asset("HIGH")], "BLOCK_AUTO_MERGE", "HIGH"),
        ([asset("HIGH", copy=True)], "AUTO_PR", None),
        ([asset(None)], "REVIEW_REQUIRED", "MEDIUM"),
        ([asset("LOW", path=False)], "REVIEW_REQUIRED", "LOW"),
        ([], "AUTO_PR", None),
    ],
)
def test_impact(spark, assets, action, highest):
    report = impact.assess(spark, {"urn": "src", "downstream_assets": assets}, POLICY)
    assert (report["admission_action"], report["highest_criticality"]) == (action, highest)


def test_reachable_ends_cycles_and_keeps_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("a", "c")], "src string, dst string")
    got = {r["node"]: (r["degree"], r["path"]) for r in graph.reachable(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"b": (1, ["a", "b"]), "c": (1, ["a", "c"]), "d": (2, ["a", "c", "d"]), "e": (3, ["a", "c", "d", "e"])}
    edges.createOrReplaceTempView("edges_view")
    rows = {r["node"]: r["degree"] for r in spark.sql(graph.reachable_sql("edges_view", "'a'")).collect()}
    assert {k: v for k, v in rows.items() if k != "a"} == {k: v[0] for k, v in got.items()}


def test_service(spark):
    pages = {0: {"fields": [{"fieldPath": "a"}, {"fieldPath": "b"}], "offset": 0, "totalFields": 3}, 2: {"fields": [{"fieldPath": "c"}], "offset": 2, "totalFields": 3}}
    assert [f["fieldPath"] for f in service.schema_fields(lambda at, n: pages[at])] == ["a", "b", "c"]
    with pytest.raises(service.ServiceError):
        list(service.schema_fields(lambda at, n: {"fields": [], "offset": at, "totalFields": 3}))
    found = spark.createDataFrame([("u1", "m.t", "DATASET", "dbt", 1, ["criticality-high"], [[("s", "D"), (None, "D"), ("u1", "D")]]), ("u2", "x.customers", "DATASET", "db", 1, [], None), (None, "z", None, None, None, None, None)], service.ENTITY_SCHEMA)
    hits = [{"urn": "dbt:1", "name": "m.customers_old"}, {"urn": "dbt:2", "name": "m.Customers"}, {"urn": "pg:3", "name": "customers"}]
    c = service.build_context(spark, "customers", lambda k: hits, lambda u, at, n: pages[at], lambda u: ["m.b", "m.a", "n.b"], lambda u: found)
    assert c["urn"] == "dbt:2" and c["upstream_tables"] == ["b", "a"]
    assert [(a["criticality"], a["is_representation"], len(a["lineage_path"])) for a in sorted(c["downstream_assets"], key=lambda a: a["urn"])] == [("HIGH", False, 2), (None, True, 0)]
    assert service.tool_json([{"text": '{"a":'}, {"type": "image"}, {"text": "1}"}]) == {"a": 1}
    assert config.context_table(spark, [c | {"fields": [{"fieldPath": "a", "editedTags": ["PII"]}]}]).first()["fields"][0]["classifications"] == ["PII"]


def test_seal_and_verify(spark, tmp_path):
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql" / "candidate.sql").write_text("select 1\n")
    provenance.seal(spark, str(tmp_path), "r1")
    assert provenance.verify(spark, str(tmp_path))["status"] == "PASS"
    (tmp_path / "sql" / "candidate.sql").chmod(0o644)
    (tmp_path / "sql" / "candidate.sql").write_text("select 2\n")
    (tmp_path / "new.txt").write_text("x")
    report = provenance.verify(spark, str(tmp_path))
    assert {(v["path"], v["problem"]) for v in report["violations"]} == {("sql/candidate.sql", "file_digest_mismatch"), ("new.txt", "unexpected_file")}


def test_memory(spark):
    log = [("u", "Task: t1\nNote: n1")]
    read = lambda: spark.createDataFrame(log, "url string, description string")
    write = lambda df: log.extend(tuple(r) for r in df.collect())
    entries = spark.createDataFrame([("u", "t1", "n1", "Task: t1\nNote: n1"), ("u", "t2", "n2", "Task: t2\nNote: n2")], "url string, task string, note string, description string")
    assert memory.append(entries, read, write) == "APPENDED" and len(log) == 2
    assert memory.append(entries, read, write) == "UNCHANGED" and len(log) == 2
    with pytest.raises(RuntimeError):
        memory.append(entries.withColumn("task", entries["note"]), read, lambda df: None, 0)
    tags = spark.createDataFrame([("a", "PII")], "field string, tag string")
    with pytest.raises(ValueError):
        memory.with_tags(tags, tags, spark.createDataFrame([("b",)], "field string"))
    a = spark.createDataFrame([("u1", "x"), ("u2", "y")], "urn string, name string")
    assert sorted(memory.graph_mismatches(a, spark.createDataFrame([("u1", "z")], "urn string, name string"), ["name"]).collect()) == [("u1", "mismatched"), ("u2", "missing")]


CONTEXT = {"table_name": "customers", "urn": "src", "fields": [{"fieldPath": "customer_id", "nativeDataType": "INTEGER"}, {"fieldPath": "first_name", "nativeDataType": "VARCHAR", "editedTags": ["PII"]}, {"fieldPath": "customer_lifetime_value", "nativeDataType": "DOUBLE"}], "downstream_assets": [asset("LOW")]}
GOVERNANCE = {"policy_id": "g", "denied_classifications": ["PII"], "allowed_actions_by_classification": {"PII": ["exclude"]}, "repair": {"strategy": "drop_projection"}}


def test_admission(spark):
    calls = []

    def fix(sql, report, context, task):
        calls.append(report)
        return "select customer_id from customers"

    good = admission.admit(spark, "select customer_id, first_name from customers", CONTEXT, GOVERNANCE, POLICY, "t", fix)
    assert (good["status"], good["admission_action"], good["repair"]["status"], len(calls)) == ("PASS", "AUTO_PR", "PASS", 1)
    same = admission.admit(spark, "select first_name from customers", CONTEXT, GOVERNANCE, POLICY, "t", lambda sql, *a: sql)
    assert (same["admission_action"], same["repair"]["status"], same["repair"]["attempts"]) == ("BLOCK_AUTO_MERGE", "FAIL", 1)

    def broken(*a):
        raise TimeoutError("provider")

    assert admission.admit(spark, "select first_name from customers", CONTEXT, GOVERNANCE, POLICY, "t", broken)["repair"]["status"] == "ERROR"
    none = admission.admit(spark, "select first_name from customers", CONTEXT, GOVERNANCE | {"allowed_actions_by_classification": {}}, POLICY, "t", fix)
    assert none["repair"]["status"] == "BLOCKED_NO_ALLOWED_REPAIR" and "repair" in none["reason"] and none["candidate_file"] is None
    assert good["reason"] == good["gates"]["downstream_impact"]["message"] and good["gates"]["final_schema"]["status"] == "PASS"
    assert admission.admit(spark, "select customer_id from customers", CONTEXT, GOVERNANCE, POLICY, "t", None, "a.sql")["candidate_file"] == "a.sql"


def test_assurance_run(spark, tmp_path):
    spark.createDataFrame([(1, "Ada", None), (2, "Grace", 12.5)], "customer_id int, first_name string, customer_lifetime_value double").createOrReplaceTempView("customers")
    rules = contract.Contract.of({"contract_id": "c", "exact_row_count": 2, "non_null_columns": ["v"], "unique_columns": ["customer_id"]})
    generate = lambda task, prompt: "```sql\nselect name from customers\n```" if "No schema" in prompt else "select customer_id, first_name, customer_lifetime_value as v from {{ ref('customers') }}"
    report = admission.assurance_run(spark, tmp_path, "r1", "t", CONTEXT, GOVERNANCE, rules, generate, lambda *a: "select customer_id, coalesce(customer_lifetime_value, 0) as v from customers")
    assert report["status"] == "PASS" and report["repair"]["attempts"] == 1
    assert [g["status"] for g in report["candidates"]["blind"]] == ["FAIL", "FAIL", "SKIPPED", "SKIPPED"]
    assert provenance.verify(spark, str(tmp_path / "r1"))["status"] == "PASS"
    with pytest.raises(FileExistsError):
        admission.assurance_run(spark, tmp_path, "r1", "t", CONTEXT, GOVERNANCE, rules, generate, None)


def test_benchmark_replay(spark, tmp_path):
    context = {"table_name": "orders", "fields": [{"fieldPath": "order_id", "nativeDataType": "INTEGER"}, {"fieldPath": "order_date", "nativeDataType": "DATE"}, {"fieldPath": "total_amount", "nativeDataType": "DECIMAL(12,2)"}]}
    (tmp_path / "orders.json").write_text(json.dumps(context))
    world = {"id": "w", "context_file": "orders.json", "rows": [[1, "2026-01-05", 120.5], [2, "2026-01-20", 80.0], [3, "2026-02-02", None]], "tasks": [{"id": "t", "prompt": "p", "reference_sql": "select cast(date_trunc('month', order_date) as date) as m, sum(total_amount) as s from orders group by 1 order by 1"}]}
    (tmp_path / "worlds.json").write_text(json.dumps({"worlds": [world]}))
    found = admission.outcomes(spark, tmp_path / "worlds.json", {("t", "good"): "select date_trunc('month', order_date) as m, round(sum(total_amount), 2) as s from {{ ref('orders') }} group by 1 order by m", ("t", "bad"): "select month as m, 1 as s from orders", ("x", "none"): ""}, GOVERNANCE)
    assert {r["mode"]: r["ready"] for r in admission.ready_counts(found).collect()} == {"good": 1, "bad": 0, "none": 0}
    rolled = score.rollups(found)
    assert rolled.where("mode = 'none' and gate = 'ready' and level = 'mode'").first()["total"] == 1
    assert "| mode | good | ready | 1 | 1 | 100.0% |" in sinks.markdown(rolled)
    world["rows"].append([1])
    (tmp_path / "worlds.json").write_text(json.dumps({"worlds": [world]}))
    with pytest.raises(config.SourceError):
        config.load_benchmark(tmp_path / "worlds.json")


def test_runtime_refuses_commands(spark):
    assert runtime.execute(spark, "drop view if exists x").report["status"] == "FAIL"
    ran = runtime.execute(spark, "select 1 as a, date'2026-01-02' as d")
    assert ran.report["preview"] == [{"a": 1, "d": "2026-01-02"}]


def test_new_files_only(tmp_path):
    sinks.write_new_text(tmp_path / "a" / "b.txt", "x")
    with pytest.raises(FileExistsError):
        sinks.write_new_text(tmp_path / "a" / "b.txt", "y")


def test_generate_all_keeps_failures():
    assert admission.generate_all([("a", "p"), ("b", "p")], lambda t, p: "ok" if t == "a" else 1 / 0) == ["ok", None]


def test_admission_survives_plans_that_nothing_understands(spark):
    report = admission.admit(spark, "select id from (values (1)) v(id)", CONTEXT, GOVERNANCE, POLICY, "t", None)
    assert report["gates"]["initial_schema"]["status"] == "PASS"
    fixed = admission.admit(spark, "select customer_id, first_name from customers", CONTEXT, GOVERNANCE, POLICY, "t", admission.projection_repair(spark, GOVERNANCE))
    assert (fixed["repair"]["status"], fixed["admission_action"]) == ("PASS", "AUTO_PR")


def test_contract_lists_few_of_many_unexpected_values(spark):
    report = contract.evaluate(spark.range(5000).selectExpr("id as k"), {"contract_id": "c", "value_counts": {"k": {"1": 1, "9999": 2}}})
    found = report["violations"][0]
    assert found["type"] == "value_count_mismatch" and found["unexpected_values"] == 4999 and len(found["actual"]) == 1 + contract.UNEXPECTED


def test_absent_entries_are_found_by_equal_keys(spark):
    rng = random.Random(5)
    bits = ["Task: ", "Note: ", "a", "b", "ä", "", "\n", "a.b"]

    def some(n):
        return None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, n)))

    entries = [(rng.choice(["u", "v", None]), some(2), some(2), i) for i in range(300)]
    log = [(rng.choice(["u", "v", None]), some(9)) for _ in range(40)]

    def held(url, task, note):
        return None not in (url, task, note) and any(u == url and d is not None and f"Task: {task}" in d and f"Note: {note}" in d for u, d in log)

    df = spark.createDataFrame(entries, "url string, task string, note string, i int")
    got = memory.absent(df, spark.createDataFrame(log, "url string, description string"))
    want = [e for e in entries if not held(*e[:3])]
    assert got.columns == df.columns and sorted(got.collect(), key=lambda r: r["i"]) == want and 50 < len(want) < 290
    assert memory.absent(df.limit(0), spark.createDataFrame(log, "url string, description string")).count() == 0
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        got.explain()
    assert "NestedLoop" not in re.sub(r"BroadcastNestedLoopJoin BuildRight, Cross", "", shown.getvalue())
    anti = next(x for x in shown.getvalue().splitlines() if "LeftAnti" in x)
    assert all(f"{k}#" in anti for k in ("task", "_task", "note", "_note"))  # before: url alone, and every pair of a url compared


def test_assurance_run_writes_back(spark, tmp_path):
    spark.createDataFrame([(1, 12.5)], "customer_id int, customer_lifetime_value double").createOrReplaceTempView("customers")
    log = []
    read = lambda: spark.createDataFrame(log, "url string, description string")
    write_back = lambda e: memory.append(e, read, lambda df: log.extend(tuple(r) for r in df.collect()))
    run = lambda name, back: admission.assurance_run(spark, tmp_path, name, "t", CONTEXT, GOVERNANCE, contract.Contract.of({"contract_id": "c"}), lambda *a: "select customer_id from customers", None, back, tmp_path)
    first = run("r1", write_back)
    assert first["status"] == "PASS" and first["write_back"] == {"status": "APPENDED"} and first["git"]["available"] is False
    assert run("r2", write_back)["write_back"] == {"status": "UNCHANGED"} and len(log) == 1 and "Task: t" in log[0][1]
    assert run("r3", lambda e: 1 / 0)["write_back"]["error_type"] == "ZeroDivisionError"
    assert run("r4", None)["write_back"]["status"] == "NOT_REQUESTED"


def benchmark_files(tmp_path):
    context = {"table_name": "orders", "fields": [{"fieldPath": "order_id", "nativeDataType": "INTEGER"}, {"fieldPath": "total_amount", "nativeDataType": "DECIMAL(12,2)"}]}
    tasks = [{"id": f"t{i}", "prompt": f"p{i}", "reference_sql": "select order_id, total_amount from orders order by order_id"} for i in range(3)]
    (tmp_path / "orders.json").write_text(json.dumps(context))
    (tmp_path / "worlds.json").write_text(json.dumps({"worlds": [{"id": "w", "context_file": "orders.json", "rows": [[1, 120.5], [2, 80.0]], "tasks": tasks}]}))
    return tmp_path / "worlds.json"


def test_benchmark_run(spark, tmp_path):
    good = "select order_id, total_amount from orders order by order_id"

    def generate(task, prompt):
        if task == "p2":
            raise TimeoutError
        return good if task == "p0" and "orders" in prompt else "select order_id, amount as total_amount from orders order by 1"

    report = admission.benchmark_run(spark, benchmark_files(tmp_path), generate, lambda sql, *a: good, GOVERNANCE, tmp_path / "out", "r1")
    assert report["ready"] == {"blind": 0, "context": 1, "assurance": 2} and report["tasks"] == 3
    assert (report["repairs"]["repairs_attempted"], report["repairs"]["repairs_passed"]) == (1, 1)
    assert json.loads((tmp_path / "out" / "latest.json").read_text())["run_id"] == "r1" and (tmp_path / "out" / "r1" / "sql" / "t1__assurance.sql").read_text().strip() == good
    assert "| mode | assurance | ready | 2 | 3 | 66.7% |" in (tmp_path / "out" / "summary.md").read_text()
    assert [g["status"] for g in report["gates"]["t2/context"]] == ["SKIPPED"] * 4


def test_command_lines(spark, tmp_path, capsys):
    from plumbline.__main__ import main

    def put(name, value):
        (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
        return str(tmp_path / name)

    context, policy, routes = put("c.json", CONTEXT), put("p.json", GOVERNANCE), put("i.json", POLICY)
    bad, good = put("bad.sql", "select customer_id, first_name from customers"), put("good.sql", "select customer_id from customers")
    assert main(["schema", "--sql", good, "--context", context]) == 0 and json.loads(capsys.readouterr().out)["status"] == "PASS"
    assert main(["schema", "--sql", put("x.sql", "select nothing from customers"), "--context", context, "--report", str(tmp_path / "r.json")]) == 1
    assert json.loads((tmp_path / "r.json").read_text())["hallucinated_columns"] == ["nothing"]
    assert main(["governance", "--sql", bad, "--context", context, "--policy", policy]) == 1
    assert main(["governance", "--sql", bad, "--context", context, "--policy", policy, "--repaired", str(tmp_path / "fixed.sql")]) == 0 and "first_name" not in (tmp_path / "fixed.sql").read_text()
    assert main(["admit", "--sql", bad, "--context", context, "--policy", policy, "--impact-policy", routes]) == 0
    high = put("h.json", CONTEXT | {"downstream_assets": [asset("HIGH")]})
    medium = put("m.json", CONTEXT | {"downstream_assets": [asset("MEDIUM")]})
    assert [main(["impact", "--context", c, "--policy", routes]) for c in (context, high, medium)] == [0, 1, 3]
    assert main(["schema", "--sql", str(tmp_path / "none.sql"), "--context", context]) == 2
    spark.createDataFrame([(1,), (2,)], "customer_id int").write.parquet(str(tmp_path / "customers.parquet"))
    rules = put("k.json", {"contract_id": "c", "exact_row_count": 2})
    assert main(["result", "--sql", good, "--contract", rules, "--tables", str(tmp_path)]) == 0
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "a.txt").write_text("x")
    provenance.seal(spark, str(tmp_path / "run"), "r")
    assert main(["verify", "--run", str(tmp_path / "run")]) == 0
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql" / "t0__blind.sql").write_text("select order_id, total_amount from orders order by order_id")
    capsys.readouterr()
    assert main(["score", "--benchmark", str(benchmark_files(tmp_path)), "--candidates", str(tmp_path / "sql"), "--policy", policy, "--modes", "blind"]) == 0
    assert {(r["passed"], r["total"]) for r in json.loads(capsys.readouterr().out)["rollups"] if r["level"] == "mode"} == {(1, 3)}


def test_streaming_counts(spark, tmp_path):
    from plumbline.streaming import running_counts

    spark.createDataFrame([(datetime.datetime(2026, 1, 1, 0, 5), 1.0), (datetime.datetime(2026, 1, 1, 0, 50), None), (datetime.datetime(2026, 1, 1, 5, 0), 3.0)], "ts timestamp, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = running_counts(stream, "v", "ts").writeStream.format("memory").queryName("counts_out").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["row_count"], r["null_count"]) for r in spark.table("counts_out").collect()) == [(1, 0), (2, 1)]


ANSWERS = """
def answer(task, system):
    return "select customer_id from customers" if "customer_id" in system else "```sql\\nselect nobody from customers\\n```"

def mend(sql, report, context, task):
    raise RuntimeError("away")
"""


def test_command_lines_of_runs(spark, tmp_path, capsys, monkeypatch):
    """A whole run of one task, and a whole benchmark, with answers by a named function."""
    from plumbline.__main__ import main

    (tmp_path / "answers.py").write_text(ANSWERS)
    monkeypatch.syspath_prepend(str(tmp_path))

    def put(name, value):
        (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
        return str(tmp_path / name)

    spark.createDataFrame([(1, "a", 2.0)], "customer_id int, first_name string, customer_lifetime_value double").write.parquet(str(tmp_path / "tables" / "customers.parquet"))
    files = {"context": put("context.json", CONTEXT), "policy": put("policy.json", GOVERNANCE), "contract": put("contract.json", {"contract_id": "c", "required_columns": ["customer_id"], "exact_row_count": 1}), "task-file": put("task.txt", "all customers\n"), "tables": str(tmp_path / "tables"), "runs": str(tmp_path / "runs")}
    words = ["assure", *(w for k, v in files.items() for w in (f"--{k}", v)), "--generate", "answers:answer", "--run-id", "one"]
    assert main(words) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["status"] == "PASS" and report["candidates"]["blind"][0]["status"] == "FAIL" and report["repair"]["status"] == "NOT_NEEDED"
    assert main(["verify", "--run", str(tmp_path / "runs" / "one")]) == 0
    assert main(words) == 2  # a run's name is taken once
    capsys.readouterr()
    words = ["benchmark", "--benchmark", str(benchmark_files(tmp_path)), "--policy", files["policy"], "--runs", str(tmp_path / "scores"), "--generate", "answers:answer", "--repair", "answers:mend", "--run-id", "two", "--workers", "2"]
    assert main(words) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["run_id"] == "two" and set(report["ready"]) == {"blind", "context", "assurance"}
    assert (tmp_path / "scores" / "two" / "report.json").exists() and (tmp_path / "scores" / "summary.md").exists()


def test_one_bounded_repair():
    failed = {"violations": [{"allowed_actions": ["exclude"]}]}
    ok, bad = [{"status": "PASS"}], [{"status": "PASS"}, None]
    run = lambda report, repair, gates=lambda sql: ok: admission.bounded_repair("x", report, {}, "t", repair, gates)
    assert run(None, lambda *a: "y")[0]["status"] == "NOT_NEEDED"
    assert run(failed, None) == ({"bounded": True, "max_attempts": 1, "attempts": 0, "status": "NOT_ATTEMPTED"}, None, None)
    for forbidden in ({"violations": []}, {"violations": [{"allowed_actions": []}]}):
        assert run(forbidden, lambda *a: "y")[0]["status"] == "BLOCKED_NO_ALLOWED_REPAIR"
    assert run(failed, lambda *a: "```sql\ny\n```")[1:] == ("y", ok) and run(failed, lambda *a: "y")[0]["status"] == "PASS"
    assert run(failed, lambda *a: "y", lambda sql: bad)[0]["status"] == "FAIL"
    record, fixed, gates = run(failed, lambda *a: 1 / 0)
    assert (record["attempts"], record["status"], record["error_type"], fixed, gates) == (1, "ERROR", "ZeroDivisionError", None, None)
