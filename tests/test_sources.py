"""Block digests, counts taken on writing, chunked file digests, paths by parents, pages, logs, stored texts and analysed tables."""

import hashlib
import io
import itertools
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from plumbline.operators import compare, contract, digests, graph, provenance, runtime, stable
from plumbline.plans import analysis
from plumbline.sources import log, paged, service, texts


def plain_differences(a, b):
    from plumbline.functions.values import ABS_TOL, REL_TOL

    def near(x, y):
        if x is None or y is None:
            return x is y
        if isinstance(x, float) and isinstance(y, float):
            return x == y or (x != x and y != y) or (abs(x) != float("inf") and abs(y) != float("inf") and abs(x - y) <= max(REL_TOL * max(abs(x), abs(y)), ABS_TOL))
        return x == y

    return [i + 1 for i, (r, s) in enumerate(itertools.zip_longest(a, b)) if r is None or s is None or not all(map(near, r, s))]


@pytest.mark.parametrize("block", [4, 4096])
def test_block_digests_find_the_same_rows(spark, monkeypatch, block):
    monkeypatch.setattr(digests, "BLOCK", block)
    r = random.Random(block)
    values = [0.0, -0.0, 1e-7, 5e-7, 1.0, 1.5, 1023.9999999, 1e6, 3.3e9, 1e300, float("inf"), float("-inf"), float("nan"), None]
    a = [(r.choice(values), r.choice(["x", "y", "", "n", None]), r.choice([True, False, None])) for _ in range(90)]
    b = [(v if v is None or r.random() < 0.5 else v + r.choice([1e-9, -1e-9, 9e-7, 2e-6, 1e-3]) if abs(v) < 2000 else v * (1 + r.choice([1e-13, 1e-10, -9e-10, 2e-9])), s if r.random() < 0.9 else "x", t) for v, s, t in a]
    schema = "v double, s string, t boolean"
    left, right = (spark.createDataFrame(x, schema).coalesce(2) for x in (a, b))
    want = plain_differences(a, b)
    assert sorted(x["row_number"] for x in compare.row_differences(left, right).collect()) == want and want
    assert [x["row_number"] for x in compare.first_differences(left, right).orderBy("row_number").collect()] == want[:3]
    both = compare.Placed(left, left.withColumn("v", F.col("v") + 0.0))
    assert both.blocks.count() == 0 and both.first(3).count() == 0
    shorter = spark.createDataFrame(a[:70], schema).coalesce(1)
    assert sorted(x["row_number"] for x in compare.row_differences(shorter, left).collect()) == list(range(71, 91))


def test_first_differences_look_into_few_blocks(spark, monkeypatch):
    """Differences in the first of many differing blocks: only the first blocks' rows meet."""
    monkeypatch.setattr(digests, "BLOCK", 8)
    monkeypatch.setattr(compare, "BLOCKS", 2)
    a = spark.range(0, 4000, 1, 4).select(F.col("id").cast("double").alias("x"), F.col("id").cast("string").alias("s"))
    b = a.withColumn("x", F.when(F.col("x") >= 100, F.col("x") + 1e-7).otherwise(F.col("x"))).withColumn("s", F.when(F.col("x") > 3990.5, F.lit("?")).otherwise(F.col("s")))
    assert [r["row_number"] for r in compare.first_differences(a, b).orderBy("row_number").collect()] == [3992, 3993, 3994]
    asked = []
    own = compare.Placed.differences
    monkeypatch.setattr(compare.Placed, "differences", lambda self, within: (asked.append(1), own(self, within))[1])
    c = a.withColumn("s", F.concat("s", F.lit("!")))
    assert [r["row_number"] for r in compare.first_differences(a, c).orderBy("row_number").collect()] == [1, 2, 3] and len(asked) == 1


def test_other_types_and_digests(spark):
    a = spark.sql("select date'2024-01-02' as d, array(1.0d, null) as l, struct('a' as x) as s, X'0102' as b, 5 as n, 'x' as t")
    same = spark.sql("select timestamp_ntz'2024-01-02 00:00:00' as d, array(1.0d, null) as l, struct('a' as x) as s, X'0102' as b, 5.0000001d as n, 'x' as t")
    assert compare.compare(a, same)["status"] == "PASS"
    assert compare.compare(a, same.withColumn("b", F.lit(b"\x01")))["status"] == "FAIL"
    assert compare.compare(a, a.withColumn("t", F.lit(1)))["status"] == "FAIL"
    assert compare.compare(a.withColumn("t", F.lit(None).cast("int")), a.withColumn("t", F.lit(None).cast("string")))["status"] == "PASS"
    assert compare.compare(a.limit(0), same.limit(0))["status"] == "PASS"


def test_counts_are_taken_while_a_result_is_written(spark):
    own = spark.newSession()
    rows = [(1, 0.0, "a", b"x"), (2, -0.0, "a", b"y"), (3, None, None, None), (3, float("nan"), "b", None)]
    own.createDataFrame(rows, "k long, v double, s string, b binary").createOrReplaceTempView("t")
    rules = contract.Contract.of({"contract_id": "c", "exact_row_count": 4, "non_null_columns": ["v", "S"], "null_defaults": {"v": {"value": 0, "expected_replacements": 2}}, "unique_columns": ["k", "v", "s", "b", "missing"], "numeric_ranges": {"v": {"min": 1}, "s": {"min": 0}}})
    ran = runtime.execute(own, "select * from t", rules)
    assert ran.report["row_count"] == 4 and ran.seen == {"rows": 4, "nulls:v": 1, "defaults:v": 2, "nulls:S": 1, "outside:v": 2, "outside:s": 3}
    assert contract.evaluate(ran.result, rules, ran.seen) == contract.evaluate(ran.result, rules)
    assert contract.distinct_counts(ran.result, {"v": 1, "b": 3}) == {"distinct:v": 3, "distinct:b": 3}
    assert runtime.execute(own, "select * from t where k > 9", rules).seen["rows"] == 0
    assert runtime.execute(own, "select 1 as x, 2 as X").report["row_count"] == 1


def test_name_findings(spark):
    outputs = spark.createDataFrame([(1, "A"), (1, "a"), (1, "extra"), (2, "a"), (2, "other")], "task int, column string")
    required = spark.createDataFrame([(1, "a"), (1, "B"), (2, "A")], "task int, column string")
    got = {tuple(r) for r in contract.name_findings(outputs, required, ["task"], spark.createDataFrame([(2,)], "task int")).collect()}
    assert got == {(1, "duplicate_output_columns", "a"), (1, "missing_required_columns", "B"), (1, "unexpected_output_columns", "extra")}
    for task in (1, 2):
        rules = contract.Contract("c", [r["column"] for r in required.where(F.col("task") == task).collect()], task == 2)
        columns = [r["column"] for r in outputs.where(F.col("task") == task).collect()]
        assert {(task, f["type"], c.casefold()) for f in contract.column_findings(columns, rules) for c in f["columns"]} == {(t, k, c.casefold()) for t, k, c in got if t == task}


def test_chunked_file_digests(spark, tmp_path):
    sizes = {"a.txt": 0, "sub/b c#1.bin": 10, "sub/é%20?.bin": 3 * 4096 + 7, "sub/deep/manifest.json": 5}
    r = random.Random(1)
    for name, n in sizes.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(r.randbytes(n))
    want = {n: (hashlib.sha256((tmp_path / n).read_bytes()).hexdigest(), s) for n, s in sizes.items() if not n.endswith("manifest.json")}
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        assert {x["path"]: (x["sha256"], x["bytes"]) for x in provenance.file_digests(spark, folder, chunk=4096).collect()} == want

    class Long(io.RawIOBase):
        """A stream beyond 2 GB that never holds more than a chunk."""

        left = (2 << 30) + 5

        def read(self, n=-1):
            assert 0 < n <= 1 << 22
            got = min(n, self.left)
            self.left -= got
            return bytes(got)

    found, size = provenance.chunked_digest(Long(), 1 << 22)
    assert size == (2 << 30) + 5 and len(found) == 64


def plain_paths(edges, source, hops, limit=None):
    """Levels, and each node's path by smallest parents."""
    degree, parent, front = {source: 0}, {}, [source]
    for d in range(1, hops + 1):
        step = {}
        for a, b in edges:
            if a in front and b not in degree:
                step[b] = min(a, step.get(b, a))
        degree |= dict.fromkeys(step, d)
        parent |= step
        front = list(step)
    out = []
    for node in sorted((n for n in degree if degree[n]), key=lambda n: (degree[n], n))[:limit]:
        path = [node]
        while path[0] != source:
            path.insert(0, parent[path[0]])
        out.append((source, node, degree[node], tuple(path)))
    return out


def test_paths_by_parents_hubs_and_limits(spark):
    r = random.Random(2)
    names = [f"n{i}" for i in range(40)]
    edges = [(r.choice(names), r.choice(names)) for _ in range(90)] + [("n0", f"x{i}") for i in range(60)] + [("n1", "n0"), ("n0", "n0"), ("n1", "n0")]
    e, s = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(n,) for n in ["n0", "n1", "n2", "n2", "none"]], "node string")
    for limit, hub in ((None, 100_000), (None, 20), (7, 20)):
        got = sorted((x["source"], x["node"], x["degree"], tuple(x["path"])) for x in graph.reachable(e, s, limit=limit, hub=hub).collect())
        assert got == sorted(p for n in ("n0", "n1", "n2", "none") for p in plain_paths(edges, n, 3, limit))
    assert graph.reachable(e.limit(0), s).count() == 0


def served(total, most=None, stuck=None, counted="totalFields"):
    def fetch(offset, limit):
        n = max(0, min(limit, most or limit, total - offset))
        n = 0 if stuck is not None and offset >= stuck else n
        page = {"fields": [{"id": i, "name": f"f{i}"} for i in range(offset, offset + n)], "offset": offset}
        return page | ({"totalFields": total} if counted == "totalFields" else {"remainingCount": total - offset - n} if counted else {})

    return fetch


@pytest.mark.parametrize(("total", "most", "counted"), [(0, None, "totalFields"), (23, None, "totalFields"), (23, 3, "totalFields"), (23, None, "remainingCount"), (23, None, None), (20, None, None)])
def test_pages_as_a_source(spark, total, most, counted):
    spark.dataSource.register(paged.paged("pages_test", served(total, most, None, counted), "name string, id long, absent int", page=5, pages=2))
    df = spark.read.format("pages_test").load()
    assert sorted(tuple(r) for r in df.collect()) == sorted((f"f{i}", i, None) for i in range(total))
    if counted:
        assert df.rdd.getNumPartitions() == max(1, -(-total // 10))
    if counted == "totalFields":
        assert [f["id"] for f in service.schema_fields(served(total, most, None, counted))] == list(range(total))


def test_pages_that_make_no_progress_fail(spark):
    spark.dataSource.register(paged.paged("stuck_pages", served(30, None, 12), "name string, id long", page=5, pages=3))
    with pytest.raises(Exception, match="no progress"):
        spark.read.format("stuck_pages").load().collect()
    spark.dataSource.register(paged.paged("bare_pages", lambda offset, limit: {}, "id long"))
    with pytest.raises(Exception, match="without fields"):
        spark.read.format("bare_pages").load().collect()


def entries(spark, names, run="r"):
    return spark.createDataFrame([(f"u{n % 3}", "t", f"note {n:03d}.", f"Run: {run}\nTask: t\nNote: note {n:03d}.") for n in names], "url string, task string, note string, description string")


def test_append_log(spark, tmp_path, monkeypatch):
    own = log.AppendLog(spark, str(tmp_path / "log é"))
    assert own.version() == 0 and own.read().count() == 0 and own.append(entries(spark, [])) == ("UNCHANGED", 0)
    assert own.append(entries(spark, range(5))) == ("APPENDED", 1)
    assert own.append(entries(spark, range(5), "other")) == ("UNCHANGED", 1)
    assert own.append(entries(spark, [3, 4, 5, 5])) == ("APPENDED", 2)
    assert own.read().count() == 6 and own.read(1).count() == 5  # an old version stays as it was
    monkeypatch.setattr(log, "PARTS", 2)
    assert own.append(entries(spark, [9])) == ("APPENDED", 3) and len(own.parts(3)) == 1 and own.read().count() == 7
    assert not own._commit(3, ["other"]) and own.parts(3) != ["other"]  # a number is taken once


def test_append_log_with_many_appenders(spark, tmp_path):
    folder = str(tmp_path / "race")
    log.AppendLog(spark, folder)

    def run(i):
        return log.AppendLog(spark, folder).append(entries(spark, range(i, i + 4), f"r{i}"))

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(run, [0, 1, 2, 0]))
    own = log.AppendLog(spark, folder)
    held = [r["description"].partition("Note: ")[2] for r in own.read().collect()]
    assert sorted(held) == [f"note {n:03d}." for n in range(6)]
    assert own.version() == sum(s == "APPENDED" for s, _ in done)


def test_stored_texts(spark, tmp_path):
    for name, text in (("a__blind.sql", "select 1\n;\n"), ("a__context.sql", " \n\t"), ("b_2__blind.sql", "x"), ("other__blind.sql", "y"), ("a__blind.txt", "no")):
        (tmp_path / name).write_text(text)
    tasks = spark.createDataFrame([("w", "a"), ("w", "b_2"), ("w", "c")], "world string, task_id string")
    got = {(r["task_id"], r["mode"]): (r["state"], r["sql"]) for r in texts.candidates(texts.whole_texts(spark, str(tmp_path)), tasks, ["blind", "context"]).collect()}
    assert got == {("a", "blind"): ("present", "select 1\n;\n"), ("a", "context"): ("empty", None), ("b_2", "blind"): ("present", "x"), ("b_2", "context"): ("missing", None), ("c", "blind"): ("missing", None), ("c", "context"): ("missing", None)}
    lines = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, '{"a": "no"}'), (3, "{"), (4, None), (5, "{}")], "k int, j string")
    good, bad = texts.json_rows(lines, "j", "a int, b string")
    assert sorted(map(tuple, good.collect())) == [(1, 1, "x"), (5, None, None)] and sorted(r["k"] for r in bad.collect()) == [2, 3, 4]


CONTEXT = {"table_name": "t", "fields": [{"fieldPath": "id", "nativeDataType": "BIGINT"}, {"fieldPath": "name", "nativeDataType": "VARCHAR", "editedTags": ["PII"]}]}


def test_analysis_of_tables(spark, monkeypatch):
    monkeypatch.setattr(analysis, "CHUNK", 2)
    rows = [(1, "select id, lost from t"), (2, "select id from t"), (3, "drop table t"), (4, "select name as n from u"), (5, None), (6, "select id, lost from t"), (7, "select upper(name) as shout, 1 as one from t")]
    df = spark.createDataFrame(rows, "task int, sql string")
    got = {(r["task"], r["column_name"], r["reason"]) for r in analysis.schema_findings(df, CONTEXT).collect()}
    assert got == {(1, "lost", "not_in_context_schema"), (6, "lost", "not_in_context_schema"), (3, None, "unparsable"), (4, "u", "unexpected_table")}
    pairs = analysis.lineage_pairs(df, CONTEXT)
    found = {(r["task"], r["position"], r["output_column"], r["source_column"], r["unresolved"]) for r in pairs.collect()}
    assert found == {(2, 1, "id", "id", False), (7, 1, "shout", "name", False), (7, 2, "one", None, False), *((i, 0, None, None, True) for i in (1, 3, 4, 6))}
    bad = analysis.violations(pairs, CONTEXT, {"denied_classifications": ["PII"]})
    assert [(r["task"], r["output_column"], r["classification"]) for r in bad.collect()] == [(7, "shout", "PII")]
    assert analysis.schema_findings(df.limit(0), CONTEXT).count() == 0


def test_addresses():
    assert stable.address("file:/a/b") == "file:///a/b" and stable.address("hdfs://h/a") == "hdfs://h/a" and stable.address("/a b") == "file:///a b"
