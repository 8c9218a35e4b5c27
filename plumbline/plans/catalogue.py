"""Named queries over the driver's tables, each with the SQL that another engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values
from ..operators import contract, graph, impact, memory, provenance, score
from ..operators import compare as compare_
from . import governance, lineage, schema_gate

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels"]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- relational operators -------------------------------------------------------------------------------------


@_query("status_summary", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS order_count, round(sum(o_totalprice), 2) AS total_amount FROM orders GROUP BY o_orderstatus ORDER BY o_orderstatus")
def status_summary(spark, d):
    return _t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("order_count"), F.round(F.sum("o_totalprice"), 2).alias("total_amount")).orderBy("o_orderstatus")


@_query("monthly_metrics", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, CAST(count(*) AS BIGINT) AS order_count, round(avg(o_totalprice), 2) AS average_order_value FROM orders GROUP BY 1 ORDER BY 1")
def monthly_metrics(spark, d):
    month = F.date_trunc("month", "o_orderdate").cast("date").alias("month_start")
    return _t(spark, d, "orders").groupBy(month).agg(F.count(F.lit(1)).alias("order_count"), F.round(F.avg("o_totalprice"), 2).alias("average_order_value")).orderBy("month_start")


@_query("top_customers", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS order_count, round(sum(o_totalprice), 2) AS total_amount FROM orders GROUP BY o_custkey ORDER BY total_amount DESC, o_custkey LIMIT 3")
def top_customers(spark, d):
    spend = _t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("order_count"), F.round(F.sum("o_totalprice"), 2).alias("total_amount"))
    return spend.orderBy(F.desc("total_amount"), "o_custkey").limit(3)


@_query("monthly_revenue", "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month_start, round(sum(l_extendedprice), 2) AS total_revenue FROM lineitem GROUP BY date_trunc('month', l_shipdate)")
def monthly_revenue(spark, d):
    return _t(spark, d, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("month_start")).agg(F.round(F.sum("l_extendedprice"), 2).alias("total_revenue"))


@_query("state_net_revenue", "WITH net AS (SELECT l_linestatus AS lifecycle_state, l_extendedprice * (1 - l_discount) AS net FROM lineitem) SELECT lifecycle_state, CAST(count(*) AS BIGINT) AS checkout_count, round(sum(net), 2) AS net_revenue FROM net GROUP BY lifecycle_state ORDER BY lifecycle_state")
def state_net_revenue(spark, d):
    net = _t(spark, d, "lineitem").select(F.col("l_linestatus").alias("lifecycle_state"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    return net.groupBy("lifecycle_state").agg(F.count(F.lit(1)).alias("checkout_count"), F.round(F.sum("net"), 2).alias("net_revenue")).orderBy("lifecycle_state")


@_query("top_shoppers_rownum", "WITH spend AS (SELECT o_custkey AS shopper_id, CAST(count(*) AS BIGINT) AS checkout_count, round(sum(o_totalprice), 2) AS total_revenue FROM orders GROUP BY o_custkey), ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY total_revenue DESC, shopper_id) AS BIGINT) AS rn FROM spend) SELECT * FROM ranked WHERE rn <= 5")
def top_shoppers_rownum(spark, d):
    spend = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("shopper_id")).agg(F.count(F.lit(1)).alias("checkout_count"), F.round(F.sum("o_totalprice"), 2).alias("total_revenue"))
    ranked = spend.select("*", F.row_number().over(Window.orderBy(F.desc("total_revenue"), "shopper_id")).cast("long").alias("rn"))
    return ranked.where("rn <= 5")  # limited per task before the window's exchange


@_query("segment_summary", "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS customer_count, round(sum(c_acctbal), 2) AS total_balance FROM customer GROUP BY c_mktsegment")
def segment_summary(spark, d):
    return _t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customer_count"), F.round(F.sum("c_acctbal"), 2).alias("total_balance"))


@_query("segment_distinct", "SELECT o_orderstatus, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers FROM orders GROUP BY o_orderstatus")
def segment_distinct(spark, d):
    return _t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"))


@_query("high_value_outreach", "WITH rich AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal >= 1000.00) SELECT * FROM rich ORDER BY c_acctbal DESC, c_custkey")
def high_value_outreach(spark, d):
    return _t(spark, d, "customer").where(F.col("c_acctbal") >= 1000.0).select("c_custkey", "c_acctbal", "c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")


@_query("at_risk_customers", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey")
def at_risk_customers(spark, d):
    return _t(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_mktsegment", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey")


_VALUE_SQL = "SELECT c.c_custkey, v.lifetime_value FROM customer c LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS lifetime_value FROM orders WHERE o_totalprice > 450000 GROUP BY o_custkey) v ON c.c_custkey = v.o_custkey"


def _values(spark, d):
    """A lifetime value per customer, null for those without a large order."""
    large = _t(spark, d, "orders").where("o_totalprice > 450000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("lifetime_value"))
    return _t(spark, d, "customer").select("c_custkey").join(large, "c_custkey", "left")


def ntiles(df: DataFrame, n: int, order: list, name: str) -> DataFrame:
    """ntile(n) over the whole of df, distributed: rows are range-sorted and numbered, and the number gives the bucket."""
    from ..operators.positions import with_position

    placed = with_position(df.orderBy(*order), "_place")
    total = df.count()
    size, more = divmod(total, n)
    place = F.col("_place") - 1
    bucket = F.when(place < more * (size + 1), F.floor(place / (size + 1))).otherwise(more + F.floor((place - more * (size + 1)) / max(size, 1))) + 1
    return placed.withColumn(name, bucket.cast("long")).drop("_place")


_CLV_SQL = f"SELECT c_custkey, coalesce(lifetime_value, 0) AS lifetime_value, CAST(ntile(5) OVER (ORDER BY coalesce(lifetime_value, 0) NULLS LAST, c_custkey) AS BIGINT) AS value_quintile FROM ({_VALUE_SQL})"


def _clv(spark, d):
    filled = _values(spark, d).withColumn("lifetime_value", F.coalesce("lifetime_value", F.lit(0.0)))
    return ntiles(filled, 5, [F.col("lifetime_value").asc_nulls_last(), F.col("c_custkey")], "value_quintile")


@_query("clv_quintiles", _CLV_SQL)
def clv_quintiles(spark, d):
    return _clv(spark, d)


@_query("clv_band_profile", f"WITH banded AS (SELECT *, CAST(ntile(5) OVER (ORDER BY lifetime_value NULLS LAST, c_custkey) AS BIGINT) AS band FROM ({_VALUE_SQL})) SELECT band, CAST(count(*) AS BIGINT) AS customers, min(lifetime_value) AS least, round(avg(lifetime_value), 2) AS average, max(lifetime_value) AS most FROM banded GROUP BY band")
def clv_band_profile(spark, d):
    banded = ntiles(_values(spark, d), 5, [F.col("lifetime_value").asc_nulls_last(), F.col("c_custkey")], "band")
    return banded.groupBy("band").agg(F.count(F.lit(1)).alias("customers"), F.min("lifetime_value").alias("least"), F.round(F.avg("lifetime_value"), 2).alias("average"), F.max("lifetime_value").alias("most"))


@_query("concat_null_skip", "SELECT n_nationkey, concat(n_name, '-', CASE WHEN n_regionkey > 1 THEN r_name END) AS label FROM nation JOIN region ON n_regionkey = r_regionkey")
def concat_null_skip(spark, d):
    both = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", values.concat_skipping_nulls(F.col("n_name"), F.lit("-"), F.when(F.col("n_regionkey") > 1, F.col("r_name"))).alias("label"))


_QUALIFY = "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1"


@_query("qualify_rewrite", _QUALIFY)
def qualify_rewrite(spark, d):
    from . import frontend

    own = spark.newSession()
    own.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    own.read.parquet(f"{d}/orders.parquet").createOrReplaceTempView("orders")
    return own.sql(frontend.ready(own, _QUALIFY))


def _candidate(spark, d, table: str, sql: str) -> DataFrame:
    """A candidate over one table as the gates take it: the schema gate on the table's columns, the rewriting, then the result."""
    from ..session import isolated
    from . import adapter, frontend

    own = isolated(spark)
    rows = own.read.parquet(f"{d}/{table}.parquet")
    rows.createOrReplaceTempView(table)
    report = schema_gate.validate(own, sql, {"table_name": table, "fields": [{"fieldPath": c} for c in rows.columns]})
    if report["status"] != "PASS":
        raise adapter.PlanError(f"the schema gate fails: {report['invalid_details']}")
    return own.sql(frontend.ready(own, sql))


# A window's alias under QUALIFY, another alias inside a window, and an order by what isn't selected.
_QUALIFY_ALIAS = "WITH ranked AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 2 ORDER BY o_orderdate) SELECT o_custkey, CAST(count(*) AS BIGINT) AS orders, round(sum(o_totalprice), 2) AS amount FROM ranked GROUP BY o_custkey QUALIFY rank() OVER (ORDER BY amount DESC) <= 500 ORDER BY ALL"


@_query("qualify_alias_run", _QUALIFY_ALIAS)
def qualify_alias_run(spark, d):
    return _candidate(spark, d, "orders", _QUALIFY_ALIAS)


_DIALECT = """WITH recent AS (SELECT * EXCLUDE (o_orderpriority) REPLACE (round(o_totalprice, 0) AS o_totalprice, lower(o_orderstatus) AS o_orderstatus) FROM orders WHERE o_orderdate >= '1995-01-01'::timestamp),
 spans AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS orders, arg_max(o_orderkey, o_totalprice + o_orderkey / 1e9) AS dearest, date_diff('month', min(o_orderdate), max(o_orderdate)) AS months, date_diff('week', min(o_orderdate), max(o_orderdate)) AS weeks, string_agg(DISTINCT o_orderstatus, '' ORDER BY o_orderstatus) AS statuses, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM recent GROUP BY ALL)
SELECT o_custkey, orders, dearest, months, weeks, statuses, last_day FROM spans WHERE orders > 1 UNION ALL BY NAME SELECT orders::varchar || ' orders' AS note, o_custkey, o_custkey // 7 AS dearest FROM spans WHERE orders = 1"""


@_query("dialect_run", _DIALECT)
def dialect_run(spark, d):
    return _candidate(spark, d, "orders", _DIALECT)


@_query("having_filter", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS order_count FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def having_filter(spark, d):
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("order_count")).where("order_count >= 12")


# --- result contracts and comparison ----------------------------------------------------------------------------


def _contract() -> contract.Contract:
    return contract.Contract.of({"contract_id": "clv", "required_columns": ["c_custkey", "lifetime_value", "value_quintile"], "non_null_columns": ["lifetime_value"], "null_defaults": {"lifetime_value": {"value": 0, "expected_replacements": 538}}, "unique_columns": ["c_custkey", "value_quintile"], "numeric_ranges": {"value_quintile": {"min": 1, "max": 5}, "lifetime_value": {"min": 1}}, "exact_row_count": 1500})


@_query("contract_row_null_metrics", f"SELECT CAST(count(*) AS BIGINT) AS row_count, CAST(count(*) FILTER (WHERE lifetime_value IS NULL) AS BIGINT) AS null_count, CAST(count(*) FILTER (WHERE lifetime_value = 0) AS BIGINT) AS replaced FROM ({_CLV_SQL})")
def contract_row_null_metrics(spark, d):
    m = contract.metrics(_clv(spark, d), _contract())
    return spark.createDataFrame([(m["rows"], m["nulls:lifetime_value"], m["defaults:lifetime_value"])], "row_count long, null_count long, replaced long")


@_query("contract_uniqueness", f"SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT lifetime_value FROM ({_VALUE_SQL}))) AS BIGINT) AS duplicate_count FROM ({_VALUE_SQL})")
def contract_uniqueness(spark, d):
    return _values(spark, d).agg((F.count(F.lit(1)) - F.count_distinct(F.struct("lifetime_value"))).alias("duplicate_count"))


@_query("contract_numeric_range", "SELECT 'c_acctbal' AS column_name, CAST(count(*) FILTER (WHERE c_acctbal < 0 OR c_acctbal > 9000) AS BIGINT) AS invalid_count FROM customer UNION ALL SELECT 'c_mktsegment', count(c_mktsegment) FROM customer")
def contract_numeric_range(spark, d):
    c = contract.Contract.of({"contract_id": "ranges", "numeric_ranges": {"c_acctbal": {"min": 0, "max": 9000}, "c_mktsegment": {"min": 0}}})
    return contract.report_rows(_t(spark, d, "customer"), c).select("column_name", F.col("actual").alias("invalid_count"))


@_query("contract_value_counts", "WITH wanted(value, expected_count) AS (VALUES ('F', 4933), ('O', 4979), ('X', 1)), actual AS (SELECT o_orderstatus AS value, CAST(count(*) AS BIGINT) AS actual_count FROM orders GROUP BY 1) SELECT coalesce(a.value, w.value) AS value, coalesce(actual_count, 0) AS actual_count, CAST(coalesce(expected_count, 0) AS BIGINT) AS expected_count, actual_count IS NOT DISTINCT FROM expected_count AS matches FROM actual a FULL OUTER JOIN wanted w ON a.value = w.value")
def contract_value_counts(spark, d):
    return contract.value_count_differences(_t(spark, d, "orders"), "o_orderstatus", {"F": 4933, "O": 4979, "X": 1}).na.fill(0, ["actual_count", "expected_count"])


_REPORT_SQL = f"""WITH c AS ({_CLV_SQL}), m AS (
 SELECT 'row_count' AS check_name, '*' AS column_name, count(*) AS actual, 1500 AS expected FROM c
 UNION ALL SELECT 'nulls', 'lifetime_value', count(*) FILTER (WHERE lifetime_value IS NULL), 0 FROM c
 UNION ALL SELECT 'default_replacements', 'lifetime_value', count(*) FILTER (WHERE lifetime_value = 0), 538 FROM c
 UNION ALL SELECT 'duplicates', 'c_custkey', count(*) - count(DISTINCT c_custkey), 0 FROM c
 UNION ALL SELECT 'duplicates', 'value_quintile', count(*) - count(DISTINCT value_quintile), 0 FROM c
 UNION ALL SELECT 'out_of_range', 'value_quintile', count(*) FILTER (WHERE value_quintile < 1 OR value_quintile > 5), 0 FROM c
 UNION ALL SELECT 'out_of_range', 'lifetime_value', count(*) FILTER (WHERE lifetime_value < 1), 0 FROM c)
SELECT check_name, column_name, CAST(actual AS BIGINT) AS actual, CAST(expected AS BIGINT) AS expected, CASE WHEN actual = expected THEN 'PASS' ELSE 'FAIL' END AS status FROM m"""


@_query("contract_report", _REPORT_SQL)
def contract_report(spark, d):
    return contract.report_rows(_clv(spark, d), _contract())


@_query("column_contract", "SELECT * FROM (VALUES ('duplicate_output_columns', 'o_status', 'rename_output_columns'), ('missing_required_columns', 'customer', 'add_required_output_aliases'), ('unexpected_output_columns', 'o_status,O_STATUS', 'exclude')) t(type, columns, actions)")
def column_contract(spark, d):
    own = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("o_status"), F.col("o_orderstatus").alias("O_STATUS"))
    rules = contract.Contract.of({"contract_id": "c", "required_columns": ["O_ORDERKEY", "customer"], "allow_extra_columns": False})
    found = contract.column_findings(own.columns, rules)
    return spark.createDataFrame([(f["type"], ",".join(f["columns"]), ",".join(f["allowed_actions"])) for f in found], "type string, columns string, actions string")


@_query("null_row_samples", f"WITH numbered AS (SELECT lifetime_value, row_number() OVER (ORDER BY c_custkey) AS row_number FROM ({_VALUE_SQL})) SELECT CAST(row_number AS BIGINT) AS row_number FROM numbered WHERE lifetime_value IS NULL ORDER BY 1 LIMIT 5")
def null_row_samples(spark, d):
    from ..operators.positions import with_position

    return with_position(_values(spark, d).orderBy("c_custkey")).where("lifetime_value is null").select("row_number").orderBy("row_number").limit(5)


@_query("result_compare_ordered", "WITH a AS (SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS row_number, c_custkey, c_acctbal FROM customer), b AS (SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey DESC) AS row_number, c_custkey, CASE WHEN c_custkey % 100 = 0 THEN c_acctbal + 1 ELSE c_acctbal + 1e-8 END AS c_acctbal FROM customer) SELECT CAST(a.row_number AS BIGINT) AS row_number, a.c_custkey AS actual_key, b.c_custkey AS wanted_key FROM a JOIN b ON a.row_number = b.row_number WHERE a.c_custkey <> b.c_custkey OR abs(a.c_acctbal - b.c_acctbal) > greatest(1e-9 * greatest(abs(a.c_acctbal), abs(b.c_acctbal)), 1e-6)")
def result_compare_ordered(spark, d):
    own = _t(spark, d, "customer").select("c_custkey", "c_acctbal")
    moved = own.orderBy(F.desc("c_acctbal"), F.desc("c_custkey")).withColumn("c_acctbal", F.when(F.col("c_custkey") % 100 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal") + 1e-8))
    out = compare_.row_differences(own.orderBy(F.desc("c_acctbal"), "c_custkey"), moved)
    return out.select("row_number", F.col("actual.a0").alias("actual_key"), F.col("wanted.b0").alias("wanted_key"))


@_query("result_first_differences", "WITH a AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS row_number, l_orderkey, l_linenumber, l_extendedprice FROM lineitem), b AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, lineitem.l_extendedprice) AS row_number, l_orderkey, l_linenumber, CASE WHEN l_orderkey % 997 = 996 AND l_linenumber = 1 THEN l_extendedprice * 1.001 ELSE l_extendedprice * (1 + 1e-13) END AS l_extendedprice FROM lineitem) SELECT CAST(a.row_number AS BIGINT) AS row_number, a.l_orderkey, a.l_extendedprice AS actual, b.l_extendedprice AS wanted FROM a JOIN b USING (row_number) WHERE abs(a.l_extendedprice - b.l_extendedprice) > 1e-4 ORDER BY 1 LIMIT 3")
def result_first_differences(spark, d):
    own = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy("l_orderkey", "l_linenumber", "l_extendedprice")
    moved = own.withColumn("l_extendedprice", F.when((F.col("l_orderkey") % 997 == 996) & (F.col("l_linenumber") == 1), F.col("l_extendedprice") * 1.001).otherwise(F.col("l_extendedprice") * (1 + 1e-13)))
    out = compare_.first_differences(moved, own)  # nearly all rows differ, few beyond the tolerance
    return out.select("row_number", F.col("actual.a0").alias("l_orderkey"), F.col("wanted.b2").alias("actual"), F.col("actual.a2").alias("wanted"))


_WATCHED = {"contract_id": "orders", "required_columns": ["o_orderkey"], "non_null_columns": ["o_custkey", "o_totalprice"], "null_defaults": {"o_custkey": {"value": 1, "expected_replacements": 9}}, "unique_columns": ["o_orderkey", "o_custkey", "o_totalprice"], "numeric_ranges": {"o_totalprice": {"min": 1000, "max": 400000}}}


@_query("contract_observed", """WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 2000) SELECT * FROM (SELECT 'rows' AS measure, CAST(count(*) AS BIGINT) AS amount FROM o UNION ALL SELECT 'nulls:o_custkey', count(*) - count(o_custkey) FROM o UNION ALL SELECT 'nulls:o_totalprice', count(*) - count(o_totalprice) FROM o UNION ALL SELECT 'defaults:o_custkey', count(*) FILTER (WHERE o_custkey = 1) FROM o
 UNION ALL SELECT 'outside:o_totalprice', count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 400000) FROM o UNION ALL SELECT 'distinct:o_orderkey', count(DISTINCT o_orderkey) FROM o UNION ALL SELECT 'distinct:o_custkey', count(DISTINCT o_custkey) FROM o UNION ALL SELECT 'distinct:o_totalprice', count(DISTINCT o_totalprice) FROM o)""")
def contract_observed(spark, d):
    """Counts taken while a candidate's result is written, and one grouping for all unique columns."""
    from ..operators import runtime
    from ..session import isolated

    own, rules = isolated(spark), contract.Contract.of(_WATCHED)
    own.read.parquet(f"{d}/orders.parquet").createOrReplaceTempView("orders")
    ran = runtime.execute(own, "select o_orderkey, o_custkey, o_totalprice from orders where o_totalprice > 2000", rules)
    found = ran.seen | contract.distinct_counts(ran.result, {n: i for i, n in enumerate(ran.result.columns)})
    return spark.createDataFrame(list(found.items()), "measure string, amount long")


@_query("values_close", "SELECT l_orderkey, l_linenumber, abs(l_extendedprice - x) <= greatest(1e-9 * greatest(abs(l_extendedprice), abs(x)), 1e-6) AS is_close FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, l_extendedprice + CASE l_linenumber % 3 WHEN 0 THEN 1e-7 WHEN 1 THEN 0.01 ELSE 0.0 END AS x FROM lineitem)")
def values_close(spark, d):
    n = F.col("l_linenumber") % 3
    x = F.col("l_extendedprice") + F.when(n == 0, 1e-7).when(n == 1, 0.01).otherwise(0.0)
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", values.close(F.col("l_extendedprice"), x).alias("is_close"))


# --- scoring --------------------------------------------------------------------------------------------------

# Outcomes derived from orders: three worlds, a task per customer, three modes, four gates.
_OUTCOMES_SQL = """SELECT CASE o_orderkey % 3 WHEN 0 THEN 'familiar' WHEN 1 THEN 'legacy' ELSE 'governed' END AS world, 't' || o_custkey AS task_id,
 CASE o_orderkey % 2 WHEN 0 THEN 'blind' ELSE 'context' END AS mode, CASE o_orderkey % 4 WHEN 0 THEN 'schema' WHEN 1 THEN 'runtime' WHEN 2 THEN 'governance' ELSE 'result' END AS gate,
 CASE WHEN o_totalprice > 100000 THEN 'PASS' WHEN o_totalprice > 50000 THEN 'FAIL' ELSE 'SKIPPED' END AS status FROM orders"""


def _outcomes(spark, d):
    k = F.col("o_orderkey")
    price = F.col("o_totalprice")
    return _t(spark, d, "orders").select(
        F.when(k % 3 == 0, "familiar").when(k % 3 == 1, "legacy").otherwise("governed").alias("world"),
        F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("task_id"),
        F.when(k % 2 == 0, "blind").otherwise("context").alias("mode"),
        F.when(k % 4 == 0, "schema").when(k % 4 == 1, "runtime").when(k % 4 == 2, "governance").otherwise("result").alias("gate"),
        F.when(price > 100000, "PASS").when(price > 50000, "FAIL").otherwise("SKIPPED").alias("status"),
    )


@_query("vmr_grouping_sets", f"""WITH o AS ({_OUTCOMES_SQL}), r AS (SELECT world, task_id, mode, bool_and(status = 'PASS') AS ok FROM o GROUP BY 1, 2, 3),
f AS (SELECT world, mode, 'ready' AS gate, ok FROM r UNION ALL SELECT world, mode, gate, status = 'PASS' FROM o),
g AS (SELECT mode, gate, world, grouping(world) AS whole, count(*) FILTER (WHERE ok) AS passed, count(*) AS total FROM f GROUP BY GROUPING SETS ((mode, gate), (mode, gate, world)))
SELECT CASE WHEN whole = 0 THEN 'world' WHEN gate = 'ready' THEN 'mode' ELSE 'gate' END AS level, mode, gate, world, CAST(passed AS BIGINT) AS passed, CAST(total AS BIGINT) AS total, round(passed / total, 6) AS pass_rate FROM g WHERE whole = 1 OR gate = 'ready'""")
def vmr_grouping_sets(spark, d):
    return score.rollups(_outcomes(spark, d))


_READY_SQL = f"SELECT world, task_id, mode, bool_and(status = 'PASS') AS ready FROM ({_OUTCOMES_SQL}) GROUP BY 1, 2, 3"


@_query("vmr_paired", f"WITH r AS ({_READY_SQL}) SELECT a.world, a.task_id, a.ready AS ready_first, b.ready AS ready_second, CASE WHEN a.ready = b.ready THEN 'same' WHEN b.ready THEN 'gained' ELSE 'lost' END AS change FROM r a JOIN r b ON a.world = b.world AND a.task_id = b.task_id WHERE a.mode = 'blind' AND b.mode = 'context'")
def vmr_paired(spark, d):
    return score.paired(score.readiness(_outcomes(spark, d), ["world", "task_id", "mode"]), "blind", "context")


@_query("rescore_left_join", f"WITH r AS ({_READY_SQL}), t AS (SELECT DISTINCT world, task_id FROM r), m(mode) AS (VALUES ('blind'), ('context'), ('assurance')) SELECT t.world, t.task_id, m.mode, CASE WHEN r.ready IS NULL THEN 'SKIPPED' WHEN r.ready THEN 'PASS' ELSE 'FAIL' END AS status FROM t CROSS JOIN m LEFT JOIN r ON r.world = t.world AND r.task_id = t.task_id AND r.mode = m.mode")
def rescore_left_join(spark, d):
    ready = score.readiness(_outcomes(spark, d), ["world", "task_id", "mode"])
    found = ready.select("world", "task_id", "mode", F.when(F.col("ready"), "PASS").otherwise("FAIL").alias("status"))
    return score.with_missing(ready.select("world", "task_id").distinct(), ["blind", "context", "assurance"], found)


@_query("all_gates_pass", _READY_SQL)
def all_gates_pass(spark, d):
    return score.readiness(_outcomes(spark, d), ["world", "task_id", "mode"])


@_query("failure_actions", f"WITH o AS ({_OUTCOMES_SQL}), p AS (SELECT *, list_position(['schema', 'runtime', 'governance', 'result'], gate) AS place FROM o WHERE status <> 'PASS') SELECT world, task_id, mode, string_agg(gate || '=' || status, ',' ORDER BY place, status) AS failures FROM p GROUP BY ALL")
def failure_actions(spark, d):
    found = score.failure_actions(_outcomes(spark, d))
    return found.withColumn("failures", F.array_join(F.transform("failures", lambda x: F.concat(x["gate"], F.lit("="), x["status"])), ","))


@_query("repair_counts", f"WITH r AS ({_READY_SQL}) SELECT mode, CAST(sum(CASE WHEN ready THEN 0 ELSE 1 END) AS BIGINT) AS repairs_attempted, CAST(0 AS BIGINT) AS repairs_passed FROM r GROUP BY mode")
def repair_counts(spark, d):
    ready = score.readiness(_outcomes(spark, d), ["world", "task_id", "mode"])
    return score.repairs(ready.select("mode", (~F.col("ready")).cast("int").alias("repair_attempts"), F.when(F.col("ready"), "NOT_NEEDED").otherwise("FAIL").alias("repair_status")))


# --- lineage graph and impact -----------------------------------------------------------------------------------


@_query("exact_name_first", "WITH c AS (SELECT 'urn:dbt:' || n_nationkey AS urn, r_name || '.' || n_name AS name, n_nationkey AS position, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey), k AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY CASE WHEN lower(split_part(name, '.', -1)) = 'france' THEN 0 ELSE 1 END, position) AS rn FROM c) SELECT n_regionkey, urn, name FROM k WHERE rn = 1")
def exact_name_first(spark, d):
    both = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = both.select(F.concat(F.lit("urn:dbt:"), F.col("n_nationkey").cast("string")).alias("urn"), F.concat("r_name", F.lit("."), "n_name").alias("name"), F.col("n_nationkey").alias("position"), "n_regionkey")
    return graph.preferred(c, "FRANCE", by=["n_regionkey"]).select("n_regionkey", "urn", "name")


@_query("ordered_distinct", "SELECT split_part(o_orderstatus || '.' || o_orderpriority, '.', -1) AS short_name, min(o_orderkey) AS first_position FROM orders GROUP BY 1")
def ordered_distinct(spark, d):
    named = _t(spark, d, "orders").select(F.concat("o_orderstatus", F.lit("."), "o_orderpriority").alias("name"), "o_orderkey")
    return graph.ordered_distinct(named, "name", "o_orderkey")


@_query("criticality_extract", "WITH p AS (SELECT p_partkey, upper(replace(CASE p_size % 4 WHEN 0 THEN 'urn:li:tag:criticality-high' WHEN 1 THEN 'Criticality:Medium' WHEN 2 THEN 'criticality_low' ELSE 'other' END, '-', '_')) AS a, CASE WHEN p_partkey % 5 = 0 THEN 'CRITICALITY_MEDIUM' ELSE 'PII' END AS b FROM part) SELECT p_partkey, CASE WHEN a LIKE '%CRITICALITY\\_HIGH%' ESCAPE '\\' THEN 'HIGH' WHEN a LIKE '%CRITICALITY:MEDIUM%' OR b = 'CRITICALITY_MEDIUM' THEN 'MEDIUM' WHEN a LIKE '%CRITICALITY\\_LOW%' ESCAPE '\\' THEN 'LOW' END AS criticality FROM p")
def criticality_extract(spark, d):
    n = F.col("p_size") % 4
    tokens = F.array(F.when(n == 0, "urn:li:tag:criticality-high").when(n == 1, "Criticality:Medium").when(n == 2, "criticality_low").otherwise("other"), F.when(F.col("p_partkey") % 5 == 0, "CRITICALITY_MEDIUM").otherwise("PII"))
    return _t(spark, d, "part").select("p_partkey", values.criticality(tokens).alias("criticality"))


_EDGES_SQL = "SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders"


def _edges(spark, d):
    def edge(table, a, src, b, dst):
        return _t(spark, d, table).select(F.concat(F.lit(a), F.col(src).cast("string")).alias("src"), F.concat(F.lit(b), F.col(dst).cast("string")).alias("dst"))

    return edge("nation", "r", "n_regionkey", "n", "n_nationkey").unionByName(edge("customer", "n", "c_nationkey", "c", "c_custkey")).unionByName(edge("supplier", "n", "s_nationkey", "s", "s_suppkey")).unionByName(edge("orders", "c", "o_custkey", "o", "o_orderkey"))


@_query("path_closure_3hop", f"WITH RECURSIVE e AS ({_EDGES_SQL}), x(node, degree, path) AS (SELECT 'r2', 0, 'r2' UNION ALL SELECT e.dst, x.degree + 1, x.path || '>' || e.dst FROM x JOIN e ON e.src = x.node WHERE x.degree < 3) SELECT node, CAST(min(degree) AS BIGINT) AS degree, min(path) AS path FROM x WHERE degree > 0 GROUP BY node")
def path_closure_3hop(spark, d):
    found = graph.reachable(_edges(spark, d), spark.createDataFrame([("r2",)], "node string"))
    return found.select("node", F.col("degree").cast("long").alias("degree"), F.array_join("path", ">").alias("path"))


@_query("lineage_paths_limited", f"""WITH RECURSIVE e AS ({_EDGES_SQL} UNION ALL SELECT 'o' || o_orderkey, 'r' || o_custkey % 5 FROM orders), s AS (SELECT DISTINCT src FROM e WHERE src LIKE 'r%' OR src LIKE 'n%'),
x(source, node, degree) AS (SELECT src, src, 0 FROM s UNION SELECT x.source, e.dst, x.degree + 1 FROM x JOIN e ON e.src = x.node WHERE x.degree < 3),
m AS (SELECT source, node, min(degree) AS degree FROM x GROUP BY 1, 2), p AS (SELECT m.source, m.node, m.degree, min(b.node) AS parent FROM m JOIN e ON e.dst = m.node JOIN m b ON b.source = m.source AND b.node = e.src AND b.degree = m.degree - 1 WHERE m.degree > 0 GROUP BY 1, 2, 3),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY degree, node) AS place FROM p)
SELECT l.source, l.node, CAST(l.degree AS BIGINT) AS degree, l.source || CASE WHEN l.degree = 3 THEN '>' || g.parent ELSE '' END || CASE WHEN l.degree > 1 THEN '>' || l.parent ELSE '' END || '>' || l.node AS path FROM l LEFT JOIN p g ON g.source = l.source AND g.node = l.parent AND l.degree > 1 WHERE place <= 100""")
def lineage_paths_limited(spark, d):
    """Many sources, edges that lead back, and at most a hundred results a source."""
    back = _t(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("r"), (F.col("o_custkey") % 5).cast("string")).alias("dst"))
    edges = _edges(spark, d).unionByName(back)
    sources = edges.where("src like 'r%' or src like 'n%'").select(F.col("src").alias("node")).distinct()
    found = graph.reachable(edges, sources, limit=graph.MAX_RESULTS)
    return found.select("source", "node", F.col("degree").cast("long").alias("degree"), F.array_join("path", ">").alias("path"))


@_query("downstream_assets", """WITH e AS (SELECT CASE WHEN p_partkey % 11 <> 0 THEN 'u' || p_partkey END AS urn, CASE WHEN p_partkey % 13 <> 0 THEN 'db.' || CASE WHEN p_size % 5 = 0 THEN upper(p_brand) ELSE p_brand END END AS name, p_size, p_partkey FROM part)
SELECT urn, name, CASE p_size % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' END AS criticality, lower(split_part(name, '.', -1)) = lower('Brand#12') AS is_representation, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 6 = 0 THEN 's' ELSE 's>' || urn END AS path FROM e WHERE urn IS NOT NULL AND name IS NOT NULL""")
def downstream_assets(spark, d):
    key, size, brand = F.col("p_partkey"), F.col("p_size") % 3, F.col("p_brand")
    urn = F.when(key % 11 != 0, F.concat(F.lit("u"), key.cast("string")))
    node = lambda x: F.struct(x.alias("urn"), F.lit("DATASET").alias("type"))
    first = F.array(node(F.lit("s")), node(F.when(key % 6 != 0, urn)))  # an element without a urn goes
    paths = F.when(key % 4 != 0, F.array(first, F.array(node(F.lit("other"))))).otherwise(F.array().cast("array<array<struct<urn:string,type:string>>>"))
    tokens = F.when(size == 0, F.array(F.lit("urn:li:tag:criticality-high"), F.lit("CRITICALITY:LOW"))).when(size == 1, F.array(F.lit("Criticality_low"))).otherwise(F.array(F.lit("PII")))
    name = F.when(key % 13 != 0, F.concat(F.lit("db."), F.when(F.col("p_size") % 5 == 0, F.upper(brand)).otherwise(brand)))
    none = F.lit(None).cast("string")
    raw = _t(spark, d, "part").select(urn.alias("urn"), name.alias("name"), none.alias("type"), none.alias("platform"), F.lit(1).alias("degree"), tokens.alias("tokens"), paths.alias("paths"))
    return graph.assets(raw, "prod.Brand#12").select("urn", "name", "criticality", "is_representation", F.array_join("lineage_path.urn", ">").alias("path"))


_IMPACT_POLICY = {"policy_id": "p", "ignore_representation_copies": True, "require_verified_paths": True, "default_criticality": "MEDIUM", "no_downstream_action": "AUTO_PR", "actions": {"LOW": "AUTO_PR", "MEDIUM": "REVIEW_REQUIRED", "HIGH": "BLOCK_AUTO_MERGE"}}
# Assets derived from parts: a brand is a source, its parts are the consumers.
_ASSETS_SQL = """SELECT p_brand AS source, 'u' || p_partkey AS urn, CASE p_size % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN CASE WHEN p_partkey % 40 = 0 THEN 'HIGH' ELSE 'LOW' END END AS declared,
 p_partkey % 7 = 0 AS copy, p_partkey % 3 <> 0 AS verified FROM part"""


def _assets(spark, d):
    n, urn = F.col("p_size") % 4, F.concat(F.lit("u"), F.col("p_partkey").cast("string"))
    kind = F.lit(None).cast("string")
    node = lambda x: F.struct(x.alias("urn"), kind.alias("type"))
    return _t(spark, d, "part").select(
        F.col("p_brand").alias("source"),
        urn.alias("urn"),
        F.when(n == 0, "LOW").when(n == 1, "MEDIUM").when(n == 2, F.when(F.col("p_partkey") % 40 == 0, "HIGH").otherwise("LOW")).alias("criticality"),
        (F.col("p_partkey") % 7 == 0).alias("is_representation"),
        F.when(F.col("p_partkey") % 3 != 0, F.array(node(F.col("p_brand")), node(urn))).otherwise(F.array(node(F.col("p_brand")))).alias("lineage_path"),
    )


@_query("impact_routing", f"""WITH a AS ({_ASSETS_SQL}), c AS (SELECT *, coalesce(declared, 'MEDIUM') AS level FROM a WHERE NOT copy),
r AS (SELECT source, CASE level WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS lv, CASE WHEN level = 'LOW' AND verified THEN 1 WHEN level = 'HIGH' THEN 3 ELSE 2 END AS ac FROM c),
g AS (SELECT s.source, count(r.lv) AS affected, max(lv) AS lv, coalesce(max(ac), 1) AS ac FROM (SELECT DISTINCT source FROM a) s LEFT JOIN r USING (source) GROUP BY s.source)
SELECT source, CAST(affected AS BIGINT) AS affected, CASE lv WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' END AS highest_criticality, CASE ac WHEN 1 THEN 'AUTO_PR' WHEN 2 THEN 'REVIEW_REQUIRED' ELSE 'BLOCK_AUTO_MERGE' END AS admission_action, CASE ac WHEN 1 THEN 'PASS' WHEN 2 THEN 'REVIEW' ELSE 'BLOCK' END AS status FROM g""")
def impact_routing(spark, d):
    return impact.decision(impact.routed(_assets(spark, d), F.col("source"), _IMPACT_POLICY), _IMPACT_POLICY, ["source"])


@_query("path_verified", f"SELECT urn, verified AS path_verified, CASE WHEN coalesce(declared, 'MEDIUM') = 'HIGH' THEN 'BLOCK_AUTO_MERGE' WHEN coalesce(declared, 'MEDIUM') = 'LOW' AND verified THEN 'AUTO_PR' ELSE 'REVIEW_REQUIRED' END AS required_action FROM ({_ASSETS_SQL})")
def path_verified(spark, d):
    return impact.routed(_assets(spark, d), F.col("source"), _IMPACT_POLICY).select("urn", "path_verified", "required_action")


@_query("allowed_actions", "WITH v AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN ['urn:li:tag:PII', 'pii'] WHEN 1 THEN ['x:secret', 'PII'] ELSE ['other'] END AS tokens FROM part) SELECT p_partkey, CASE WHEN len(list_filter(tokens, lambda t: upper(split_part(t, ':', -1)) = 'SECRET')) > 0 THEN 'mask,exclude' WHEN len(list_filter(tokens, lambda t: upper(split_part(t, ':', -1)) = 'PII')) > 0 THEN 'exclude' ELSE '' END AS actions FROM v")
def allowed_actions(spark, d):
    n = F.col("p_size") % 3
    tokens = F.when(n == 0, F.array(F.lit("urn:li:tag:PII"), F.lit("pii"))).when(n == 1, F.array(F.lit("x:secret"), F.lit("PII"))).otherwise(F.array(F.lit("other")))
    violations = _t(spark, d, "part").select("p_partkey", tokens.alias("tokens"))
    return governance.allowed_actions(violations, {"PII": ["exclude"], "SECRET": ["mask", "exclude"]}).select("p_partkey", F.array_join("actions", ",").alias("actions"))


# --- plan analysis ------------------------------------------------------------------------------------------------


@_query("schema_ref_check", "WITH refs(name) AS (VALUES ('c_custkey'), ('C_NAME'), ('c_email'), ('loyalty_tier')) SELECT name FROM refs WHERE lower(name) NOT IN (SELECT lower(column_name) FROM (VALUES ('c_custkey'), ('c_name'), ('c_nationkey'), ('c_acctbal'), ('c_mktsegment')) t(column_name))")
def schema_ref_check(spark, d):
    refs = spark.createDataFrame([("c_custkey",), ("C_NAME",), ("c_email",), ("loyalty_tier",)], "name string")
    return schema_gate.not_in(refs, spark.createDataFrame([(c,) for c in _t(spark, d, "customer").columns], "column_name string"))


@_query("lineage_violations", "WITH pairs(output_column, source_column) AS (VALUES ('label', 'C_NAME'), ('label', 'c_mktsegment'), ('total', 'c_acctbal'), ('key', 'c_custkey')), tagged(column_name, token) AS (VALUES ('c_name', 'PII'), ('c_name', 'RESTRICTED'), ('c_acctbal', 'urn:li:tag:PII')) SELECT output_column, source_column, token AS classification FROM pairs JOIN tagged ON lower(source_column) = lower(column_name) WHERE lower(token) IN ('pii', 'urn:li:tag:pii')")
def lineage_violations(spark, d):
    pairs = spark.createDataFrame([("label", "C_NAME"), ("label", "c_mktsegment"), ("total", "c_acctbal"), ("key", "c_custkey")], "output_column string, source_column string")
    tagged = spark.createDataFrame([("c_name", "PII"), ("c_name", "RESTRICTED"), ("c_acctbal", "urn:li:tag:PII")], "column_name string, token string")
    return governance.violations(pairs, tagged, ["PII", "urn:li:tag:PII"])


_CUSTOMER_CONTEXT = {"table_name": "customer", "urn": "urn:customer", "fields": [{"fieldPath": "c_custkey", "nativeDataType": "BIGINT"}, {"fieldPath": "c_name", "nativeDataType": "VARCHAR", "editedTags": ["PII"]}, {"fieldPath": "c_nationkey", "nativeDataType": "INTEGER"}, {"fieldPath": "c_acctbal", "nativeDataType": "DOUBLE"}, {"fieldPath": "c_mktsegment", "nativeDataType": "VARCHAR"}]}
_GOVERNANCE_POLICY = {"version": 1, "policy_id": "pii", "scope": "final_output", "denied_classifications": ["PII", "urn:li:tag:PII"], "fail_closed_on_unresolved_lineage": True, "allowed_actions_by_classification": {"PII": ["exclude"]}, "repair": {"strategy": "drop_projection", "replacement_identity": "c_custkey", "max_attempts": 1}}


@_query("pii_drop_projection", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal >= 5000")
def pii_drop_projection(spark, d):
    from . import repair

    own = _t(spark, d, "customer").where("c_acctbal >= 5000").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return repair.drop_projections(own, lineage.of_dataframe(own), _CUSTOMER_CONTEXT, _GOVERNANCE_POLICY)


_LIVE_SQL = "WITH base AS (SELECT *, upper(c_name) AS shout FROM customer) SELECT c_custkey, shout AS label, count(*) OVER (PARTITION BY c_nationkey) AS peers, (SELECT max(c_name) FROM customer) AS last_name FROM base"


@_query("lineage_live_report", "SELECT * FROM (VALUES ('c_custkey', 'c_custkey'), ('label', 'c_name'), ('peers', 'c_nationkey'), ('last_name', 'c_name')) t(output_column, source_column)")
def lineage_live_report(spark, d):
    rows = [(o.name, s) for o in lineage.of_sql(spark, _LIVE_SQL, _CUSTOMER_CONTEXT) for s in sorted(o.sources) or [""]]
    return spark.createDataFrame(rows, "output_column string, source_column string")


@_query("schema_gate_live_report", "SELECT * FROM (VALUES ('c_email', 'not_in_context_schema'), ('loyalty', 'not_produced_by_derived_source')) t(column_name, reasons)")
def schema_gate_live_report(spark, d):
    report = schema_gate.validate(spark, "WITH t AS (SELECT c_custkey, c_email AS mail FROM customer) SELECT mail, loyalty FROM t", _CUSTOMER_CONTEXT)
    return spark.createDataFrame([(x["column"], ",".join(x["reasons"])) for x in report["invalid_details"]], "column_name string, reasons string")


# Candidates derived from parts: a dozen different texts over customer, by the size of the part.
_TEXTS = {0: "SELECT c_custkey, c_email FROM customer QUALIFY row_number() OVER (ORDER BY c_tier) <= {n}", 1: "WITH t AS (SELECT c_custkey, c_name AS Label FROM customer) SELECT c_custkey, Label, label FROM t WHERE c_custkey > {n}", 2: "SELECT upper(c_name) || c_mktsegment AS label, c_custkey FROM customer WHERE c_acctbal > {n}", 3: "SELECT * EXCLUDE (c_acctbal, c_mktsegment) FROM customer LIMIT {n}"}


def _texts(spark, d) -> DataFrame:
    kind, n = F.col("p_size") % 4, (F.col("p_size") % 3).cast("string")
    sql = F.coalesce(*(F.when(kind == k, F.replace(F.lit(t), F.lit("{n}"), n)) for k, t in _TEXTS.items()))
    return _t(spark, d, "part").select("p_partkey", sql.alias("sql"))


@_query("schema_gate_table", "SELECT p_partkey, x.column_name, 'not_in_context_schema' AS reason FROM part CROSS JOIN (VALUES ('c_email'), ('c_tier')) x(column_name) WHERE p_size % 4 = 0")
def schema_gate_table(spark, d):
    from . import analysis

    return analysis.schema_findings(_texts(spark, d), _CUSTOMER_CONTEXT)


_PAIRS_SQL = "SELECT p_partkey, x.* EXCLUDE (kind) FROM part JOIN (VALUES (1, 1, 'c_custkey', 'c_custkey'), (1, 2, 'Label', 'c_name'), (1, 3, 'label', 'c_name'), (2, 1, 'label', 'c_name'), (2, 1, 'label', 'c_mktsegment'), (2, 2, 'c_custkey', 'c_custkey'), (3, 1, 'c_custkey', 'c_custkey'), (3, 2, 'c_name', 'c_name'), (3, 3, 'c_nationkey', 'c_nationkey')) x(kind, position, output_column, source_column) ON x.kind = p_size % 4"


@_query("lineage_table", _PAIRS_SQL)
def lineage_table(spark, d):
    from . import analysis

    return analysis.lineage_pairs(_texts(spark, d), _CUSTOMER_CONTEXT).where("not unresolved").drop("unresolved")


@_query("governance_table", f"SELECT p_partkey, position, output_column, source_column, 'PII' AS classification FROM ({_PAIRS_SQL}) WHERE source_column = 'c_name'")
def governance_table(spark, d):
    from . import analysis

    pairs = analysis.lineage_pairs(_texts(spark, d), _CUSTOMER_CONTEXT).where("not unresolved").drop("unresolved")
    return analysis.violations(pairs, _CUSTOMER_CONTEXT, _GOVERNANCE_POLICY)


@_query("column_contract_table", f"""WITH o AS (SELECT DISTINCT p_partkey, position, lower(output_column) AS name FROM ({_PAIRS_SQL})), r AS (SELECT DISTINCT p_partkey, x.name FROM o CROSS JOIN (VALUES ('C_CUSTKEY'), ('Label')) x(name))
SELECT p_partkey, 'duplicate_output_columns' AS type, name AS "column" FROM o GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT r.p_partkey, 'missing_required_columns', r.name FROM r WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.p_partkey = r.p_partkey AND o.name = lower(r.name))
UNION ALL SELECT DISTINCT p_partkey, 'unexpected_output_columns', name FROM o WHERE name NOT IN ('c_custkey', 'label') AND p_partkey % 2 = 0""")
def column_contract_table(spark, d):
    from . import analysis

    outputs = analysis.lineage_pairs(_texts(spark, d), _CUSTOMER_CONTEXT).where("not unresolved").select("p_partkey", "position", F.col("output_column").alias("column")).distinct()
    tasks = outputs.select("p_partkey").distinct()
    required = tasks.withColumn("column", F.explode(F.array(F.lit("C_CUSTKEY"), F.lit("Label"))))
    return contract.name_findings(outputs, required, ["p_partkey"], tasks.where("p_partkey % 2 <> 0"))


# --- provenance, memory, sets ---------------------------------------------------------------------------------------


@_query("manifest_verify", "WITH e AS (SELECT 'f' || o_orderkey AS path, sha256(CAST(o_custkey AS VARCHAR)) AS h, o_custkey AS b FROM orders WHERE o_orderkey % 7 <> 0), a AS (SELECT 'f' || o_orderkey AS path, sha256(CAST(CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 1 ELSE o_custkey END AS VARCHAR)) AS h, o_custkey AS b FROM orders WHERE o_orderkey % 5 <> 0) SELECT coalesce(e.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'missing_file' WHEN e.path IS NULL THEN 'unexpected_file' ELSE 'file_digest_mismatch' END AS problem FROM e FULL OUTER JOIN a ON e.path = a.path WHERE a.path IS NULL OR e.path IS NULL OR e.h <> a.h")
def manifest_verify(spark, d):
    o = _t(spark, d, "orders")
    path = F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path")

    def entries(rows, key):
        return rows.select(path, F.sha2(key.cast("string"), 256).alias("sha256"), F.col("o_custkey").alias("bytes"))

    changed = F.when(F.col("o_orderkey") % 11 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    return provenance.differences(entries(o.where("o_orderkey % 7 <> 0"), F.col("o_custkey")), entries(o.where("o_orderkey % 5 <> 0"), changed))


@_query("row_sha256", "SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus) AS digest FROM orders")
def row_sha256(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus"), 256).alias("digest"))


_ENTRIES_SQL = "SELECT 'u' || c_nationkey AS url, c_mktsegment AS task, 'n' || c_custkey % 60 AS note, 'Run: r' || c_custkey || chr(10) || 'Task: ' || c_mktsegment || chr(10) || 'Note: n' || c_custkey % 60 AS description, c_custkey FROM customer"


@_query("memory_append", f"WITH e AS ({_ENTRIES_SQL}), log AS (SELECT url, description FROM e WHERE c_custkey % 3 = 0) SELECT url, description FROM log UNION ALL SELECT url, description FROM e WHERE NOT EXISTS (SELECT 1 FROM log WHERE log.url = e.url AND contains(log.description, 'Task: ' || e.task) AND contains(log.description, 'Note: ' || e.note))")
def memory_append(spark, d):
    key = F.col("c_custkey")
    note = F.concat(F.lit("n"), (key % 60).cast("string"))
    text = F.concat(F.lit("Run: r"), key.cast("string"), F.lit("\nTask: "), "c_mktsegment", F.lit("\nNote: "), note)
    entries = _t(spark, d, "customer").select(F.concat(F.lit("u"), F.col("c_nationkey").cast("string")).alias("url"), F.col("c_mktsegment").alias("task"), note.alias("note"), text.alias("description"), "c_custkey")
    log = entries.where("c_custkey % 3 = 0").select("url", "description")
    # a note such as n1 is held by an element with n12, too: containment decides, not equality
    return log.unionByName(memory.absent(entries, log).select("url", "description"))


@_query("append_log_race", f"WITH e AS ({_ENTRIES_SQL}) SELECT url, min(description) AS description FROM e GROUP BY url, task, note")
def append_log_race(spark, d):
    """Two appenders at once give the same entries to a new log; each entry is there once."""
    from concurrent.futures import ThreadPoolExecutor

    from ..operators import stable
    from ..sources.log import AppendLog

    key = F.col("c_custkey")
    note = F.concat(F.lit("n"), (key % 60).cast("string"))
    text = F.concat(F.lit("Run: r"), key.cast("string"), F.lit("\nTask: "), "c_mktsegment", F.lit("\nNote: "), note)
    entries = _t(spark, d, "customer").select(F.concat(F.lit("u"), F.col("c_nationkey").cast("string")).alias("url"), F.col("c_mktsegment").alias("task"), note.alias("note"), text.alias("description"))
    log = AppendLog(spark, stable.new_folder(spark, "append-log"))
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda _: log.append(entries), range(2)))
    return log.read()


@_query("paged_fields", "SELECT CAST(p_partkey AS BIGINT) AS field_id, p_name AS field_path, p_brand AS native_type, CAST(p_size AS BIGINT) AS size FROM part")
def paged_fields(spark, d):
    """The parts as a service's pages of fields, read back through the registered source by page ranges."""
    from ..operators import stable
    from ..sources import paged

    size, folder = 100, stable.new_folder(spark, "pages")
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("field_id"), F.col("p_name").alias("field_path"), F.col("p_brand").alias("native_type"), F.col("p_size").cast("long").alias("size"))
    from ..operators.positions import with_position

    placed = with_position(rows.orderBy("field_id"), "at").withColumn("at", F.col("at") - 1)
    total = placed.count()
    lines = placed.select("at", F.floor(F.col("at") / size).cast("int").alias("page"), F.to_json(F.struct("at", "field_id", "field_path", "native_type", "size")).alias("value"))
    lines.repartition("page").select("page", "value").write.mode("append").partitionBy("page").text(folder)

    def fetch(offset: int, limit: int) -> dict:
        import json

        from pyarrow import fs

        store, own = fs.FileSystem.from_uri(folder)
        found = []
        for info in store.get_file_info(fs.FileSelector(f"{own}/page={offset // size}", allow_not_found=True)):
            if info.base_name.startswith("part-"):
                with store.open_input_stream(info.path, compression=None) as stream:
                    found += [json.loads(x) for x in stream.read().decode().splitlines()]
        wanted = sorted((r for r in found if offset <= r["at"] < offset + limit), key=lambda r: r["at"])
        return {"fields": wanted, "offset": offset, "totalFields": total}

    spark.dataSource.register(paged.paged("plumbline_pages", fetch, "field_id long, field_path string, native_type string, size long", page=size, pages=4))
    return spark.read.format("plumbline_pages").load()


_GRID_SQL = "SELECT 't' || p_partkey AS task_id, m.mode, p_partkey, p_size FROM part CROSS JOIN (VALUES ('blind'), ('context')) m(mode) WHERE p_size <= 10"


@_query("stored_candidates", f"SELECT task_id, mode, CASE WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 7 = 0 AND mode = 'blind' THEN 'empty' ELSE 'present' END AS state, CASE WHEN p_partkey % 5 <> 0 AND NOT (p_partkey % 7 = 0 AND mode = 'blind') THEN 'select ' || p_size || ' as n' END AS sql FROM ({_GRID_SQL})")
def stored_candidates(spark, d):
    """Candidates stored as one file each, read as a table against the grid of tasks; missing and empty ones stay."""
    from ..operators import stable
    from ..sources import texts

    folder, key = stable.new_folder(spark, "candidates"), F.col("p_partkey")
    own = _t(spark, d, "part").where("p_size <= 10")
    tasks = own.select(F.concat(F.lit("t"), key.cast("string")).alias("task_id"))
    files = own.where(key % 5 != 0).withColumn("mode", F.explode(F.array(F.lit("blind"), F.lit("context"))))
    name = F.concat(F.lit("t"), key.cast("string"), F.lit("__"), "mode", F.lit(".sql"))
    text = F.when((key % 7 == 0) & (F.col("mode") == "blind"), F.lit(" \n")).otherwise(F.concat(F.lit("select "), F.col("p_size").cast("string"), F.lit(" as n")))

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for n, t in zip(*(batch.column(c).to_pylist() for c in ("name", "text")), strict=True):
                store, to = fs.FileSystem.from_uri(folder)
                with store.open_output_stream(f"{to}/{n}", compression=None) as out:
                    out.write(t.encode())
            yield pa.RecordBatch.from_arrays([batch.column("name")], ["name"])

    files.select(name.alias("name"), text.alias("text")).mapInArrow(write, "name string").count()
    return texts.candidates(texts.whole_texts(spark, folder), tasks, ["blind", "context"]).select("task_id", "mode", "state", "sql")


@_query("file_digests", "SELECT 'n_nationkey=' || n_nationkey AS folder, sha256(repeat(n_name || '-', 20000) || chr(10)) AS sha256, CAST(20000 * (length(n_name) + 1) + 1 AS BIGINT) AS bytes FROM nation")
def file_digests(spark, d):
    """A file a nation, of several chunks, digested where it is read."""
    from ..operators import stable

    folder = stable.new_folder(spark, "files")
    _t(spark, d, "nation").select("n_nationkey", F.repeat(F.concat("n_name", F.lit("-")), F.lit(20000)).alias("value")).repartition("n_nationkey").write.mode("append").partitionBy("n_nationkey").text(folder)
    found = provenance.file_digests(spark, folder, chunk=1 << 16).where(F.col("path").rlike(r"(^|/)part-"))
    return found.select(F.substring_index("path", "/", 1).alias("folder"), "sha256", "bytes")


@_query("tag_ensure", "WITH have AS (SELECT DISTINCT 'T' || p_size AS tag, 'old' AS description FROM part WHERE p_size % 3 = 0) SELECT * FROM have UNION ALL SELECT 'T' || p_size, min(p_brand) FROM part WHERE 'T' || p_size NOT IN (SELECT tag FROM have) GROUP BY 1")
def tag_ensure(spark, d):
    tag = F.concat(F.lit("T"), F.col("p_size").cast("string")).alias("tag")
    p = _t(spark, d, "part")
    return memory.ensured_tags(p.select(tag, F.col("p_brand").alias("description")), p.where("p_size % 3 = 0").select(tag, F.lit("old").alias("description")).distinct())


@_query("graph_upsert", "WITH a AS (SELECT 'u' || p_partkey AS urn, p_brand AS name, p_size AS degree FROM part WHERE p_partkey % 2 = 0), e AS (SELECT 'u' || p_partkey AS urn, upper(p_name) AS name, p_size + 1 AS degree FROM part WHERE p_partkey % 3 = 0) SELECT coalesce(e.urn, a.urn) AS urn, CASE WHEN e.urn IS NULL THEN a.name ELSE e.name END AS name, CAST(CASE WHEN e.urn IS NULL THEN a.degree ELSE e.degree END AS INTEGER) AS degree FROM e FULL JOIN a ON e.urn = a.urn")
def graph_upsert(spark, d):
    p = _t(spark, d, "part").withColumn("urn", F.concat(F.lit("u"), F.col("p_partkey").cast("string")))
    actual = p.where("p_partkey % 2 = 0").select("urn", F.col("p_brand").alias("name"), F.col("p_size").cast("int").alias("degree"))
    expected = p.where("p_partkey % 3 = 0").select("urn", F.upper("p_name").alias("name"), (F.col("p_size") + 1).cast("int").alias("degree"))
    return memory.upserted(expected, actual)


@_query("graph_mismatches", "WITH a AS (SELECT 'u' || p_partkey AS urn, CASE WHEN p_size > 25 THEN p_brand END AS name FROM part WHERE p_partkey % 5 <> 0), e AS (SELECT 'u' || p_partkey AS urn, CASE WHEN p_size > 10 THEN p_brand END AS name FROM part) SELECT e.urn, CASE WHEN a.urn IS NULL THEN 'missing' ELSE 'mismatched' END AS problem FROM e LEFT JOIN a ON e.urn = a.urn WHERE a.urn IS NULL OR e.name IS DISTINCT FROM a.name")
def graph_mismatches(spark, d):
    p = _t(spark, d, "part").withColumn("urn", F.concat(F.lit("u"), F.col("p_partkey").cast("string")))
    actual = p.where("p_partkey % 5 <> 0").select("urn", F.when(F.col("p_size") > 25, F.col("p_brand")).alias("name"))
    return memory.graph_mismatches(p.select("urn", F.when(F.col("p_size") > 10, F.col("p_brand")).alias("name")), actual, ["name"])


@_query("tag_apply_missing", "SELECT 'f' || p_partkey AS field, 'PII' AS tag FROM part WHERE p_size > 10 UNION SELECT 'f' || p_partkey, CASE WHEN p_size < 30 THEN 'PII' ELSE 'OLD' END FROM part WHERE p_size < 40")
def tag_apply_missing(spark, d):
    p = _t(spark, d, "part").withColumn("field", F.concat(F.lit("f"), F.col("p_partkey").cast("string")))
    requested = p.where("p_size > 10").select("field", F.lit("PII").alias("tag"))
    tagged = p.where("p_size < 40").select("field", F.when(F.col("p_size") < 30, "PII").otherwise("OLD").alias("tag"))
    return memory.with_tags(requested, tagged, p.select("field"))


@_query("set_diff", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 450000")
def set_diff(spark, d):
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(_t(spark, d, "orders").where("o_totalprice > 450000").select("o_custkey"))


@_query("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, d):
    return _t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(_t(spark, d, "supplier").select("s_nationkey"))


@_query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT n_regionkey FROM nation")
def set_union(spark, d):
    return _t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(_t(spark, d, "nation").select("n_regionkey")).distinct()
