"""Result contracts: declarative checks over a result, counted while it is written or in one aggregate pass, plus a grouped pass per value count."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import is_number, number, plain, spelled
from .positions import with_position

SAMPLES = 5
#: Values without an expected count that a report lists.
UNEXPECTED = 20


class ContractError(ValueError):
    """A contract that can't be evaluated."""


@dataclass
class Contract:
    contract_id: str
    required_columns: list[str] = field(default_factory=list)
    allow_extra_columns: bool = True
    exact_row_count: int | None = None
    non_null_columns: list[str] = field(default_factory=list)
    null_defaults: dict[str, Any] = field(default_factory=dict)
    unique_columns: list[str] = field(default_factory=list)
    numeric_ranges: dict[str, dict[str, Any]] = field(default_factory=dict)
    value_counts: dict[str, dict[str, int]] = field(default_factory=dict)

    @classmethod
    def of(cls, raw: dict[str, Any]) -> Contract:
        if not isinstance(raw.get("contract_id"), str) or not raw["contract_id"]:
            raise ContractError("a contract needs a contract_id")
        c = cls(**{k: v for k, v in raw.items() if k in cls.__dataclass_fields__})
        for name, kind in (("required_columns", list), ("non_null_columns", list), ("unique_columns", list), ("null_defaults", dict), ("numeric_ranges", dict), ("value_counts", dict)):
            if not isinstance(getattr(c, name), kind):
                raise ContractError(f"{name} must be a {kind.__name__}")
        if not all(isinstance(x, str) for x in c.required_columns):
            raise ContractError("required_columns must be strings")
        counts = [c.exact_row_count, *(d.get("expected_replacements") for d in c.null_defaults.values() if isinstance(d, dict))]
        counts += [n for m in c.value_counts.values() if isinstance(m, dict) for n in m.values()]
        if any(n is not None and (not isinstance(n, int) or isinstance(n, bool) or n < 0) for n in counts):
            raise ContractError("counts must be non-negative integers")
        if any(isinstance(d, dict) and "value" not in d for d in c.null_defaults.values()):
            raise ContractError("a null default needs a value")
        if not all(isinstance(m, dict) for m in [*c.numeric_ranges.values(), *c.value_counts.values()]):
            raise ContractError("ranges and value counts must be objects")
        return c


def _places(columns: list[str]) -> dict[str, int]:
    """The first place of each name, whatever its case."""
    return {x.casefold(): i for i, x in reversed(list(enumerate(columns)))}


def _flat(df: DataFrame) -> DataFrame:
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # names may repeat


def measures(df: DataFrame, contract: Contract) -> dict[str, Column]:
    """Counts of the contract that one pass over c0, c1, ... gives without distinct values: rows, nulls, replaced defaults, values out of range."""
    at, kinds = _places(df.columns), [f.dataType for f in df.schema.fields]
    wanted = {"rows": F.count(F.lit(1))}
    for name in contract.non_null_columns:
        if isinstance(name, str) and (i := at.get(name.casefold())) is not None:
            wanted[f"nulls:{name}"] = F.count_if(F.col(f"c{i}").isNull())
            default = contract.null_defaults.get(name)
            if isinstance(default, dict) and default.get("expected_replacements") is not None:
                value = default["value"]
                comparable = value is None or is_number(kinds[i]) == isinstance(value, (bool, int, float))
                hit = (F.lit(False) if not comparable else number(F.col(f"c{i}"), kinds[i]) == F.lit(float(value)) if is_number(kinds[i]) and value is not None else F.col(f"c{i}").isNull() if value is None else F.col(f"c{i}").cast("string") == F.lit(str(value)))
                wanted[f"defaults:{name}"] = F.count_if(hit)
    for name, bounds in contract.numeric_ranges.items():
        if (i := at.get(name.casefold())) is not None:
            wanted[f"outside:{name}"] = F.count_if(_outside(f"c{i}", kinds[i], bounds))
    return wanted


def _unique(df: DataFrame, contract: Contract) -> dict[str, int]:
    """Names of columns that should be unique, with their places."""
    at = _places(df.columns)
    return {n: at[n.casefold()] for n in contract.unique_columns if isinstance(n, str) and n.casefold() in at}


def watched(df: DataFrame, contract: Contract) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """df, whose next action counts measures() on its way, and a function that gives them then."""
    seen, wanted = Observation(), measures(df, contract)
    out = _flat(df).observe(seen, *(e.alias(f"m{n}") for n, e in enumerate(wanted.values()))).toDF(*df.columns)
    return out, lambda: {k: seen.get[f"m{n}"] for n, k in enumerate(wanted)}


def distinct_counts(df: DataFrame, places: dict[str, int]) -> dict[str, int]:
    """How many values columns have, null being one: by one grouping over pairs of column and value, for all columns together."""
    if not places:
        return {}
    flat, kinds = _flat(df), [f.dataType for f in df.schema.fields]

    def shown(i: int) -> Column:
        col, kind = F.col(f"c{i}"), kinds[i]
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            col = col + F.lit(0.0).cast(kind)  # one zero
        return F.to_json(F.struct(col.alias("v"))) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else F.base64(col) if isinstance(kind, T.BinaryType) else col.cast("string")

    pairs = flat.select(F.explode(F.array(*(F.struct(F.lit(i).alias("at"), shown(i).alias("value")) for i in set(places.values())))).alias("p")).select("p.*")
    found = {r["at"]: r["n"] for r in pairs.distinct().groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a column
    return {f"distinct:{name}": found.get(i, 0) for name, i in places.items()}


def metrics(df: DataFrame, contract: Contract) -> dict[str, int]:
    """All counts of the contract in one pass: measures(), and distinct values (null is one)."""
    wanted = measures(df, contract)
    wanted |= {f"distinct:{name}": F.count_distinct(F.struct(f"c{i}")) for name, i in _unique(df, contract).items()}
    row = _flat(df).agg(*(e.alias(f"m{n}") for n, e in enumerate(wanted.values()))).first()
    return dict(zip(wanted, row, strict=True))


def _outside(column: str, kind, bounds: dict[str, Any]):
    col = F.col(column)
    if not is_number(kind):
        return col.isNotNull()
    x, bad = number(col, kind), F.lit(False)
    if bounds.get("min") is not None:
        bad = bad | (x < float(bounds["min"]))
    if bounds.get("max") is not None:
        bad = bad | (~F.isnan(x) & (x > float(bounds["max"])))
    return F.coalesce(bad, F.lit(False))


def samples(df: DataFrame, condition) -> list[int]:
    """The first row numbers, in result order, that meet the condition; run only after a failure."""
    return [r[0] for r in with_position(df).where(condition).select("row_number").orderBy("row_number").limit(SAMPLES).collect()]


def value_count_differences(df: DataFrame, column: str, expected: dict[str, int]) -> DataFrame:
    """value, actual_count, expected_count, matches: counts of spelled values against the expected, full outer."""
    kind = df.schema[column].dataType
    actual = df.groupBy(spelled(F.col(column), kind).alias("value")).agg(F.count(F.lit(1)).alias("actual_count"))
    wanted = df.sparkSession.createDataFrame([(k, int(v)) for k, v in expected.items()], "value string, expected_count long")
    both = actual.join(F.broadcast(wanted), "value", "full_outer")
    return both.withColumn("matches", F.col("actual_count").eqNullSafe(F.col("expected_count")))


def column_findings(columns: list[str], contract: Contract) -> list[dict[str, Any]]:
    """What the names of a result's columns violate: repeated, missing or unexpected ones, whatever their case."""
    folded, known, found = [x.casefold() for x in columns], {x.casefold() for x in contract.required_columns}, []
    if repeated := sorted({x for x in folded if folded.count(x) > 1}):
        found.append({"type": "duplicate_output_columns", "columns": repeated, "allowed_actions": ["rename_output_columns"]})
    if missing := [x for x in contract.required_columns if x.casefold() not in folded]:
        found.append({"type": "missing_required_columns", "columns": missing, "allowed_actions": ["add_required_output_aliases"]})
    if not contract.allow_extra_columns and (extra := [x for x in columns if x.casefold() not in known]):
        found.append({"type": "unexpected_output_columns", "columns": extra, "allowed_actions": ["exclude"]})
    return found


def name_findings(outputs: DataFrame, required: DataFrame, keys: list[str], open_: DataFrame | None = None) -> DataFrame:
    """As column_findings() for tables of results: keys, type, column (folded; of missing ones as required).

    outputs: keys and column, a row an output; required: keys and column; open_: keys of results that may have other columns.
    """
    names = outputs.select(*keys, F.lower("column").alias("folded"))
    wanted = required.select(*keys, F.col("column").alias("asked"), F.lower("column").alias("folded"))
    found = [
        names.groupBy(*keys, "folded").count().where("count > 1").select(*keys, F.lit("duplicate_output_columns").alias("type"), F.col("folded").alias("column")),
        wanted.join(names.distinct(), [*keys, "folded"], "left_anti").select(*keys, F.lit("missing_required_columns").alias("type"), F.col("asked").alias("column")),
    ]
    extra = names.distinct().join(wanted.select(*keys, "folded").distinct(), [*keys, "folded"], "left_anti")
    if open_ is not None:
        extra = extra.join(open_.select(*keys).distinct(), keys, "left_anti")
    found.append(extra.select(*keys, F.lit("unexpected_output_columns").alias("type"), F.col("folded").alias("column")))
    return found[0].unionByName(found[1]).unionByName(found[2])


def evaluate(df: DataFrame | None, contract: dict[str, Any] | Contract, seen: dict[str, int] | None = None) -> dict[str, Any]:
    """The gate's report. df None stands for a query that did not run: the gate is skipped. seen: what watched() has counted while df was written."""
    c = contract if isinstance(contract, Contract) else Contract.of(contract)
    if df is None:
        return {"gate": "result_quality", "status": "SKIPPED", "contract_id": c.contract_id, "violations": [], "message": "The query did not run."}
    violations = column_findings(df.columns, c)

    def violate(kind: str, action: str, **more) -> None:
        violations.append({"type": kind, **more, "allowed_actions": [action]})

    m = seen | distinct_counts(df, _unique(df, c)) if seen is not None else metrics(df, c)
    if c.exact_row_count is not None and m["rows"] != c.exact_row_count:
        violate("row_count_mismatch", "preserve_one_row_per_entity", expected=c.exact_row_count, actual=m["rows"])
    flat, at = _flat(df), _places(df.columns)
    nulls, unique, ranges, counts = {}, {}, {}, {}
    for name in c.non_null_columns:
        if f"nulls:{name}" not in m:
            continue
        n = m[f"nulls:{name}"]
        first = samples(flat, F.col(f"c{at[name.casefold()]}").isNull()) if n else []
        nulls[name] = {"status": "FAIL" if n else "PASS", "null_count": n, "sample_row_numbers": first}
        spec = c.null_defaults.get(name)
        default = spec["value"] if isinstance(spec, dict) else spec
        if f"defaults:{name}" in m:
            got, wanted = m[f"defaults:{name}"], spec["expected_replacements"]
            ok = got == wanted
            nulls[name] |= {"declared_default": default, "expected_replacements": wanted, "actual_replacements": got, "default_replacement_status": "PASS" if ok else "FAIL"}
            if not ok:
                nulls[name]["status"] = "FAIL"
                violate("null_default_count_mismatch", "apply_declared_null_default", column=name, declared_default=default, expected_replacements=wanted, actual_replacements=got)
        if n:
            violate("unexpected_nulls", "apply_declared_null_default", column=name, null_count=n, sample_row_numbers=first, **({"declared_default": default} if name in c.null_defaults else {}))
    for name in c.unique_columns:
        if f"distinct:{name}" in m:
            n = m["rows"] - m[f"distinct:{name}"]
            unique[name] = {"status": "FAIL" if n else "PASS", "duplicate_count": n}
            if n:
                violate("uniqueness_violation", "preserve_one_row_per_entity", column=name, duplicate_count=n)
    for name, bounds in c.numeric_ranges.items():
        if f"outside:{name}" in m:
            n, i = m[f"outside:{name}"], at[name.casefold()]
            ranges[name] = {"status": "FAIL" if n else "PASS", "minimum": bounds.get("min"), "maximum": bounds.get("max"), "invalid_count": n}
            if n:
                violate("numeric_range_violation", "correct_calculation", column=name, invalid_count=n, sample_row_numbers=samples(flat, _outside(f"c{i}", df.schema.fields[i].dataType, bounds)))
    for name, expected in c.value_counts.items():
        if name.casefold() in at:
            i = at[name.casefold()]
            differences = value_count_differences(flat, f"c{i}", expected)
            other = differences.where("expected_count is null")
            found = {r["value"]: r["actual_count"] for r in differences.where("expected_count is not null and actual_count is not null").orderBy("value").collect()}  # as many as are expected
            extra = other.orderBy("value").limit(UNEXPECTED).collect()
            more = other.count() if len(extra) == UNEXPECTED else len(extra)
            found |= {r["value"]: r["actual_count"] for r in extra}
            ok = not more and found == {str(k): v for k, v in expected.items()}
            counts[name] = {"status": "PASS" if ok else "FAIL", "expected": expected, "actual": found, "unexpected_values": more}
            if not ok:
                violate("value_count_mismatch", "correct_calculation", column=name, expected=expected, actual=found, unexpected_values=more)
    return {"gate": "result_quality", "status": "FAIL" if violations else "PASS", "contract_id": c.contract_id, "row_count": m["rows"], "columns": df.columns, "required_columns": c.required_columns, "null_quality": nulls, "uniqueness": unique, "numeric_ranges": ranges, "value_counts": counts, "violations": [{k: plain(v) for k, v in x.items()} for x in violations], "message": "The result violates its contract." if violations else "The result meets its contract."}


def report_rows(df: DataFrame, contract: Contract) -> DataFrame:
    """check_name, column_name, actual, expected, status: one row for each check of counts, from one pass over df."""
    m, rows = metrics(df, contract), []

    def add(check: str, column: str, actual: int, expected: int) -> None:
        rows.append((check, column, int(actual), int(expected), "PASS" if actual == expected else "FAIL"))

    if contract.exact_row_count is not None:
        add("row_count", "*", m["rows"], contract.exact_row_count)
    for key, n in m.items():
        check, _, column = key.partition(":")
        if check == "nulls":
            add("nulls", column, n, 0)
        elif check == "defaults":
            add("default_replacements", column, n, contract.null_defaults[column]["expected_replacements"])
        elif check == "distinct":
            add("duplicates", column, m["rows"] - n, 0)
        elif check == "outside":
            add("out_of_range", column, n, 0)
    return df.sparkSession.createDataFrame(rows, "check_name string, column_name string, actual long, expected long, status string")
