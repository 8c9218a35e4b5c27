"""Declared native types as Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Type names that contexts declare.
_PLAIN = {"INTEGER": T.IntegerType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType()}


def spark_type(native: str | None) -> T.DataType:
    """Unknown and missing types are strings; so is VARCHAR, with or without a length."""
    name = (native or "VARCHAR").strip().upper()
    if m := re.fullmatch(r"(?:DECIMAL|NUMERIC)\((\d+)\s*,\s*(\d+)\)", name):
        return T.DecimalType(int(m[1]), int(m[2]))
    return _PLAIN.get(name, T.StringType())


def context_schema(fields: list[dict]) -> T.StructType:
    """All columns nullable whatever is declared, since Catalyst takes a false 'not null' as a fact; the declaration is metadata."""
    return T.StructType([T.StructField(f["fieldPath"], spark_type(f.get("nativeDataType")), True, {"declared_nullable": bool(f.get("nullable", True)), "native_type": f.get("nativeDataType") or "UNKNOWN"}) for f in fields])
