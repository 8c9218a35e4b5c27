"""Rules for values: closeness, text forms, names."""

from __future__ import annotations

import datetime
import decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

REL_TOL, ABS_TOL = 1e-9, 1e-6


def is_number(kind: T.DataType) -> bool:
    """Booleans are numbers too, as they are to Python."""
    return isinstance(kind, (T.NumericType, T.BooleanType))


def number(col: Column, kind: T.DataType) -> Column:
    return col.cast("int").cast("double") if isinstance(kind, T.BooleanType) else col.cast("double")


def close(left: Column, right: Column) -> Column:
    """Doubles within a relative 1e-9 or an absolute 1e-6; infinities only equal themselves; nulls are equal."""
    gap = F.greatest(F.greatest(F.abs(left), F.abs(right)) * REL_TOL, F.lit(ABS_TOL))
    near = (left == right) | (~F.isnan(left) & ~F.isnan(right) & (F.abs(left) < float("inf")) & (F.abs(right) < float("inf")) & (F.abs(left - right) <= gap))
    return F.when(left.isNull() | right.isNull(), left.isNull() & right.isNull()).otherwise(near)


def same(left: Column, right: Column, left_type: T.DataType, right_type: T.DataType) -> Column:
    """Numbers by closeness, dates and timestamps as moments (a date is its midnight), all else by null-safe equality."""
    moments = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if is_number(left_type) and is_number(right_type):
        return close(number(left, left_type), number(right, right_type))
    if isinstance(left_type, moments) and isinstance(right_type, moments):
        return left.cast("timestamp_ntz").eqNullSafe(right.cast("timestamp_ntz"))
    if type(left_type) is not type(right_type):
        return left.isNull() & right.isNull()
    return left.eqNullSafe(right)


def spelled(col: Column, kind: T.DataType) -> Column:
    """A value as contracts spell it: None, True, False, decimals of doubles."""
    text = F.when(col, "True").otherwise("False") if isinstance(kind, T.BooleanType) else col.cast("string")
    return F.coalesce(F.when(col.isNotNull(), text), F.lit("None"))


def short_name(col: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(col, ".", -1)


def classification_key(col: Column) -> Column:
    """What follows the last colon, in capitals."""
    return F.upper(F.substring_index(col, ":", -1))


def concat_skipping_nulls(*cols: Column) -> Column:
    return F.concat_ws("", *cols)


def criticality(tokens: Column) -> Column:
    """HIGH before MEDIUM before LOW among tokens that hold CRITICALITY_x or CRITICALITY:x; dashes count as underscores."""
    found = F.transform(tokens, lambda t: F.replace(F.upper(t), F.lit("-"), F.lit("_")))

    def hit(name: str) -> Column:
        return F.exists(found, lambda t: F.contains(t, F.lit(f"CRITICALITY_{name}")) | F.contains(t, F.lit(f"CRITICALITY:{name}")))

    return F.when(hit("HIGH"), "HIGH").when(hit("MEDIUM"), "MEDIUM").when(hit("LOW"), "LOW")


def plain(value):
    """A collected value as JSON holds it: moments in ISO form, decimals as floats."""
    if isinstance(value, (datetime.date, datetime.datetime, datetime.time)):
        return value.isoformat()
    return float(value) if isinstance(value, decimal.Decimal) else value
