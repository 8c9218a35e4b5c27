"""Block digests of numbered results: which blocks of rows may differ, without bringing the rows together.

A block is BLOCK rows at consecutive places. Its digest is the exclusive or of 64-bit hashes of each row with its place. Numbers
enter it by the cell of a grid that is no wider than the tolerance, so blocks with equal digests hold equal rows. Values that
are close but in neighbouring cells only make a block one to look into; a second grid, shifted by half a cell, leaves few of
these. Partial digests are made where the rows are, so what is shuffled is a row a block and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import ABS_TOL, REL_TOL, is_number, number

BLOCK = 4096
_MOMENTS = (T.DateType, T.TimestampType, T.TimestampNTZType)


#: In place of a cell's power of two: a null, not a number, infinities, and cells of absolute width.
_NULL, _NAN, _MORE, _LESS, _FINE = -5000, -5001, -5002, -5003, -5004


def _cell(x: Column, half: float) -> list[Column]:
    """A double's cell as power and place: of absolute width up to where the relative tolerance is wider, from there by the power of two. Two doubles of one cell are close."""
    power = F.floor(F.log2(F.abs(x)) + half)
    width = F.pow(F.lit(2.0), power - 2 * half) * (REL_TOL / 2)
    odd = F.when(x.isNull(), _NULL).when(F.isnan(x), _NAN).when(x == float("inf"), _MORE).when(x == float("-inf"), _LESS)
    wide = width > ABS_TOL / 2
    return [odd.when(wide, power).otherwise(_FINE), F.when(odd.isNotNull(), F.lit(0.0)).otherwise(F.floor(x / F.when(wide, width).otherwise(ABS_TOL / 2) + half).cast("double"))]


def _keyed(col: Column, kind: T.DataType, other: T.DataType, half: float) -> list[Column]:
    """What a digest takes of a value, never null: equal ones mean equal values by the rule of comparison."""
    if is_number(kind) and is_number(other):
        return _cell(number(col, kind), half)
    if isinstance(kind, _MOMENTS) and isinstance(other, _MOMENTS):
        shown = col.cast("timestamp_ntz").cast("string")
    elif type(kind) is not type(other):  # equal only where both are null
        shown = F.when(col.isNotNull(), F.concat(F.lit(type(kind).__name__), F.lit(" "), F.to_json(F.struct(col))))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        shown = F.to_json(F.struct(col))
    else:
        shown = F.base64(col) if isinstance(kind, T.BinaryType) else col.cast("string")
    return [F.coalesce(F.concat(F.lit("v"), shown), F.lit("n"))]


def block_of(row_number: Column) -> Column:
    return F.floor((row_number - 1) / BLOCK).cast("long")


def digests(placed: DataFrame, columns: list[str], kinds: list[T.DataType], others: list[T.DataType]) -> DataFrame:
    """block, rows, and the digest on each grid (a, b) of a result with row_number."""
    keys = {}
    for grid, half in (("a", 0.0), ("b", 0.5)):
        keys[grid] = F.xxhash64("row_number", *(k for c, kind, other in zip(columns, kinds, others, strict=True) for k in _keyed(F.col(c), kind, other, half)))
    hashed = placed.select(block_of(F.col("row_number")).alias("block"), *(v.alias(k) for k, v in keys.items()))
    return hashed.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), *(F.bit_xor(k).alias(k) for k in keys))


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """block: those of digests() of two results that aren't proven equal on either grid."""
    both = left.alias("l").join(right.alias("r"), "block", "full_outer")
    same = [F.col(f"l.{g}") == F.col(f"r.{g}") for g in ("a", "b")]
    equal = (F.col("l.rows") == F.col("r.rows")) & (same[0] | same[1])
    return both.where(~F.coalesce(equal, F.lit(False))).select("block")
