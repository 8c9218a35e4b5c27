"""Exact top-k inner products by pivot-table elimination.

Distances from every vector to a bounded set of pivots are computed once. For a query q and a candidate x, the
largest |d(q, p) - d(x, p)| over the pivots p is a lower bound of d(q, x), hence
(|q|^2 + |x|^2 - bound^2) / 2 an upper bound of the inner product.

Rows lie in cells by their nearest pivot, of which the pivot table also has the least and greatest distances and norm. A
first pass searches one block of each query's own cell; its k-th score is a floor that no row of the query's result falls
below. The query then goes only to cells whose bound reaches its floor. Within a block, candidates are evaluated in the
order of their bound until the k-th best score found, or the floor, exceeds the next bound.

Components are turned into floor(scale * x). Scores are exact integers; where a block's sums could leave 2^53
they are computed with Python's integers and end at the limits of a long.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part; nor do rows
without an id. Repeated rows count once; rows that share the query's id are not its candidates. Vectors of other
dimensions are not comparable and not candidates. Ties go to the smaller id. Extra columns are ignored, whatever their
names. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors

PIVOTS, SCALE, FIRST = 32, 64, 256
LONG = (1 << 63) - 1


def _pivot_table(pivots: dict[int, np.ndarray], scale: int):
    """vec_id, dim, cell (the nearest pivot), whole (the integer components), far (distances to the pivots)."""

    @common.tidy
    def run(batches):
        for batch in batches:
            whole, far, cell = [], [], []
            for row in batch.column("vec"):
                x = np.floor(scale * row.values.to_numpy(zero_copy_only=False).astype(np.float64))
                whole.append(x)
                p = pivots.get(len(x))  # none if the sample missed a rare dimension: one cell, no bounds
                far.append(np.sqrt(((p - x) ** 2).sum(1)) if p is not None else np.zeros(0))
                cell.append(int(far[-1].argmin()) if p is not None else 0)
            numbers = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("dim"), pa.array(cell, pa.int32()), pa.array(whole, numbers), pa.array(far, numbers)], ["vec_id", "dim", "cell", "whole", "far"])

    return run


def _ranges(t: DataFrame, pivots: int) -> dict[int, list[tuple]]:
    """By dimension, each cell's (cell, least distances, greatest distances, greatest square of a norm): a row a pivot and dimension."""
    square = F.expr("aggregate(whole, 0D, (a, x) -> a + x * x)")
    far = lambda i: F.try_element_at("far", F.lit(i + 1))
    rows = t.groupBy("dim", "cell").agg(F.array(*(F.min(far(i)) for i in range(pivots))).alias("low"), F.array(*(F.max(far(i)) for i in range(pivots))).alias("high"), F.max(square).alias("square")).collect()
    out: dict[int, list[tuple]] = {}
    for r in rows:
        size = sum(x is not None for x in r["low"])
        out.setdefault(r["dim"], []).append((r["cell"], np.array(r["low"][:size], float), np.array(r["high"][:size], float), r["square"]))
    return out


def _reached(ranges: dict[int, list[tuple]], packs: dict[tuple[int, int], int]):
    """Queries once for each pack that holds a cell with a bound that reaches their floor."""

    @common.tidy
    def run(batches):
        arrays = {d: ([c for c, *_ in own], *(np.array([x[i] for x in own]) for i in (1, 2, 3))) for d, own in ranges.items()}
        for batch in batches:
            take, chosen = [], []
            for i, (dim, far, whole, floor) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("dim", "far", "whole", "floor")), strict=True)):
                names, low, high, square = arrays[dim]
                f, q = np.array(far), float(np.dot(whole, whole))
                gap = np.maximum(np.maximum(f - high, low - f), 0.0).max(1, initial=0.0)
                most = (q + square - gap**2) / 2 + 1e-6 * (q + square) + 1  # beyond the rounding of the distances
                own = sorted({packs[dim, c] for c, m in zip(names, most, strict=True) if floor is None or m >= floor})
                take += [i] * len(own)
                chosen += own
            rows = batch.select([c for c in batch.schema.names if c != "cell"]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(chosen, pa.int32())], [*rows.schema.names, "pack"])

    return run


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    if x.dtype != object:
        return np.rint(x @ q).astype(np.int64)
    own = [int(v) for v in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, own, strict=True)), -LONG - 1), LONG) for row in x], dtype=object)


def narrow(x: np.ndarray, q: np.ndarray) -> np.dtype:
    """The smallest type in which all products and sums of whole numbers are exact."""
    most = np.abs(x).max() * np.abs(q).max() * x.shape[1]
    return np.dtype(np.float32 if most < 2**24 else np.float64 if most < 2**53 else object)


def steps_of(bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in falling order of their bound, and for each the bound rounded up to one of 32,767 steps; -inf is left out."""
    live = np.flatnonzero(bound > -np.inf)
    if not len(live):
        return live, bound[live]
    low, high = float(bound[live].min()), float(bound[live].max())
    width = (high - low) / 32_766 or 1.0
    step = np.ceil((bound[live] - low) / width).astype(np.int16)
    order = np.argsort(-step, kind="stable")  # a radix sort
    return live[order], low + (step[order] + 1.0) * width


def top_k(q: np.ndarray, bound: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the k best rows of x (ids ascending), and how many were evaluated.

    Rows of bound -inf are left out, and so may be rows that score below the floor.
    """
    order, most = steps_of(bound)
    best_ids, best, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, FIRST
    while at < len(order) and (floor is None or most[at] >= floor) and (len(best) < k or most[at] >= best[-1]):
        rows = order[at : at + step]
        at, step = at + len(rows), step * 8
        scores = _scores(x[rows], q)
        if len(best) == k:
            rows, scores = rows[scores >= best[-1]], scores[scores >= best[-1]]
        elif len(scores) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= least], scores[scores >= least]
        best, best_ids = np.concatenate([best, scores]), np.concatenate([best_ids, ids[rows]])
        keep = np.lexsort((best_ids, -best))[:k]
        best, best_ids = best[keep], best_ids[keep]
    return best_ids, best, at


def _search(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return vectors.found_table([], pa.int64())
        rows = rows.sort_by("vec_id")
        dim = rows.column("dim")[0].as_py()
        x, q = vectors.matrix(rows.column("whole"), dim), vectors.matrix(queries.column("whole"), dim)
        pivots = len(rows.column("far")[0].values)
        fx, fq = (vectors.matrix(t.column("far"), pivots) if pivots else np.zeros((t.num_rows, 0)) for t in (rows, queries))
        ids, own = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
        floors = queries.column("floor").to_pylist() if "floor" in queries.column_names else [None] * len(own)
        nx, nq, kind = (x * x).sum(1), (q * q).sum(1), narrow(x, q)
        x, q, fx, out = x.astype(kind), q.astype(kind), np.ascontiguousarray(fx.T, np.float32), []
        least, gap = np.empty(len(x), np.float32), np.empty(len(x), np.float32)
        for i in range(len(q)):
            least[:] = 0
            for p in range(pivots):
                np.subtract(fx[p], np.float32(fq[i, p]), out=gap)
                np.maximum(least, np.abs(gap, out=gap), out=least)
            most = (nq[i] + nx - least.astype(np.float64) ** 2) / 2
            most += 1e-4 * (nq[i] + nx) + 1  # beyond the rounding of the distances
            most[ids == own[i]] = -np.inf
            found, scores, _ = top_k(q[i], most, x, ids, k, floors[i])
            out.append((own[i], found, scores))
        return vectors.found_table(out, pa.int64())

    return run


def search(df: DataFrame, is_query, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest integer inner products over all other rows."""
    spark, mark = df.sparkSession, common.mark()
    common.arrow_batches(spark)
    v = vectors.usable(df, id_col, vec_col, zero=True)
    chosen = {d: np.floor(scale * p) for d, p in vectors.bounded_sample(v, pivots).items()}
    t = common.stored(v.mapInArrow(_pivot_table(chosen, scale), "vec_id long, dim int, cell int, whole array<double>, far array<double>"), "pivot-table")
    (cells, packs), find = vectors.packs_of(t), _search(k)
    queries = t.where(is_query(F.col("vec_id")))
    first = vectors.nearest_in_blocks(queries, t, cells, find, k, "long", own=True)
    floors = common.stored(first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor")), "floors")
    schema = "vec_id long, dim int, whole array<double>, far array<double>, floor long, pack int"
    reached = common.stored(queries.join(floors, "vec_id", "left").mapInArrow(_reached(_ranges(t, pivots), packs), schema), "reached")
    common.drop_since(spark, mark, t, reached)
    return vectors.nearest_in_blocks(reached, t, cells, find, k, "long")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


OP9_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
