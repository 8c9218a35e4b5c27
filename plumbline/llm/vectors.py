"""Vector search over blocks: what exact search and the permutation index share.

Rows lie in cells by their nearest pivot, small cells share a pack, and packs are cut in blocks of bounded size. Queries go to
the blocks of the packs that they name, and each pair of a query block and a candidate block is one group, processed in memory that the block sizes bound. A query
block takes as many queries as a block has rows, so candidates are copied only once for each so many queries. Each
group returns its nearest `k` for each query; these are merged by query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers in a block of candidates, and in one of queries.
BLOCK = 1 << 20


def usable(df: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """vec_id, vec (doubles), dim: rows whose vector is there, not empty, all finite and, unless `zero`, not zero. Equal rows count once."""
    v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec_id is not null and size(vec) > 0")
    v = v.where("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    if not zero:
        v = v.where("exists(vec, x -> x <> 0)")
    return v.distinct().withColumn("dim", F.size("vec"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def bounded_sample(v: DataFrame, n: int) -> dict[int, np.ndarray]:
    """By dimension, the vectors of the n smallest hashes of ids, of twice as many expected ones that are collected: the parameter bounds them for each dimension."""
    counts = {r["dim"]: r["n"] for r in v.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a dimension
    if not counts:
        return {}
    places, at = 1 << 30, F.xxhash64("vec_id", F.lit("sample"))
    upto = F.create_map(*(F.lit(x) for d, m in counts.items() for x in (d, min(places, -(-2 * n * places // m)))))
    rows = v.where(F.pmod(at, F.lit(places)) < F.element_at(upto, F.col("dim"))).select("dim", at.alias("at"), "vec_id", "vec").collect()
    rows.sort(key=lambda r: (r["at"], r["vec_id"], r["vec"]))
    own = {d: [r["vec"] for r in rows if r["dim"] == d][:n] for d in counts}
    return {d: np.array(x) for d, x in own.items() if x}


def packs_of(t: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """dim, cell, pack, blocks of the cells of t, also as pack by (dim, cell): small cells share a pack of one block, large ones have several blocks.

    There is a row for each pivot of a dimension at most.
    """
    sizes = sorted((r["dim"], r["cell"], r["n"]) for r in t.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).collect())
    out, pack, room, last = [], -1, 0, None
    for dim, cell, n in sizes:
        size = n * dim
        if dim != last or size > room:
            pack, room, last = pack + 1, max(BLOCK, size), dim
        room -= size
        out.append((dim, cell, pack, max(1, -(-size // BLOCK))))
    return t.sparkSession.createDataFrame(out, "dim int, cell int, pack int, blocks int"), {(d, c): p for d, c, p, _ in out}


def block_of(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("vec_id"), blocks).cast("int")


def nearest_in_blocks(queries: DataFrame, candidates: DataFrame, cells: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], k: int, score_type: str, *, own: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score. candidates have vec_id, dim and cell, queries the packs that they go to; cells as of packs_of().

    With `own`, queries have their cell, and go only to the block of its pack in which a candidate of their id would lie.
    """
    packs = F.broadcast(cells.select("dim", "pack", "blocks").distinct())
    q = queries.join(F.broadcast(cells), ["dim", "cell"]).drop("cell") if own else queries.join(packs, ["dim", "pack"])
    q = q.withColumn("c_block", block_of(F.col("blocks")) if own else F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = F.greatest(F.lit(1), F.ceil(F.count_if(F.col("c_block") == 0) * F.col("dim") / BLOCK)).cast("int").alias("parts")
    per = F.broadcast(packs.select("dim", "pack", F.lit(1).alias("parts")) if own else q.groupBy("dim", "pack").agg(many))
    q = q.join(per, ["dim", "pack"]).withColumn("q_block", block_of(F.col("parts"))).drop("blocks", "parts")
    c = candidates.join(F.broadcast(cells), ["dim", "cell"]).drop("cell").join(per, ["dim", "pack"]).withColumn("c_block", block_of(F.col("blocks")))
    c = c.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("blocks", "parts")
    keys = ["dim", "pack", "c_block", "q_block"]
    q = q.select(*(F.col(x).alias(x) for x in q.columns))  # both sides come from the same tables
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(search, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def found_table(out: list[tuple[int, np.ndarray, np.ndarray]], score: pa.DataType) -> pa.Table:
    """From (query id, ids, scores) of each query."""
    ids = np.concatenate([x[1] for x in out]) if out else np.zeros(0, np.int64)
    scores = np.concatenate([x[2] for x in out]) if out else np.zeros(0)
    query = np.repeat(np.array([x[0] for x in out], np.int64), [len(x[1]) for x in out]) if out else ids
    return pa.table([pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores.tolist() if scores.dtype == object else scores, score)], names=["query_id", "vec_id", "score"])
