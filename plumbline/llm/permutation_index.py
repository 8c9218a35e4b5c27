"""Approximate nearest neighbours by a permutation index.

A vector is represented by its `prefix` nearest pivots in order. Half of the pivots are spread over a bounded sample of its
dimension, each the farthest from those before it, and half follow the density of rows, so that dense groups are told
apart as well as rare ones. For the largest inner product, vectors are lifted by one component to equal length, which turns
it into the smallest distance.

Rows lie in cells by their nearest pivot; a query goes only to the cells of the `visits` pivots nearest to it. There a
block of rows is posted in the pivots' inverted files: for every pivot the rows that have it in their prefix, with its
place. The query walks the files of its own nearest pivots and adds up Spearman's footrule, a pivot that is missing counting
as place `prefix`. Rows up to the query's own limit are reranked by the exact inner product. The limit is the footrule
within which the `share` of the sample lies: it holds for all blocks alike, so that blocks near the query give more
rows than others, and dense groups as many as they have.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part; nor do
rows without an id. Repeated rows count once; rows that share the query's id are not its candidates. Vectors of
another dimension are not candidates. Equal scores go to the smaller id. A dimension that the sample lacks, or of no more
than `few` rows, is searched whole. Extra columns are ignored, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors

PIVOTS, PREFIX, VISITS, SHARE = 128, 32, 120, 0.35
#: Rows sampled for each pivot, and rows of a dimension that are all reranked.
SPREAD, FEW = 16, 512


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0.0, longest * longest - (x * x).sum(1)))[:, None]], axis=1)


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Rows of pivot numbers, nearest first; ties to the smaller number."""
    far = (pivots * pivots).sum(1)[None] - 2 * (x @ pivots.T)
    return np.argsort(far, axis=1, kind="stable")[:, :prefix].astype(np.int16)


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x or all different ones: the first, then always the row farthest from those chosen."""
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


class InvertedFiles:
    """For each pivot the rows of a block that have it in their prefix, and at which place: postings in a row, by pivot."""

    def __init__(self, order: np.ndarray, pivots: int):
        self.rows, self.prefix = order.shape
        by_pivot = np.argsort(order.ravel(), kind="stable")
        self.row, self.place = (by_pivot // self.prefix).astype(np.int32), (by_pivot % self.prefix).astype(np.int32)
        self.start = np.searchsorted(order.ravel()[by_pivot], np.arange(pivots + 1))

    def footrule(self, own: np.ndarray) -> np.ndarray:
        """Footrule of every row from a query's prefix; a pivot that one of them lacks counts as place `prefix`."""
        n = self.prefix
        # as if no row had any of the query's pivots; each posting takes off what it has in common
        total = np.full(self.rows, n * (n + 1) // 2 + sum(n - at for at in range(len(own))), np.int32)
        for at, pivot in enumerate(own):
            a, b = self.start[pivot], self.start[pivot + 1]
            place = self.place[a:b]
            total[self.row[a:b]] -= (n - at) + (n - place) - np.abs(place - at)
        return total


class Index:
    """What workers need of one dimension: its pivots, and the prefixes of the sample."""

    def __init__(self, sample: np.ndarray, longest: float, pivots: int, prefix: int):
        x = lifted(sample, longest)
        far = spread(x, max(1, pivots // 2))
        self.pivots = np.unique(np.concatenate([far, x[: pivots - len(far)]]), axis=0)
        self.prefix = min(prefix, len(self.pivots))
        self.files = InvertedFiles(permutations(x, self.pivots, self.prefix), len(self.pivots))

    def walk(self, q: np.ndarray) -> np.ndarray:
        """All pivots in a query's order. It is lifted by nothing: only its direction counts."""
        return permutations(np.concatenate([q, [0.0]])[None], self.pivots, len(self.pivots))[0]

    def limit(self, own: np.ndarray, share: float) -> int:
        total = self.files.footrule(own)
        return int(np.partition(total, (at := min(len(total) - 1, int(np.ceil(share * len(total))))))[at])


def _posted(found: dict[int, Index], longest: float):
    """vec_id, dim, vec, cell, order (the prefix)."""

    @common.tidy
    def run(batches):
        for batch in batches:
            cell, order = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if int(d) in found:
                    x = vectors.matrix(batch.column("vec").take(pa.array(at)), int(d))
                    own = permutations(lifted(x, longest), found[int(d)].pivots, found[int(d)].prefix)
                    cell[at] = own[:, 0]
                    for i, o in zip(at.tolist(), own, strict=True):
                        order[i] = o
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "dim", "vec")), pa.array(cell), pa.array(order, pa.list_(pa.int16()))], ["vec_id", "dim", "vec", "cell", "order"])

    return run


def _sent(found: dict[int, Index], packs: dict[tuple[int, int], int], visits: int, share: float):
    """Queries once for each pack with a cell that they go to, with their prefix and limit (null: all rows)."""
    whole = {d: sorted({p for (x, _), p in packs.items() if x == d}) for d in {d for d, _ in packs}}

    @common.tidy
    def run(batches):
        for batch in batches:
            take, chosen, order, limits, went = [], [], [], [], []
            for i, (d, vec) in enumerate(zip(batch.column("dim").to_pylist(), batch.column("vec"), strict=True)):
                index, own, limit = found.get(d), None, None
                if index is not None:
                    own = index.walk(vec.values.to_numpy(zero_copy_only=False).astype(np.float64))
                    went, own = sorted({packs[d, c] for c in own[:visits].tolist() if (d, c) in packs}), own[: index.prefix]
                    limit = index.limit(own, share)
                if index is None or visits >= len(index.pivots):
                    went = whole[d]
                take += [i] * len(went)
                chosen += went
                order += [own] * len(went)
                limits += [limit] * len(went)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("vec_id", "dim", "vec")), pa.array(chosen, pa.int32()), pa.array(order, pa.list_(pa.int16())), pa.array(limits, pa.int32())], ["vec_id", "dim", "vec", "pack", "order", "most"])

    return run


def _search(sizes: dict[int, tuple[int, int]], k: int):
    """sizes: by dimension, how many pivots and places of a prefix."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return vectors.found_table([], pa.float64())
        rows = rows.sort_by("vec_id")
        dim = rows.column("dim")[0].as_py()
        x, q = vectors.matrix(rows.column("vec"), dim), vectors.matrix(queries.column("vec"), dim)
        ids, own, most = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy(), queries.column("most").to_pylist()
        files = None
        if dim in sizes:
            pivots, prefix = sizes[dim]
            shape = lambda t: t.column("order").combine_chunks().flatten().to_numpy().reshape(-1, prefix)
            files, walks = InvertedFiles(shape(rows), pivots), shape(queries)
        out = []
        for i in range(len(q)):
            near = np.arange(len(x)) if files is None or most[i] is None else np.flatnonzero(files.footrule(walks[i]) <= most[i])
            near = near[ids[near] != own[i]]
            scores = (x[near] * q[i]).sum(1)
            if len(near) > k:
                some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
                near, scores = near[some], scores[some]
            keep = np.lexsort((ids[near], -scores))[:k]
            out.append((own[i], ids[near][keep], scores[keep]))
        return vectors.found_table(out, pa.float64())

    return run


def search(df: DataFrame, is_query, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, visits: int = VISITS, share: float = SHARE, few: int = FEW) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found by inner product."""
    spark, mark = df.sparkSession, common.mark()
    common.arrow_batches(spark)
    v = common.stored(vectors.usable(df, id_col, vec_col, zero=False), "vectors")
    norm = F.expr("sqrt(aggregate(vec, 0D, (a, x) -> a + x * x))")
    sizes = {r["dim"]: (r["n"], r["longest"]) for r in v.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("longest")).collect()}  # a row a dimension
    longest = max((x for _, x in sizes.values()), default=0.0)
    found = {d: Index(x, longest, pivots, prefix) for d, x in vectors.bounded_sample(v, SPREAD * pivots).items() if sizes[d][0] > few}
    posted = common.stored(v.mapInArrow(_posted(found, longest), "vec_id long, dim int, vec array<double>, cell int, order array<short>"), "posted")
    cells, packs = vectors.packs_of(posted)
    sent = v.where(is_query(F.col("vec_id"))).mapInArrow(_sent(found, packs, visits, share), "vec_id long, dim int, vec array<double>, pack int, order array<short>, most int")
    queries = common.stored(sent, "sent")
    common.drop_since(spark, mark, posted, queries)
    find = _search({d: (len(i.pivots), i.prefix) for d, i in found.items()}, k)
    return vectors.nearest_in_blocks(queries, posted, cells, find, k, "double")


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
