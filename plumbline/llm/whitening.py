"""Whitening of vectors by a tiled covariance.

Each entry c becomes the whole number x = floor(1024 c) + 100000. A first aggregation gives every dimension's number of
rows, sum and bounds. Tasks then cut their rows into row-blocks and columns into blocks of `tile` dimensions, and send each
block of rows, centred at a whole number near the mean, to the tile keys (pairs of column blocks) that need it. A
row-block's two column blocks of a tile meet in one group, which multiplies them; products are summed by tile. Only the
tiles' sums (a number a pair of dimensions, whatever the number of rows) reach the driver, which removes the rest of the
mean exactly, in whole numbers, and takes the eigenvectors. A pass over the rows projects them.

A group holds BLOCK entries a side, so memory doesn't grow with the rows; a column block is copied to at most COPIES
tiles. Row-blocks are chunks of consecutive rows, so repeated ids or vectors gather nowhere.

Defined results: null, empty vectors and those with null or non-finite entries take no part; a null id is kept as null;
repeated rows count and return as often as they stand; other columns are ignored; an empty table gives no rows. Vectors
of several lengths are whitened apart, each length with its own fit. Entries beyond what a double holds exactly
(|x| > 2**52) are held at that bound. A component whose eigenvalue is no more than rounding (constant dimensions, fewer
rows than dimensions) has null `whitened`, as has `explained` where nothing varies; a deviation beyond a long is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Dimensions of a column block at least, and tiles that a block is copied to at most (of vectors up to COPIES * WIDEST dimensions).
TILE, COPIES, WIDEST = 32, 8, 1024
#: Entries of one side of a group, and of the rows that a task turns into column blocks at once.
BLOCK, CHUNK = 1 << 22, 1 << 20
EXACT = 2.0**52


@dataclass(frozen=True)
class Sums:
    """Of the vectors of one length: rows, sums by dimension (whole numbers), and the largest distance from the centre."""

    n: int
    total: tuple[int, ...]
    reach: int

    @property
    def centre(self) -> np.ndarray:
        """The whole numbers nearest to the means."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.total], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """Sums of the centred entries: at most half the number of rows."""
        return np.array([s - self.n * int(c) for s, c in zip(self.total, self.centre, strict=True)], np.int64)


@dataclass(frozen=True)
class Fit:
    sums: Sums
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def sound(self) -> np.ndarray:
        """Components whose eigenvalue is more than rounding."""
        return self.values > len(self.sums.total) * np.finfo(float).eps * max(float(self.trace), 0.0)


def rows_of(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, x (array of long), dim: the rows that take part."""
    v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where("size(vec) > 0")
    v = v.where("forall(vec, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    held = F.transform("vec", lambda c: F.floor(F.greatest(F.lit(-EXACT), F.least(F.lit(EXACT), c * SCALE))).cast("long") + SHIFT)
    return v.select("vec_id", held.alias("x"), F.size("vec").alias("dim"))


def _matrices(batch: pa.RecordBatch):
    """(dim, places in the batch, matrix) of each vector length."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, batch.column("x").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def sums(rows: DataFrame) -> dict[int, Sums]:
    """By vector length; a row a dimension is collected."""

    @common.tidy
    def run(batches):
        own: dict[int, list] = {}
        for batch in batches:
            for dim, _, x in _matrices(batch):
                new = [len(x), (x >> 26).sum(0), (x & (1 << 26) - 1).sum(0), x.min(0), x.max(0)]  # sums of each part stay within a long
                old = own.get(dim)
                own[dim] = [old[0] + new[0], old[1] + new[1], old[2] + new[2], np.minimum(old[3], new[3]), np.maximum(old[4], new[4])] if old else new
        for dim, (n, high, low, least, most) in own.items():
            same = lambda v: np.full(dim, v)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in ((same(dim), pa.int32()), (np.arange(dim), pa.int32()), (same(n), pa.int64()), (high, pa.int64()), (low, pa.int64()), (least, pa.int64()), (most, pa.int64()))], ["dim", "at", "n", "high", "low", "least", "most"])

    part = rows.select("x", "dim").mapInArrow(run, "dim int, at int, n long, high long, low long, least long, most long")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    found = part.groupBy("dim", "at").agg(F.sum("n").alias("n"), *wide, F.min("least").alias("least"), F.max("most").alias("most")).collect()
    out = {}
    for dim in {r["dim"] for r in found}:
        own = sorted((r for r in found if r["dim"] == dim), key=lambda r: r["at"])
        total = tuple((int(r["high"]) << 26) + int(r["low"]) for r in own)
        n = own[0]["n"]
        reach = max(max(abs(r["least"] - s // n), abs(r["most"] - s // n)) + 1 for r, s in zip(own, total, strict=True))
        out[dim] = Sums(n, total, reach)
    return out


def tile_of(dim: int, tile: int | None = None) -> int:
    return tile or min(WIDEST, max(TILE, -(-dim // COPIES)))


def _column_blocks(fits: dict[int, Sums], tile: int | None):
    """For each chunk of rows and tile key its column blocks, as bytes of the narrowest whole numbers that hold them."""
    widths = {d: next(w for w in ("<i2", "<i4", "<i8") if s.reach <= np.iinfo(w).max) for d, s in fits.items()}
    centres = {d: s.centre for d, s in fits.items()}
    names = ["dim", "row_block", "a", "b", "chunk", "second", "block"]

    @common.tidy
    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 36
        for batch in batches:
            for dim, _, x in _matrices(batch):
                t, at_once = tile_of(dim, tile), max(1, CHUNK // dim)
                blocks = range(-(-dim // t))
                groups = max(1, -(-fits[dim].n * t // BLOCK))
                for start in range(0, len(x), at_once):
                    z = (x[start : start + at_once] - centres[dim]).astype(widths[dim])
                    sides = [z[:, i * t : i * t + t].tobytes() for i in blocks]
                    chunk += 1
                    home = (chunk * 0x9E3779B97F4A7C15 & (1 << 64) - 1) * groups >> 64
                    out = [(dim, home, a, b, chunk, side, sides[b if side else a]) for a in blocks for b in blocks if a <= b for side in ((False, True) if a < b else (False,))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names)

    return run, widths


def _products(widths: dict[int, str], tile: int | None):
    """One group: the column blocks of a row-block for one tile. Products of whole numbers are exact while they fit a double."""

    def run(table: pa.Table) -> pa.Table:
        dim, a, b = (table.column(c)[0].as_py() for c in ("dim", "a", "b"))
        t = tile_of(dim, tile)
        wide = [min(t, dim - i * t) for i in (a, b)]
        total, sides = np.zeros(wide), ({}, {})
        for chunk, second, block in zip(*(table.column(c).to_pylist() for c in ("chunk", "second", "block")), strict=True):
            sides[second][chunk] = block
        for chunk, block in sides[0].items():
            x = np.frombuffer(block, widths[dim]).reshape(-1, wide[0]).astype(float)
            y = x if a == b else np.frombuffer(sides[1][chunk], widths[dim]).reshape(-1, wide[1]).astype(float)
            total += x.T @ y
        at = np.arange(total.size, dtype=np.int32)
        same = lambda v: pa.array(np.full(total.size, v, np.int32))
        return pa.table([same(dim), same(a), same(b), pa.array(at), pa.array(total.ravel())], names=["dim", "a", "b", "at", "product"])

    return run


def covariances(rows: DataFrame, found: dict[int, Sums], tile: int | None = None) -> dict[int, np.ndarray]:
    """By vector length the covariance matrix, divisor n. A number a pair of dimensions is collected."""
    blocks, widths = _column_blocks(found, tile)
    sent = rows.select("x", "dim").mapInArrow(blocks, "dim int, row_block int, a int, b int, chunk long, second boolean, block binary")
    products = sent.groupBy("dim", "row_block", "a", "b").applyInArrow(_products(widths, tile), "dim int, a int, b int, at int, product double")
    cells = products.groupBy("dim", "a", "b", "at").agg(F.sum("product").alias("product")).toArrow()
    out = {d: np.zeros((d, d)) for d in found}
    dims, a, b, at, product = (cells.column(c).to_numpy() for c in ("dim", "a", "b", "at", "product"))
    for d, s in found.items():
        own, t = dims == d, tile_of(d, tile)
        i, j = a[own] * t, b[own] * t
        wide = np.minimum(t, d - j)
        i, j = i + at[own] // wide, j + at[own] % wide
        mean = s.rest / s.n
        out[d][i, j] = product[own] / s.n - mean[i] * mean[j]
        out[d][j, i] = out[d][i, j]
    return out


def fits(rows: DataFrame, components: int = COMPONENTS, tile: int | None = None) -> dict[int, Fit]:
    """By vector length: sums, and the leading eigenvalues and unit eigenvectors (columns), largest first."""
    found = sums(rows)
    out = {}
    for d, v in covariances(rows, found, tile).items() if found else ():
        values, vectors = np.linalg.eigh(v)
        first = np.argsort(-values, kind="stable")[:components]
        out[d] = Fit(found[d], values[first], vectors[:, first], float(np.trace(v)))
    return out


def _projected(x: np.ndarray, fit: Fit) -> np.ndarray:
    """Rows by sound components: the centred entries, without the rest of the mean, projected and divided by the root of the eigenvalue."""
    z = (x - fit.sums.centre) - fit.sums.rest / fit.sums.n
    return z @ (fit.vectors[:, fit.sound] / np.sqrt(fit.values[fit.sound]))


def identity_errors(rows: DataFrame, fitted: dict[int, Fit]) -> dict[int, float | None]:
    """By vector length, how far the whitened rows' covariance is from the identity; a number a pair of components is collected."""

    @common.tidy
    def run(batches):
        for batch in batches:
            for dim, _, x in _matrices(batch):
                w = np.column_stack([_projected(x, fitted[dim]), np.ones(len(x))])
                m = w.T @ w
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, dim, np.int32)), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.ravel())], ["dim", "at", "moment"])

    got = rows.select("x", "dim").mapInArrow(run, "dim int, at int, moment double").groupBy("dim", "at").agg(F.sum("moment").alias("moment")).collect()
    out = {}
    for d, f in fitted.items():
        k, n = int(f.sound.sum()), f.sums.n
        m = np.zeros((k + 1) ** 2)
        for r in got:
            if r["dim"] == d:
                m[r["at"]] = r["moment"]
        m = m.reshape(k + 1, k + 1) / n
        out[d] = float(np.abs(m[:k, :k] - np.outer(m[k, :k], m[:k, k]) - np.eye(k)).max()) if k else None
    return out


def _deviations(x: np.ndarray, s: Sums) -> list[int | None]:
    """Sum over dimensions of (n x - S) ** 2, exactly; None beyond a long."""
    z = x - s.centre
    if (s.n * (s.reach + 1)) ** 2 * len(s.total) < 1 << 63:
        return (((s.n * z - s.rest) ** 2).sum(1)).tolist()
    exact = ((s.n * z.astype(object) - s.rest.astype(object)) ** 2).sum(1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def whiten(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, tile: int | None = None) -> DataFrame:
    """For each row that takes part and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    spark = df.sparkSession
    common.arrow_batches(spark)
    rows = common.stored(rows_of(df, id_col, vec_col), "whitening-rows")
    fitted = fits(rows, components, tile)
    errors = identity_errors(rows, fitted) if fitted else {}
    sent = spark.sparkContext.broadcast(fitted)  # a number a dimension and component

    @common.tidy
    def run(batches):
        for batch in batches:
            for dim, at, x in _matrices(batch):
                f, k = sent.value[dim], len(sent.value[dim].values)
                w, sound = np.full((len(x), k), np.nan), np.flatnonzero(f.sound)
                w[:, sound] = _projected(x, f)
                share = f.values / f.trace if f.trace > 0 else np.full(k, np.nan)
                each = lambda v: np.repeat(v, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(each(at))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * k, f.sums.n)),
                        pa.array([v for v in _deviations(x, f.sums) for _ in range(k)], pa.int64()),
                        pa.array(w.ravel(), from_pandas=True),
                        pa.array(np.tile(share, len(x)), from_pandas=True),
                        pa.array([errors[dim]] * (len(x) * k), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.table(spark, sf_dir, "embeddings"))
