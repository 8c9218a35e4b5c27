"""Whitening by a tiled covariance against whole numbers on the driver."""

import math
from fractions import Fraction

import numpy as np
import pytest

from plumbline.llm import common, whitening

DATA = "/root/testdata/sf0.001"


def plain(vectors):
    """n, sums, covariance (exact fractions to doubles) and deviations of lists of x."""
    n, d = len(vectors), len(vectors[0])
    s = [sum(v[i] for v in vectors) for i in range(d)]
    y = [[n * v[i] - s[i] for i in range(d)] for v in vectors]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    return n, s, cov, [sum(c * c for c in r) for r in y]


def held(vector):
    return [math.floor(1024 * float(c)) + 100_000 for c in vector]


def compare(got, vectors, components=8):
    """got: rows by id; vectors: x by id."""
    ids = sorted(vectors)
    n, s, cov, deviations = plain([vectors[i] for i in ids])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, len(s))
    for i, dev in zip(ids, deviations, strict=True):
        rows = sorted(got[i], key=lambda r: r["component"])
        assert [r["component"] for r in rows] == list(range(1, k + 1))
        assert {r["deviation"] for r in rows} == {dev} and {r["n"] for r in rows} == {n}
    for j in range(k):
        want = np.array([[float(Fraction(n * x - t, n)) for x, t in zip(vectors[i], s, strict=True)] for i in ids]) @ axes[:, j] / math.sqrt(values[j])
        have = np.array([next(r["whitened"] for r in got[i] if r["component"] == j + 1) for i in ids])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-8
        assert got[ids[0]][0]["identity_error"] < 1e-9
        assert next(r["explained"] for r in got[ids[0]] if r["component"] == j + 1) == pytest.approx(values[j] / np.trace(cov), rel=1e-9)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], []).append(r)
    return out


@pytest.mark.parametrize("tile", [None, 7, 64])
def test_whitening_equals_whole_numbers(spark, tile):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet").limit(150)
    result = whitening.whiten(df, tile=tile)
    compare(by_id(result), {r["vec_id"]: held(r["embedding"]) for r in df.collect()})
    common.release(result)


def test_several_row_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 320)
    monkeypatch.setattr(whitening, "CHUNK", 640)
    df = spark.read.parquet(f"{DATA}/embeddings.parquet").limit(120)
    compare(by_id(whitening.whiten(df, tile=20)), {r["vec_id"]: held(r["embedding"]) for r in df.collect()})


def test_odd_vectors(spark):
    rows = [(1, [0.5, 1.0, -2.0]), (2, [0.25, 3.0, 1.0]), (3, [float("nan"), 1.0, 1.0]), (4, None), (5, []), (6, [float("inf"), 0.0, 0.0]), (7, [None, 1.0, 2.0]), (8, [9.0, -4.0, 0.125]), (9, [1.0, 1.0, 7.5]), (9, [1.0, 1.0, 7.5])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, x string, dim int")
    got = by_id(whitening.whiten(df))
    assert sorted(got) == [1, 2, 8, 9] and len(got[9]) == 6  # the repeated row returns twice
    n, _, cov, deviations = plain([held(v) for i, v in rows if i in got])
    assert n == 5 and got[1][0]["n"] == 5 and got[1][0]["deviation"] == deviations[0]
    share = np.linalg.eigvalsh(cov)[::-1] / np.trace(cov)
    assert [r["explained"] for r in sorted(got[1], key=lambda r: r["component"])] == pytest.approx(share.tolist())
    assert whitening.whiten(df.limit(0)).count() == 0


def test_no_variation_and_several_lengths(spark):
    rows = [(1, [2.0, 3.0]), (2, [2.0, 3.0]), (3, [1.0, 5.0, 1.0]), (4, [1.0, 7.0, 1.0]), (5, [1e300, -1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_id(whitening.whiten(df.where("vec_id <> 5")))
    assert all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["identity_error"] is None for r in got[1])
    three = sorted(got[3], key=lambda r: r["component"])
    assert [r["n"] for r in three] == [2, 2, 2] and abs(three[0]["whitened"]) == pytest.approx(1.0) and three[1]["whitened"] is None and three[0]["explained"] == pytest.approx(1.0)
    huge = by_id(whitening.whiten(df.where("size(embedding) = 2")))
    assert huge[5][0]["deviation"] is None  # beyond a long


def test_whole_table(spark):
    got = whitening.op13_whitening(spark, DATA)
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert got.count() == 8 * n and got.where("identity_error > 1e-4 or n <> " + str(n)).count() == 0
