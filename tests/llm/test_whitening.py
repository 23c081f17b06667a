"""Whitening against numpy's eigenvectors of the exact covariance."""

import math

import numpy as np
import pytest

from lattica.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component string, x string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "n", "c", "x") for i, v in rows], SCHEMA)


def brute_force(rows):
    """{vec_id: (n, deviation, {component: whitened})}, eigenvalue shares; of vectors of one length."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in good]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    a = np.array(fit, dtype=np.float64)
    centred = a - np.array(sums) / n
    e, vecs = np.linalg.eigh(centred.T @ centred / n)
    e, vecs = e[::-1], vecs[:, ::-1]
    out = []
    for i, v in x:
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        white = (np.array(v) - np.array(sums) / n) @ vecs[:, :4] / np.sqrt(e[:4])
        out.append((i, deviation, white))
    return n, out, e / e.sum()


def check(got, rows):
    n, want, shares = brute_force(rows)
    k = min(4, len(shares))
    assert got.count() == len(want) * k
    found = got.collect()
    assert {r["n"] for r in found} == {n}
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9
    by = sorted((r["component"], r["vec_id"] is None, r["vec_id"] or 0, r["deviation"], r["whitened"], r["explained"]) for r in found)
    for c in range(k):
        mine = np.array([(r[2], r[3], r[4]) for r in by if r[0] == c + 1], dtype=np.float64)
        assert np.allclose([r[5] for r in by if r[0] == c + 1], shares[c], rtol=1e-9)
        theirs = np.array([(i or 0, d, w[c]) for i, d, w in want], dtype=np.float64)
        first = np.abs(theirs[:, 2]).argmax()
        signs = [1, -1] if len(theirs) else [1]
        mine = mine[np.lexsort((np.round(mine[:, 2], 6), mine[:, 0]))]
        assert any(
            np.allclose(mine, t[np.lexsort((np.round(t[:, 2], 6), t[:, 0]))], atol=1e-8)
            for t in (theirs * [1, 1, s] for s in signs)
        ), (c, first)


def test_against_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    check(whitening.whitened(table), [(r["vec_id"], r["embedding"]) for r in table.collect()])


def test_edge_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=5) * [3, 2, 1, 0.5, 9]]) for i in range(60)]
    rows += [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [float("inf")] * 5)]
    rows += [(7, rows[7][1]), (200, rows[3][1]), (None, rows[4][1])]  # repeated row, repeated vector, null id
    check(whitening.whitened(vectors(spark, rows)), rows)


def test_fewer_entries_than_components_and_no_variance(spark):
    rows = [(1, [0.0, 1.0]), (2, [1.0, -1.0]), (3, [0.5, 2.0])]
    check(whitening.whitened(vectors(spark, rows)), rows)
    same = whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in same] == [(1, 0, None, None)] * 4
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [])])).count() == 0


def test_lengths_are_spaces_of_their_own(spark):
    rng = np.random.default_rng(2)
    five = [(i, [float(c) for c in rng.normal(size=5)]) for i in range(20)]
    three = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(100, 130)]
    got = whitening.whitened(vectors(spark, five + three))
    check(got.filter("vec_id < 100"), five)
    check(got.filter("vec_id >= 100"), three)


def test_large_entries(spark):
    rows = [(1, [1e30, 0.0]), (2, [0.0, 1e9]), (3, [3.0, -5.0])]
    got = {(r["vec_id"], r["component"]): r["deviation"] for r in whitening.whitened(vectors(spark, rows)).collect()}
    assert got[1, 1] is None and got[3, 1] is None  # beyond a long


def test_exact_deviations():
    rows = np.array([[3037000499, 1], [3037000500, 0], [0, 0]], dtype=np.int64)
    assert whitening.squared_lengths(rows) == [3037000499**2 + 1, None, 0]
    assert whitening.squared_lengths(rows.astype(object)) == [3037000499**2 + 1, None, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 8, 30])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    a = a @ a.T if n != 8 else np.diag([5.0, 5, 2, 2, 2, 0, 0, 1])
    values, vectors = whitening.symmetric_qr(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * max(1, values[0]))
    assert np.allclose(vectors @ vectors.T, np.eye(n), atol=1e-13)
    assert np.allclose(vectors @ a, values[:, None] * vectors, atol=1e-12 * max(1, values[0]))


def test_merging_equals_one_stream(spark):
    rows = np.random.default_rng(3).integers(-50, 50, size=(300, 4))
    df = spark.createDataFrame([(r.tolist(),) for r in rows], "x array<long>").repartition(40)  # two levels of merging
    of = whitening.moments(df, 4)
    assert of.n == 300 and of.sums == rows.sum(axis=0).tolist()
    assert np.allclose(of.covariance(), np.cov(rows.T, bias=True), rtol=1e-12)
