import numpy as np
import pytest

from cadenza.llm import whitening
from cadenza.llm.queries import op13_embedding_whitening

SF = "/root/testdata/sf0.01"


def reference(vectors, most=32):
    x = np.floor(np.array(vectors, np.float64) * 64).astype(np.int64) + 1_000_000
    n = len(x)
    s = x.sum(axis=0)
    y = x - s / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    deviation = [sum(int(v) ** 2 for v in row) for row in (n * x - s).astype(object)]
    return n, deviation, y, e, u, np.trace(y.T @ y / n)


def matrix(rows, ids):
    k = max(r["component"] for r in rows)
    out = np.full((len(ids), k), np.nan)
    at = {v: j for j, v in enumerate(ids)}
    for r in rows:
        out[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
    assert not np.isnan(out).any()
    return out


def test_query_by_dense_algebra(spark):
    rows = op13_embedding_whitening(spark, SF).collect()
    given = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, deviation, y, e, u, trace = reference([v for _, v in given])
    assert len(rows) == n * 32 and {r["n"] for r in rows} == {n}
    got = matrix(rows, [i for i, _ in given])
    want = y @ u / np.sqrt(e)
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-9
    assert {(r["vec_id"], r["deviation"]) for r in rows} == set(zip([i for i, _ in given], deviation, strict=True))
    for r in rows:
        assert abs(r["explained"] - e[r["component"] - 1] / trace) < 1e-12 and r["identity_error"] < 1e-9


@pytest.mark.parametrize("spectrum", ["falling", "clustered", "flat", "low"])
def test_jacobi_davidson(spectrum):
    """Residuals at double precision for spread, near and equal eigenvalues and missing ranks, of operators known by their products only."""
    rng = np.random.default_rng(3)
    d, k = 150, 20
    e = {"falling": 100 * 0.9 ** np.arange(d), "clustered": np.r_[np.full(6, 50.0), 50 - 1e-7 * np.arange(1, 7), np.linspace(40, 1, d - 12)], "flat": np.linspace(1.3, 1.0, d), "low": np.r_[np.linspace(9, 2, 12), np.zeros(d - 12)]}[spectrum]
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    a = (q * e) @ q.T
    calls = []
    values, u = whitening.jacobi_davidson(lambda b: (calls.append(b.shape[1]), a @ b)[1], d, k, most_rounds=600)
    assert np.abs(values - e[:k]).max() < 1e-12 * e[0] * 10
    assert np.abs(a @ u - u * values).max() < 1e-12 * e[0] and np.abs(u.T @ u - np.eye(k)).max() < 1e-13
    assert len(calls) < 200


def test_minres_solves_each_column():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    b = rng.standard_normal((30, 4))
    b[:, 2] = 0
    assert np.abs(a @ whitening.minres(lambda y: a @ y, b, 200, 1e-13) - b).max() < 1e-8


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (1, [1.0, 2.0]), (None, [0.5, -0.25]), (8, [1e30, 0.0]), (9, [-3.0, 7.125]), (10, [-0.001, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "1 as x", "2 as n", "3 as whitened")
    rows = whitening.whitened_components(df).collect()
    kept = [(i, v) for i, v in vectors if v in ([1.0, 2.0], [0.5, -0.25], [-3.0, 7.125], [-0.001, 0.0])]
    n, deviation, y, e, u, trace = reference([v for _, v in kept])
    assert len(rows) == 2 * n == 10
    assert sorted(((r["vec_id"], r["deviation"]) for r in rows if r["component"] == 1), key=str) == sorted(zip([i for i, _ in kept], deviation, strict=True), key=str)
    assert {round(r["explained"], 12) for r in rows} == {round(float(x / trace), 12) for x in e}
    assert whitening.whitened_components(df.limit(0)).count() == 0
    assert whitening.whitened_components(df.where("vec_id = 1")).count() == 0  # no variance


def test_missing_ranks_and_deviations_beyond_a_long(spark):
    rng = np.random.default_rng(1)
    base = np.round(rng.standard_normal((60, 3)) * 64) / 64
    data = np.hstack([base, base[:, :2] * 2, np.ones((60, 1))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "vec_id long, embedding array<double>")
    rows = whitening.whitened_components(df).collect()
    assert {r["component"] for r in rows} == {1, 2, 3} and {r["identity_error"] < 1e-9 for r in rows} == {True}
    far = spark.createDataFrame([(k, [float(k % 2) * 5e9, float(k)]) for k in range(40)], "vec_id long, embedding array<double>")
    out = whitening.whitened_components(far, 1).collect()
    assert {r["deviation"] for r in out} == {None} and len(out) == 40
