import math

import numpy as np
import pytest

from quillspark.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<float>, label int, deviation string, _v int"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in zip(ids or range(len(vectors)), vectors)], SCHEMA)


def brute(vectors):
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in np.asarray(vectors, np.float32).astype(float).tolist()]
    n, total = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, total)) for r in x]
    z = np.array([[a - s / n for a, s in zip(r, total)] for r in x])
    e, u = np.linalg.eigh(z.T @ z / n)
    return deviation, z, e[::-1], u[:, ::-1]


def held(got, vectors, ids=None):
    deviation, z, e, u = brute(vectors)
    k, n = min(8, len(e)), len(vectors)
    got = sorted(got, key=lambda r: (r["vec_id"], r["component"]))
    assert [(r["vec_id"], r["component"]) for r in got] == [(i, c + 1) for i in sorted(ids or range(n)) for c in range(k)]
    w = np.array([r["whitened"] for r in got]).reshape(n, k)
    want = z @ u[:, :k] / np.sqrt(e[:k])
    assert np.allclose(w * np.sign((w * want).sum(0)), want, atol=1e-9)
    assert [r["deviation"] for r in got[::k]] == deviation and {r["n"] for r in got} == {n}
    assert np.allclose([r["explained"] for r in got[:k]], e[:k] / e.sum(), rtol=1e-9)
    assert {r["identity_error"] < 1e-9 for r in got} == {True}


@pytest.mark.parametrize("width", [3, 16, 40, 150])
def test_against_brute_force(spark, width):
    rng = np.random.default_rng(width)
    v = (rng.normal(size=(700, width)) @ np.diag(1 + np.arange(width)) * 0.1).tolist()
    held(W.query(frame(spark, v).repartition(5)).collect(), v)


def test_tiles_of_any_width_agree(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 50)).astype(np.float32)
    df = frame(spark, v.tolist()).repartition(4).select(W.F.col("embedding").cast("array<double>").alias("_v"))
    n, total = W.sums(df)
    z = np.floor(1024 * v.astype(float)) + 100_000
    want = np.cov(z.T, bias=True)
    for tile in (1, 7, 16, 50, 64):
        assert np.allclose(W.covariance(df, W.Centre(n, total), tile), want, rtol=1e-10, atol=1e-7 * want.max())


def test_products_are_sent_on_when_many_are_held(spark, monkeypatch):
    monkeypatch.setattr(W, "HELD_BYTES", 1)
    v = np.random.default_rng(2).normal(size=(300, 20)).tolist()
    held(W.query(frame(spark, v).repartition(6)).collect(), v)


def test_unusable_rows_are_dropped(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 10)).tolist()
    bad = [None, [], [1.0] * 9 + [None], [1.0] * 9 + [float("nan")], [float("inf")] + [0.0] * 9, [1.0, 2.0]]
    got = W.query(frame(spark, v + bad)).collect()
    held(got, v)


def test_copies_and_repeated_ids(spark):
    v = [[1.0, 0.0, 0.5]] * 100 + [[0.0, 1.0, 0.25]] * 50 + [[0.5, 0.25, -1.0]] * 3
    df = spark.createDataFrame([(7, x, 0, "x", 1) for x in v], SCHEMA)
    got = W.query(df).collect()
    assert len(got) == 153 * 3 and {r["vec_id"] for r in got} == {7}
    assert all(r["whitened"] is None for r in got if r["component"] == 3) and {r["identity_error"] < 1e-9 for r in got} == {True}


def test_degenerate_tables(spark):
    assert W.query(frame(spark, [])).collect() == [] and W.query(frame(spark, [None, []])).collect() == []
    got = W.query(frame(spark, [[0.5, 0.25]])).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(1, 0, None, None, None), (2, 0, None, None, None)]


def test_huge_entries(spark):
    v = [[3e38, 1.0], [-3e38, 2.0], [0.0, 3.0]]
    got = W.query(frame(spark, v)).collect()
    assert len(got) == 6 and {(r["vec_id"], r["deviation"]) for r in got} == {(0, None), (1, None), (2, 3072**2)}
    big = [[2.0**20, 0.0], [-(2.0**20), 1.0], [5.0, 0.5]]
    assert [r["deviation"] for r in sorted(W.query(frame(spark, big)).collect(), key=lambda r: (r["vec_id"], r["component"]))[::2]] == [d if d < 2**63 else None for d in brute(big)[0]]


def test_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    held(W.query(df).collect(), [r["embedding"] for r in rows], [r["vec_id"] for r in rows])
