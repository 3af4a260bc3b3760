"""Distributed singular vectors, subset search and centred moments against numpy."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from countgrove.operators import aggregates as A
from countgrove.operators import ordination as O
from countgrove.plans import low_rank

from .helpers import frame, table


def matrix_of(df, key, names):
    rows = {r[key]: [r[c] for c in df.columns if c.startswith("axis_")] for r in df.collect()}
    return np.array([rows.get(n, [0.0] * (len(df.columns) - 1)) for n in names])


def test_singular_values_and_vectors(spark):
    rng = np.random.default_rng(2)   # falling values, more columns than directions
    m = np.round(rng.normal(size=(70, 40)) * 300 @ np.diag(0.8 ** np.arange(40)) + 400).clip(0)
    out = O.truncated_svd(frame(spark, m.astype(int)).withColumnRenamed("reads", "value"), 4)
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    got = out["singular_values"].orderBy("axis").collect()
    assert np.allclose([r["singular_value"] for r in got], s[:4], rtol=1e-9)
    assert np.allclose([r["ratio"] for r in got], np.cumsum(s[:4]) / s[:4].sum()) and np.isclose(got[0]["log_value"], np.log(s[0]))
    left = matrix_of(out["rows"], "feature", [f"f{i:02d}" for i in range(70)])
    right = matrix_of(out["columns"], "sample", [f"s{j:02d}" for j in range(40)])
    assert np.allclose(left @ right.T, u[:, :4] * s[:4] @ vt[:4], atol=1e-3)
    assert np.allclose(left.T @ left, np.diag(s[:4]), atol=1e-3) and np.allclose(right.T @ right, np.diag(s[:4]), atol=1e-3)


@pytest.mark.parametrize("turned", [False, True])
def test_close_singular_values(spark, turned):
    m = np.random.default_rng(4).integers(1, 1000, (90, 130))   # a bulk of close values, more keys than directions
    m = m.T if turned else m
    cells = [(f"f{i:03d}" if i else None, f"s{j:03d}", int(v)) for (i, j), v in np.ndenumerate(m)] + [("f001", "s001", 0), ("f002", "s003", 7)]
    m[2, 3] += 7                      # a repeated cell adds up; a NULL row is a row
    out = O.truncated_svd(spark.createDataFrame(cells, "feature string, sample string, value long"), 5)
    u, s, vt = np.linalg.svd(m.astype(float), full_matrices=False)
    assert np.allclose([r["singular_value"] for r in out["singular_values"].orderBy("axis").collect()], s[:5], rtol=1e-12)
    left = matrix_of(out["rows"], "feature", [f"f{i:03d}" if i else None for i in range(len(m))])
    right = matrix_of(out["columns"], "sample", [f"s{j:03d}" for j in range(m.shape[1])])
    assert np.allclose(left @ right.T, u[:, :5] * s[:5] @ vt[:5], atol=1e-8)


def test_iteration_of_wide_matrices(spark, monkeypatch):
    monkeypatch.setattr(low_rank, "NARROW", 0)
    test_singular_values_and_vectors(spark)
    test_low_rank_and_empty_matrices(spark)


def test_low_rank_and_empty_matrices(spark):
    m = np.outer(np.arange(1, 9), np.arange(1, 6))
    out = O.truncated_svd(frame(spark, m).withColumnRenamed("reads", "value"), 3)
    assert out["singular_values"].count() == 1 and out["rows"].columns == ["feature", "axis_1"]
    none = O.truncated_svd(frame(spark, m).withColumnRenamed("reads", "value").filter("value < 0"), 3)
    assert none["singular_values"].count() == 0 and none["rows"].count() == 0


def test_triangle_tree(spark, monkeypatch):
    monkeypatch.setattr(low_rank, "FAN", 2)
    x = np.random.default_rng(1).normal(size=(60, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row long, b0 double, b1 double, b2 double").repartition(7)
    r = low_rank._triangle(df)
    assert np.allclose(r.T @ r, x.T @ x)


def models_by_enumeration(data, names, delta):
    n = len(data)
    out = {}
    for k in range(len(names) + 1):
        for ix in combinations(range(len(names)), k):
            x = np.column_stack([np.ones(n), data[:, list(ix)]])
            rss = ((data[:, -1] - x @ np.linalg.lstsq(x, data[:, -1], rcond=None)[0]) ** 2).sum()
            q = k + 2
            out["+".join(names[i] for i in ix) or "1"] = n * np.log(rss / n) + n * (np.log(2 * np.pi) + 1) + 2 * q + 2 * q * (q + 1) / (n - q - 1)
    best = min(out.values())
    return {m: a for m, a in out.items() if a - best < delta}


def data_of(spark, n, p, seed, shift=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    x[:, 1] += x[:, 0]
    y = x[:, 0] - 0.4 * x[:, 2] + 0.2 * x[:, p - 1] + rng.normal(size=n)
    data = np.column_stack([x, y]) + shift
    names = [f"x{i}" for i in range(p)]
    return spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"{c} double" for c in [*names, "y"])), data, names


@pytest.mark.parametrize("delta", [2.0, 9.0])
def test_subset_search_equals_enumeration(spark, delta):
    df, data, names = data_of(spark, 60, 12, 5)
    got = {r["model"]: r["aicc"] for r in O.all_subsets_aicc(df, "y", names, delta).collect()}
    want = models_by_enumeration(data, names, delta)
    assert got.keys() == want.keys() and all(np.isclose(got[m], want[m]) for m in want)


def test_subset_search_has_no_term_limit(spark):
    df, data, names = data_of(spark, 200, 32, 6)
    rows = O.all_subsets_aicc(df, "y", names, 0.5).collect()
    assert rows and rows[0]["delta"] == 0 and "x0" in rows[0]["model"].split("+")


def test_means_far_from_zero_keep_digits(spark):
    df, data, names = data_of(spark, 80, 3, 7, shift=1e9)
    got = {r["term"]: r for r in O.glm_gaussian(df, "y", names).collect()}
    near = data - 1e9
    want = np.linalg.lstsq(np.column_stack([np.ones(80), near[:, :3]]), near[:, 3], rcond=None)[0]
    assert np.allclose([got[c]["estimate"] for c in names], want[1:], rtol=1e-6)
    x = 1e9 + np.random.default_rng(3).normal(size=500)
    cells = spark.createDataFrame([("f", f"s{i}", float(v)) for i, v in enumerate(x)], "feature string, sample string, reads double").repartition(6)
    row = A.mean_var(cells, sd=True).first()
    assert np.isclose(row["variance"], x.var(ddof=1), rtol=1e-7) and np.isclose(row["sd"], x.std(ddof=1), rtol=1e-7)
    m = table(10, 7, seed=8)
    for r in A.mean_var(frame(spark, m)).collect():
        own = m[int(r["feature"][1:])]
        assert np.isclose(r["mean"], own.mean()) and np.isclose(r["variance"], own.var(ddof=1))
