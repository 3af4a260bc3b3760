"""Products met block by block, laws per environment and clusters of columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from countgrove.operators import joins as J
from countgrove.operators import laws as M
from countgrove.operators import ordination as O

from .helpers import frame, table


def test_product_of_two_tables(spark):
    a = spark.createDataFrame([(i,) for i in range(5)], "x long")
    b = spark.createDataFrame([(i, f"y{i % 3}") for i in range(7)] + [(None, None)] * 2, "y long, name string")
    for block in (2, 1024):
        got = J.cross_tables(a, b, block)
        assert got.columns == ["x", "y", "name"] and got.count() == 45
        assert sorted(map(str, got.collect())) == sorted(map(str, a.crossJoin(b).collect()))
    assert J.cross_tables(a, b.limit(0)).count() == 0
    with pytest.raises(ValueError):
        J.cross_tables(a, b.withColumnRenamed("y", "X"))


def test_powers_and_predicted_occupancy_by_blocks_of_depths(spark, monkeypatch):
    m = table(14, 9, seed=21, zeros=0.4)
    df = frame(spark, m)
    depth = m.sum(axis=0).astype(float)
    params = M.gamma_parameters(df)
    known = {r["feature"]: r for r in params.collect()}
    eta = spark.createDataFrame([(-4.0, 0.7), (-2.0, 0.7), (-1.0, 0.7)], "eta double, mean_shape double")
    for size in (2, 1024):
        monkeypatch.setattr(M, "DEPTHS", size)
        for r in M.expected_occupancy(df, params, mean_of_powers=True).collect():
            p = known[r["feature"]]
            if p["shape"] is not None and p["shape"] > 0:
                want = 1 - np.mean((1 + p["mean_abundance"] / p["shape"] * depth) ** -p["shape"])
                assert np.isclose(r["occupancy_expected"], want)
        got = M.predicted_occupancy_density(df, eta, 20).collect()
        log_p0 = [0.7 * np.log(0.7 / (0.7 + depth * np.exp(e))) for e in (-4.0, -2.0, -1.0)]
        weight = [1 - np.exp(x.sum()) for x in log_p0]
        bins = {}
        for x, w in zip(log_p0, weight):
            bins.setdefault(int((1 - np.exp(x)).mean() * 20), []).append(w)
        assert {r["b"]: round(r["n"], 9) for r in got} == {b: round(sum(w), 9) for b, w in bins.items()}


def test_powers_of_odd_parameters(spark):
    df = frame(spark, table(6, 5, seed=3))
    params = spark.createDataFrame([("a", 0.01, 2.0), ("b", None, 1.0), ("c", 0.2, None), ("d", 0.5, -0.5)],
                                   "feature string, mean_abundance double, shape double")
    out = M.expected_occupancy(df, params, mean_of_powers=True)
    got = {r["feature"]: r["occupancy_expected"] for r in out.collect()}
    depth = np.array([r["d"] for r in df.groupBy("sample").agg(F.sum("reads").alias("d")).collect()], dtype=float)
    assert np.isclose(got["a"], 1 - np.mean((1 + 0.01 / 2 * depth) ** -2.0)) and got.keys() == {*"abcd"}
    assert got["b"] is None and got["c"] is None and got["d"] is None
    assert "CoGroup" in out._jdf.queryExecution().executedPlan().toString()      # powers are taken in arrays, not by an interpreted lambda


def test_latent_grid_is_the_fitted_normal(spark):
    fit = spark.createDataFrame([(1.5, 0.5, 0.3)], "mu double, sigma double, mean_shape double")
    eta = np.array([r["eta"] for r in M.quantile_grid(fit, 400).collect()])
    assert len(eta) == 400 and np.isclose(eta.mean(), 1.5) and abs(eta.std() - 0.5) < 0.01 and np.isclose(np.median(eta), 1.5)


def test_columns_of_like_profile_cluster(spark):
    rng = np.random.default_rng(2)
    kinds = rng.poisson(20, (3, 40)) * (rng.random((3, 40)) < 0.5)
    m = np.stack([rng.poisson(kinds[j % 3] * 3) for j in range(18)], axis=1)
    got = {r["sample"]: r["cluster"] for r in O.column_clusters(frame(spark, m), 3, 3).collect()}
    groups = [{got[f"s{j:02d}"] for j in range(18) if j % 3 == k} for k in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def test_no_feature_above_the_cut_off_has_no_lognormal(spark):
    """Empty moments come as NULL; the search for a root among them did not end."""
    for gone in (None, float("nan")):
        assert M._solve_mu(gone, gone, gone) is None
    params = M.gamma_parameters(frame(spark, table(8, 5, seed=4))).withColumn("mean_abundance", F.lit(1e-9))
    moments = M.truncated_moments(params, frame(spark, table(8, 5, seed=4)))
    got = M.estimate_lognormal(moments).collect()
    assert len(got) == 1 and got[0]["n_observed"] == 0 and got[0]["mu"] is None and got[0]["total_species"] is None
    assert M.mean_abundance_density(params, M.estimate_lognormal(moments)).count() == 0
