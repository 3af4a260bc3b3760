import math

import numpy as np

from countgrove.operators import laws as M
from countgrove.operators import ordination as O
from tests.helpers import frame, table


def wide(spark, x):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"c{j} double" for j in range(x.shape[1])))


def test_pca_and_vif(spark):
    x = np.random.default_rng(1).normal(size=(40, 4)) @ np.diag([1, 2, 3, 4.0])
    x[:, 1] += x[:, 0]
    df, cols = wide(spark, x), ["c0", "c1", "c2", "c3"]
    corr = np.corrcoef(x.T)
    got = [r["eigenvalue"] for r in O.pca(df, "id", cols, 4)["eigenvalues"].orderBy("axis").collect()]
    assert np.allclose(got, np.sort(np.linalg.eigvalsh(corr))[::-1])
    assert np.allclose([r["vif"] for r in O.vif(df, cols).collect()], np.diag(np.linalg.inv(corr)))
    s = np.array([[r["axis_1"], r["axis_2"]] for r in O.pca(df, "id", cols, 2)["scores"].orderBy("id").collect()])
    assert np.allclose(s.var(axis=0, ddof=1), got[:2])


def test_svd_and_correspondence_analysis(spark):
    m = table(15, 6, seed=2, zeros=0.4)
    df = frame(spark, m)
    out = O.truncated_svd(df.withColumnRenamed("reads", "value"), 3)
    got = [r["eigenvalue"] for r in out["eigenvalues"].orderBy("axis").collect()]
    assert np.allclose(got, np.linalg.svd(m.astype(float))[1][:3] ** 2)
    p = m / m.sum()
    r, c = p.sum(axis=1), p.sum(axis=0)
    z = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    got = [q["eigenvalue"] for q in O.correspondence_analysis(df, 2)["eigenvalues"].orderBy("axis").collect()]
    assert np.allclose(got, np.linalg.svd(z)[1][:2] ** 2)


def test_rda_cca_partial_and_partition(spark):
    rng = np.random.default_rng(3)
    m = table(12, 9, seed=3, zeros=0.3)
    x = rng.normal(size=(9, 3))
    cov = spark.createDataFrame([(f"s{j:02d}", *map(float, x[j])) for j in range(9)], "sample string, a double, b double, c double")
    cells = frame(spark, m).withColumnRenamed("reads", "value")
    y = m.T.astype(float)
    yc, xc = y - y.mean(axis=0), x - x.mean(axis=0)
    r2 = lambda q: (np.linalg.lstsq(q, yc, rcond=None)[0].T @ q.T).var(axis=1).sum() / yc.var(axis=0).sum()
    rda = O.rda(cells, cov, ["a", "b", "c"])
    assert math.isclose(rda.r2(["a", "b", "c"]), r2(xc), rel_tol=1e-9)
    assert math.isclose(rda.r2(["a"], ["b", "c"]), r2(xc) - r2(xc[:, 1:]), rel_tol=1e-9)
    p = m.T / m.sum()
    w, f = p.sum(axis=1), p.sum(axis=0)
    q = (p - np.outer(w, f)) / np.sqrt(np.outer(w, f))
    xw = np.sqrt(w)[:, None] * (x - w @ x)
    fit = xw @ np.linalg.lstsq(xw, q, rcond=None)[0]
    cca = O.cca(cells, cov, ["a", "b", "c"])
    assert math.isclose(cca.r2(["a", "b", "c"]), (fit ** 2).sum() / (q ** 2).sum(), rel_tol=1e-9)
    parts = {r["fraction"]: r["adjusted_r2"] for r in O.variation_partition(rda, {"A": ["a"], "B": ["b", "c"]}).collect()}
    assert math.isclose(sum(parts.values()), 1.0, abs_tol=1e-9)
    assert math.isclose(parts["A"], rda.adjusted(["a", "b", "c"]) - rda.adjusted(["b", "c"]), abs_tol=1e-9)
    steps = O.forward_select(cells, cov, ["a", "b", "c"], weighted=False, n_perm=9).collect()
    assert 1 <= len(steps) <= 3


def test_all_subsets_and_shift(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    x = np.column_stack([x, 2 * x[:, 0] - x[:, 1] + rng.normal(size=60) * 0.1])
    best = O.all_subsets_aicc(wide(spark, x), "c3", ["c0", "c1", "c2"]).first()
    assert {"c0", "c1"} <= set(best["model"].split("+"))
    # Share tables where the third row is the same in both and the first two are not.
    a = spark.createDataFrame([("sp1", .4, 0.), ("sp2", 0., 1.), ("sp3", .6, 0.)], "id string, axis_1 double, axis_2 double")
    b = spark.createDataFrame([("sp1", 0., 1.), ("sp2", .4, 0.), ("sp3", .6, 0.)], "id string, axis_1 double, axis_2 double")
    d = {r["id"]: r["distance"] for r in O.shift_distance(a, b, "id", ["axis_1", "axis_2"]).collect()}
    assert d["sp3"] == 0 and math.isclose(d["sp1"], d["sp2"]) and d["sp1"] > 0


def test_lognormal_recovers_parameters(spark):
    rng = np.random.default_rng(6)
    mu, sd, c = -10.0, 2.0, -11.0
    draw = rng.normal(mu, sd, 200000)
    kept = draw[draw > c]
    m = spark.createDataFrame([(c, float(kept.mean()), float((kept ** 2).mean()), len(kept))], "c double, m1 double, m2 double, n_observed long")
    r = M.estimate_lognormal(m).first()
    assert abs(r["mu"] - mu) < 0.15 and abs(r["sigma"] - sd) < 0.1 and abs(r["total_species"] / 200000 - 1) < 0.05


def _factor_data(spark):
    rng = np.random.default_rng(21)
    m = table(15, 24, seed=21, zeros=0.2)
    a = rng.normal(size=24)
    f = np.array(["x", "y", "z"])[rng.integers(0, 3, 24)]
    m = m + (rng.poisson(4, m.shape) * np.where(f == "z", 3, 1)).astype(int)
    cov = spark.createDataFrame([(f"s{j:02d}", float(a[j]), str(f[j])) for j in range(24)], "sample string, a double, f string")
    return m, a, f, frame(spark, m).withColumnRenamed("reads", "value"), cov


def test_factor_terms_and_scores(spark):
    m, a, f, cells, cov = _factor_data(spark)
    x = np.column_stack([a, f == "y", f == "z"]).astype(float)
    p = m.T / m.sum()
    w, r = p.sum(axis=1), p.sum(axis=0)
    q = (p - np.outer(w, r)) / np.sqrt(np.outer(w, r))
    xw = np.sqrt(w)[:, None] * (x - w @ x)
    share = lambda z: ((z @ np.linalg.lstsq(z, q, rcond=None)[0]) ** 2).sum() / (q ** 2).sum()
    model = O.cca(cells, cov, ["a", "f"])
    assert math.isclose(model.r2(["a", "f"]), share(xw), rel_tol=1e-9)
    assert math.isclose(model.r2(["f"], ["a"]), share(xw) - share(xw[:, :1]), rel_tol=1e-9)
    assert math.isclose(model.adjusted(["f"], ["a"]), model.adjusted(["a", "f"]) - model.adjusted(["a"]))
    out = O.score_table(model, ["a", "f"], 2)
    get = lambda df: np.array([[v["axis_1"], v["axis_2"]] for v in df.orderBy(df.columns[0]).collect()])
    fitted, averaged = get(out["sites"]), get(out["sites_averaged"])
    again = xw @ np.linalg.lstsq(xw, np.sqrt(w)[:, None] * averaged, rcond=None)[0] / np.sqrt(w)[:, None]
    assert np.allclose(again, fitted)
    features = get(out["features"]) / np.sqrt(r)[:, None]
    assert np.allclose(averaged * [v["eigenvalue"] for v in out["axes"].orderBy("axis").collect()], (p / w[:, None]) @ features)
    means = {v["level"]: (v["axis_1"], v["axis_2"]) for v in out["centroids"].collect()}
    for level in "xyz":
        at = f == level
        assert np.allclose(means[level], (w[at, None] * fitted[at]).sum(axis=0) / w[at].sum())
    partial = O.score_table(model, ["f"], 2, ["a"])
    assert np.allclose((w[:, None] * get(partial["sites"])).T @ (a - w @ a), 0, atol=1e-9)


def test_forward_selection_by_term_with_condition(spark):
    _, _, _, cells, cov = _factor_data(spark)
    steps = O.forward_select(cells, cov, ["a", "f"], weighted=False, n_perm=19, both=True).collect()
    assert steps[0]["covariate"] == "f" and steps[0]["p"] == 0.05
    given = O.forward_select(cells, cov, ["a"], weighted=False, n_perm=19, condition=["f"]).collect()
    model = O.rda(cells, cov, ["a", "f"])
    assert len(given) == 1 and math.isclose(given[0]["r2"], model.r2(["a"], ["f"]), rel_tol=1e-9)


def test_generalised_inflation_and_large_means(spark):
    _, a, f, _, cov = _factor_data(spark)
    x = np.column_stack([a, f == "y", f == "z"]).astype(float)
    r = np.corrcoef(x.T)
    want = np.linalg.det(r[:1, :1]) * np.linalg.det(r[1:, 1:]) / np.linalg.det(r)
    got = {v["term"]: v for v in O.vif_terms(cov, ["a", "f"]).collect()}
    assert got["f"]["df"] == 2 and math.isclose(got["f"]["gvif"], want) and math.isclose(got["a"]["gvif"], want)
    far = np.random.default_rng(4).normal(size=(50, 2)) + 1e9
    s = O._moments(wide(spark, far), ["c0", "c1"])[2]
    assert np.allclose(s / 49, np.cov(far.T), rtol=1e-6)


def test_coinertia_and_factor_analyses_of_blocks(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 5)) + rng.normal(size=(40, 1))
    f = np.array(["u", "v", "w"])[rng.integers(0, 3, 40)]
    df = spark.createDataFrame([(i, *map(float, r), str(g)) for i, (r, g) in enumerate(zip(x, f))],
                               "id long, c0 double, c1 double, c2 double, c3 double, c4 double, f string")
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    d = np.linalg.svd(z[:, :2].T @ z[:, 2:] / 39)[1]
    out = O.coinertia(df, "id", ["c0", "c1"], ["c2", "c3", "c4"], 2)
    values = lambda t: [r["eigenvalue"] for r in t.orderBy("axis").collect()]
    assert np.allclose(values(out["eigenvalues"]), d ** 2)
    first, second = ([r["axis_1"] for r in out[k].orderBy("id").collect()] for k in ("first", "second"))
    assert math.isclose(np.cov(first, second)[0, 1], d[0])
    a, b = np.corrcoef(z[:, :2].T), np.corrcoef(z[:, 2:].T)
    c = z[:, :2].T @ z[:, 2:] / 39
    assert math.isclose(out["rv"].first()["rv"], (c ** 2).sum() / np.sqrt((a ** 2).sum() * (b ** 2).sum()))
    scaled = np.hstack([z[:, :2] / np.sqrt(np.linalg.eigvalsh(a)[-1]), z[:, 2:] / np.sqrt(np.linalg.eigvalsh(b)[-1])])
    m = O.mfa(df, "id", {"a": ["c0", "c1"], "b": ["c2", "c3", "c4"]}, 2)
    assert np.allclose(values(m["eigenvalues"]), np.sort(np.linalg.eigvalsh(np.cov(scaled.T)))[::-1][:2])
    share = np.stack([(f == g) / np.sqrt((f == g).mean()) for g in "uvw"], axis=1)
    both = np.hstack([z[:, :2], share])
    g = O.famd(df, "id", ["c0", "c1"], {"f": ["u", "v", "w"]}, 2)
    assert np.allclose(values(g["eigenvalues"]), np.sort(np.linalg.eigvalsh(np.cov(both.T)))[::-1][:2])
    scores = np.array([[r["axis_1"], r["axis_2"]] for r in g["scores"].collect()])
    assert np.allclose(scores.var(axis=0, ddof=1), values(g["eigenvalues"]))
