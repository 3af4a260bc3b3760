import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from countgrove.functions import special as sp
from countgrove.operators import inference as H
from tests.helpers import avg_rank, frame, table


def test_special_functions(spark):
    import statistics
    df = spark.createDataFrame([(x / 7.0,) for x in range(-60, 61)], "x double")
    out = df.select("x", sp.erfc("x").alias("e"), sp.norm_ppf((F.col("x") + 9) / 18).alias("q"), sp.lgamma(F.abs("x") + 0.01).alias("g"))
    for r in out.collect():
        assert math.isclose(r["e"], math.erfc(r["x"]), rel_tol=1e-12)
        assert math.isclose(r["q"], statistics.NormalDist().inv_cdf((r["x"] + 9) / 18), abs_tol=1e-12)
        assert math.isclose(r["g"], math.lgamma(abs(r["x"]) + 0.01), abs_tol=1e-11)
    one = spark.range(1)
    # Upper 5 % points of standard tables.
    for x, k in ((3.841459, 1), (5.991465, 2), (11.070498, 5), (12.591587, 6)):
        assert math.isclose(one.select(sp.chi2_sf(F.lit(x), k)).first()[0], 0.05, abs_tol=1e-6)
    assert math.isclose(one.select(sp.student_sf2(F.lit(2.262157), F.lit(9.0))).first()[0], 0.05, abs_tol=1e-6)


TOY = {"biased sample": [[10, 10, 10, 100], [10, 10, 20, 200], [20, 20, 10, 50], [20, 20, 20, 50]],
       "biased method": [[10, 10, 100, 100], [10, 10, 200, 200], [20, 20, 100, 50], [20, 20, 200, 50]]}


@pytest.mark.parametrize("name", TOY)
def test_biased_library_toys(spark, name):
    c = frame(spark, np.array(TOY[name]))
    g = spark.createDataFrame([(f"s{j:02d}", "M1" if j < 2 else "M2") for j in range(4)], "sample string, group string")
    f = H.rle_size_factors(c)
    fc = {r["feature"]: r["log_fc"] for r in H.log_fc_cpm(c, f, g).collect()}
    test = {r["feature"]: r for r in H.nb_two_group_test(c, f, g).collect()}
    assert fc["f01"] > fc["f00"] > fc["f02"] and fc["f01"] > 0 > fc["f02"]
    assert max(test, key=lambda k: test[k]["log_fc"]) == "f01"
    assert test["f03"]["fdr"] > 0.05


def test_rle_size_factors_brute_force(spark):
    m = table(31, 6, seed=12, zeros=0.7)
    x = m + 1.0
    geo = np.exp(np.log(x).mean(axis=1))
    f = np.median(x / geo[:, None], axis=0) / x.sum(axis=0)
    f = f / np.exp(np.log(f).mean())
    got = {r["sample"]: r["norm_factor"] for r in H.rle_size_factors(frame(spark, m)).collect()}
    assert np.allclose([got[f"s{j:02d}"] for j in range(6)], f)


def test_zero_inflated_contrast_recovers_signs(spark):
    rng = np.random.default_rng(4)
    effect = np.array([math.log(0.25)] * 4 + [0.0] * 2 + [math.log(4)] * 4)
    mean = np.exp(4 + np.outer(effect, np.repeat([0, 1], 10)))
    m = rng.poisson(mean) * (rng.random((10, 20)) < 0.8)
    m = np.vstack([m, rng.poisson(5000, 20)])
    g = spark.createDataFrame([(f"s{j:02d}", "A" if j < 10 else "B") for j in range(20)], "sample string, group string")
    got = {r["feature"]: r["beta"] for r in H.zero_inflated_contrast(frame(spark, m), g).collect()}
    assert all(np.sign(got[f"f{i:02d}"]) == np.sign(effect[i]) for i in range(10) if effect[i])


def test_rank_sum_with_zeros(spark):
    m = table(5, 8, seed=13, zeros=0.5)
    rows = [(f"t{i}", f"s{j}", "A" if j < 3 else "B", int(m[i, j])) for i, j in zip(*np.nonzero(m))]
    v = spark.createDataFrame(rows, "taxon string, sample string, group string, reads long")
    got = {r["taxon"]: r for r in H.rank_sum_test(v, H.group_sizes(v)).collect()}
    for i in range(5):
        r = avg_rank(m[i])
        w = r[:3].sum() - 6
        t = sum(c ** 3 - c for c in np.unique(m[i], return_counts=True)[1])
        sd = math.sqrt(15 / 12 * (9 - t / 56))
        z = (w - 7.5 - np.sign(w - 7.5) * 0.5) / sd
        assert math.isclose(got[f"t{i}"]["w"], w) and math.isclose(got[f"t{i}"]["p"], min(1, math.erfc(abs(z) / math.sqrt(2))), rel_tol=1e-9)


def test_nmi_of_itself_is_one(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b"), ("b", "b"), ("c", "c")], "x string, y string")
    assert math.isclose(H.nmi(df, "x", "y").first()["nmi"], 1.0)


def _three_groups(spark):
    rng = np.random.default_rng(8)
    cells = [("t", f"{g}{i}", g, int(v)) for g, m in (("A", 3), ("B", 30), ("C", 5)) for i, v in enumerate(rng.poisson(m, 6))]
    return spark.createDataFrame(cells, "taxon string, sample string, group string, reads long")


def test_three_groups_need_labels(spark):
    v = _three_groups(spark)
    with pytest.raises(Exception, match="two groups"):
        H.rank_sum_test(v, H.group_sizes(v)).collect()
    only = v.filter("group <> 'B'")
    named = H.group_sizes(v, labels=("A", "C"))
    for test in (H.rank_sum_test, H.group_contrast):
        assert test(v, named).collect() == test(only, H.group_sizes(only)).collect()
    turned = H.group_contrast(v, H.group_sizes(v, labels=("C", "A"))).first()
    assert turned["mean_diff"] == -H.group_contrast(v, named).first()["mean_diff"]


def test_comparisons_have_their_own_labels(spark):
    rng = np.random.default_rng(9)
    mean = np.where(np.arange(8) < 4, 10, 60)
    m = np.stack([rng.poisson(mean), rng.poisson(mean[::-1]), rng.poisson(40, 8)]) + 1
    c = frame(spark, m)
    rows = [(f"s{j:02d}", k, g) for j in range(8) for k, g in ((1, "A" if j < 4 else "B"), (2, "C" if j < 4 else "D"))]
    g = spark.createDataFrame(rows, "sample string, comparison int, group string")
    f = H.rle_size_factors(c)
    for run in (lambda x, by: H.zero_inflated_contrast(c, x, by=by), lambda x, by: H.log_fc_cpm(c, f, x, by=by),
                lambda x, by: H.nb_two_group_test(c, f, x, by=by)):
        both = {(r["feature"], r["comparison"]): r.asDict() for r in run(g, ["comparison"]).collect()}
        for k in (1, 2):
            one = {r["feature"]: r.asDict() for r in run(g.filter(f"comparison = {k}").drop("comparison"), []).collect()}
            assert len(one) == 3
            for name, want in one.items():
                got = both[name, k]
                assert all(got[x] == want[x] or np.isclose(got[x], want[x]) for x in want)
    with pytest.raises(Exception, match="two groups"):
        H.log_fc_cpm(c, f, g).collect()


def test_suite_equals_its_tests_one_by_one(spark):
    rng = np.random.default_rng(21)
    mean = np.where(np.arange(8) < 4, 10, 60)
    m = np.stack([rng.poisson(mean), rng.poisson(mean[::-1]), rng.poisson(40, 8), rng.poisson(3, 8) * (rng.random(8) < 0.7)])
    tables = {"all": frame(spark, m), "half": frame(spark, m // 2)}
    rows = [(f"s{j:02d}", k, g) for j in range(8) for k, g in ((1, "A" if j < 4 else "B"), (2, "D" if j % 2 else "C"))]
    g = spark.createDataFrame(rows, "sample string, comparison int, group string")
    got = {(r["comparison"], r["variant"], r["test"], r["feature"]): r for r in H.contrast_suite(tables, g, ["comparison"]).collect()}
    seen = 0
    for k in (1, 2):
        mine = g.filter(f"comparison = {k}").drop("comparison")
        for name, c in tables.items():
            values = c.withColumnRenamed("feature", "taxon").join(mine, "sample")
            ranks = H.contrast_grid(values.withColumn("one", F.lit(1)), H.group_sizes(mine), ["one"], level=1.0)
            alone = {("rank_sum", r["taxon"]): (-r["mean_diff"], r["p"], r["p_adjusted"]) for r in ranks.collect()}
            alone |= {("negative_binomial", r["feature"]): (r["log_fc"], r["p"], r["fdr"])
                      for r in H.nb_two_group_test(c, H.rle_size_factors(c), mine).collect()}
            zero = H.p_adjust_bh(H.zero_inflated_contrast(c, mine))
            alone |= {("zero_inflated", r["feature"]): (r["beta"], r["p"], r["p_adjusted"]) for r in zero.collect()}
            for (test, feature), want in alone.items():
                r = got[k, name, test, feature]
                have = (r["effect"], r["p"], r["p_adjusted"])
                assert all(x == y or np.isclose(x, y) for x, y in zip(have, want) if y is not None or x is not None), (test, feature)
                q = r["p_adjusted"]
                assert r["kept"] == (r["effect"] if q is not None and q <= 0.05 else 0.0)
                seen += 1
    assert seen == len(got)
    with pytest.raises(ValueError, match="unknown"):
        H.contrast_suite(tables, g, tests=("exact",))


def test_spearman_of_many_columns(spark):
    rng = np.random.default_rng(22)
    x = rng.integers(0, 6, (60, 12)).astype(float)
    cols = [f"v{j:02d}" for j in range(12)]
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], cols).unionByName(
        spark.createDataFrame([(None, *[1.0] * 11)], ", ".join(f"{c} double" for c in cols)))
    rank = np.array([[(v < c).sum() + ((v == c).sum() + 1) / 2 for c in v] for v in x.T])
    want = np.corrcoef(rank)
    got = {(r["c1"], r["c2"]): (r["r"], r["n"]) for r in H.correlation_matrix(df, cols, "spearman").collect()}
    assert len(got) == 66
    for (a, b), (r, n) in got.items():
        assert n == 60 and np.isclose(r, want[cols.index(a), cols.index(b)])


def test_draws_beyond_a_billion_reads():
    from countgrove.operators import resampling as X

    rng = np.random.default_rng(1)
    good, bad, size = 3_000_000_000, 5_000_000_000, 2_000_000
    x = np.array([X._split(rng, good, bad, size) for _ in range(400)])
    share = good / (good + bad)
    sd = np.sqrt(size * share * (1 - share))
    assert abs(x.mean() - size * share) < 5 * sd / 20 and 0.85 < x.std() / sd < 1.15
    urn = np.array([4_000_000_000, 7, 0, 900_000_000, 2_000_000_000])
    for n in (0, 5, 10 ** 9, int(urn.sum())):
        d = X._draw(rng, urn, n)
        assert d.sum() == n and (d <= urn).all() and (d >= 0).all()
    near = [(X._split(np.random.default_rng([7, i]), 600_000_000, 600_000_000, 10) , ) for i in range(2000)]
    assert abs(np.mean(near) - 5) < 0.15 and abs(np.var(near) - 2.5) < 0.3


def test_lognormal_location_far_from_zero():
    from countgrove.operators.laws import _solve_mu

    rng = np.random.default_rng(2)
    for mu in (-200.0, -3.0, 40.0):
        x = rng.normal(mu, 1.5, 200000)
        c = mu - 0.5
        x = x[x > c]
        assert abs(_solve_mu(c, x.mean(), (x * x).mean()) - mu) < 0.1
    assert _solve_mu(1.0, 1.0, 2.0) is None


def test_gamma_and_lognormal_densities(spark):
    one = spark.createDataFrame([(0.5, 2.5, 1.5), (3.0, 0.7, 0.2), (0.0, 1.0, 4.0), (-1.0, 2.0, 2.0), (1.0, -1.0, 2.0)],
                                "x double, a double, b double")
    got = one.select(sp.gamma_density("x", "a", "b").alias("g"), sp.lognormal_density("x", "a", "b").alias("l")).collect()
    gamma = lambda x, a, b: b ** a * x ** (a - 1) * math.exp(-b * x) / math.gamma(a)
    log = lambda x, m, s: math.exp(-((math.log(x) - m) / s) ** 2 / 2) / (x * s * math.sqrt(2 * math.pi))
    assert math.isclose(got[0]["g"], gamma(0.5, 2.5, 1.5), rel_tol=1e-9) and math.isclose(got[1]["g"], gamma(3, 0.7, 0.2), rel_tol=1e-9)
    assert math.isclose(got[0]["l"], log(0.5, 2.5, 1.5)) and math.isclose(got[1]["l"], log(3, 0.7, 0.2))
    assert got[2]["g"] == 4.0 and got[2]["l"] == 0.0 and got[3]["g"] == 0.0 and got[4]["g"] is None


def test_grid_keeps_cells_of_a_key_apart(spark):
    """Sizes of the keys are sent to the cells: no join by the key deals its rows to one task, and the counts are written once."""
    rng = np.random.default_rng(8)
    m = rng.integers(0, 6, (9, 12))
    rows = [(k, f"f{i}", f"s{j}", "A" if j < 5 else "B", int(m[i, j]) + (k == "y")) for k in "xy" for i in range(9) for j in range(12)]
    v = spark.createDataFrame(rows, "key string, taxon string, sample string, group string, reads long")
    sizes = H.group_sizes(v, by=["key"])
    seen = []
    plain, H.written = H.written, lambda df, label: (seen.append((label, df._jdf.queryExecution().toString())), plain(df, label))[1]
    try:
        got = H.rank_sum_test(v, sizes, by=["key"]).collect()
    finally:
        H.written = plain
    assert [label for label, p in seen] == ["histogram"] and "strategy=broadcast" in seen[0][1]
    for r in got:
        x = m[int(r["taxon"][1:])] + (r["key"] == "y")
        assert math.isclose(r["w"], avg_rank(x)[:5].sum() - 15)


def test_suite_reads_the_groups_once(spark):
    """Tests join the groups several times; what finds them runs once."""
    c = frame(spark, table(9, 8, seed=6))
    found = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def half(sample):
        found.add(1)
        return "A" if sample < "s04" else "B"

    g = spark.createDataFrame([(f"s{j:02d}",) for j in range(8)], "sample string").withColumn("group", half("sample"))
    rows = H.contrast_suite({"raw": c}, g).collect()
    assert found.value == 8 and len(rows) == 27
