"""Queries for ordination, clustering and macro-ecological laws."""

from __future__ import annotations

from pyspark.sql import functions as F

from countgrove.operators import counts as C
from countgrove.operators import laws as M
from countgrove.operators import ordination as O

from . import tables as t
from .registry import case

COLS = ["balance", "discount", "price", "tax"]


def _embeddings(spark, d):
    return O.array_columns(t.table(spark, d, "embeddings"), "vec_id", "embedding", 64)


X64 = [f"x{i}" for i in range(64)]


@case("pca_eigenvalues")
def pca_eigenvalues(spark, d):
    return O.pca(_embeddings(spark, d), "vec_id", X64, 5)["eigenvalues"]


@case("pca_scores")
def pca_scores(spark, d):
    return O.pca(_embeddings(spark, d), "vec_id", X64, 3)["scores"]


@case("truncated_svd")
def truncated_svd(spark, d):
    x = C.log_transform(t.brand_counts(spark, d), "reads", "log1p", "value").select("feature", "sample", "value")
    return O.truncated_svd(x, 5)["eigenvalues"]


def _taxa_svd(spark, d, k=5):
    x = C.log_transform(t.brand_counts(spark, d), "reads", "log1p", "value").select("feature", "sample", "value")
    return O.truncated_svd(x, k), x


@case("svd_singular_values")
def svd_singular_values(spark, d):
    return _taxa_svd(spark, d)[0]["singular_values"]


@case("svd_rows")
def svd_rows(spark, d):
    return _taxa_svd(spark, d)[0]["rows"]


@case("svd_columns")
def svd_columns(spark, d):
    return _taxa_svd(spark, d)[0]["columns"]


@case("svd_rebuilt", f"WITH {t.BRANDS} SELECT feature, sample, round(ln(1 + CAST(reads AS DOUBLE)), 6) AS value FROM brands", digits=6)
def svd_rebuilt(spark, d):
    """Every cell from the row and column scores of all axes."""
    svd, x = _taxa_svd(spark, d, t.brand_counts(spark, d).select("feature").distinct().count())
    axes = [c for c in svd["rows"].columns if c.startswith("axis_")]
    left, right = (svd[k].select(key, F.array(*axes).alias(name)) for k, key, name in (("rows", "feature", "l"), ("columns", "sample", "r")))
    return x.select("feature", "sample").join(left, "feature").join(right, "sample").select("feature", "sample", F.aggregate(
        F.zip_with("l", "r", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias("value"))


@case("correspondence_analysis")
def correspondence_analysis(spark, d):
    return O.correspondence_analysis(t.brand_counts(spark, d), 3)["samples"]


def _response(spark, d):
    return C.hellinger(t.brand_counts(spark, d), "sample")


HELL = """hel AS (SELECT feature, sample, sqrt(CAST(reads AS DOUBLE) / sum(reads) OVER (PARTITION BY sample)) AS y FROM brands)"""


@case("rda_one_covariate", f"""WITH {t.BRANDS}, {t.COV}, {HELL}, y AS (SELECT feature, sample, y, balance AS x FROM hel JOIN cov USING (sample) WHERE y <> 0),
 s AS (SELECT DISTINCT sample, x FROM y), st AS (SELECT avg(x) AS mx, count(*) AS n, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx FROM s),
 b AS (SELECT feature, sum(y * (x - mx)) AS b, sum(y * y) AS q, sum(y) AS s FROM y, st GROUP BY 1),
 r AS (SELECT sum(b * b) / max(sxx) / (max(n) - 1) AS inertia, sum(q - s * s / n) / (max(n) - 1) AS total, max(n) AS n FROM b, st)
 SELECT 'balance' AS model, round(inertia, 6) AS inertia, round(inertia / total, 6) AS r2, round(1 - (1 - inertia / total) * (n - 1) / (n - 2), 6) AS adjusted_r2 FROM r""")
def rda_one_covariate(spark, d):
    m = O.rda(_response(spark, d), t.covariates(spark, d), ["balance"])
    return O.model_table(spark, m, {"balance": (["balance"], [])})


@case("cca_one_covariate", f"""WITH {t.BRANDS}, {t.COV}, tot AS (SELECT CAST(sum(reads) AS DOUBLE) AS t FROM brands), p AS (SELECT feature, sample, reads / t AS p FROM brands, tot WHERE reads > 0),
 r AS (SELECT feature, sum(p) AS r FROM p GROUP BY 1), c AS (SELECT sample, sum(p) AS c FROM p GROUP BY 1), x AS (SELECT sample, c, balance AS x FROM c JOIN cov USING (sample)),
 st AS (SELECT sum(c * x) AS mx, count(*) AS n FROM x), sx AS (SELECT sum(c * (x - mx) * (x - mx)) AS sxx FROM x, st),
 b AS (SELECT feature, sum((x - mx) * p / sqrt(r)) AS b FROM p JOIN r USING (feature) JOIN x USING (sample), st GROUP BY 1),
 i AS (SELECT sum(p * p / (r * c)) - 1 AS total FROM p JOIN r USING (feature) JOIN c USING (sample)),
 e AS (SELECT sum(b * b) / max(sxx) AS inertia, max(total) AS total, max(n) AS n FROM b, sx, i, st)
 SELECT 'balance' AS model, round(inertia, 6) AS inertia, round(inertia / total, 6) AS r2, round(1 - (1 - inertia / total) * (n - 1) / (n - 2), 6) AS adjusted_r2 FROM e""")
def cca_one_covariate(spark, d):
    m = O.cca(t.brand_counts(spark, d).withColumnRenamed("reads", "value"), t.covariates(spark, d), ["balance"])
    return O.model_table(spark, m, {"balance": (["balance"], [])})


@case("cca_partial")
def cca_partial(spark, d):
    m = O.cca(t.brand_counts(spark, d).withColumnRenamed("reads", "value"), t.covariates(spark, d), COLS)
    return O.model_table(spark, m, {"full": (COLS, []), "without price": (COLS[:2], ["price", "tax"])})


@case("forward_select")
def forward_select(spark, d):
    return O.forward_select(_response(spark, d), t.covariates(spark, d), COLS, weighted=False, seed=2)


@case("variation_partition")
def variation_partition(spark, d):
    m = O.rda(_response(spark, d), t.covariates(spark, d), COLS)
    return O.variation_partition(m, {"a": ["balance"], "b": ["discount", "tax"], "c": ["price"]})


@case("score_table")
def score_table(spark, d):
    m = O.cca(t.brand_counts(spark, d).withColumnRenamed("reads", "value"), t.covariates(spark, d), COLS)
    return O.score_table(m, COLS, 2)["sites"]


@case("coinertia")
def coinertia(spark, d):
    return O.coinertia(_embeddings(spark, d), "vec_id", X64[:32], X64[32:], 2)["eigenvalues"]


@case("shift_distance", """SELECT vec_id, round(sqrt(pow(CAST(embedding[1] AS DOUBLE) - embedding[3], 2) + pow(CAST(embedding[2] AS DOUBLE) - embedding[4], 2)), 6) AS distance FROM embeddings""")
def shift_distance(spark, d):
    x = _embeddings(spark, d)
    a = x.select("vec_id", F.col("x0").alias("axis_1"), F.col("x1").alias("axis_2"))
    b = x.select("vec_id", F.col("x2").alias("axis_1"), F.col("x3").alias("axis_2"))
    return O.shift_distance(a, b, "vec_id", ["axis_1", "axis_2"])


@case("mfa")
def mfa(spark, d):
    return O.mfa(_embeddings(spark, d), "vec_id", {"a": X64[:20], "b": X64[20:40], "c": X64[40:]}, 3)["eigenvalues"]


@case("famd")
def famd(spark, d):
    places = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    return O.famd(t.covariates(spark, d), "sample", COLS, {"locality": places}, 3)["scores"]


@case("cluster_on_axes")
def cluster_on_axes(spark, d):
    s = O.pca(_embeddings(spark, d), "vec_id", X64, 3)["scores"]
    return O.cluster_on_axes(s, "vec_id", ["axis_1", "axis_2", "axis_3"], 4)


def _status_profile(spark, d):
    return t.table(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


@case("profile_clusters")
def profile_clusters(spark, d):
    return O.profile_clusters(_status_profile(spark, d), "o_custkey", ["F", "O", "P"], 4)


@case("block_summary", f"""WITH {t.CLEAN}, {t.COV}, r AS (SELECT p_partkey AS feature, p_type AS cluster FROM part), nr AS (SELECT cluster, count(*) AS n FROM r GROUP BY 1), nc AS (SELECT locality, count(*) AS n FROM cov GROUP BY 1),
 b AS (SELECT r.cluster AS row_cluster, locality AS col_cluster, CAST(sum(reads) AS BIGINT) AS reads FROM clean JOIN r USING (feature) JOIN cov USING (sample) GROUP BY 1, 2)
 SELECT row_cluster, col_cluster, reads, round(reads / CAST(nr.n * nc.n AS DOUBLE), 6) AS mean FROM b JOIN nr ON nr.cluster = row_cluster JOIN nc ON nc.locality = col_cluster""")
def block_summary(spark, d):
    rows = t.table(spark, d, "part").select(F.col("p_partkey").alias("feature"), F.col("p_type").alias("cluster"))
    cols = t.covariates(spark, d).select("sample", F.col("locality").alias("cluster"))
    return O.block_summary(t.clean(spark, d), rows, cols)


@case("cluster_table", f"""WITH {t.SITES}, {t.COV} SELECT sample, n_name AS nation, CASE WHEN balance > 5000 THEN 'rich' ELSE 'poor' END AS wealth, regexp_extract(sample, 'BU_([A-Z]+)', 1) AS locality FROM cov""")
def cluster_table(spark, d):
    c = t.covariates(spark, d)
    return O.cluster_table({"nation": c.select("sample", F.col("n_name").alias("cluster")),
                            "wealth": c.select("sample", F.when(F.col("balance") > 5000, "rich").otherwise("poor").alias("cluster"))})


@case("geo_distance", f"WITH {t.SITES}, {t.COV} SELECT a.sample AS s1, b.sample AS s2, round(sqrt(pow(a.balance - b.balance, 2) + pow(a.price - b.price, 2)), 6) AS distance FROM cov a JOIN cov b ON a.sample < b.sample")
def geo_distance(spark, d):
    return O.geo_distance(t.covariates(spark, d), x="balance", y="price")


@case("vif")
def vif(spark, d):
    return O.vif(t.covariates(spark, d), COLS)


@case("vif_two", f"WITH {t.SITES}, {t.COV} SELECT c AS covariate, round(1 / (1 - pow(corr(balance, price), 2)), 6) AS vif FROM cov, (VALUES ('balance'), ('price')) v(c) GROUP BY 1")
def vif_two(spark, d):
    return O.vif(t.covariates(spark, d), ["balance", "price"])


@case("glm_gaussian", """SELECT term, round(CASE term WHEN 'l_quantity' THEN b ELSE a END, 3) AS estimate, round(rss / (n - 2) / 1e6, 3) AS dispersion, round(r2, 3) AS deviance_r2 FROM
 (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n, regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) AS rss FROM lineitem),
 (VALUES ('(intercept)'), ('l_quantity')) v(term)""")
def glm_gaussian(spark, d):
    g = O.glm_gaussian(t.table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return g.withColumn("dispersion", F.col("dispersion") / 1e6)


@case("all_subsets_aicc")
def all_subsets_aicc(spark, d):
    return O.all_subsets_aicc(t.table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber"])


@case("best_subset_of_two", """WITH m AS (SELECT regr_r2(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_tax) AS b, corr(l_extendedprice, l_quantity) AS yq, corr(l_extendedprice, l_tax) AS yt,
 corr(l_quantity, l_tax) AS qt, CAST(regr_syy(l_extendedprice, l_quantity) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM lineitem),
 f AS (SELECT n, s, unnest(['1', 'l_quantity', 'l_tax', 'l_quantity+l_tax']) AS model, unnest([2, 3, 3, 4]) AS df,
 unnest([0, a, b, (yq * yq + yt * yt - 2 * yq * yt * qt) / (1 - qt * qt)]) AS r2 FROM m),
 c AS (SELECT model, df, n * ln(s * (1 - r2) / n) + n * (ln(2 * pi()) + 1) + 2 * df + 2.0 * df * (df + 1) / (n - df - 1) AS aicc FROM f)
 SELECT model, CAST(df AS INTEGER) AS df, round(aicc, 6) AS aicc FROM c""")
def best_subset_of_two(spark, d):
    return O.all_subsets_aicc(t.table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"], delta=1e12).select("model", "df", "aicc")


# ------------------------------------------------------------------ laws


def gamma_sql(src: str, env: str = "") -> str:
    """CTEs for the parameters; `env` is an extra key of `src`."""
    k = f"{env}, " if env else ""
    on = f"AND d.{env} = c.{env}" if env else ""
    n = f"(SELECT count(*) FROM dep z WHERE z.{env} = c.{env})" if env else "(SELECT count(*) FROM dep)"
    return f"""present AS (SELECT * FROM {src} WHERE reads > 0), dep AS (SELECT {k}sample, CAST(sum(reads) AS DOUBLE) AS n FROM present GROUP BY ALL),
 sm AS (SELECT {k}count(*) AS s, avg(n) AS avg_n, max(n) AS max_n FROM dep {'GROUP BY ' + env if env else ''}),
 g0 AS (SELECT c.feature, {('c.' + env + ', ') if env else ''}sum(c.reads / d.n) AS p, sum(c.reads * (c.reads - 1.0) / (d.n * (d.n - 1))) AS q, CAST(count(*) AS DOUBLE) AS seen
   FROM present c JOIN dep d ON d.sample = c.sample {on} GROUP BY ALL),
 gp AS (SELECT feature, {('g0.' + env + ', ') if env else ''}p / s AS m, q / s - (p / s) * (p / s) AS v, seen / s AS occ, avg_n, max_n, s FROM g0 {'JOIN sm USING (' + env + ')' if env else ', sm'}),
 gx AS (SELECT *, m * m / nullif(v, 0) AS shape, m / nullif(v, 0) AS scale FROM gp),
 ge AS (SELECT *, CASE WHEN 1 + m / shape * avg_n > 0 THEN 1 - pow(1 + m / shape * avg_n, -shape) END AS expd FROM gx)"""


G = f"WITH {t.CLEAN}, {gamma_sql('clean')}"
GB = f"WITH {t.BRANDS}, {gamma_sql('brands')}"
GE = f"WITH {t.CLEAN}, {t.COV}, ec AS (SELECT feature, sample, reads, locality FROM clean JOIN cov USING (sample)), {gamma_sql('ec', 'locality')}"


def _params(spark, d):
    return M.gamma_parameters(t.clean(spark, d))


@case("gamma_parameters", f"{G} SELECT feature, round(m * 1e3, 6) AS mean_abundance, round(v * 1e6, 6) AS variance_abundance, round(occ, 6) AS occupancy, round(shape, 6) AS shape FROM gx")
def gamma_parameters(spark, d):
    return _params(spark, d).select("feature", (F.col("mean_abundance") * 1e3).alias("mean_abundance"),
                                    (F.col("variance_abundance") * 1e6).alias("variance_abundance"), "occupancy", "shape")


@case("expected_occupancy", f"{G} SELECT feature, round(occ, 6) AS occupancy, round(expd, 6) AS occupancy_expected FROM ge")
def expected_occupancy(spark, d):
    return M.expected_occupancy(t.clean(spark, d), _params(spark, d)).select("feature", "occupancy", "occupancy_expected")


@case("expected_occupancy_mean_of_powers", f"{G} SELECT feature, round(1 - avg(pow(1 + m / shape * n, -shape)), 6) AS occupancy_expected FROM gx, dep GROUP BY 1")
def expected_occupancy_mean_of_powers(spark, d):
    return M.expected_occupancy(t.clean(spark, d), _params(spark, d), mean_of_powers=True).select("feature", "occupancy_expected")


@case("taylor_law", f"{G} SELECT round(regr_slope(ln(v), ln(m)), 6) AS slope, round(regr_intercept(ln(v), ln(m)), 6) AS intercept, round(regr_r2(ln(v), ln(m)), 6) AS r2, CAST(count(*) AS BIGINT) AS n FROM gx WHERE m > 0 AND v > 0")
def taylor_law(spark, d):
    return M.taylor_law(_params(spark, d))


def _expected(spark, d):
    from countgrove.plans.scratch import written
    c = t.clean(spark, d)
    return c, written(M.expected_occupancy(c, M.gamma_parameters(c)), "parameters")


OBIN = """ob AS (SELECT min(occ) AS lo, (max(occ) - min(occ)) / 10.0::DOUBLE AS w FROM ge)"""


@case("occupancy_bins", f"{G}, {OBIN} SELECT CAST(trunc((occ - lo) / w) AS BIGINT) AS b, count(*) AS n, round(avg(occ), 6) AS mean_occupancy, round(avg(expd), 6) AS mean_occupancy_expected FROM ge, ob GROUP BY 1")
def occupancy_bins(spark, d):
    return M.occupancy_bins(_expected(spark, d)[1])


@case("occupancy_fit", f"{G} SELECT round(regr_slope(occ, expd), 6) AS slope, round(regr_intercept(occ, expd), 6) AS intercept, round(regr_r2(occ, expd), 6) AS r2, CAST(regr_count(occ, expd) AS BIGINT) AS n FROM ge")
def occupancy_fit(spark, d):
    return M.occupancy_fit(_expected(spark, d)[1])


MOM = "mo AS (SELECT max(ln(s / max_n)) AS c, avg(ln(m)) AS m1, avg(ln(m) * ln(m)) AS m2, count(DISTINCT feature) AS n_observed, sum(m) AS sum_mean, avg(shape) AS mean_shape, avg(scale) AS mean_scale FROM gx WHERE m > 0 AND ln(m) > ln(s / max_n))"


@case("truncated_moments", f"{GB}, {MOM} SELECT round(c, 6) AS c, round(m1, 6) AS m1, round(m2, 6) AS m2, n_observed, round(sum_mean, 6) AS sum_mean, round(mean_shape, 6) AS mean_shape, round(mean_scale, 3) AS mean_scale FROM mo", digits=6)
def truncated_moments(spark, d):
    c = t.brand_counts(spark, d)
    return M.truncated_moments(M.gamma_parameters(c), c)


def _fit(spark, d):
    """Parameters and fit on (kingdom, phylum) taxa, whose shares pass the cut-off."""
    c = t.brand_counts(spark, d)
    p = M.gamma_parameters(c)
    return c, p, M.estimate_lognormal(M.truncated_moments(p, c))


@case("estimate_lognormal")
def estimate_lognormal(spark, d):
    return _fit(spark, d)[2]


GRID_N = 40


@case("predicted_occupancy_density", f"""{GB}, {MOM}, et AS (SELECT m1 + (i - 20) * 0.1 AS eta, mean_shape AS b FROM mo, range(0, {GRID_N}) r(i)),
 o AS (SELECT eta, avg(1 - pow(b / (b + n * exp(eta)), b)) AS occupancy, 1 - exp(sum(b * ln(b / (b + n * exp(eta))))) AS weight FROM et, dep GROUP BY 1),
 w AS (SELECT CAST(trunc(occupancy * 20) AS BIGINT) AS b, sum(weight) AS n, sum(weight * occupancy) / sum(weight) AS mean, avg(weight) AS mean_weight FROM o GROUP BY 1)
 SELECT b, round(n, 6) AS n, round(mean, 6) AS mean, round(mean_weight, 6) AS mean_weight, round(n / (sum(n) OVER ()) * 20, 6) AS p FROM w""")
def predicted_occupancy_density(spark, d):
    c = t.brand_counts(spark, d)
    m = M.truncated_moments(M.gamma_parameters(c), c)
    grid = m.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(GRID_N - 1)))).withColumn("eta", F.col("m1") + (F.col("i") - 20) * 0.1)
    return M.predicted_occupancy_density(c, grid)


@case("observed_occupancy_density", f"{G}, w AS (SELECT CAST(trunc(occ * 20) AS BIGINT) AS b, count(*) AS n, avg(occ) AS mean, stddev_samp(occ) AS sd FROM gx GROUP BY 1) SELECT b, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(0.05::DOUBLE, 6) AS width, round(n / (sum(n) OVER ()) * 20, 6) AS p FROM w")
def observed_occupancy_density(spark, d):
    return M.observed_occupancy_density(_params(spark, d))


@case("abundance_fluctuation_density", f"""WITH {t.BRANDS}, present AS (SELECT * FROM brands WHERE reads > 0), ls AS (SELECT feature, sample, ln(CAST(reads AS DOUBLE) / sum(reads) OVER (PARTITION BY sample)) AS l FROM present),
 fs AS (SELECT feature, avg(l) AS m, stddev_samp(l) AS s FROM ls GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT sample) FROM present)), z AS (SELECT (l - m) / s AS z FROM ls JOIN fs USING (feature)),
 r AS (SELECT min(z) AS lo, (max(z) - min(z)) / 20.0::DOUBLE AS w FROM z), b AS (SELECT CAST(trunc((z - lo) / w) AS BIGINT) AS b, count(*) AS n, avg(z) AS mean, stddev_samp(z) AS sd, max(w) AS width FROM z, r GROUP BY 1)
 SELECT b, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(width, 6) AS width, round(n / (sum(n) OVER ()) / width, 6) AS p FROM b""")
def abundance_fluctuation_density(spark, d):
    return M.abundance_fluctuation_density(t.brand_counts(spark, d))


@case("mean_abundance_density")
def mean_abundance_density(spark, d):
    _, p, fit = _fit(spark, d)
    return M.mean_abundance_density(p, fit)


@case("laws_by_environment_parameters", f"{GE} SELECT feature, locality, round(m * 1e3, 6) AS mean_abundance, round(occ, 6) AS occupancy, round(expd, 6) AS occupancy_expected FROM ge")
def laws_by_environment_parameters(spark, d):
    out = M.laws_by_environment(t.clean(spark, d), t.covariates(spark, d), "locality")["parameters"]
    return out.select("feature", "locality", (F.col("mean_abundance") * 1e3).alias("mean_abundance"), "occupancy", "occupancy_expected")


@case("laws_by_environment_taylor", f"{GE} SELECT locality, round(regr_slope(ln(v), ln(m)), 6) AS slope, round(regr_intercept(ln(v), ln(m)), 6) AS intercept, round(regr_r2(ln(v), ln(m)), 6) AS r2, CAST(count(*) AS BIGINT) AS n FROM gx WHERE m > 0 AND v > 0 GROUP BY 1")
def laws_by_environment_taylor(spark, d):
    return M.laws_by_environment(t.clean(spark, d), t.covariates(spark, d), "locality")["taylor"]


def _environment(spark, d, name):
    return M.laws_by_environment(t.clean(spark, d), t.covariates(spark, d), "locality")[name]


@case("laws_by_environment_bins", f"""{GE}, eb AS (SELECT locality, min(occ) AS lo, (max(occ) - min(occ)) / 10.0::DOUBLE AS w FROM ge GROUP BY 1)
 SELECT locality, CAST(trunc((occ - lo) / w) AS BIGINT) AS b, count(*) AS n, round(avg(occ), 6) AS mean_occupancy, round(avg(expd), 6) AS mean_occupancy_expected FROM ge JOIN eb USING (locality) GROUP BY 1, 2""")
def laws_by_environment_bins(spark, d):
    return _environment(spark, d, "bins")


@case("laws_by_environment_fit", f"{GE} SELECT locality, round(regr_slope(occ, expd), 6) AS slope, round(regr_intercept(occ, expd), 6) AS intercept, round(regr_r2(occ, expd), 6) AS r2, CAST(regr_count(occ, expd) AS BIGINT) AS n FROM ge GROUP BY 1")
def laws_by_environment_fit(spark, d):
    return _environment(spark, d, "fit")


@case("laws_by_environment_observed", f"{GE}, w AS (SELECT locality, CAST(trunc(occ * 20) AS BIGINT) AS b, count(*) AS n, avg(occ) AS mean, stddev_samp(occ) AS sd FROM ge GROUP BY 1, 2) SELECT locality, b, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(0.05::DOUBLE, 6) AS width, round(n / (sum(n) OVER (PARTITION BY locality)) * 20, 6) AS p FROM w")
def laws_by_environment_observed(spark, d):
    return _environment(spark, d, "observed")


@case("laws_by_environment_lognormal")
def laws_by_environment_lognormal(spark, d):
    return M.laws_by_environment(t.brand_counts(spark, d), t.covariates(spark, d), "locality")["lognormal"]


@case("laws_by_environment_predicted")
def laws_by_environment_predicted(spark, d):
    return M.laws_by_environment(t.brand_counts(spark, d), t.covariates(spark, d), "locality")["predicted"]


@case("column_clusters")
def column_clusters(spark, d):
    return O.column_clusters(t.brand_counts(spark, d), 3, 5)


@case("rank_abundance", f"{G} SELECT feature, round(ln(m), 6) AS log_mean, rank() OVER (ORDER BY round(ln(m), 9)) + (count(*) OVER (PARTITION BY round(ln(m), 9)) - 1) / 2.0::DOUBLE AS rank FROM gx WHERE m > 0")
def rank_abundance(spark, d):
    p = _params(spark, d).filter("mean_abundance > 0")
    # equal abundances differ in their last bits by the order of a sum; ranks see nine decimals
    tied = p.withColumn("mean_abundance", F.exp(F.round(F.log("mean_abundance"), 9)))
    return M.rank_abundance(tied).select("feature", "rank").join(
        p.select("feature", F.log("mean_abundance").alias("log_mean")), "feature")
