"""Macro-ecological laws of abundance and occupancy.

Zero cells count: a feature has one share per sample, so sums run over present cells and
means divide by the number of samples taken from the data. `by` adds an environment key.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.common import attach, dbl, finite, names, ratio, safe_log, with_group_stats
from ..plans.ranking import average_rank, row_index
from ..plans.scratch import written
from .aggregates import bin_equal, binned_density, weighted_density
from .inference import linear_trend
from .windows import rescale_log_share


def _depths(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.groupBy(*by, "sample").agg(F.sum("reads").cast("double").alias("_depth"))


def gamma_parameters(counts: DataFrame, by=()) -> DataFrame:
    """Mean and variance of shares, gamma shape and scale, occupancy per feature.

    The variance is mean(n(n-1) / (N(N-1))) - mean^2.
    """
    by = names(by)
    cells = counts.filter("reads > 0")
    depths = _depths(cells, by)
    size = depths.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("_samples"))
    n, big = dbl("reads"), F.col("_depth")
    sums = cells.join(depths, [*by, "sample"]).groupBy("feature", *by).agg(
        F.sum(n / big).alias("_p"), F.sum(F.try_divide(n * (n - 1), big * (big - 1))).alias("_q"),
        F.count(F.lit(1)).cast("double").alias("_seen"))
    m = F.col("_p") / F.col("_samples")
    v = F.col("_q") / F.col("_samples") - m * m
    out = attach(sums, size, by).select(
        "feature", *by, m.alias("mean_abundance"), v.alias("variance_abundance"),
        (F.col("_seen") / F.col("_samples")).alias("occupancy"))
    return out.withColumn("shape", ratio(F.col("mean_abundance") * F.col("mean_abundance"), "variance_abundance")).withColumn(
        "scale", ratio("mean_abundance", "variance_abundance"))


def expected_occupancy(counts: DataFrame, params: DataFrame, by=(), mean_of_powers: bool = False) -> DataFrame:
    """Occupancy expected from the gamma parameters.

    1 - (mean over samples of (1 + m N / shape))^(-shape). With `mean_of_powers` the mean
    is taken of the powers. The mean is linear in N, so the default needs only the mean
    depth; the option evaluates each distinct depth once.
    """
    by = names(by)
    depths = _depths(counts.filter("reads > 0"), by)
    base = F.col("mean_abundance") / F.col("shape")
    if not mean_of_powers:
        mean = depths.groupBy(*by).agg(F.avg("_depth").alias("_mean"))
        inner = 1 + base * F.col("_mean")
        value = F.when(inner > 0, F.lit(1.0) - F.pow(inner, -F.col("shape")))
        return attach(params, mean, by).withColumn("occupancy_expected", finite(value)).drop("_mean")
    params = written(params, "params")
    blocks, sizes = _depth_blocks(depths, by)
    chunks = max(1, -(-params.count() // ROWS))
    rows = attach(params.select("feature", *by, base.alias("_base"), dbl("shape").alias("_shape")).dropna(subset=["_base", "_shape"]), sizes, by).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))).alias("_block"), F.pmod(F.xxhash64("feature"), F.lit(chunks)).alias("_chunk"))
    each = blocks.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))))
    schema = T.StructType([rows.schema[c] for c in ("feature", *by, "_k")] + [T.StructField("_part", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def add_powers(own: pa.Table, block: pa.Table) -> pa.Table:
        if not own.num_rows or not block.num_rows:
            return arrow.empty_table()
        pairs = block["_d"].combine_chunks().flatten()
        depth, times = (pairs.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("_depth", "_c"))
        with np.errstate(all="ignore"):
            sums = [times @ (1 + m * depth) ** -shape for m, shape in zip(own["_base"].to_numpy(), own["_shape"].to_numpy())]
        return own.select(["feature", *by, "_k"]).append_column("_part", pa.array(sums, pa.float64())).cast(arrow)

    keys = [*by, "_block", "_chunk"]
    parts = rows.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInArrow(add_powers, schema)
    unseen = parts.groupBy("feature", *by).agg((F.sum("_part") / F.max("_k")).alias("_unseen"))
    return (params.join(unseen, ["feature", *by], "left")
            .withColumn("occupancy_expected", finite(F.lit(1.0) - F.col("_unseen"))).drop("_unseen"))


DEPTHS = 1024   # distinct depths that a row meets at once
ROWS = 20000    # rows that meet a block of depths in one group, about


def _depth_blocks(depths: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Written blocks of DEPTHS distinct sample depths, `_d` (depth, count); and per group the `_last` block and `_k` samples."""
    hist = depths.groupBy(*by, "_depth").agg(F.count(F.lit(1)).alias("_c"))
    placed = row_index(hist, "_depth", by, "_i").withColumn("_block", F.floor(F.col("_i") / DEPTHS))
    blocks = written(placed.groupBy(*by, "_block").agg(F.collect_list(F.struct("_depth", "_c")).alias("_d"), F.sum("_c").alias("_own")), "depths")
    return blocks.drop("_own"), blocks.groupBy(*by).agg(F.max("_block").alias("_last"), F.sum("_own").alias("_k"))


def _meet_depths(rows: DataFrame, depths: DataFrame, by: list[str]) -> DataFrame:
    """Each row once per block of DEPTHS distinct sample depths of its group: `_d` (depth, count) and `_k` samples.

    Rows go to the numbers of the blocks and meet them by an equi-join, so neither all depths of a
    group nor all its rows have to fit into one array.
    """
    blocks, sizes = _depth_blocks(depths, by)
    spread = attach(rows, sizes, by).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))))
    return spread.join(blocks, [*by, "_block"]).drop("_block", "_last")


def taylor_law(params: DataFrame, by=()) -> DataFrame:
    """Log variance on log mean; the law expects slope 2."""
    logs = params.select(*names(by), safe_log("mean_abundance").alias("lm"), safe_log("variance_abundance").alias("lv"))
    return linear_trend(logs.filter("lm IS NOT NULL AND lv IS NOT NULL"), "lm", "lv", by)


def occupancy_bins(params: DataFrame, nbin: int = 10, by=()) -> DataFrame:
    """Equal-width bins of observed occupancy with both means."""
    return bin_equal(params, "occupancy", nbin, by, ["occupancy", "occupancy_expected"])


def occupancy_fit(params: DataFrame, by=()) -> DataFrame:
    return linear_trend(params.filter("occupancy_expected IS NOT NULL"), "occupancy_expected", "occupancy", by)


def truncated_moments(params: DataFrame, counts: DataFrame, by=()) -> DataFrame:
    """Moments of log mean abundance above the detection cut-off.

    The cut-off is the smallest ln(number of samples / reads of a sample).
    """
    by = names(by)
    depths = _depths(counts.filter("reads > 0"), by)
    cut = depths.groupBy(*by).agg(F.log(F.count(F.lit(1)) / F.max("_depth")).alias("c"))
    x = F.col("_x")
    return (attach(params.withColumn("_x", safe_log("mean_abundance")), cut, by).filter(x > F.col("c"))
            .groupBy(*by).agg(F.max("c").alias("c"), F.avg(x).alias("m1"), F.avg(x * x).alias("m2"),
                              F.count_distinct("feature").alias("n_observed"), F.sum("mean_abundance").alias("sum_mean"),
                              F.avg("shape").alias("mean_shape"), F.avg("scale").alias("mean_scale")))


def _solve_mu(c: float, m1: float, m2: float, tol: float = 1e-10):
    """Location of the truncated lognormal by bisection, or None without a root or without moments.

    The location lies below the one at which the spread vanishes. The bracket starts one
    standard deviation of the moments under it and doubles until the sign changes.
    """
    if not all(v is not None and math.isfinite(v) for v in (c, m1, m2)):
        return None            # no feature above the cut-off: comparisons with NaN would never end

    def f(mu):
        s = math.sqrt(m2 - c * m1 + (c - m1) * mu)
        x = (c - mu) / s / math.sqrt(2.0)
        return (mu - m1) * math.erfc(x) + math.exp(-x * x) * math.sqrt(2.0 / math.pi) * s

    unit = math.sqrt(max(m2 - m1 * m1, 0.0))
    if c >= m1 or unit == 0.0:
        return None
    top = (c * m1 - m2) / (c - m1)
    high = top - 1e-9 * max(1.0, abs(top))
    sign, step = f(high) < 0, unit
    while (f(high - step) < 0) == sign:
        step *= 2
        if math.erfc((c - high + step) / math.sqrt(2.0 * (m2 - c * m1 + (c - m1) * (high - step)))) == 0.0:
            return None        # the mass above the cut-off has gone, and with it the equation
    low = high - step
    while high - low > tol * max(1.0, abs(low)):
        mid = (low + high) / 2
        if (f(mid) < 0) == sign:
            high = mid
        else:
            low = mid
    return (low + high) / 2


def estimate_lognormal(moments: DataFrame) -> DataFrame:
    """Location, spread, cut-off score and total species of the lognormal, one row per group."""
    def run(batches):
        for pdf in batches:
            mu, sigma, x, total = [], [], [], []
            for c, m1, m2, s in zip(pdf["c"], pdf["m1"], pdf["m2"], pdf["n_observed"]):
                m = _solve_mu(c, m1, m2)
                mu.append(m)
                if m is None:
                    sigma.append(None), x.append(None), total.append(None)
                    continue
                sd = math.sqrt(m2 - c * m1 + c * m - m1 * m)
                z = (c - m) / (math.sqrt(2.0) * sd)
                sigma.append(sd), x.append(z), total.append(2 * s / math.erfc(z))
            yield pdf.assign(mu=pd.Series(mu, index=pdf.index, dtype="float64"), sigma=pd.Series(sigma, index=pdf.index, dtype="float64"),
                             x=pd.Series(x, index=pdf.index, dtype="float64"), total_species=pd.Series(total, index=pdf.index, dtype="float64"))

    fields = ", ".join(f"{n} {t}" for n, t in moments.dtypes)
    out = moments.mapInPandas(run, f"{fields}, mu double, sigma double, x double, total_species double")
    return out.withColumns({c: finite(c) for c in ("mu", "sigma", "x", "total_species")})


def quantile_grid(fit: DataFrame, size: int = 200) -> DataFrame:
    """Latent log abundances at the mid-quantiles of the fitted normal."""
    from ..functions.special import norm_ppf

    grid = F.explode(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: (i - 0.5) / F.lit(float(size))))
    p = fit.withColumn("_p", grid)
    return p.withColumn("eta", F.col("mu") + F.col("sigma") * norm_ppf("_p")).drop("_p")


def predicted_occupancy_density(counts: DataFrame, grid: DataFrame, nbin: int = 20, by=()) -> DataFrame:
    """Density of occupancy expected over the latent grid.

    `grid` has eta and mean_shape. Each latent value gets its mean occupancy over samples
    and the weight 1 - prod(1 - occupancy); samples of equal depth are taken together.
    """
    by = names(by)
    points = grid.select(*by, "eta", F.col("mean_shape").alias("_b"))
    met = _meet_depths(points, _depths(counts.filter("reads > 0"), by), by)

    def total(term):
        log_p0 = lambda e: F.col("_b") * F.log(F.col("_b") / (F.col("_b") + e["_depth"] * F.exp("eta")))
        return F.aggregate("_d", F.lit(0.0), lambda acc, e: acc + e["_c"] * term(log_p0(e)))

    per = met.select(*by, "eta", "_k", total(lambda p: 1 - F.exp(p)).alias("_seen"), total(lambda p: p).alias("_log")).groupBy(*by, "eta").agg(
        (F.sum("_seen") / F.max("_k")).alias("occupancy"), (F.lit(1.0) - F.exp(F.sum("_log"))).alias("weight"))
    return weighted_density(per, "occupancy", "weight", nbin, by)


def observed_occupancy_density(params: DataFrame, nbin: int = 20, by=()) -> DataFrame:
    return binned_density(params, "occupancy", nbin, by, unit=True)


def abundance_fluctuation_density(counts: DataFrame, nbin: int = 20) -> DataFrame:
    """Density of rescaled log shares of the features present everywhere."""
    return binned_density(rescale_log_share(counts), "rescaled", nbin)


def mean_abundance_density(params: DataFrame, fit: DataFrame, nbin: int = 20, min_n: int = 10, margin: float = 0.15) -> DataFrame:
    """Binned log mean abundance, bins above the cut-off with more than `min_n` features."""
    logs = params.withColumn("log_mean", safe_log("mean_abundance"))
    bins = binned_density(logs, "log_mean", nbin)
    return (attach(bins, fit.select("c", "mu", "sigma"))
            .filter((F.col("n") > min_n) & (F.col("mean") > F.col("c") + margin))
            .withColumn("x_scaled", F.try_divide(F.col("mean") - F.col("mu"), F.sqrt(F.lit(2.0)) * F.col("sigma"))))


def laws_by_environment(counts: DataFrame, cov: DataFrame, environment: str, size: int = 200) -> dict[str, DataFrame]:
    """All laws with an environment of the sample as an extra key.

    The predicted density of occupancy is taken over `size` mid-quantiles of each environment's lognormal fit.
    """
    c = written(counts.join(cov.select("sample", environment), "sample"), "environment")
    params = written(expected_occupancy(c, gamma_parameters(c, environment), environment), "parameters")
    moments = truncated_moments(params, c, environment)
    fit = written(estimate_lognormal(moments), "lognormal")
    grid = quantile_grid(fit.filter("mu IS NOT NULL AND sigma IS NOT NULL"), size).select(environment, "eta", "mean_shape")
    return {"parameters": params, "taylor": taylor_law(params, environment),
            "bins": occupancy_bins(params, 10, environment), "fit": occupancy_fit(params, environment),
            "lognormal": fit, "observed": observed_occupancy_density(params, 20, environment),
            "predicted": predicted_occupancy_density(c, grid, 20, environment)}


def rank_abundance(params: DataFrame) -> DataFrame:
    """Log mean abundance and its average-tie rank, for the sorted curve."""
    logs = params.select("feature", safe_log("mean_abundance").alias("log_mean")).filter("log_mean IS NOT NULL")
    return average_rank(logs, "log_mean", name="rank")
