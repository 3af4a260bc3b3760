"""Alpha, beta and gamma diversity of count tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import attach, names, ratio, with_group_stats
from ..plans.pair_blocks import pair_moments, pair_spread, pair_sums, shared, shared_entropy, triple_sums


def _shares(counts: DataFrame, by=("sample",)) -> DataFrame:
    return (with_group_stats(counts.filter("reads > 0"), by, _n=F.sum("reads"))
            .withColumn("p", ratio("reads", "_n")).drop("_n"))


def hill_numbers(counts: DataFrame, by=("sample",), orders=(0, 1, 2)) -> DataFrame:
    """Hill numbers hill_<q>: richness, exp(entropy), 1/sum p^2, general (sum p^q)^(1/(1-q))."""
    aggs = []
    for q in orders:
        if q == 0:
            e = F.count(F.lit(1)).cast("double")
        elif q == 1:
            e = F.exp(-F.sum(F.col("p") * F.log("p")))
        else:
            e = F.pow(F.sum(F.pow("p", F.lit(float(q)))), F.lit(1.0 / (1.0 - q)))
        aggs.append(e.alias(f"hill_{str(q).replace('.', '_')}"))
    return _shares(counts, names(by)).groupBy(*names(by)).agg(*aggs)


def evenness(hill: DataFrame) -> DataFrame:
    return hill.select("*", ratio("hill_1", "hill_0").alias("evenness_1"),
                       ratio("hill_2", "hill_0").alias("evenness_2"))


def diversity_long(table: DataFrame, id_col: str = "sample") -> DataFrame:
    """All indices as (id, index, value)."""
    cols = [c for c in table.columns if c != id_col]
    typed = table.select(id_col, *[F.col(c).cast("double").alias(c) for c in cols])
    return typed.unpivot(id_col, cols, "index", "value")


def classic_indices(counts: DataFrame, by=("sample",)) -> DataFrame:
    """Shannon, Simpson, inverse Simpson, Pielou (NULL for a single feature), richness."""
    h = -F.sum(F.col("p") * F.log("p"))
    d = F.sum(F.col("p") * F.col("p"))
    n = F.count(F.lit(1))
    return _shares(counts, names(by)).groupBy(*names(by)).agg(
        n.alias("richness"), h.alias("shannon"), (F.lit(1.0) - d).alias("simpson"),
        (F.lit(1.0) / d).alias("inverse_simpson"), F.try_divide(h, F.log(n)).alias("pielou"))


def chao1(counts: DataFrame, by=("sample",)) -> DataFrame:
    """Observed richness and the bias-corrected estimate with singletons and doubletons."""
    r = F.col("reads")
    agg = counts.groupBy(*names(by)).agg(
        F.count_if(r > 0).alias("observed"), F.count_if(r == 1).alias("_f1"), F.count_if(r == 2).alias("_f2"))
    extra = F.col("_f1") * (F.col("_f1") - 1) / (2.0 * (F.col("_f2") + 1))
    return agg.withColumn("chao1", F.col("observed") + extra).drop("_f1", "_f2")


def diversity_table(counts: DataFrame, by=("sample",)) -> DataFrame:
    """Nine indices per sample from one aggregation."""
    by = names(by)
    h = -F.sum(F.col("p") * F.log("p"))
    d = F.sum(F.col("p") * F.col("p"))
    base = _shares(counts, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("richness"), h.alias("shannon"), d.alias("_d"))
    n = F.col("richness").cast("double")
    return base.select(
        *by, "richness", "shannon", (F.lit(1.0) - F.col("_d")).alias("simpson"),
        (F.lit(1.0) / F.col("_d")).alias("inverse_simpson"),
        F.try_divide(F.col("shannon"), F.log(n)).alias("pielou"),
        F.exp("shannon").alias("hill_1"), (F.lit(1.0) / F.col("_d")).alias("hill_2"),
        (F.exp("shannon") / n).alias("evenness_1"), (F.lit(1.0) / F.col("_d") / n).alias("evenness_2"))


def partition_diversity(counts: DataFrame, q: int = 0) -> DataFrame:
    """Alpha, gamma and beta = gamma / alpha over all samples with equal weights."""
    if q not in (0, 1):
        raise ValueError("q must be 0 or 1")
    shares = _shares(counts)
    one = hill_numbers(counts, orders=(q,))
    if q == 0:
        alpha = one.agg(F.avg("hill_0").alias("alpha"))
        gamma = shares.agg(F.count_distinct("feature").cast("double").alias("gamma"))
    else:
        alpha = one.agg(F.exp(F.avg(F.log("hill_1"))).alias("alpha"))
        n = one.agg(F.count(F.lit(1))).scalar()
        pooled = shares.groupBy("feature").agg((F.sum("p")).alias("_p")).withColumn("_p", F.col("_p") / n)
        gamma = pooled.agg(F.exp(-F.sum(F.col("_p") * F.log("_p"))).alias("gamma"))
    return attach(alpha, gamma).withColumn("beta", ratio("gamma", "alpha"))


def _beta_0(sums, a, b):
    return (a.n + b.n - sums) / ((a.n + b.n) / 2)


def _beta_1(sums, a, b):
    return 2.0 * np.exp(sums)


def pairwise_beta(counts: DataFrame, q: int = 0, within=(), name: str = "beta") -> DataFrame:
    """Beta diversity (1 to 2) of every pair of samples, (within, s1, s2, beta).

    q = 0 is size of union over mean size. For q = 1 the sample entropies cancel, leaving
    2 * exp(sum over shared features). Pairs that share nothing have beta 2.
    """
    if q not in (0, 1):
        raise ValueError("q must be 0 or 1")
    within = names(within)
    present = counts.filter("reads > 0")
    if q == 1:
        return pair_sums(_shares(present, [*within, "sample"]), "sample", "feature", "p", shared_entropy, within, out=name, finish=_beta_1)
    return pair_sums(present.dropna(subset=within) if within else present, "sample", "feature", "reads", shared, within, out=name, finish=_beta_0)


def pairwise_beta_spread(counts: DataFrame, rep: str, reps: int, q: int = 0, mean: str = "mean", sd: str = "sd") -> DataFrame:
    """Mean and sd of `pairwise_beta` over the replicates 1 to `reps` of `rep`, (s1, s2, mean, sd), added up where pairs are formed."""
    if q not in (0, 1):
        raise ValueError("q must be 0 or 1")
    present = counts.filter("reads > 0").dropna(subset=[rep])
    if q == 1:
        return pair_spread(_shares(present, [rep, "sample"]), "sample", "feature", "p", shared_entropy, _beta_1, rep, reps, mean, sd)
    return pair_spread(present, "sample", "feature", "reads", shared, _beta_0, rep, reps, mean, sd)


def pairwise_dissimilarity(pairs: DataFrame, q: int = 0) -> DataFrame:
    """1 - homogeneity for two samples: beta - 1 at q = 0, ln(beta) / ln 2 at q = 1."""
    d = F.col("beta") - 1 if q == 0 else F.log("beta") / F.log(F.lit(2.0))
    return pairs.withColumn("dissimilarity", d)


def same_site_beta(counts: DataFrame, q: int = 0, site: str = "site", method: str = "method") -> DataFrame:
    """Beta between the methods of one site, labelled `method x method`.

    The site is a key of the pair table, so only pairs of one site are ever formed.
    """
    cells = counts.select(site, F.col(method).alias("sample"), "feature", "reads")
    pairs = pairwise_beta(cells, q, within=[site])
    return pairs.select(site, F.concat_ws(" x ", "s1", "s2").alias("comparison"), "beta")


def beta_nci(observed: DataFrame, null: DataFrame, on=("s1", "s2")) -> DataFrame:
    """(observed - null mean) / null sd per pair, and whether it passes the lines at -2 and 2.

    `null` has a row per pair, or per key of `on`; a null of samples is sent to the pairs, which then stay where they are.
    """
    from .joins import beside_pairs

    on = names(on)
    joined = observed.join(null if "s2" in on and "s1" in on else beside_pairs(null), on)
    nci = F.try_divide(F.col("beta") - F.col("null_mean"), F.col("null_sd"))
    return joined.withColumn("nci", nci).withColumn(
        "outside", F.when(F.col("nci").isNotNull(), F.abs("nci") > 2))


def beta_by_group(pairs: DataFrame, groups: DataFrame, group: str, value: str = "beta",
                  key: str = "sample") -> DataFrame:
    """Values summarised within and between groups; group pairs are unordered."""
    out = pairs
    for end, g in (("s1", "_a"), ("s2", "_b")):
        out = out.join(groups.select(F.col(key).alias(end), F.col(group).alias(g)), end)
    return (out.select(F.least("_a", "_b").alias("group_1"), F.greatest("_a", "_b").alias("group_2"), value)
            .groupBy("group_1", "group_2")
            .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
            .withColumn("within", F.col("group_1") == F.col("group_2")))


def _beta_moments(counts: DataFrame, q: int, group: str | None = None, within=()) -> DataFrame:
    """Count, mean and variance of the pairwise beta by pair of groups, summed up where pairs are formed."""
    if q not in (0, 1):
        raise ValueError("q must be 0 or 1")
    present = counts.filter("reads > 0")
    if q == 1:
        return pair_moments(_shares(present, [*names(within), "sample"]), "sample", "feature", "p", shared_entropy, _beta_1, group, within)
    return pair_moments(present, "sample", "feature", "reads", shared, _beta_0, group, within)


def beta_within_and_between(counts: DataFrame, groups: DataFrame, group: str, q: int = 0, key: str = "sample") -> DataFrame:
    """`beta_by_group` of all pairs of samples, straight from the counts and without a table of pairs."""
    own = groups.select(F.col(key).alias("sample"), F.col(group).alias("_label")).dropDuplicates(["sample"])
    found = _beta_moments(counts.join(own, "sample"), q, "_label")
    return found.select("group_1", "group_2", "n", "mean", F.sqrt("variance").alias("sd"),
                        (F.col("group_1") == F.col("group_2")).alias("within"))


def mean_pairwise_beta(counts: DataFrame, q: int = 0, within=()) -> DataFrame:
    """`mean_beta` of all pairs of samples (per key of `within`), without a table of pairs."""
    return _beta_moments(counts, q, None, within).select(*names(within), F.col("mean").alias("mean_beta"))


def mean_phylo_distance(counts: DataFrame, distance: DataFrame, weighted: bool = True) -> DataFrame:
    """Mean feature distance between two samples, sum p_i q_j d_ij, for every pair.

    `distance` holds (f1, f2, d) with f1 < f2; what it lacks is 0. Both shares and the distances between
    them are multiplied tile by tile (`triple_sums`).
    """
    shares = _shares(counts)
    if not weighted:
        shares = with_group_stats(shares, "sample", _k=F.count(F.lit(1))).withColumn(
            "p", F.lit(1.0) / F.col("_k"))
    return triple_sums(shares, distance, "sample", "feature", "p", out="distance")


def mean_beta(pairs: DataFrame, by=(), value: str = "beta") -> DataFrame:
    return pairs.groupBy(*names(by)).agg(F.avg(value).alias(f"mean_{value}"))


def covariate_difference(pairs: DataFrame, cov: DataFrame, cols, value: str = "beta",
                         key: str = "sample") -> DataFrame:
    """abs(x1 - x2) of each covariate next to the pair value, long."""
    from .joins import decorate_pairs

    cols = names(cols)
    both = decorate_pairs(pairs, cov.select(key, *cols), key)
    diffs = both.select("s1", "s2", value, *[
        F.abs(F.col(f"{c}_1") - F.col(f"{c}_2")).cast("double").alias(c) for c in cols])
    return diffs.unpivot(["s1", "s2", value], cols, "covariate", "difference")


def diversity_vs_covariate(div: DataFrame, cov: DataFrame, indices, cols, key: str = "sample") -> DataFrame:
    """(key, index, value, covariate, x) for facets, with the trend of each facet."""
    from .inference import linear_trend

    long = diversity_long(div.select(key, *names(indices)), key)
    facts = cov.select(key, *[F.col(c).cast("double").alias(c) for c in names(cols)])
    x = facts.unpivot(key, names(cols), "covariate", "x")
    return linear_trend(long.join(x, key), "x", "value", by=["index", "covariate"])
