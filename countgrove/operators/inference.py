"""Two-group tests, multiple-test control, trends, associations, posterior summaries.

Dense semantics: a taxon has one value per sample of a group, absent cells being 0. The
zero block enters as one tied value with a count. Extra keys in `by` (comparison, variant,
rank) run many tests in one plan.

p-values of rank tests are asymptotic, with tie and continuity correction.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import attach, dbl, names, ratio, safe_log, with_group_stats
from ..functions.special import chi2_sf, norm_cdf, norm_sf2, student_sf2
from ..plans import permuted_tiles
from ..plans.pair_blocks import dot, pair_sums
from ..plans.permuted_tiles import indexed_pairs, n_relabellings, permuted_sums
from ..plans.ranking import (accumulate, accumulate_beside, average_rank, hashed_index, hist_quantiles, median_of,
                             row_index, step_up_adjust, value_counts)
from ..plans.scratch import written
from .counts import library_size

# ------------------------------------------------------------------ two-group tests


def group_sizes(samples: DataFrame, group: str = "group", by=(), labels: tuple | None = None) -> DataFrame:
    """One row (per `by`) with the two group labels in order and their sample counts.

    `labels` names the two groups; rows of other groups then take no part. Without it every
    key has its own two labels, and a key with one or with three and more groups is an error.
    """
    by = names(by)
    if labels is not None:
        samples = samples.filter(F.col(group).isin(*labels))
    per = samples.filter(F.col(group).isNotNull()).groupBy(*by, group).agg(F.count_distinct("sample").alias("_c"))
    if labels is not None:
        first, second = (F.lit(x) for x in labels)
        ends = (first, second, F.coalesce(F.sum(F.when(F.col(group) == first, F.col("_c"))), F.lit(0)),
                F.coalesce(F.sum(F.when(F.col(group) == second, F.col("_c"))), F.lit(0)))
        two = F.lit(2)
    else:
        ends = (F.min(group), F.max(group), F.min_by("_c", group), F.max_by("_c", group))
        two = F.count(F.lit(1))
    sizes = per.groupBy(*by).agg(two.alias("_groups"), *[
        e.alias(n) for e, n in zip(ends, ("group_1", "group_2", "n_1", "n_2"))])
    problem = F.concat(F.lit("a two-group test needs two groups, or labels; found "), F.col("_groups"))
    checked = F.when(F.col("_groups") == 2, F.col("n_1")).otherwise(F.raise_error(problem).cast("bigint"))
    return sizes.select(*by, "group_1", "group_2", checked.alias("n_1"), "n_2")


def _two_group_hist(values: DataFrame, sizes: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """(by, taxon, value, a, b, sizes): samples of each group with that value, zeros included."""
    scope = [c for c in by if c in sizes.columns]
    # one row per key: a join by these few keys would send all cells of a key to one task
    sizes = F.broadcast(sizes) if scope else sizes
    seen = attach(values.filter((F.col(value) != 0) & F.col(value).isNotNull()), sizes, scope)
    first, second = F.col(group) == F.col("group_1"), F.col(group) == F.col("group_2")
    keys = [*by, "taxon"]
    hist = written(seen.filter(first | second).groupBy(*keys, F.col(value).cast("double").alias("value")).agg(
        F.count_if(first).alias("a"), F.count_if(second).alias("b")), "histogram")
    zero = attach(hist.groupBy(*keys).agg(F.sum("a").alias("_a"), F.sum("b").alias("_b")), sizes, scope).select(
        *keys, F.lit(0.0).alias("value"), (F.col("n_1") - F.col("_a")).alias("a"), (F.col("n_2") - F.col("_b")).alias("b"))
    return hist.unionByName(zero).withColumn("_n", F.col("a") + F.col("b"))


def two_group_stats(values: DataFrame, sizes: DataFrame, value: str = "reads", group: str = "group", by=()) -> DataFrame:
    """Rank sum, ties, medians and means of both groups per taxon, from one ordered pass.

    The value counts of both groups are accumulated together, so the rank of a value and its
    place inside either group come from one table of ranges.
    """
    by = names(by)
    keys = [*by, "taxon"]
    acc = accumulate(_two_group_hist(values, sizes, value, group, by), "value", keys, ["_n", "a", "b"])
    n, v = dbl("_n"), F.col("value")

    def at(side, k):
        hit = (F.col(side) > 0) & (F.col(f"{side}_below") <= k) & (k < F.col(f"{side}_below") + F.col(side))
        return F.max(F.when(hit, v))

    aggs = [F.sum(F.col("a") * (F.col("_n_below") + (n + 1) / 2)).alias("_r"), F.sum(n * n * n - n).alias("_t")]
    for s, side in ((1, "a"), (2, "b")):
        last = F.col(f"{side}_total") - 1
        aggs += [((at(side, F.floor(last / 2)) + at(side, F.ceil(last / 2))) / 2).alias(f"median_{s}"),
                 ratio(F.sum(v * F.col(side)), F.sum(side)).alias(f"mean_{s}"), F.sum(side).cast("double").alias(f"_n{s}")]
    return acc.groupBy(*keys).agg(*aggs)


def _rank_test(stats: DataFrame) -> DataFrame:
    w = F.col("_r") - F.col("_n1") * (F.col("_n1") + 1) / 2
    total = F.col("_n1") + F.col("_n2")
    var = F.col("_n1") * F.col("_n2") / 12 * (total + 1 - F.try_divide(F.col("_t"), total * (total - 1)))
    out = stats.withColumn("w", w).withColumn("_d", F.col("w") - F.col("_n1") * F.col("_n2") / 2).withColumn(
        "z", F.when(var > 1e-9, (F.col("_d") - F.signum("_d") * 0.5) / F.sqrt(var)))
    return out.withColumn("p", F.least(F.lit(1.0), norm_sf2("z")))


def _contrast(stats: DataFrame) -> DataFrame:
    both_zero = (F.col("median_1") == 0) & (F.col("median_2") == 0)
    return stats.withColumns({
        "median_diff": F.col("median_1") - F.col("median_2"), "mean_diff": F.col("mean_1") - F.col("mean_2"),
        "log2_median_ratio": F.when(both_zero, F.lit(0.0)).otherwise(safe_log(ratio("median_1", "median_2"), "2"))})


def rank_sum_test(values: DataFrame, sizes: DataFrame, value: str = "reads", group: str = "group", by=()) -> DataFrame:
    """Two-group rank-sum test per taxon: statistic of group 1, z, two-sided p."""
    return _rank_test(two_group_stats(values, sizes, value, group, by)).select(*names(by), "taxon", "w", "z", "p")


def group_contrast(values: DataFrame, sizes: DataFrame, value: str = "reads", group: str = "group", by=()) -> DataFrame:
    """Difference of medians and means and log2 ratio of medians, group 1 against group 2.

    0 / 0 gives a log ratio of 0; a ratio with one zero median has no finite logarithm
    and is NULL.
    """
    return _contrast(two_group_stats(values, sizes, value, group, by)).select(
        *names(by), "taxon", "median_1", "median_2", "median_diff", "mean_diff", "log2_median_ratio")


def p_adjust_bh(df: DataFrame, p: str = "p", by=(), name: str = "p_adjusted") -> DataFrame:
    """Benjamini-Hochberg adjustment inside each `by` group; NULL p-values do not count."""
    return step_up_adjust(df, p, by, name)


def mask_not_significant(df: DataFrame, effects, p: str = "p_adjusted", level: float = 0.05) -> DataFrame:
    """Effects become 0 where p exceeds the level or is missing."""
    return df.withColumns({e: F.when(F.col(p) <= level, F.col(e)).otherwise(F.lit(0.0)) for e in names(effects)})


# ------------------------------------------------------------------ normalised counts


PLACES = 256   # of an order that are looked up together


def rle_size_factors(counts: DataFrame) -> DataFrame:
    """Relative-log-expression factors on reads + 1, scaled to geometric mean 1.

    The reference profile is the geometric mean of a feature over all samples. A sample's
    factor is the median over all features of its ratio to that profile, over its size.
    Absent cells all have ratio 1 / profile, so the median is found from one shared order
    of these values and, per sample, the few values its own cells take out and put in. Both
    are in one table of events, cut once by value.
    """
    cells = written(counts.filter("reads > 0").select("feature", "sample", "reads"), "cells")
    n_s = cells.agg(F.count_distinct("sample")).scalar()
    n_f = cells.agg(F.count_distinct("feature")).scalar()
    # Summed as decimals, which is exact: the profile has the same values wherever it is read.
    logs = F.sum(F.log(dbl("reads") + 1).cast("decimal(28,18)")).cast("double")
    profile = cells.groupBy("feature").agg(logs.alias("_l")).select("feature", F.exp(-F.col("_l") / n_s).alias("_g"))
    own = (cells.join(profile, "feature").select("sample", F.explode(F.array(
        F.struct(F.col("_g").alias("x"), F.lit(-1).alias("w")),
        F.struct(((dbl("reads") + 1) * F.col("_g")).alias("x"), F.lit(1).alias("w")))).alias("e"))
        .groupBy("sample", "e.x").agg(F.sum("e.w").alias("_w")).withColumns({"_own": F.lit(True), "_c": F.lit(0).cast("bigint")}))
    shared = profile.groupBy(F.col("_g").alias("x")).agg(F.count(F.lit(1)).alias("_c")).withColumns(
        {"_own": F.lit(False), "_w": F.lit(0).cast("bigint"), "sample": F.lit(None).cast(cells.schema["sample"].dataType)})
    order = accumulate_beside(own.unionByName(shared), "x", "sample", "_w", "_c")
    at = F.col("_c_below") + F.col("_w_below")
    ev = order.filter("_own").select("sample", "x", at.alias("_at"), (F.col("_c_here") + F.col("_w")).alias("_mult"),
                                     (F.col("_w_below") + F.col("_w")).alias("_carry"))

    picks = []
    for i, k in enumerate((F.floor((n_f - 1) / 2), F.ceil((n_f - 1) / 2))):
        hit = (F.col("_at") <= k) & (k < F.col("_at") + F.col("_mult"))
        past = F.col("_at") + F.col("_mult") <= k
        picks += [F.max(F.when(hit, F.col("x"))).alias(f"_hit{i}"),
                  F.coalesce(F.max_by("_carry", F.when(past, F.col("x"))), F.lit(0)).alias(f"_c{i}"),
                  F.max(k).alias(f"_k{i}")]
    found = ev.groupBy("sample").agg(*picks)
    # Values of the shared order by place: a place meets the few values of its block.
    spans = order.filter("NOT _own").select("x", F.col("_c_below").alias("_from"), (F.col("_c_below") + F.col("_c")).alias("_until"))
    blocks = spans.withColumn("_block", F.explode(F.sequence(
        F.floor(F.col("_from") / PLACES), F.floor((F.col("_until") - 1) / PLACES))))
    far = [F.when(F.col(f"_hit{i}").isNull(), F.col(f"_k{i}") - F.col(f"_c{i}")) for i in (0, 1)]
    asked = found.withColumn("e", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), far[i].alias("r")) for i in (0, 1)]))).select(
        "sample", "_hit0", "_hit1", "e.*").withColumn("_asked", F.floor(F.col("r") / PLACES))
    met = asked.join(blocks, (F.col("_asked") == F.col("_block")) & (F.col("r") >= F.col("_from")) & (F.col("r") < F.col("_until")), "left")
    found = met.groupBy("sample").agg(*[
        F.coalesce(F.max(f"_hit{i}"), F.max(F.when(F.col("i") == i, F.col("x")))).alias(f"_m{i}") for i in (0, 1)])
    median = (F.col("_m0") + F.col("_m1")) / 2
    sizes = library_size(cells).withColumn("lib_size", F.col("depth") + n_f)
    raw = written(found.join(sizes, "sample").select("sample", "lib_size", (median / F.col("lib_size")).alias("_f")), "factor")
    scaled = with_group_stats(raw, [], _mean=F.avg(F.log("_f")))
    return scaled.select("sample", "lib_size", (F.col("_f") / F.exp("_mean")).alias("norm_factor"))


def _normalised(counts: DataFrame, factors: DataFrame, groups: DataFrame, group: str, scale, by: list[str]):
    """Dense per-group sums of (reads + 1) * k with k = scale / effective size, per feature.

    Keys of `by` come from the groups (comparisons) or from counts and factors (variants, ranks).
    """
    counts = written(counts.filter("reads > 0"), "counts")
    own = [k for k in by if k in counts.columns]
    eff = factors.join(groups, ["sample", *[k for k in by if k in factors.columns and k in groups.columns]]).withColumn(
        "_k", scale / (F.col("lib_size") * F.col("norm_factor")))
    base = eff.groupBy(*by, group).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum("_k").alias("_k1"), F.sum(F.col("_k") * F.col("_k")).alias("_k2"))
    x = dbl("reads")
    cells = counts.join(eff.select("sample", *by, group, "_k"), ["sample", *own]).groupBy("feature", *by, group).agg(
        F.sum(x * F.col("_k")).alias("_y1"),
        F.sum(((x + 1) * (x + 1) - 1) * F.col("_k") * F.col("_k")).alias("_y2"))
    features = counts.select("feature", *own).distinct()
    frame = (features.join(base, own) if own else
             features.select("feature", F.explode(base.agg(F.collect_list(F.struct(*base.columns))).scalar()).alias("_b"))
             .select("feature", "_b.*"))
    full = frame.join(cells, ["feature", *by, group], "left")
    return full.select("feature", *by, group, "_n",
                       (F.coalesce("_y1", F.lit(0.0)) + F.col("_k1")).alias("_s1"),
                       (F.coalesce("_y2", F.lit(0.0)) + F.col("_k2")).alias("_s2"))


def _by_side(df: DataFrame, groups: DataFrame, group: str, by: list[str], keys: list[str], cols, labels=None) -> DataFrame:
    """Columns of the two groups next to each other; labels are those of the key, or the given ones."""
    ends = groups.filter(F.col(group).isNotNull()).groupBy(*by).agg(
        F.min(group).alias("_low"), F.max(group).alias("_high"), F.count_distinct(group).alias("_groups"))
    if labels is not None:
        low, high = F.lit(labels[0]), F.lit(labels[1])
        side = df
    else:
        problem = F.concat(F.lit("two groups are compared, or labels given; found "), F.col("_groups"))
        side = attach(df, ends.select(*by, "_high", F.when(F.col("_groups") == 2, F.col("_low")).otherwise(
            F.raise_error(problem).cast(groups.schema[group].dataType)).alias("_low")), by)
        low, high = F.col("_low"), F.col("_high")
    aggs = [F.max(F.when(F.col(group) == end, F.col(c))).alias(f"{c}{s}") for c in cols for s, end in ((1, low), (2, high))]
    return side.groupBy(*keys).agg(*aggs)


def log_fc_cpm(counts: DataFrame, factors: DataFrame, groups: DataFrame, group: str = "group", by=(),
               labels: tuple | None = None) -> DataFrame:
    """log2 fold change (second group over first) and mean log2 counts per million, for every key of `by`."""
    by = names(by)
    y = _normalised(counts, factors, groups, group, F.lit(1e6), by)
    flat = _by_side(y, groups, group, [k for k in by if k in groups.columns], ["feature", *by], ["_s1", "_n"], labels)
    m1, m2 = F.col("_s11") / F.col("_n1"), F.col("_s12") / F.col("_n2")
    return flat.select("feature", *by, (F.log2(m2) - F.log2(m1)).alias("log_fc"),
                       F.log2((F.col("_s11") + F.col("_s12")) / (F.col("_n1") + F.col("_n2"))).alias("log_cpm"))


PRIOR_DF = 10.0


def nb_two_group_test(counts: DataFrame, factors: DataFrame, groups: DataFrame, group: str = "group", by=(),
                      labels: tuple | None = None) -> DataFrame:
    """Negative-binomial two-group test per feature with shrunken dispersion, for every key of `by`.

    Moment dispersions are shrunk to the common value of the key (prior worth PRIOR_DF degrees
    of freedom); a Wald statistic tests the log fold change. Not the conditional exact test.
    Keys that `factors` has and `groups` has not (variants, ranks) are scaled to their own mean size.
    """
    by = names(by)
    own = [k for k in by if k in factors.columns and k not in groups.columns]
    size = F.avg(F.col("lib_size") * F.col("norm_factor")).alias("_mean_size")
    scaled = attach(factors, factors.groupBy(*own).agg(size) if own else factors.agg(size), own)
    y = _normalised(counts, scaled, groups, group, F.col("_mean_size"), by)
    flat = _by_side(y, groups, group, [k for k in by if k in groups.columns], ["feature", *by], ["_s1", "_s2", "_n"], labels)
    n1, n2 = F.col("_n1"), F.col("_n2")
    ss = (F.col("_s21") - F.col("_s11") * F.col("_s11") / n1) + (F.col("_s22") - F.col("_s12") * F.col("_s12") / n2)
    df = n1 + n2 - 2
    m = (F.col("_s11") + F.col("_s12")) / (n1 + n2)
    rows = flat.select("feature", *by, n1.alias("_n1"), n2.alias("_n2"), df.alias("_df"), m.alias("_m"),
                       (F.col("_s11") / n1).alias("_a"), (F.col("_s12") / n2).alias("_b"),
                       F.try_divide(ss, df).alias("_v"))
    own = rows.withColumn("_phi", F.greatest(F.lit(0.0), F.try_divide(F.col("_v") - F.col("_m"), F.col("_m") * F.col("_m"))))
    common = with_group_stats(own, by, dispersion_common=F.avg("_phi"))
    phi = (F.lit(PRIOR_DF) * F.col("dispersion_common") + F.col("_df") * F.col("_phi")) / (F.lit(PRIOR_DF) + F.col("_df"))
    var = (F.lit(1.0) / F.col("_a") + F.col("dispersion")) / F.col("_n1") + (
        F.lit(1.0) / F.col("_b") + F.col("dispersion")) / F.col("_n2")
    tested = common.withColumn("dispersion", phi).withColumn("log_fc", F.log2(F.col("_b") / F.col("_a"))).withColumn(
        "z", F.log(F.col("_b") / F.col("_a")) / F.sqrt(var)).withColumn("p", norm_sf2("z"))
    return p_adjust_bh(tested.select("feature", *by, "log_fc", "dispersion", "z", "p"), "p", by, name="fdr")


def zero_inflated_contrast(counts: DataFrame, groups: DataFrame, group: str = "group", by=(),
                           labels: tuple | None = None) -> DataFrame:
    """Detection and abundance contrast of two groups per taxon.

    Counts are scaled by sample size over the median size. Detection is the share of
    samples with reads; `beta` the difference of mean log scaled counts among detections
    (second group over first) with its standard error and z. Keys of `by` come from the groups
    (comparisons) or from the counts (variants, ranks), which are scaled each by itself.
    """
    by = names(by)
    own = [k for k in by if k in counts.columns]
    there = [k for k in by if k not in own]
    counts = written(counts, "counts")
    sizes = counts.groupBy("sample", *own).agg(F.sum("reads").alias("depth"))
    sf = attach(sizes, median_of(sizes, "depth", own, "_med"), own).select("sample", *own, ratio("depth", "_med").alias("_sf"))
    n = groups.groupBy(*there, group).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    cells = (counts.filter("reads > 0").join(sf, ["sample", *own]).join(groups, "sample")
             .withColumn("_y", F.log(F.col("reads") / F.col("_sf"))))
    per = cells.groupBy("feature", *by, group).agg(
        F.count(F.lit(1)).cast("double").alias("_k"), F.avg("_y").alias("_m"), F.var_samp("_y").alias("_v"))
    per = per.join(n, [*there, group])
    flat = _by_side(per, groups, group, there, ["feature", *by], ["_k", "_m", "_v", "_n"], labels)
    se = F.sqrt(F.col("_v1") / F.col("_k1") + F.col("_v2") / F.col("_k2"))
    out = flat.select(
        "feature", *by, F.coalesce(ratio("_k1", "_n1"), F.lit(0.0)).alias("detection_1"),
        F.coalesce(ratio("_k2", "_n2"), F.lit(0.0)).alias("detection_2"),
        (F.col("_m2") - F.col("_m1")).alias("beta"), se.alias("se"))
    return (out.withColumn("detection_ratio", ratio("detection_2", "detection_1"))
            .withColumn("z", F.try_divide(F.col("beta"), F.col("se"))).withColumn("p", norm_sf2("z")))


def contrast_grid(values: DataFrame, sizes: DataFrame, by, level: float = 0.05) -> DataFrame:
    """Rank-sum test, contrast, adjustment and masking for every key of `by`, from one ordered pass.

    `contrast_suite` runs several tests on several variants of the counts.
    """
    by = names(by)
    stats = _contrast(_rank_test(two_group_stats(values, sizes, by=by))).select(
        *by, "taxon", "w", "z", "p", "median_1", "median_2", "median_diff", "mean_diff", "log2_median_ratio")
    test = p_adjust_bh(written(stats, "tests"), "p", by)
    return mask_not_significant(test, ["median_diff", "mean_diff", "log2_median_ratio"], level=level)


def _suite_rank_sum(counts: DataFrame, factors, groups: DataFrame, by: list[str]) -> DataFrame:
    """The contrast of means, turned as the other tests are: second group against first."""
    values = counts.withColumnRenamed("feature", "taxon").join(groups, "sample")
    sizes = group_sizes(groups, by=[k for k in by if k in groups.columns])
    stats = _contrast(_rank_test(two_group_stats(values, sizes, by=by)))
    return stats.select(*by, F.col("taxon").alias("feature"), (-F.col("mean_diff")).alias("effect"), (-F.col("z")).alias("z"), "p")


def _suite_nb(counts: DataFrame, factors: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    return nb_two_group_test(counts, factors, groups, by=by).select(*by, "feature", F.col("log_fc").alias("effect"), "z", "p")


def _suite_zero_inflated(counts: DataFrame, factors, groups: DataFrame, by: list[str]) -> DataFrame:
    return zero_inflated_contrast(counts, groups, by=by).select(*by, "feature", F.col("beta").alias("effect"), "z", "p")


SUITE = {"rank_sum": _suite_rank_sum, "negative_binomial": _suite_nb, "zero_inflated": _suite_zero_inflated}


def contrast_suite(tables: dict[str, DataFrame], groups: DataFrame, comparisons=(), tests=tuple(SUITE),
                   level: float = 0.05) -> DataFrame:
    """(comparisons, variant, test, feature, effect, z, p, p_adjusted, kept): all tests of all variants at once.

    `tables` names variants of the counts (raw, rarefied, ranks of the lineage), each with (feature,
    sample, reads); `groups` holds (sample, group) per key of `comparisons`. Every test runs once
    for all variants and comparisons. Effects are those of the second group against the first:
    difference of means, log2 fold change, difference of mean logs. p-values are adjusted inside a
    comparison, variant and test; `kept` is the effect where the adjusted one is at most `level`, else 0.
    Size factors are found per variant, and only where a test needs them.
    """
    unknown = set(tests) - set(SUITE)
    if unknown or not tables or not tests:
        raise ValueError(f"tables and tests of {sorted(SUITE)} are needed; unknown: {sorted(unknown)}")
    by = [*names(comparisons), "variant"]
    parts = [df.filter("reads > 0").select("feature", "sample", "reads", F.lit(name).alias("variant")) for name, df in tables.items()]
    counts = written(reduce(DataFrame.unionByName, parts), "variants")
    groups = written(groups, "groups")   # each test reads them several times
    factors = None
    if "negative_binomial" in tests:
        factors = written(reduce(DataFrame.unionByName, [
            rle_size_factors(counts.filter(F.col("variant") == name).drop("variant")).withColumn("variant", F.lit(name))
            for name in tables]), "factors")
    runs = [SUITE[test](counts, factors, groups, by).withColumn("test", F.lit(test)) for test in tests]
    tested = p_adjust_bh(written(reduce(DataFrame.unionByName, runs), "tests"), "p", [*by, "test"])
    kept = mask_not_significant(tested.withColumn("kept", F.col("effect")), ["kept"], level=level)
    return kept.select(*by, "test", "feature", "effect", "z", "p", "p_adjusted", "kept")


# ------------------------------------------------------------------ trends, correlation


def linear_trend(df: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """Least-squares line per group."""
    return df.groupBy(*names(by)).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def mean_variance_power_law(moments: DataFrame, by="method", floor: float = 1.0) -> DataFrame:
    """log10 variance on log10 mean per method, for means and variances above the floor."""
    kept = moments.filter((F.col("mean") > floor) & (F.col("variance") > floor))
    logs = kept.select(*names(by), F.log10("mean").alias("lm"), F.log10("variance").alias("lv"))
    return linear_trend(logs, "lm", "lv", by)


def correlation_matrix(df: DataFrame, cols, method: str = "pearson") -> DataFrame:
    """Correlation of every column pair as (c1, c2, r, n); rows with a NULL are left out.

    Spearman ranks all columns in one ordered pass over (column, value).
    """
    cols = sorted(names(cols))
    if method not in ("pearson", "spearman"):
        raise ValueError("method must be 'pearson' or 'spearman'")
    data = df.dropna(subset=cols)
    if method == "spearman":
        numbered = written(data.select(*cols, F.monotonically_increasing_id().alias("_row")), "rows")
        ranked = average_rank(numbered.unpivot("_row", cols, "_column", "_value"), "_value", "_column", "_rank")
        data = ranked.groupBy("_row").agg(*[F.max(F.when(F.col("_column") == c, F.col("_rank"))).alias(c) for c in cols])
    pairs = list(combinations(cols, 2))
    one = data.agg(F.count(F.lit(1)).alias("n"),
                   *[F.corr(dbl(a), dbl(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("c1"), F.lit(b).alias("c2"), F.col(f"r{i}").alias("r"))
                     for i, (a, b) in enumerate(pairs)])
    return one.select("n", F.explode(rows).alias("e")).select("e.c1", "e.c2", "e.r", "n")


def row_correlation(cells: DataFrame, row: str = "sample", inner: str = "feature", value: str = "reads",
                    method: str = "pearson") -> DataFrame:
    """Correlation of every pair of rows of a sparse non-negative matrix, absent cells being 0.

    Spearman ranks are taken relative to the rank of the zero block, which keeps them sparse.
    """
    x = written(cells.filter(F.col(value) > 0).select(row, inner, dbl(value).alias("_x")), "positive")
    n = float(x.agg(F.count_distinct(inner)).first()[0])
    if method == "spearman":
        ranked = with_group_stats(average_rank(x, "_x", row, "_r"), row, _k=F.count(F.lit(1)))
        zeros = n - F.col("_k")
        above = F.col("_r") + zeros - (zeros + 1) / 2
        x = ranked.select(row, inner, F.when(zeros > 0, above).otherwise(F.col("_r")).alias("_x"))
    elif method != "pearson":
        raise ValueError("method must be 'pearson' or 'spearman'")
    def correlation(xy, a, b):
        spread = (n * a.q - a.s * a.s) * (n * b.q - b.s * b.s)
        return np.divide(n * xy - a.s * b.s, np.sqrt(np.maximum(spread, 0.0)), out=np.full(xy.shape, np.nan), where=spread > 0)

    return pair_sums(x, row, inner, "_x", dot, out="r", finish=correlation)


def correlation_pvalue(df: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    """t statistic of r with n - 2 degrees of freedom and its two-sided p."""
    t = F.col(r) * F.sqrt(F.try_divide(dbl(n) - 2, F.lit(1.0) - F.col(r) * F.col(r)))
    return df.withColumn("t", t).withColumn("p", student_sf2("t", dbl(n) - 2))


def _rank_groups(df: DataFrame, value: str, group: str, by: list[str]):
    """Rank sums per group with N and the tie sum, from value counts."""
    cells = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*by, value, group).agg(
        F.count(F.lit(1)).alias("_c"))
    hist = cells.groupBy(*by, value).agg(F.sum("_c").alias("_n"))
    acc = accumulate(hist, value, by)
    n = dbl("_n")
    ranks = acc.select(*by, value, (F.col("_n_below") + (n + 1) / 2).alias("_rank"))
    ties = acc.groupBy(*by).agg(F.sum(n * n * n - n).alias("_ties"), F.sum("_n").cast("double").alias("_total"))
    groups = cells.join(ranks, [*by, value]).groupBy(*by, group).agg(
        F.sum("_c").cast("double").alias("_k"), F.sum(F.col("_c") * F.col("_rank")).alias("_sum"))
    return attach(groups, ties, by)


def kruskal_wallis(df: DataFrame, value: str, group: str, by=()) -> DataFrame:
    """H with tie correction, degrees of freedom and p, per response."""
    by = names(by)
    g = _rank_groups(df, value, group, by)
    rows = g.groupBy(*by).agg(F.sum(F.col("_sum") * F.col("_sum") / F.col("_k")).alias("_q"),
                              F.max("_total").alias("_t"), F.max("_ties").alias("_ties"),
                              (F.count(F.lit(1)) - 1).alias("df"))
    t = F.col("_t")
    h = (F.lit(12.0) / (t * (t + 1)) * F.col("_q") - 3 * (t + 1))
    fix = F.lit(1.0) - F.try_divide(F.col("_ties"), t * t * t - t)
    return (rows.withColumn("h", F.try_divide(h, fix)).select(*by, "h", "df")
            .withColumn("p", F.when(F.col("h").isNotNull(), chi2_sf("h", F.col("df")))))


def dunn_posthoc(df: DataFrame, value: str, group: str, by=()) -> DataFrame:
    """z of the mean rank difference for every pair of levels, two-sided p and its adjustment."""
    by = names(by)
    g = _rank_groups(df, value, group, by).withColumn("_mean", F.col("_sum") / F.col("_k"))
    a = g.select(*by, F.col(group).alias("g1"), F.col("_mean").alias("_m1"), F.col("_k").alias("_k1"), "_total", "_ties")
    b = g.select(*by, F.col(group).alias("g2"), F.col("_mean").alias("_m2"), F.col("_k").alias("_k2"))
    levels = g.select(group).distinct().agg(F.sort_array(F.collect_set(group))).scalar()
    # The result is one row per pair of levels: each level meets the later ones by key.
    wide = a.withColumn("_levels", levels).withColumn(
        "g2", F.explode(F.filter("_levels", lambda v: v > F.col("g1")))).drop("_levels")
    pairs = wide.join(b, [*by, "g2"])
    t = F.col("_total")
    var = (t * (t + 1) / 12 - F.col("_ties") / (F.lit(12.0) * (t - 1))) * (
        F.lit(1.0) / F.col("_k1") + F.lit(1.0) / F.col("_k2"))
    rows = pairs.withColumn("z", (F.col("_m1") - F.col("_m2")) / F.sqrt(var)).withColumn("p", norm_sf2("z"))
    return p_adjust_bh(rows.select(*by, "g1", "g2", "z", "p"), "p", by)


def yates_cooccurrence(a: DataFrame, b: DataFrame, n_sites: int | None = None) -> DataFrame:
    """2x2 presence table of each feature between two methods over the sites of either.

    `a` and `b` hold (feature, sample, reads). Yates-corrected chi-square and expected
    number of joint occurrences.
    """
    pa = a.filter("reads > 0").select("feature", "sample", F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    pb = b.filter("reads > 0").select("feature", "sample", F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    cell = pa.unionByName(pb).groupBy("feature", "sample").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    n = (F.lit(n_sites) if n_sites is not None
         else cell.agg(F.count_distinct("sample")).scalar())
    both = (F.col("_a") == 1) & (F.col("_b") == 1)
    rows = cell.groupBy("feature").agg(
        F.count_if(both).alias("both"), F.count_if((F.col("_a") == 1) & (F.col("_b") == 0)).alias("only_1"),
        F.count_if((F.col("_a") == 0) & (F.col("_b") == 1)).alias("only_2"))
    rows = rows.withColumn("neither", n - F.col("both") - F.col("only_1") - F.col("only_2"))
    p, q, r, s = (dbl(c) for c in ("both", "only_1", "only_2", "neither"))
    total = p + q + r + s
    gap = F.greatest(F.abs(p * s - q * r) - total / 2, F.lit(0.0))
    chi = F.try_divide(total * gap * gap, (p + q) * (r + s) * (p + r) * (q + s))
    return rows.withColumn("expected", (p + q) * (p + r) / total).withColumn("chi2", chi)


def nmi(df: DataFrame, a: str, b: str, variant: str = "max") -> DataFrame:
    """Normalised mutual information of two labelings; `variant` names the denominator."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("_n"))
    total = cells.agg(F.sum("_n").cast("double")).scalar()

    def entropy(keys):
        t = cells.groupBy(*keys).agg(F.sum("_n").alias("_c")).withColumn("_p", F.col("_c") / total)
        return t.agg(-F.sum(F.col("_p") * F.log("_p"))).scalar()

    one = cells.agg(F.count(F.lit(1)).alias("n_cells")).select(
        entropy([a]).alias("_ha"), entropy([b]).alias("_hb"), entropy([a, b]).alias("_hab"))
    mi = F.col("_ha") + F.col("_hb") - F.col("_hab")
    dens = {"max": F.greatest("_ha", "_hb"), "min": F.least("_ha", "_hb"), "sum": (F.col("_ha") + F.col("_hb")) / 2,
            "sqrt": F.sqrt(F.col("_ha") * F.col("_hb")), "joint": F.col("_hab")}
    if variant not in dens:
        raise ValueError(f"variant must be one of {sorted(dens)}")
    return one.select(mi.alias("mutual_information"), F.try_divide(mi, dens[variant]).alias("nmi"))


# ------------------------------------------------------------------ distance tables


def mantel_statistic(a: DataFrame, b: DataFrame, method: str = "spearman") -> DataFrame:
    """Correlation of two pair tables (s1, s2, value)."""
    j = a.select("s1", "s2", F.col("value").alias("x")).join(b.select("s1", "s2", F.col("value").alias("y")).hint("merge"), ["s1", "s2"])
    if method == "spearman":
        j = average_rank(average_rank(j, "x", name="rx"), "y", name="ry").select(
            F.col("rx").alias("x"), F.col("ry").alias("y"))
    return j.agg(F.corr(dbl("x"), dbl("y")).alias("r"), F.count(F.lit(1)).alias("n_pairs"))


def _correlation(n, x, y, xx, yy, xy) -> Column:
    """Correlation from the sums of centred values; NULL where one side does not vary."""
    return F.try_divide(xy - x * y / n, F.sqrt(F.greatest(xx - x * x / n, F.lit(0.0))) * F.sqrt(F.greatest(yy - y * y / n, F.lit(0.0))))


def _centred_values(t: DataFrame, method: str) -> DataFrame:
    """(i, j, v): ranks or values less their mean, so that sums of products lose no digits."""
    if method not in ("spearman", "pearson"):
        raise ValueError("method must be spearman or pearson")
    if method == "spearman":   # the mean of N ranks is (N + 1) / 2
        return average_rank(t, "v", name="_r", total="_N").select("i", "j", (F.col("_r") - (F.col("_N") + 1) / 2).alias("v"))
    t = written(t.select("i", "j", dbl("v").alias("v")), "values")
    return t.select("i", "j", (F.col("v") - t.agg(F.avg("v")).scalar()).alias("v"))


def mantel(a: DataFrame, b: DataFrame, method: str = "spearman", n_perm: int = 9999, seed: int = 1,
           block: int = permuted_tiles.BLOCK) -> DataFrame:
    """Mantel statistic with permutation p = (1 + #{r* >= r}) / (1 + n_perm).

    The tables (s1, s2, value) are compared on the samples that both have; pairs that one of them
    lacks are left out. Ranks do not change when samples of `b` change places, so values are ranked
    once. If the samples have no more orders than `n_perm`, each order is taken once, p is exact and
    `n_perm` tells their number less one. Tables without variation have r and p NULL; without pairs, n_perm 0.
    """
    sides = [t.select("s1", "s2", F.col("value").alias("v")) for t in (written(a, "pairs"), written(b, "pairs"))]
    (x, y), n = indexed_pairs(sides)
    times, every = n_relabellings(n, n_perm)
    sums = permuted_sums(_centred_values(x, method), _centred_values(y, method), n, times, every, seed, block=block)
    r = sums.select("rep", _correlation(*map(F.col, ("n", "x", "y", "xx", "yy", "xy"))).alias("r"))
    out = with_group_stats(r, [], _obs=F.max(F.when(F.col("rep") == 0, F.col("r"))))
    hits = F.count_if((F.col("rep") > 0) & (F.col("r") >= F.col("_obs") - 1e-12))
    return out.agg(F.max("_obs").alias("r"), F.when(F.max("_obs").isNotNull(), (hits + 1) / F.lit(times + 1.0)).alias("p"),
                   F.lit(times).alias("n_perm"))


def mantel_correlogram(d: DataFrame, geo: DataFrame, n_class: int | None = None, n_perm: int = 0, seed: int = 1,
                       block: int = permuted_tiles.BLOCK) -> DataFrame:
    """Mantel statistic of ranked values against membership in each distance class.

    Classes are equal in width; their number follows Sturges' rule by default. The sign is
    turned, so positive means that pairs of the class are alike. With `n_perm` relabellings (all
    orders of the samples, if they are no more) each class has a p on the side of its statistic, and
    `p_adjusted`: Holm's correction over the classes up to it, in order of distance.
    """
    j = d.select("s1", "s2", F.col("value").alias("x")).join(
        geo.select("s1", "s2", F.col("value").alias("g")).hint("merge"), ["s1", "s2"])
    ranked = written(average_rank(j, "x", name="_r").select("s1", "s2", "_r", "g"), "ranked")
    facts = with_group_stats(ranked, [], _lo=F.min("g"), _hi=F.max("g"), _n=F.count(F.lit(1)), _s=F.sum("_r"),
                             _q=F.sum(F.col("_r") * F.col("_r")))
    k = F.lit(n_class) if n_class is not None else F.ceil(F.log2(F.col("_n")) + 1)
    cls = F.least(F.try_divide(F.col("g") - F.col("_lo"), (F.col("_hi") - F.col("_lo")) / k).cast("int"), k - 1)
    classed = facts.withColumn("class", cls.cast("bigint"))
    rows = classed.groupBy("class").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("g").alias("mean_distance"), F.sum("_r").alias("_in"),
        F.max("_n").cast("double").alias("_n"), F.max("_s").alias("_s"), F.max("_q").alias("_q"))
    m = dbl("n_pairs")
    cov = F.col("_n") * F.col("_in") - m * F.col("_s")
    spread = (F.col("_n") * F.col("_q") - F.col("_s") * F.col("_s")) * (F.col("_n") * m - m * m)
    table = rows.select("class", "n_pairs", "mean_distance", (-F.try_divide(cov, F.sqrt(spread))).alias("r"))
    if not n_perm:
        return table
    sides = [classed.select("s1", "s2", F.col(c).alias("v")) for c in ("_r", "class")]
    (x, y), n = indexed_pairs(sides)
    times, every = n_relabellings(n, n_perm)
    sums = permuted_sums(_centred_values(x, "pearson"), y, n, times, every, seed, classes=True, block=block)
    whole = sums.groupBy("rep").agg(*[F.sum(c).alias(f"_{c}") for c in ("n", "x", "xx")])
    inside = F.col("n")
    each = attach(sums, whole, "rep").select("rep", "class", (-_correlation(
        F.col("_n"), F.col("_x"), inside, F.col("_xx"), inside, F.col("x"))).alias("r"))
    observed = attach(each, each.filter("rep = 0").select("class", F.col("r").alias("_obs")), "class").filter("rep > 0")
    side = F.signum("_obs")
    hits = observed.groupBy("class").agg(F.count_if(side * F.col("r") >= side * F.col("_obs") - 1e-12).alias("_hits"))
    tested = table.join(hits, "class", "left").withColumn("p", F.when(
        F.col("r").isNotNull(), (F.coalesce("_hits", F.lit(0)) + 1) / F.lit(times + 1.0))).drop("_hits")
    return _progressive_holm(tested)


def _progressive_holm(tested: DataFrame) -> DataFrame:
    """`p_adjusted`: the p of a class by Holm's step-down correction over it and the nearer classes.

    Classes are few (a Sturges count), so each meets the nearer ones.
    """
    p = tested.filter(F.col("p").isNotNull()).select(F.col("class").alias("c"), "p")
    family = p.withColumnsRenamed({"c": "of", "p": "_own"}).join(p, F.col("c") <= F.col("of"))
    order = Window.partitionBy("of").orderBy("p", "c")
    stepped = family.withColumn("_s", F.col("p") * (F.count(F.lit(1)).over(Window.partitionBy("of")) - F.row_number().over(order) + 1))
    running = stepped.withColumn("p_adjusted", F.least(F.lit(1.0), F.max("_s").over(order))).filter("c = of")
    return tested.join(running.select(F.col("of").alias("class"), "p_adjusted"), "class", "left")


# ------------------------------------------------------------------ screens, draws


def normality_screen(df: DataFrame, col: str) -> DataFrame:
    """Skewness, kurtosis and Jarque-Bera of raw, log1p and square-root values."""
    x = dbl(col)
    kinds = {"raw": x, "log1p": F.when(x > -1, F.log1p(x)), "sqrt": F.when(x >= 0, F.sqrt(x))}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("transform"), v.alias("v")) for k, v in kinds.items()])).alias("e")).select("e.*")
    rows = long.groupBy("transform").agg(F.skewness("v").alias("skewness"), F.kurtosis("v").alias("kurtosis"),
                                         F.count("v").alias("n"))
    return rows.withColumn("jarque_bera", dbl("n") / 6 * (
        F.col("skewness") * F.col("skewness") + F.col("kurtosis") * F.col("kurtosis") / 4))


def posterior_summary(draws: DataFrame, by="parameter", value: str = "value") -> DataFrame:
    """2.5, 50 and 97.5 % quantiles; `sign` when both limits have the same sign."""
    q = hist_quantiles(value_counts(draws, value, by), value, {"lower": 0.025, "median": 0.5, "upper": 0.975}, by)
    return q.withColumn("signif", F.when(F.signum("lower") == F.signum("upper"), "sign").otherwise("NS"))


def gelman_rubin(draws: DataFrame, by="parameter", limit: float = 1.2) -> DataFrame:
    """Potential scale reduction of several chains, cut to the shortest chain.

    The convergence rule is applied to the point estimate.
    """
    by = names(by)
    lengths = draws.groupBy(*by, "chain").agg(F.count(F.lit(1)).alias("_len"))
    shortest = lengths.groupBy(*by).agg(F.min("_len").alias("_n"))
    kept = attach(row_index(draws, "iteration", [*by, "chain"], "_i"), shortest, by).filter(F.col("_i") < F.col("_n"))
    chains = kept.groupBy(*by, "chain").agg(F.avg("value").alias("_m"), F.var_samp("value").alias("_v"),
                                            F.max("_n").cast("double").alias("_n"))
    rows = chains.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("m"), F.max("_n").alias("n"), F.avg("_v").alias("w"),
        F.var_samp("_m").alias("vm"), F.var_samp("_v").alias("vv"), F.avg("_m").alias("mu"),
        F.covar_samp("_v", F.col("_m") * F.col("_m")).alias("c2"), F.covar_samp("_v", "_m").alias("c1"))
    m, n, w = F.col("m"), F.col("n"), F.col("w")
    b = n * F.col("vm")
    v = (n - 1) * w / n + (1 + 1 / m) * b / n
    cov = n / m * (F.col("c2") - 2 * F.col("mu") * F.col("c1"))
    var_v = ((n - 1) * (n - 1) * F.col("vv") / m + (1 + 1 / m) * (1 + 1 / m) * 2 * b * b / (m - 1)
             + 2 * (n - 1) * (1 + 1 / m) * cov) / (n * n)
    dof = 2 * v * v / var_v
    r2 = (n - 1) / n + (1 + 1 / m) / n * b / w
    out = rows.withColumn("psrf", F.sqrt((dof + 3) / (dof + 1) * r2))
    return out.select(*by, "psrf", (F.col("psrf") < limit).alias("converged"))


def mask_effect(df: DataFrame, effect: str = "median", signif: str = "signif", converged: str = "converged") -> DataFrame:
    """0 unless significant and converged."""
    keep = (F.col(signif) == "sign") & F.col(converged)
    return df.withColumn("masked", F.when(keep, F.col(effect)).otherwise(F.lit(0.0)))


def normal_tail_score(draws: DataFrame, by="parameter", value: str = "value") -> DataFrame:
    """2 * min(P, 1 - P) of 0 under a normal with the mean and sd of the draws."""
    s = draws.groupBy(*names(by)).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    cdf = norm_cdf(F.try_divide(-F.col("mean"), F.col("sd")))
    return s.withColumn("score", F.lit(2.0) * F.least(cdf, F.lit(1.0) - cdf))
