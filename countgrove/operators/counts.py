"""Preparing long count tables (feature, sample, reads)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import attach, dbl, names, ratio, safe_log, with_group_stats
from ..functions.special import lgamma, norm_ppf
from ..plans.ranking import average_rank, median_of


def decontaminate(counts: DataFrame, is_control: Column) -> DataFrame:
    """Subtract the control reads of a feature from each of its true cells, floor 0.

    Controls leave the table. Cells that become 0 stay; features never seen in a true
    sample do not appear. Both sides of the join see all rows of `counts`, so an aggregated
    input is computed once and its shuffle is used twice: the control total is a conditional
    sum, and controls are left out by a condition that cannot move below the join.
    """
    reads = F.col("reads")
    control = counts.groupBy("feature").agg(
        F.coalesce(F.sum(F.when(is_control & (reads > 0), reads)), F.lit(0)).alias("_n"))
    both = counts.withColumn("_control", is_control).join(control, "feature")
    true_cells = both.filter((reads > 0) & (~F.col("_control") | (F.col("_n") < 0)))
    return true_cells.select("feature", "sample", F.greatest(reads - F.col("_n"), F.lit(0)).alias("reads"))


def library_size(counts: DataFrame) -> DataFrame:
    return counts.groupBy("sample").agg(F.sum("reads").alias("depth"))


def min_depth(counts: DataFrame) -> DataFrame:
    """One row with the smallest library size."""
    return library_size(counts).agg(F.min("depth").alias("min_depth"))


def rarefy_expected(counts: DataFrame, depth: int | None = None) -> DataFrame:
    """Limit of averaging many random subsamples: depth * reads / N, half-even rounded.

    Without `depth` the smallest library size is used. Samples at or below it stay as
    they are.
    """
    sizes = library_size(counts)
    target = (F.lit(depth) if depth is not None
              else sizes.agg(F.min("depth")).scalar())
    joined = attach(counts, sizes, "sample").withColumn("_d", target)
    scaled = F.bround(dbl("reads") * F.col("_d") / F.col("depth"), 0).cast("bigint")
    return joined.select("feature", "sample", F.when(
        F.col("depth") <= F.col("_d"), F.col("reads")).otherwise(scaled).alias("reads"))


GRID = 4096    # depths of a curve that are met at once


def rarefaction_curve(counts: DataFrame, step: int = 20) -> DataFrame:
    """Expected number of features at depths 1, 1+step, ... and at the full depth.

    Features with equal reads in a sample share one term, so cost follows the number of
    distinct counts and not the number of features. A sample's depths are cut into blocks of GRID;
    its terms go to each block and meet the depths there, one by one, so neither a deep sample
    nor its curve has to fit into one row or task.
    """
    if step < 1:
        raise ValueError("step must be positive")
    positive = counts.filter("reads > 0")
    terms = positive.groupBy("sample", "reads").agg(F.count(F.lit(1)).alias("_k"))
    last = F.floor((F.col("depth") - 1) / (F.lit(step) * GRID)).cast("bigint")
    zero, stride = F.lit(0).cast("bigint"), F.lit(step).cast("bigint")
    met = (attach(terms, library_size(positive), "sample")
           .withColumn("_own", lgamma(dbl("depth") - F.col("reads") + 1) - lgamma(dbl("depth") + 1))
           .withColumn("_block", F.explode(F.sequence(zero, last))).repartition("sample", "_block"))
    start = F.col("_block") * GRID * stride + 1
    end = F.least(start + (GRID - 1) * stride, F.col("depth"))
    depths = F.sequence(start, end, stride)
    full = F.when(F.col("_block") == last, F.array(F.col("depth"))).otherwise(F.array().cast("array<bigint>"))
    grid = met.withColumn("subsample", F.explode(F.array_distinct(F.concat(depths, full))))
    # C(N - r, d) / C(N, d): the factor of d alone cancels, that of r alone is known before depths are met.
    left = dbl("depth") - F.col("subsample") - F.col("reads")
    miss = F.col("_own") + lgamma(dbl("depth") - F.col("subsample") + 1) - lgamma(left + 1)
    seen = F.lit(1.0) - F.when(left >= 0, F.exp(miss)).otherwise(F.lit(0.0))
    return grid.groupBy("sample", "_block", "subsample").agg(F.sum(F.col("_k") * seen).alias("richness")).drop("_block")


def relative_abundance(counts: DataFrame, by="sample") -> DataFrame:
    return (with_group_stats(counts, by, _t=F.sum("reads"))
            .withColumn("share", ratio("reads", "_t")).drop("_t"))


def hellinger(counts: DataFrame, margin: str = "sample") -> DataFrame:
    """Square root of the share inside the margin ('sample' or 'feature')."""
    if margin not in ("sample", "feature"):
        raise ValueError("margin must be 'sample' or 'feature'")
    return relative_abundance(counts, margin).select(
        "feature", "sample", F.sqrt("share").alias("value"))


def standardize(df: DataFrame, cols, by=()) -> DataFrame:
    """(x - mean) / sd with n - 1, per column; NULL where the sd is 0."""
    cols = names(cols)
    aggs = {}
    for c in cols:
        aggs[f"_m_{c}"], aggs[f"_s_{c}"] = F.avg(c), F.stddev_samp(c)
    joined = with_group_stats(df, by, **aggs)
    return joined.withColumns({
        c: ratio(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in cols}).drop(*aggs)


def rank_zscore(df: DataFrame, col: str, by=(), name: str = "zscore") -> DataFrame:
    """Normal quantile of the average rank over n + 1."""
    ranked = average_rank(df, col, by, "_r", "_n")
    return ranked.withColumn(name, norm_ppf(F.col("_r") / (F.col("_n") + 1))).drop("_r", "_n")


def log_transform(df: DataFrame, col: str, kind: str = "log1p", name: str | None = None) -> DataFrame:
    c = dbl(col)
    fns = {"log1p": lambda: F.when(c > -1, F.log1p(c)), "log10": lambda: safe_log(c, "10"),
           "log2": lambda: safe_log(c, "2"), "log": lambda: safe_log(c),
           "sqrt": lambda: F.when(c >= 0, F.sqrt(c))}
    if kind not in fns:
        raise ValueError(f"kind must be one of {sorted(fns)}")
    return df.withColumn(name or f"{kind}_{col}", fns[kind]())


def size_factor_median(counts: DataFrame) -> DataFrame:
    """Library size over the median library size."""
    sizes = library_size(counts)
    return (attach(sizes, median_of(sizes, "depth", name="_m"))
            .select("sample", "depth", ratio("depth", "_m").alias("size_factor")))


def aggregate_to_rank(counts: DataFrame, lineage: DataFrame, rank: str) -> DataFrame:
    return (counts.join(lineage.select("feature", rank), "feature")
            .groupBy(rank, "sample").agg(F.sum("reads").alias("reads")))


# Genera of each functional group.
GUILDS = {
    "legume_nfixer": ("Allorhizobium-Neorhizobium-Pararhizobium-Rhizobium", "Mesorhizobium",
                      "Sinorhizobium", "Ensifer", "Bradyrhizobium", "Microvirga"),
    "actinorhizal_nfixer": ("Frankia",),
    "ammonia_oxidiser": ("Nitrosomonas", "Nitrosospira", "Nitrosococcus"),
    "nitrite_oxidiser": ("Nitrobacter", "Nitrospira", "Nitrococcus"),
}


def functional_guilds(counts: DataFrame, lineage: DataFrame, guilds: dict = GUILDS,
                      rank: str = "genus") -> DataFrame:
    """Reads per functional group and sample; a genus may serve several groups."""
    pairs = F.array(*[F.struct(F.lit(g).alias("guild"), F.lit(m).alias("member"))
                      for g, members in guilds.items() for m in members])
    member = lineage.select("feature", F.explode(
        F.filter(pairs, lambda p: p["member"] == F.col(rank))).alias("p")).select(
        "feature", "p.guild")
    return counts.join(member, "feature").groupBy("guild", "sample").agg(
        F.sum("reads").alias("reads"))


def merge_replicates(counts: DataFrame, pattern: str = r"_R\d") -> DataFrame:
    """Strip the replicate from the sample id and sum."""
    return (counts.withColumn("sample", F.regexp_replace("sample", pattern, ""))
            .groupBy("feature", "sample").agg(F.sum("reads").alias("reads")))


def filter_prevalence(counts: DataFrame, min_samples: int, min_reads: int) -> DataFrame:
    """Features seen in more than `min_samples` samples with more than `min_reads` reads."""
    kept = (counts.groupBy("feature")
            .agg(F.count_if(F.col("reads") > 0).alias("_s"), F.sum("reads").alias("_r"))
            .filter((F.col("_s") > min_samples) & (F.col("_r") > min_reads)).select("feature"))
    return counts.join(kept, "feature", "left_semi")


def feature_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("feature").agg(F.sum("reads").alias("total"))


def drop_zero_features(counts: DataFrame) -> DataFrame:
    kept = feature_totals(counts).filter("total <> 0").select("feature")
    return counts.join(kept, "feature", "left_semi")


def zero_features(counts: DataFrame) -> DataFrame:
    """Features whose total is 0."""
    return feature_totals(counts).filter("total = 0").select("feature")


def drop_low_total(counts: DataFrame, totals=(1, 2)) -> DataFrame:
    """Drop features whose total is one of `totals`."""
    kept = feature_totals(counts).filter(~F.col("total").isin(*totals)).select("feature")
    return counts.join(kept, "feature", "left_semi")


def drop_samples(counts: DataFrame, samples) -> DataFrame:
    return counts.filter(~F.col("sample").isin(*names(samples)))


def keep_common_sites(df: DataFrame, site: str = "site", method: str = "method") -> DataFrame:
    """Rows of the sites that every method has."""
    seen = df.select(site, method).distinct()
    k = seen.select(method).distinct().agg(F.count(F.lit(1))).scalar()
    kept = seen.groupBy(site).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") == k)
    return df.join(kept.select(site), site, "left_semi")


def complete_cases(df: DataFrame, cols) -> DataFrame:
    return df.dropna(subset=names(cols))


def null_outliers(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Values above their threshold become NULL."""
    return df.withColumns({c: F.when(F.col(c) <= t, F.col(c)) for c, t in limits.items()})


def fill_missing(df: DataFrame, cols, value=0) -> DataFrame:
    return df.fillna(value, subset=names(cols))


def sparse_form(counts: DataFrame) -> DataFrame:
    """A zero cell is an absent cell."""
    return counts.filter("reads > 0")
