"""Group summaries of count tables.

Dense semantics (absent cells are zeros) come from sums, sums of squares and the number
of cells of the full grid, never from a materialised grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import attach, dbl, names, ratio, safe_log, with_group_stats
from ..plans.ranking import quantiles_of


def dense_moments(counts: DataFrame, by, cells: Column, value: str = "reads", sd: bool = False) -> DataFrame:
    """Mean and sample variance over `cells` cells per group, absent cells being 0.

    Centred moments of the present cells, which merge without losing digits, are combined with the
    block of zeros: its squares about the common mean add mean^2 n zeros / cells.
    """
    x = dbl(value)
    sums = counts.groupBy(*names(by)).agg(F.avg(x).alias("_m"), F.var_pop(x).alias("_v"), F.count(x).cast("double").alias("_k"),
                                          cells.alias("_n"))
    n, k, m = dbl("_n"), F.col("_k"), F.coalesce("_m", F.lit(0.0))
    squares = F.coalesce("_v", F.lit(0.0)) * k + m * m * k * (n - k) / n
    out = sums.select(*names(by), F.try_divide(m * k, n).alias("mean"), F.when(n > 1, squares / (n - 1)).alias("variance"))
    return out.withColumn("sd", F.sqrt("variance")) if sd else out


def mean_var(counts: DataFrame, by=("feature",), value: str = "reads", sd: bool = False,
             dense_over: str | None = "sample", scope=()) -> DataFrame:
    """Mean and variance per group.

    With `dense_over` the group has one cell for each of its distinct ids inside the keys of
    `scope` (in the whole table by default); otherwise only present rows count.
    """
    by = names(by)
    if dense_over is None:
        x = dbl(value)
        aggs = [F.avg(x).alias("mean"), F.var_samp(x).alias("variance")]
        return counts.groupBy(*by).agg(*aggs, *([F.stddev_samp(x).alias("sd")] if sd else []))
    scope = names(scope)
    size = counts.groupBy(*scope).agg(F.count_distinct(dense_over).alias("_cells"))
    return dense_moments(attach(counts, size, scope), by, F.max("_cells"), value, sd)


def log_var(moments: DataFrame, offset: float = 1.0) -> DataFrame:
    """log10(variance + offset)."""
    return moments.withColumn("log_variance", safe_log(F.col("variance") + F.lit(float(offset)), "10"))


def observed_features(counts: DataFrame, by=("sample",)) -> DataFrame:
    return counts.groupBy(*names(by)).agg(F.count_if(F.col("reads") > 0).alias("observed"))


def share_mean_var(counts: DataFrame, by=("feature",), within="sample") -> DataFrame:
    """Mean and variance of the share in the sample, over the rows of a group."""
    share = with_group_stats(counts, within, _t=F.sum("reads")).withColumn("_p", ratio("reads", "_t"))
    return share.groupBy(*names(by)).agg(F.avg("_p").alias("mean_share"), F.var_samp("_p").alias("var_share"))


def tally(df: DataFrame, cols) -> DataFrame:
    """Frequency table."""
    return df.groupBy(*names(cols)).agg(F.count(F.lit(1)).alias("n"))


def contingency(df: DataFrame, cols) -> DataFrame:
    """n-way table without empty cells."""
    return tally(df, cols)


def lump_rare(df: DataFrame, col: str, fewer_than: int, other: str = "others",
              merges: dict[str, str] | None = None) -> DataFrame:
    """Levels seen fewer than n times become `other`; then explicit merges."""
    sizes = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    lumped = F.when(F.col("_n") < fewer_than, F.lit(other))
    for old, new in (merges or {}).items():
        lumped = lumped.when(F.col(col) == old, F.lit(new))
    return df.join(sizes, col).withColumn(col, lumped.otherwise(F.col(col))).drop("_n")


def share_by_condition(df: DataFrame, condition: str, label: str, min_share: float = 0.001,
                       per_label: bool = False, low: str = "< 0.1%") -> DataFrame:
    """Reads per condition and label; rows of a small share get the label `low`.

    The share is that of each row in its condition, or of the whole label with `per_label`.
    """
    if per_label:
        df = df.groupBy(condition, label).agg(F.sum("reads").alias("reads"))
    shares = with_group_stats(df, condition, _t=F.sum("reads"))
    small = ratio("reads", "_t") < min_share
    return (shares.withColumn(label, F.when(small, F.lit(low)).otherwise(F.col(label)))
            .groupBy(condition, label).agg(F.sum("reads").alias("reads"), F.max("_t").alias("_t"))
            .withColumn("share", ratio("reads", "_t")).drop("_t"))


def _bin(df: DataFrame, col: str, nbin: int, by) -> DataFrame:
    """Adds width and bin b; the largest value falls in bin `nbin`."""
    x = dbl(col)
    out = with_group_stats(df.filter(F.col(col).isNotNull()), by, _lo=F.min(x), _hi=F.max(x))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(nbin))
    return (out.withColumn("width", width)
            .withColumn("b", F.try_divide(x - F.col("_lo"), F.col("width")).cast("int").cast("bigint"))
            .drop("_lo", "_hi"))


def bin_equal(df: DataFrame, col: str, nbin: int, by=(), means=()) -> DataFrame:
    """Equal-width bins with the mean of each column of `means` (the binned one by default)."""
    cols = names(means) or [col]
    return (_bin(df, col, nbin, by).groupBy(*names(by), "b")
            .agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in cols]))


def binned_density(df: DataFrame, col: str, nbin: int, by=(), unit: bool = False) -> DataFrame:
    """Count, mean, sd and density per bin; `unit` bins [0, 1] as int(x * nbin)."""
    by = names(by)
    if unit:
        binned = df.withColumn("width", F.lit(1.0 / nbin)).withColumn(
            "b", (dbl(col) * nbin).cast("int").cast("bigint"))
    else:
        binned = _bin(df, col, nbin, by)
    rows = binned.groupBy(*by, "b").agg(
        F.count(F.lit(1)).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"),
        F.max("width").alias("width"))
    return (with_group_stats(rows, by, _t=F.sum("n"))
            .withColumn("p", F.try_divide(ratio("n", "_t"), F.col("width"))).drop("_t"))


def weighted_density(df: DataFrame, col: str, weight: str, nbin: int, by=()) -> DataFrame:
    """Unit-interval bins with summed weight, weighted mean and density."""
    by = names(by)
    w, x = dbl(weight), dbl(col)
    rows = (df.filter(F.col(col).isNotNull())
            .withColumn("b", (x * nbin).cast("int").cast("bigint")).groupBy(*by, "b")
            .agg(F.sum(w).alias("n"), ratio(F.sum(w * x), F.sum(w)).alias("mean"), F.avg(w).alias("mean_weight")))
    return (with_group_stats(rows, by, _t=F.sum("n"))
            .withColumn("p", ratio("n", "_t") * F.lit(float(nbin))).drop("_t"))


def quantiles(df: DataFrame, col: str, probs: dict[str, float], by=()) -> DataFrame:
    """Exact linear-interpolation quantiles, one column per named probability."""
    return quantiles_of(df, col, probs, by)


def n_distinct(df: DataFrame, col: str, by=()) -> DataFrame:
    return df.groupBy(*names(by)).agg(F.count_distinct(col).alias("n_distinct"))


def sum_by(df: DataFrame, by, cols="reads") -> DataFrame:
    return df.groupBy(*names(by)).agg(*[F.sum(c).alias(c) for c in names(cols)])


def mean_by(df: DataFrame, by, cols) -> DataFrame:
    return df.groupBy(*names(by)).agg(*[F.avg(c).alias(c) for c in names(cols)])


def histogram(df: DataFrame, col: str, nbin: int, by=()) -> DataFrame:
    """Rows per equal-width bin."""
    return (_bin(df, col, nbin, by).groupBy(*names(by), "b").agg(F.count(F.lit(1)).alias("n")))


def strand_difference(df: DataFrame, by="feature", strand: str = "strand", first="R1", second="R2") -> DataFrame:
    """Totals of two strands per feature and their absolute difference."""
    def total(level):
        return F.coalesce(F.sum(F.when(F.col(strand) == level, F.col("reads"))), F.lit(0).cast("bigint"))

    return (df.groupBy(*names(by)).agg(total(first).alias("total_1"), total(second).alias("total_2"))
            .withColumn("difference", F.abs(F.col("total_1") - F.col("total_2"))))


def max_by_group(df: DataFrame, by, col: str) -> DataFrame:
    """Largest effect per group with its fold change 2^effect, largest first."""
    return (df.groupBy(*names(by)).agg(F.max(col).alias(f"max_{col}"))
            .withColumn("fold_change", F.pow(F.lit(2.0), F.col(f"max_{col}")))
            .orderBy(F.col(f"max_{col}").desc(), *names(by)))
