"""Keyed joins and row-wise set operations. No strategy is forced: AQE decides by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import attach, names
from ..plans.ranking import average_rank
from ..plans.scratch import written


def left_cov(df: DataFrame, cov: DataFrame, key="sample") -> DataFrame:
    """Decorate rows with covariates; rows without covariates stay."""
    return df.join(cov, names(key), "left")


def full_merge(a: DataFrame, b: DataFrame, keys, values_a, values_b, fill=0) -> DataFrame:
    """Full outer join on several keys; missing numbers become `fill`."""
    values = names(values_a) + names(values_b)
    return a.join(b, names(keys), "full").fillna(fill, subset=values)


def merge_runs(run1: DataFrame, run2: DataFrame, key: str = "sample") -> DataFrame:
    """Run 2 replaces run 1 completely for every sample it has."""
    redone = run2.select(key).distinct()
    return run1.join(redone, key, "left_anti").unionByName(run2)


def join_aggregate(df: DataFrame, agg: Column, by, name: str, source: DataFrame | None = None,
                   how: str = "left") -> DataFrame:
    """Rows with an aggregate of their group, taken from `source` (the rows themselves by default)."""
    by = names(by)
    stats = (df if source is None else source).groupBy(*by).agg(agg.alias(name))
    return df.join(stats, by, how)


BESIDE = 400_000    # rows of a table per sample that is kept whole beside its pairs


def beside_pairs(table: DataFrame) -> DataFrame:
    """A written table of one row per sample, sent whole to every executor up to BESIDE rows: pairs, its square, stay where they are."""
    return F.broadcast(table) if table.count() <= BESIDE else table


def decorate_pairs(pairs: DataFrame, cov: DataFrame, key: str = "sample",
                   suffixes=("_1", "_2"), ids=("s1", "s2")) -> DataFrame:
    """Covariates of both ends of a pair, with a suffix for each end.

    The covariates are written first and sent to the pairs, which are not shuffled unless there are more than BESIDE samples.
    """
    out, cov = pairs, written(cov, "covariates")
    for end, suffix in zip(ids, suffixes):
        side = cov.select(F.col(key).alias(end),
                          *[F.col(c).alias(c + suffix) for c in cov.columns if c != key])
        out = out.join(beside_pairs(side), end, "left")
    return out


def semi(df: DataFrame, other: DataFrame, key) -> DataFrame:
    return df.join(other.select(*names(key)), names(key), "left_semi")


def anti_append(df: DataFrame, other: DataFrame, key) -> DataFrame:
    """Add the rows of `other` whose key is missing here, values included."""
    key = names(key)
    return df.unionByName(other.join(df.select(*key).distinct(), key, "left_anti"))


def side_by_side(a: DataFrame, b: DataFrame, key, suffixes=("_a", "_b"), how: str = "inner") -> DataFrame:
    """Two result tables on the same key, columns told apart by suffix."""
    key = names(key)

    def mark(df, s):
        return df.select(*key, *[F.col(c).alias(c + s) for c in df.columns if c not in key])

    return mark(a, suffixes[0]).join(mark(b, suffixes[1]), key, how)


def with_grid(df: DataFrame, values, name: str) -> DataFrame:
    """Each row with every value of a fixed, given grid."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def cross_tables(a: DataFrame, b: DataFrame, block: int = 1024) -> DataFrame:
    """Every row of `a` with every row of `b`; the product is the result asked for.

    `b` is cut into numbered blocks of about `block` rows; rows of `a` go to the numbers and meet the
    blocks by an equi-join, which adaptive execution splits. Tables must not share a column name.
    """
    clash = {c.lower() for c in a.columns} & {c.lower() for c in b.columns}
    if clash:
        raise ValueError(f"columns in both tables: {sorted(clash)}")
    rows = written(b.select(F.struct(*b.columns).alias("_row")), "rows")
    count = rows.count()
    last = max(0, -(-count // block) - 1)
    number = F.pmod(F.xxhash64("_row", F.monotonically_increasing_id()), F.lit(last + 1))
    blocks = written(rows.withColumn("_block", number), "blocks").groupBy("_block").agg(F.collect_list("_row").alias("_rows"))
    spread = a.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))))
    return (spread.join(blocks, "_block").withColumn("_row", F.explode("_rows"))
            .select(*[F.col(f"`{c}`") for c in a.columns], *[F.col("_row")[c].alias(c) for c in b.columns]))


def bind(a: DataFrame, b: DataFrame, key=()) -> DataFrame:
    """Columns of b next to a by key; without key b has one row (read as a scalar)."""
    return a.join(b, names(key), "left") if names(key) else attach(a, b)


def truth_vs_estimate(estimate: DataFrame, truth: DataFrame, keys, value="estimate",
                      true_value="truth") -> DataFrame:
    return (estimate.join(truth, names(keys))
            .withColumn("error", F.col(value).cast("double") - F.col(true_value).cast("double")))


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both by column name; a missing column is NULL."""
    return a.unionByName(b, allowMissingColumns=True)


def append_runs(runs, name: str = "rep") -> DataFrame:
    """Outputs of several runs with a run number from 1."""
    out = None
    for i, df in enumerate(runs, start=1):
        part = df.withColumn(name, F.lit(i).cast("bigint"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no runs given")
    return out


def duplicates(df: DataFrame, key) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return (df.groupBy(*names(key)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))


def frame_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table missing in the other, duplicates counted, with their side."""
    b = b.select(*a.columns)
    return (a.exceptAll(b).withColumn("side", F.lit("left"))
            .unionByName(b.exceptAll(a).withColumn("side", F.lit("right"))))


def distinct(df: DataFrame, cols=None) -> DataFrame:
    return (df if cols is None else df.select(*names(cols))).distinct()


def sort_result(df: DataFrame, cols, descending=()) -> DataFrame:
    """Order a final result; give unique columns for a total order."""
    desc = set(names(descending))
    return df.orderBy(*[F.col(c).desc() if c in desc else F.col(c).asc() for c in names(cols)])


def head_tail(df: DataFrame, col: str, k: int, tie: str) -> DataFrame:
    """The k smallest and the k largest rows by a column, ties by `tie`."""
    low = df.orderBy(F.col(col).asc(), F.col(tie).asc()).limit(k).withColumn("end", F.lit("head"))
    high = df.orderBy(F.col(col).desc(), F.col(tie).asc()).limit(k).withColumn("end", F.lit("tail"))
    return low.unionByName(high)


def rank_above(df: DataFrame, col: str, threshold: float) -> DataFrame:
    """Rows whose average-tie rank of `col` exceeds the threshold."""
    return average_rank(df, col, name="rank").filter(F.col("rank") > threshold)


def top_by_p(df: DataFrame, k: int, p: str = "p", tie: str = "taxon") -> DataFrame:
    """The k smallest p-values."""
    return df.orderBy(F.col(p).asc_nulls_last(), F.col(tie).asc()).limit(k)


def order_columns(df: DataFrame, first=()) -> DataFrame:
    head = names(first)
    return df.select(*head, *sorted(c for c in df.columns if c not in head))
