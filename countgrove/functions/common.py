"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def names(cols) -> list[str]:
    """A column name or a sequence of names as a list."""
    return [cols] if isinstance(cols, str) else list(cols)


def dbl(col) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("double")


def ratio(num, den) -> Column:
    """num / den as a double; NULL where the denominator is 0 or NULL."""
    return F.try_divide(dbl(num), dbl(den))


def safe_log(col, base: str = "e") -> Column:
    """Logarithm that is NULL for values <= 0."""
    c = dbl(col)
    fn = {"e": F.log, "2": F.log2, "10": F.log10}[base]
    return F.when(c > 0, fn(c))


def finite(col) -> Column:
    """NaN and infinities become NULL."""
    c = dbl(col)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def attach(df: DataFrame, stats: DataFrame, by=()) -> DataFrame:
    """Join group statistics back to the rows of their group.

    Without keys `stats` has exactly one row and is read as a scalar subquery, so no
    cross join is planned. With keys it is an equi-join: AQE broadcasts the statistics
    when their run-time size allows it and splits hot keys otherwise.
    """
    by = names(by)
    if by:
        return df.join(stats, by, "inner")
    cols = stats.columns
    one = stats.select(F.struct(*cols).alias("s")).scalar()
    kept = [c for c in df.columns if c not in cols]
    return (df.select(*kept, one.alias("_one"))
            .select(*kept, *[F.col("_one")[c].alias(c) for c in cols]))


def with_group_stats(df: DataFrame, by, **aggs: Column) -> DataFrame:
    """Whole-group aggregates next to every row.

    The aggregate is combined map-side and joined back, instead of sending each group
    through one window task.
    """
    by = names(by)
    stats = df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])
    return attach(df, stats, by)

