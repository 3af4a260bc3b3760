"""Long and wide forms of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import names


def to_long(df: DataFrame, ids, values, name: str = "sample", value: str = "reads",
            drop_null: bool = False) -> DataFrame:
    out = df.unpivot(names(ids), names(values), name, value)
    return out.filter(F.col(value).isNotNull()) if drop_null else out


def to_wide(df: DataFrame, ids, name: str, value: str, levels, fill=0) -> DataFrame:
    """Long to wide for a given list of levels (a sink format: levels become columns)."""
    wide = df.groupBy(*names(ids)).pivot(name, list(levels)).agg(F.sum(value))
    return wide if fill is None else wide.fillna(fill, subset=[str(v) for v in levels])


def transpose(df: DataFrame, row: str = "feature", column: str = "sample") -> DataFrame:
    """Swap the two keys of a long table."""
    swap = {row: column, column: row}
    return df.select(*[F.col(c).alias(swap.get(c, c)) for c in df.columns])


def one_hot(df: DataFrame, id_col: str, col: str, levels=None) -> DataFrame:
    """Level indicator: long (id, level, 1), or wide 0/1 columns for a given level list."""
    long = (df.filter(F.col(col).isNotNull())
            .select(id_col, F.col(col).cast("string").alias("level")).distinct()
            .withColumn("value", F.lit(1).cast("bigint")))
    if levels is None:
        return long
    present = df.select(id_col).distinct()
    return present.join(to_wide(long, id_col, "level", "value", levels), id_col, "left").fillna(0)


def multi_hot(df: DataFrame, id_col: str, col: str, components: dict[str, list[str]]) -> DataFrame:
    """Indicator where a mixture level counts in each of its components."""
    src = F.col(col)
    parts = F.array(src)
    for level, members in components.items():
        parts = F.when(src == level, F.array(*[F.lit(m) for m in members])).otherwise(parts)
    return (df.filter(src.isNotNull()).select(id_col, F.explode(parts).alias("level")).distinct()
            .withColumn("value", F.lit(1).cast("bigint")))


def unite_present(long: DataFrame, id_col: str, order, sep: str = "_",
                  name: str = "combination") -> DataFrame:
    """Names of the levels equal to 1, joined in the given level order."""
    levels = list(order)
    flags = [F.max(F.when((F.col("level") == v) & (F.col("value") == 1), F.lit(v))).alias(f"_l{i}")
             for i, v in enumerate(levels)]
    joined = F.concat_ws(sep, *[F.col(f"_l{i}") for i in range(len(levels))])
    return long.groupBy(id_col).agg(*flags).select(id_col, joined.alias(name))


def sorted_combo(cols, sep: str = " ") -> Column:
    """Row-wise sorted values of several columns as one text, NULLs left out."""
    return F.array_join(F.array_sort(F.array_compact(F.array(*[F.col(c) for c in names(cols)]))), sep)


def matrix_to_pairs(wide: DataFrame, id_col: str, columns, name: str = "value") -> DataFrame:
    """Square wide matrix to (s1, s2, value), upper triangle, NULLs left out."""
    long = wide.unpivot(id_col, names(columns), "s2", name)
    return (long.filter(F.col(name).isNotNull() & (F.col(id_col) < F.col("s2")))
            .select(F.col(id_col).alias("s1"), "s2", name))


def long_beside(df: DataFrame, ids, response, cols) -> DataFrame:
    """Covariates long next to a response: (ids, response, covariate, x)."""
    keep = names(ids) + names(response)
    wide = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in names(cols)])
    return wide.unpivot(keep, names(cols), "covariate", "x")


def parse_parameter(df: DataFrame, col: str = "parameter") -> DataFrame:
    """`name[idx]` to name and index; both NULL for another form."""
    pattern = r"(.+)\[(\d+)\]"
    name = F.nullif(F.regexp_extract(col, pattern, 1), F.lit(""))
    idx = F.nullif(F.regexp_extract(col, pattern, 2), F.lit(""))
    return df.select("*", name.alias("name"), idx.cast("bigint").alias("idx"))
