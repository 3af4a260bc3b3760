"""Readers and writers of count tables and covariates."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import names
from ..plans.scratch import written


def read_delimited(spark: SparkSession, path, schema: T.StructType | str | None = None,
                   sep: str = "\t") -> DataFrame:
    """Headed delimited text; give a schema to avoid the extra inference pass."""
    reader = spark.read.option("header", True).option("sep", sep)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def _cells(sep: str):
    """Column: the cells of a line; quoted cells may hold the separator, but no line break."""
    one = re.escape(sep)
    quoted = F.regexp_extract_all(
        F.concat(F.lit(sep), "value"),
        F.lit(rf'{one}(\s*"[^"\\]*(?:(?:\\.|"")[^"\\]*)*"\s*(?={one}|$)|(?:(?!{one}).)*)'), F.lit(1))
    bare = F.transform(quoted, lambda c: F.when(
        F.trim(c).rlike('^".*"$'), F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"$', ""), r'[\\"]"', '"')).otherwise(c))
    return F.when(F.contains("value", F.lit('"')), bare).otherwise(F.split("value", one, -1))


def read_cells(spark: SparkSession, path, id_col: str, other_col: str | None = None, sep: str = "\t",
               skip: int = 0, keep: str | None = None, only=None) -> tuple[DataFrame, bool]:
    """Wide text files as (id, other, column, cell), and whether any file has `other_col`.

    Every file has a header of its own after `skip` lines, so files may have other columns or another
    order; they stay splittable. Headers become rows (file, position, column) that meet the cells by
    a join, so the plan does not grow with the columns. A file starts at offset 0, and the lines of a split
    are numbered in order, which tells header from body by place. `keep` is a regular expression for the columns to keep;
    `only(cell)` drops cells before the join. Files without a line are left out. Short lines give
    fewer cells, cells beyond the header and blank lines are dropped. Headers cost one more scan (two with a preamble).
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"))
    top = lines.filter(F.col("_start") == 0)
    heads = written(top.groupBy("_file").agg(F.min("_line").alias("_line"), F.min_by("value", "_line").alias("value")), "heads")
    files = heads.count()
    if skip:
        first = heads.select("_file", (F.col("_line") + skip).alias("_line"))
        heads = written(top.join(first, ["_file", "_line"]).select("_file", "_line", "value"), "heads")
    place = F.array_position("_cells", F.lit(id_col)).alias("_id_at")
    other = (F.array_position("_cells", F.lit(other_col)) if other_col else F.lit(0).cast("bigint")).alias("_other_at")
    heads = written(heads.select("_file", F.col("_line").alias("_head"), _cells(sep).alias("_cells")).select(
        "*", place, other), "layouts")
    found = heads.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_id_at") == 0).alias("lacking"),
                      F.max("_other_at").alias("other")).first()
    if found["n"] < files or not files:
        raise ValueError(f"no header after {skip} preamble line(s) in {path}")
    if found["lacking"]:
        raise ValueError(f"header has no column {id_col!r}")
    columns = heads.select("_file", "_id_at", "_other_at", F.posexplode("_cells").alias("_at", "column")).filter(
        ~(F.col("_at") + 1).isin(F.col("_id_at"), F.col("_other_at")))
    if keep is not None:
        columns = columns.filter(F.col("column").rlike(keep))
    columns = written(columns.select("_file", "_at", "column"), "columns")
    body = (lines.join(heads.drop("_cells"), "_file")
            .filter(((F.col("_start") > 0) | (F.col("_line") > F.col("_head"))) & (F.trim("value") != ""))
            .select("_file", "_id_at", "_other_at", _cells(sep).alias("_v"))
            .select("_file", F.try_element_at("_v", F.col("_id_at").cast("int")).alias("id"),
                    F.when(F.col("_other_at") > 0, F.try_element_at("_v", F.col("_other_at").cast("int"))).alias("other"),
                    F.posexplode("_v").alias("_at", "cell")))
    if only is not None:
        body = body.filter(only(F.col("cell")))
    return body.join(columns, ["_file", "_at"]).select("id", "other", "column", "cell"), bool(found["other"])


def _counts(cells: DataFrame, with_lineage: bool) -> DataFrame:
    lineage = [F.col("other").alias("lineage")] if with_lineage else []
    return cells.select(F.col("id").alias("feature"), *lineage, F.col("column").alias("sample"),
                        F.trim("cell").cast("double").cast("bigint").alias("reads"))


def _is_count(cell):
    number = F.trim(cell).try_cast("double")
    return (number > 0) & ~F.isnan(number)


def read_wide_counts(spark: SparkSession, path, id_col: str = "OTU",
                     lineage_col: str = "taxonomy", sep: str = "\t",
                     keep: str | None = None) -> DataFrame:
    """Wide count tables (one column per sample) as (feature, lineage, sample, reads).

    Files under `path` may hold different samples (`read_cells`); a file without lineages has NULL ones,
    and without any lineage column there is none. `keep` is a regular expression for the sample
    columns to keep. Zeros, blanks and what is no number are left out.
    """
    return _counts(*read_cells(spark, path, id_col, lineage_col, sep, 0, keep, _is_count))


def melt_counts(wide: DataFrame, id_col: str, lineage_col: str | None = None,
                keep: str | None = None) -> DataFrame:
    """Sample columns of a wide table to rows, zeros and NULLs left out."""
    fixed = [id_col] + ([lineage_col] if lineage_col else [])
    samples = [c for c in wide.columns
               if c not in fixed and (keep is None or re.search(keep, c))]
    long = wide.unpivot(fixed, samples, "sample", "reads").filter(F.col("reads") > 0)
    out = [F.col(id_col).alias("feature")]
    if lineage_col:
        out.append(F.col(lineage_col).alias("lineage"))
    return long.select(*out, "sample", F.col("reads").cast("bigint").alias("reads"))


def read_counts_with_preamble(spark: SparkSession, path: str, id_col: str = "#OTU ID",
                              lineage_col: str = "taxonomy", sep: str = "\t", skip: int = 1,
                              keep: str | None = None) -> DataFrame:
    """`read_wide_counts` of files whose header follows `skip` preamble lines.

    Preamble and header are told by their place in each file, so body lines may repeat them.
    """
    return _counts(*read_cells(spark, path, id_col, lineage_col, sep, skip, keep, _is_count))


def clean_names(df: DataFrame) -> DataFrame:
    """Dots and blanks in column names become underscores."""
    return df.toDF(*[re.sub(r"[.\s]+", "_", c) for c in df.columns])


def read_covariates(spark: SparkSession, path, schema=None, sep: str = "\t",
                    rename: dict[str, str] | None = None, columns=None) -> DataFrame:
    """Covariate table: clean names, then the chosen and renamed columns."""
    df = clean_names(read_delimited(spark, path, schema, sep))
    if columns is not None:
        df = df.select(*names(columns))
    return df.withColumnsRenamed(rename or {})


def read_matrix(spark: SparkSession, path, id_col: str, sep: str = "\t", id_type: str = "string",
                value_type: str = "double") -> DataFrame:
    """Exported matrices as long (id, column, value); a cell that is no number is NULL."""
    cells, _ = read_cells(spark, path, id_col, None, sep)
    return cells.select(F.col("id").cast(id_type).alias(id_col), "column", F.trim("cell").try_cast(value_type).alias("value"))


def tag_runs(tables: dict[str, DataFrame], tag: str = "method",
             sample: str | None = None) -> DataFrame:
    """Several runs stacked with a tag column; the tag is also appended to the sample id."""
    out = None
    for label, df in tables.items():
        part = df.withColumn(tag, F.lit(label))
        if sample:
            part = part.withColumn(sample, F.concat_ws("_", sample, F.lit(label)))
        out = part if out is None else out.unionByName(part)
    return out


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=(),
                mode: str = "errorifexists") -> None:
    """Write one table as parquet or headed TSV."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*names(partition_by))
    if fmt == "tsv":
        writer.option("header", True).option("sep", "\t").csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return fs.exists(done)


def load_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """Reuse a finished result at `path`, otherwise compute and write it first.

    A directory without the success marker (a job lost half-way) is computed again.
    """
    if not path_exists(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
