"""Sample identifiers: normalising, parsing, recoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import names

# Id spellings of the raw tables and their replacements, applied in order.
ID_RULES = (
    (r"_bracken_genuses$", ""),
    (r"^OR-", "BU_"),
    (r"-", "_"),
    (r"_S\d+", ""),
    (r"^T_(\d)", "CONT_BU_PCR_$1"),
    (r"BU_T_extr", "CONT_BU_ext"),
    (r"^T_Ex", "CONT_BU_ext"),
    (r"(BU_[A-Z]+_)(\d)(_R\d+)", "$10$2$3"),
)
# Parts of a sample id.
REPLICATE = r"R\d_[A-Z]"
SITE = r"BU_[A-Z]+_\d+"
LOCALITY = r"(?<=BU_)[A-Z]+"


def normalize_sample_id(col) -> Column:
    """Clean id: suffixes off, project prefix, named controls, two-digit site number."""
    out = F.col(col) if isinstance(col, str) else col
    for pattern, to in ID_RULES:
        out = F.regexp_replace(out, pattern, to)
    return out


def extract(col, pattern: str, group: int = 0) -> Column:
    """First match of a pattern; NULL when there is none."""
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def parse_sample_id(df: DataFrame, col: str = "sample") -> DataFrame:
    """Adds replicate (strand and method), site, locality."""
    return df.select("*", extract(col, REPLICATE).alias("replicate"),
                     extract(col, SITE).alias("site"), extract(col, LOCALITY).alias("locality"))


def coordinates_key(col, prefix: str = "BU") -> Column:
    """`AB7` -> `BU_AB_07`."""
    letters = F.regexp_extract(col, r"([A-Z]+)(\d+)", 1)
    number = F.regexp_extract(col, r"([A-Z]+)(\d+)", 2)
    padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    return F.when(letters != "", F.concat_ws("_", F.lit(prefix), letters, padded))


def prefer_resequenced(df: DataFrame, key=("feature", "sample"), value: str = "reads",
                       marker: str = "_S$") -> DataFrame:
    """Where a sample was sequenced again (marked id), only the second sequencing stays.

    It replaces the first one for the whole sample and takes over the clean id.
    """
    others = [k for k in names(key) if k != "sample"]
    tagged = (df.withColumn("_again", F.col("sample").rlike(marker))
              .withColumn("sample", F.regexp_replace("sample", marker, "")))
    redone = tagged.filter("_again").select("sample").distinct()
    first = tagged.filter("NOT _again").join(redone, "sample", "left_anti")
    second = tagged.filter("_again")
    return first.unionByName(second).select(*others, "sample", value)


def select_by_name(df: DataFrame, prefix: str | None = None, suffix: str | None = None,
                   contains: str | None = None, col: str = "sample") -> DataFrame:
    """Rows whose id matches a name pattern (the columns of the wide table)."""
    keep = F.lit(True)
    if prefix is not None:
        keep = keep & F.col(col).startswith(prefix)
    if suffix is not None:
        keep = keep & F.col(col).endswith(suffix)
    if contains is not None:
        keep = keep & F.col(col).contains(contains)
    return df.filter(keep)


def recode(col, mapping: dict[str, str], default: str | None = None) -> Column:
    """Value recoding with fall-through: unmapped values stay, or take the default."""
    src = F.col(col) if isinstance(col, str) else col
    out = None
    for old, new in mapping.items():
        hit = src == old
        out = F.when(hit, F.lit(new)) if out is None else out.when(hit, F.lit(new))
    rest = src if default is None else F.lit(default)
    return rest if out is None else out.otherwise(rest)


def as_category(df: DataFrame, col: str, levels=None) -> DataFrame:
    """Numeric id or label to text; the level order is kept in `<col>_order`."""
    text = F.col(col).cast("string")
    if levels is None:
        order = F.col(col).cast("double")
    else:
        order = F.nullif(F.array_position(F.array(*[F.lit(str(v)) for v in levels]), text),
                         F.lit(0)).cast("double")
    return df.select(*[c for c in df.columns if c != col], text.alias(col),
                     order.alias(f"{col}_order"))
