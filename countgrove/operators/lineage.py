"""Taxonomic lineages and the taxon tree.

A taxon is identified by its lineage prefix, so the tree needs no edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import names, ratio, with_group_stats

# Spellings of a missing rank.
UNKNOWN_WORDS = r"uncultured|\*|Incertae_Sedis"
UNIDENTIFIED_WORDS = (r"uncultured_bacterium", r"unidentified_bacterium", r"uncultured", r"\*")
RANK_PREFIX = r"^[kpcofgs]__"


def split_lineage(df: DataFrame, ranks, col: str = "lineage", sep: str = r"\|",
                  drop_tail: str | None = None) -> DataFrame:
    """Lineage text to one column per rank; ranks beyond the list are dropped."""
    text = F.col(col) if drop_tail is None else F.regexp_replace(col, drop_tail, "")
    parts = F.split(text, sep)
    return df.select("*", *[F.try_element_at(parts, F.lit(i)).alias(r)
                            for i, r in enumerate(names(ranks), start=1)])


def repair_lineage_deepest(col, sep: str = "|") -> Column:
    """Unknown ranks take the name and initial of the deepest known rank of the lineage.

    The deepest known rank counts even when it lies below the unknown one. Without any
    known rank the repaired lineage is NULL.
    """
    text = F.regexp_replace(col, UNKNOWN_WORDS, "unknown")
    parts = F.split(text, "\\" + sep)
    known = F.filter(parts, lambda r: ~r.contains("unknown"))
    deepest = F.try_element_at(known, F.lit(-1))
    label = F.concat(F.lit("unknown__"), F.regexp_extract(deepest, "[^_]+$", 0), F.lit("_"),
                     F.substring(deepest, 1, 1))
    fixed = F.transform(parts, lambda r: F.when(r.contains("unknown"), label).otherwise(r))
    return F.when(~F.exists(fixed, lambda r: r.isNull()), F.array_join(fixed, sep))


def repair_lineage_cascade(df: DataFrame, ranks) -> DataFrame:
    """Unidentified ranks become `unidentified_<parent>`, parents first.

    Missing, uncultured and metagenome ranks count as unidentified, and so does a last
    rank that ends in an unnamed species. Repeated prefixes collapse to one.
    """
    ranks = names(ranks)
    cleaned = {}
    for r in ranks:
        c = F.col(r)
        for word in UNIDENTIFIED_WORDS:
            c = F.regexp_replace(c, word, "unidentified")
        cleaned[r] = F.coalesce(c, F.lit("unidentified"))
    out = df.withColumns(cleaned)
    for parent, rank in zip(ranks, ranks[1:]):
        bad = F.col(rank).contains("unidentified") | F.col(rank).contains("metagenome")
        if rank == ranks[-1]:
            bad = bad | F.col(rank).contains("_sp")
        out = out.withColumn(rank, F.when(bad, F.concat(F.lit("unidentified_"), F.col(parent)))
                             .otherwise(F.col(rank)))
        out = out.withColumn(rank, F.regexp_replace(rank, "^(unidentified_)+", "unidentified_"))
    return out


def strip_rank_prefix(col) -> Column:
    return F.regexp_replace(col, RANK_PREFIX, "")


def filter_lineage(df: DataFrame, col: str = "lineage", include: str | None = None,
                   exclude: dict[str, str] | None = None,
                   exclude_like: dict[str, str] | None = None) -> DataFrame:
    """Keep lineages matching `include`; drop given rank values and rank patterns.

    A NULL rank is dropped by a value exclusion, as a comparison with NULL is not true.
    """
    if include is not None:
        df = df.filter(F.col(col).rlike(include))
    for rank, value in (exclude or {}).items():
        df = df.filter(F.col(rank) != value)
    for rank, pattern in (exclude_like or {}).items():
        df = df.filter(~F.col(rank).rlike(pattern))
    return df


def known_only(counts: DataFrame, lineage: DataFrame, rank: str,
               unknown: str = "unidentified") -> DataFrame:
    """Counts of features whose rank is identified."""
    kept = lineage.filter(~F.col(rank).contains(unknown)).select("feature")
    return counts.join(kept, "feature", "left_semi")


def lineage_prefixes(lineage: DataFrame, ranks, sep: str = "|") -> DataFrame:
    """(feature, taxon, depth): one row per feature and ancestor, the leaf rank included."""
    path = F.array(*[F.col(r) for r in names(ranks)])
    return (lineage.select("feature", path.alias("_p"))
            .select("feature", F.explode(F.transform(
                F.sequence(F.lit(1), F.size("_p")),
                lambda d: F.struct(F.array_join(F.slice("_p", F.lit(1), d), sep).alias("taxon"),
                                   d.alias("depth")))).alias("t"))
            .select("feature", "t.taxon", "t.depth"))


def taxon_tree_sum(counts: DataFrame, lineage: DataFrame, ranks, by=("sample",)) -> DataFrame:
    """Reads of every taxon at every rank, per `by`.

    Cells are first summed to the deepest rank, then expanded to their ancestors, so the
    expansion works on taxa and not on features.
    """
    ranks, by = names(ranks), names(by)
    leaf = (counts.join(lineage.select("feature", *ranks), "feature")
            .groupBy(*ranks, *by).agg(F.sum("reads").alias("reads")))
    path = F.array(*[F.col(r) for r in ranks])
    up = leaf.select(*by, "reads", path.alias("_p")).select(
        *by, "reads", F.explode(F.transform(
            F.sequence(F.lit(1), F.size("_p")),
            lambda d: F.struct(F.array_join(F.slice("_p", F.lit(1), d), "|").alias("taxon"),
                               d.alias("depth")))).alias("t"))
    return (up.select(*by, "t.taxon", "t.depth", "reads")
            .groupBy("taxon", "depth", *by).agg(F.sum("reads").alias("reads")))


def n_obs(lineage: DataFrame, ranks, keep_rank: str | None = None) -> DataFrame:
    """Features per taxon; `keep_rank` keeps that rank and its ancestors."""
    ranks = names(ranks)
    depth = len(ranks) if keep_rank is None else ranks.index(keep_rank) + 1
    return (lineage_prefixes(lineage.dropDuplicates(["feature"]), ranks[:depth])
            .groupBy("taxon", "depth").agg(F.count(F.lit(1)).alias("n_obs")))


def n_samples(tree: DataFrame, by=()) -> DataFrame:
    """Samples with reads per taxon, per `by`; `tree` has one row per (taxon, sample)."""
    return (tree.groupBy("taxon", *names(by))
            .agg(F.count_if(F.col("reads") > 0).alias("n_samples")))


def tree_proportions(tree: DataFrame) -> DataFrame:
    """Share of each taxon among the taxa of its rank in the sample."""
    return (with_group_stats(tree, ["sample", "depth"], _t=F.sum("reads"))
            .withColumn("share", ratio("reads", "_t")).drop("_t"))
