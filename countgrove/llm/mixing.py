"""Mixing sources to target weights by systematic sampling.

A document's expected copies are the target of its source over the size of the source. Within
a source, documents are laid out by size; their expected copies are added up, one offset of the
source is added, and a document is emitted once for every integer it crosses. Because sizes
rise along the line, the words taken miss the target by less than the largest document.

The running sum is a rank times a constant. Ranks come from ranges of (source, size, id): the
table is cut into ranges once, counted per range, and ranked inside each range, so no source
has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import written
from .common import free_name

WEIGHTS = (5.0, 2.0, 1.0)   # by source in code point order, repeating
SHARE = 1.5                 # of all sizes, taken together
CEILING = 2.0               # times the size of a source at most
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text_col: str = "text") -> Column:
    """Number of words: runs without ASCII white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source_col: str = "source", weights=WEIGHTS, share: float = SHARE,
            ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, target): `share` of all sizes, dealt by weight under a ceiling.

    `sizes` has one row per source. A source stops at `ceiling` times its size and its excess
    goes to the others by weight. In the order of ceiling over weight, the level at which the
    remaining sources share the remaining amount rises until no ceiling is in the way and falls
    from there, so the final level is the largest.
    """
    by_name = Window.orderBy(F.col(source_col).asc_nulls_last())
    every = Window.partitionBy()
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighted = sizes.select(
        source_col, "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                (place + 1).cast("int")).alias("_w"))
    capped = weighted.withColumn("_cap", ceiling * F.col("source_size")).withColumn(
        "_all", share * F.sum("source_size").over(every))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col(source_col).asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = capped.withColumn("_level", (F.col("_all") - before) / rest)
    return level.select(source_col, "source_size", F.least(
        F.col("_w") * F.max("_level").over(every), F.col("_cap")).alias("target"))


def _offset(source_col: str, seed: str) -> Column:
    """Uniform in [0, 1), fixed by the seed and the source."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), source_col).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING, seed: str = SEED) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken), one row per document.

    NULL texts have size 0; a NULL source is a source of its own, last in order; equal sizes
    are laid out by id, NULL ids first; repeated rows are documents of their own, each with its
    copies; a source without words has target 0 and no copies; an empty table gives no rows.
    Other columns are ignored. Reruns agree.
    """
    sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
                        size_of(text_col).alias("size"))
    cut = written(sized.repartitionByRange("_source", "size", "_id")
                  .withColumn("_part", F.spark_partition_id()), "mix")
    parts = cut.groupBy("_source", "_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words"))
    sums = parts.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    goals = targets(sums, "_source", weights, share, ceiling).withColumnRenamed("_source", "_s")
    earlier = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.select(F.col("_source").alias("_bs"), F.col("_part").alias("_bp"),
                          F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begin"))
    known = begins.join(goals, F.col("_bs").eqNullSafe(F.col("_s"))).drop("_s")
    inside = Window.partitionBy("_part", "_source").orderBy("size", "_id")
    ranked = (cut.withColumn("_rank", F.row_number().over(inside).cast("long"))
              .join(known, (F.col("_part") == F.col("_bp")) & F.col("_source").eqNullSafe(F.col("_bs"))))
    rank = F.col("_rank") + F.col("_begin")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = _offset("_source", seed)
    copies = F.floor(u + expected * rank) - F.floor(u + expected * (rank - 1))
    return (ranked.withColumn("copies", copies)
            .select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), "size", "source_size",
                    "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def emit(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source") -> DataFrame:
    """The rows of `docs`, each as often as `mixed` says, with their own columns only.

    Copies are known by id, source and size. Rows that agree in all three count alike and share
    their copies evenly, in the order of their texts' digests; NULL ids and sources are values like any other.
    """
    own = [F.col(f"`{id_col}`"), F.col(f"`{source_col}`"), size_of(f"`{text_col}`")]
    size, total, rows, place, each = (free_name(docs, c) for c in ("size", "copies", "rows", "row_no", "copy_no"))
    counts = mixed.groupBy(F.col(id_col).alias("_mixed_id"), F.col(source_col).alias("_mixed_source"), F.col("size").alias("_mixed_size")).agg(
        F.sum("copies").alias(total), F.count(F.lit(1)).alias(rows)).filter(F.col(total) > 0)
    joined = docs.withColumn(size, own[2]).join(
        counts, own[0].eqNullSafe(F.col("_mixed_id")) & own[1].eqNullSafe(F.col("_mixed_source")) & (F.col(size) == F.col("_mixed_size")))
    alike = Window.partitionBy("_mixed_id", "_mixed_source", "_mixed_size").orderBy(F.xxhash64(f"`{text_col}`"))
    single = joined.filter(F.col(rows) == 1).withColumn(place, F.lit(0))
    several = joined.filter(F.col(rows) > 1).withColumn(place, F.row_number().over(alike) - 1)
    copies = F.floor(F.col(total) / F.col(rows)) + (F.col(place) < F.col(total) % F.col(rows)).cast("int")
    dealt = single.unionByName(several).withColumn(total, copies).filter(F.col(total) > 0)
    return (dealt.withColumn(each, F.explode(F.sequence(F.lit(1).cast("long"), F.col(total))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
