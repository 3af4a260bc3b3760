"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import release, written


def _stars(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to its smallest neighbour."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.join(low, "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_stars(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them; `links` has u > v."""
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(low, "u").filter(F.col("v") > F.col("m")).select(
        F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(h)).first())


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) of every node that is not the smallest of its component.

    Links are undirected; self links and NULL ends are ignored. Each round is two
    aggregations joined back, so a node with a third of all links is combined map-side and
    its join is split by adaptive execution. The number of rounds grows with the logarithm
    of the component size, not with the length of chains. A round reads the table of the one
    before from the shared folder, which is deleted once it is replaced.
    """
    links = links.select(F.col(u).alias("u"), F.col(v).alias("v")).filter(F.col("u") != F.col("v"))
    now = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(now)
    while state[0]:
        last, before = now, state
        now = written(_small_stars(_stars(last)), "links")
        release(last)
        state = _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
