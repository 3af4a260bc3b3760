"""The given tables seen as count tables, in Spark and (same rule) in SQL.

sample = supplier site, feature = part, reads = quantity sold. Suppliers with a low account
balance act as control samples; a control line counts as one read. Line status is the
method (B or G), return flag the strand (R1, R2, R3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countgrove.operators.counts import decontaminate

CONTROL_BELOW = 1000.0


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sites(spark, d) -> DataFrame:
    """One row per supplier: sample id, locality and covariates."""
    s = table(spark, d, "supplier")
    n = table(spark, d, "nation")
    r = table(spark, d, "region")
    key = F.concat_ws("_", F.upper(F.substring("r_name", 1, 2)), F.col("s_suppkey"))
    return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select("s_suppkey", F.when(F.col("s_acctbal") < CONTROL_BELOW, F.concat(F.lit("CONT_BU_"), key))
                    .otherwise(F.concat(F.lit("BU_"), key)).alias("sample"),
                    F.col("r_name").alias("locality"), "n_name", "s_acctbal"))


def lines(spark, d) -> DataFrame:
    """Line items with their sample, method and strand."""
    li = table(spark, d, "lineitem")
    reads = F.when(F.col("sample").startswith("CONT"), F.lit(1)).otherwise(F.col("l_quantity").cast("bigint"))
    strand = F.when(F.col("l_returnflag") == "A", "R1").when(F.col("l_returnflag") == "R", "R2").otherwise("R3")
    return (li.join(sites(spark, d), li.l_suppkey == F.col("s_suppkey"))
            .select(F.col("l_partkey").alias("feature"), "sample", "locality", reads.cast("bigint").alias("reads"),
                    F.when(F.col("l_linestatus") == "O", "B").otherwise("G").alias("method"),
                    strand.alias("strand"), "l_shipdate"))


def counts(spark, d) -> DataFrame:
    return lines(spark, d).groupBy("feature", "sample").agg(F.sum("reads").alias("reads"))


def clean(spark, d) -> DataFrame:
    """Counts of the true samples after control subtraction (zero cells kept)."""
    return decontaminate(counts(spark, d), F.col("sample").startswith("CONT"))


def lineage(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    second = F.element_at(F.split("p_name", " "), 2)
    first = F.element_at(F.split("p_name", " "), 1)
    return p.select(
        F.col("p_partkey").alias("feature"), F.concat(F.lit("k__"), "p_type").alias("kingdom"),
        F.concat(F.lit("p__"), "p_brand").alias("phylum"),
        F.when(first == "small", "uncultured").otherwise(F.concat(F.lit("c__"), second)).alias("class"),
        F.when(F.col("p_size") < 8, "*").otherwise(F.concat(F.lit("o__"), F.col("p_size"))).alias("order"))


def lineage_text(spark, d) -> DataFrame:
    return lineage(spark, d).select("feature", F.concat_ws("|", "kingdom", "phylum", "class", "order").alias("lineage"))


def brand_counts(spark, d) -> DataFrame:
    """Clean counts summed to (kingdom, phylum) taxa."""
    lin = lineage(spark, d).select("feature", F.concat_ws("|", "kingdom", "phylum").alias("taxon"))
    return (clean(spark, d).join(lin, "feature").groupBy("taxon", "sample")
            .agg(F.sum("reads").alias("reads")).withColumnRenamed("taxon", "feature"))


def method_counts(spark, d) -> DataFrame:
    """Reads per feature and sample id `site_strand_method`, true sites only."""
    return (lines(spark, d).filter(~F.col("sample").startswith("CONT"))
            .groupBy("feature", F.concat_ws("_", "sample", "strand", "method").alias("sample"))
            .agg(F.sum("reads").alias("reads")))


def method_taxa(spark, d) -> DataFrame:
    """(taxon, site, method, reads) on (kingdom, phylum) taxa."""
    lin = lineage(spark, d).select("feature", F.concat_ws("|", "kingdom", "phylum").alias("taxon"))
    return (lines(spark, d).filter(~F.col("sample").startswith("CONT")).join(lin, "feature")
            .groupBy("taxon", F.col("sample").alias("site"), "method").agg(F.sum("reads").alias("reads")))


def covariates(spark, d) -> DataFrame:
    """Covariates of the true samples."""
    li = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"),
        F.avg("l_extendedprice").alias("price"))
    s = sites(spark, d)
    return (s.filter(~F.col("sample").startswith("CONT")).join(li, s.s_suppkey == li.l_suppkey)
            .select("sample", "locality", "n_name", F.col("s_acctbal").alias("balance"), "discount", "tax", "price"))


def draws(spark, d) -> DataFrame:
    """Events as chains of draws: parameter = type, chain = last digit class of the user."""
    return table(spark, d, "events").select(
        F.col("event_type").alias("parameter"), F.pmod("user_id", F.lit(4)).cast("bigint").alias("chain"),
        F.col("event_id").alias("iteration"), F.col("value"))


# ---------------------------------------------------------------- the same in SQL

SITES = """sites AS (SELECT s_suppkey,
  CASE WHEN s_acctbal < 1000.0 THEN 'CONT_BU_' ELSE 'BU_' END || upper(substr(r_name,1,2)) || '_' || s_suppkey AS sample,
  r_name AS locality, n_name, s_acctbal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
LINES = SITES + """, lines AS (SELECT l_partkey AS feature, sample, locality,
  CASE WHEN sample LIKE 'CONT%' THEN 1 ELSE CAST(l_quantity AS BIGINT) END AS reads,
  CASE WHEN l_linestatus = 'O' THEN 'B' ELSE 'G' END AS method,
  CASE l_returnflag WHEN 'A' THEN 'R1' WHEN 'R' THEN 'R2' ELSE 'R3' END AS strand, l_shipdate
  FROM lineitem JOIN sites ON l_suppkey = s_suppkey)"""
COUNTS = LINES + """, counts AS (SELECT feature, sample, CAST(sum(reads) AS BIGINT) AS reads FROM lines GROUP BY 1, 2)"""
CLEAN = COUNTS + """, control AS (SELECT feature, sum(reads) AS n FROM counts WHERE sample LIKE 'CONT%' GROUP BY 1),
 clean AS (SELECT c.feature, c.sample, CAST(greatest(c.reads - coalesce(k.n, 0), 0) AS BIGINT) AS reads
  FROM counts c LEFT JOIN control k ON c.feature = k.feature WHERE c.sample NOT LIKE 'CONT%' AND c.reads > 0)"""
LINEAGE = """lineage AS (SELECT p_partkey AS feature, 'k__' || p_type AS kingdom, 'p__' || p_brand AS phylum,
  CASE WHEN split_part(p_name,' ',1) = 'small' THEN 'uncultured' ELSE 'c__' || split_part(p_name,' ',2) END AS class,
  CASE WHEN p_size < 8 THEN '*' ELSE 'o__' || p_size END AS "order" FROM part)"""
BRANDS = CLEAN + ", " + LINEAGE + """, brands AS (SELECT kingdom || '|' || phylum AS feature, sample,
  CAST(sum(reads) AS BIGINT) AS reads FROM clean JOIN lineage USING (feature) GROUP BY 1, 2)"""
METHODS = LINES + """, mcounts AS (SELECT feature, sample || '_' || strand || '_' || method AS sample,
  CAST(sum(reads) AS BIGINT) AS reads FROM lines WHERE sample NOT LIKE 'CONT%' GROUP BY 1, 2)"""
MTAXA = LINES + ", " + LINEAGE + """, mtaxa AS (SELECT kingdom || '|' || phylum AS taxon, sample AS site, method,
  CAST(sum(reads) AS BIGINT) AS reads FROM lines JOIN lineage USING (feature) WHERE sample NOT LIKE 'CONT%' GROUP BY 1, 2, 3)"""
COV = """cov AS (SELECT sample, locality, n_name, s_acctbal AS balance, discount, tax, price FROM sites
  JOIN (SELECT l_suppkey, avg(l_discount) AS discount, avg(l_tax) AS tax, avg(l_extendedprice) AS price
        FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey WHERE sample NOT LIKE 'CONT%')"""
DRAWS = """draws AS (SELECT event_type AS parameter, CAST(user_id % 4 AS BIGINT) AS chain, event_id AS iteration, value FROM events)"""
