"""Queries for sources, filters and count preparation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from countgrove.functions.common import attach
from countgrove.operators import counts as C
from countgrove.operators import diversity as V
from countgrove.operators import ids, lineage as L
from countgrove.plans.scratch import new_path
from countgrove.sources import tables as S

from . import tables as t
from .registry import case

RANKS = ["kingdom", "phylum", "class", "order"]

# ------------------------------------------------------------------ flagship


@case("hill_after_rarefaction", f"""WITH {t.CLEAN},
 depth AS (SELECT sample, sum(reads) AS n FROM clean GROUP BY 1),
 rare AS (SELECT c.feature, c.sample, CAST(CASE WHEN d.n <= m.d THEN c.reads
   ELSE round_even(c.reads * m.d / d.n, 0) END AS BIGINT) AS reads
   FROM clean c JOIN depth d USING (sample), (SELECT CAST(min(n) AS DOUBLE) AS d FROM depth) m),
 p AS (SELECT sample, reads / CAST(sum(reads) OVER (PARTITION BY sample) AS DOUBLE) AS p FROM rare WHERE reads > 0),
 h AS (SELECT sample, CAST(count(*) AS DOUBLE) AS hill_0, exp(-sum(p * ln(p))) AS hill_1, 1 / sum(p * p) AS hill_2 FROM p GROUP BY 1)
 SELECT sample, round(hill_0, 6) AS hill_0, round(hill_1, 6) AS hill_1, round(hill_2, 6) AS hill_2,
   round(hill_1 / hill_0, 6) AS evenness_1, round(hill_2 / hill_0, 6) AS evenness_2 FROM h""")
def hill_after_rarefaction(spark, d):
    return V.evenness(V.hill_numbers(C.rarefy_expected(t.clean(spark, d))))


# ------------------------------------------------------------------ sources

WIDE_SQL = f"""WITH {t.LINES} SELECT CAST(feature AS VARCHAR) AS feature, 'part|' || feature AS lineage,
 replace(locality, ' ', '_') AS sample, CAST(sum(reads) AS BIGINT) AS reads FROM lines GROUP BY feature, locality"""
PLACES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def _wide(spark, d):
    return (t.lines(spark, d).groupBy("feature").pivot("locality", PLACES).agg(F.sum("reads")).na.fill(0)
            .select(F.col("feature").alias("OTU"), F.concat(F.lit("part|"), "feature").alias("taxonomy"),
                    *[F.col(p).alias(p.replace(" ", "_")) for p in PLACES]))


@case("read_counts", WIDE_SQL)
def read_counts(spark, d):
    path = new_path(spark, "wide")
    S.write_table(_wide(spark, d), path, "tsv")
    return S.read_wide_counts(spark, path)


@case("read_counts_with_preamble", WIDE_SQL)
def read_counts_with_preamble(spark, d):
    path = new_path(spark, "preamble")
    wide = _wide(spark, d)
    cols = ["#OTU ID", "taxonomy", *[p.replace(" ", "_") for p in PLACES]]
    body = wide.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in wide.columns]).alias("value"))

    def with_header(batches):
        yield pd.DataFrame({"value": ["# counts of one run", "\t".join(cols)]})
        yield from batches

    body.mapInPandas(with_header, "value string").write.text(path)
    return S.read_counts_with_preamble(spark, path)


@case("read_covariates", """SELECT s_suppkey AS site_id, s_nationkey AS nation_key, round(s_acctbal, 6) AS balance FROM supplier""")
def read_covariates(spark, d):
    path = new_path(spark, "cov")
    t.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("site.id"), F.col("s_nationkey").alias("nation.key"),
        F.col("s_acctbal").alias("acct.bal")).write.option("header", True).option("sep", "\t").csv(path)
    return S.read_covariates(spark, path, "`site.id` long, `nation.key` int, `acct.bal` double",
                             rename={"acct_bal": "balance"})


@case("read_covariate_export", """SELECT c_custkey AS plot, c_mktsegment AS crop, round(c_acctbal, 6) AS balance FROM customer""")
def read_covariate_export(spark, d):
    path = new_path(spark, "sheet")
    t.table(spark, d, "customer").withColumnsRenamed({"c_custkey": "c.custkey", "c_mktsegment": "market segment"}).write.option(
        "header", True).csv(path)
    return S.read_covariates(spark, path, "`c.custkey` long, c_name string, c_nationkey int, c_acctbal double, `market segment` string",
                             sep=",", columns=["c_custkey", "market_segment", "c_acctbal"],
                             rename={"c_custkey": "plot", "market_segment": "crop", "c_acctbal": "balance"})


@case("read_matrix", f"""WITH {t.LINES}, w AS (SELECT feature, replace(locality, ' ', '_') AS loc, sum(reads) AS r FROM lines GROUP BY 1, 2),
 f AS (SELECT DISTINCT feature FROM lines), l AS (SELECT replace(r_name, ' ', '_') AS loc FROM region)
 SELECT CAST(f.feature AS INT) AS id, l.loc AS "column", CAST(coalesce(w.r, 0) AS INT) AS value
 FROM f CROSS JOIN l LEFT JOIN w ON w.feature = f.feature AND w.loc = l.loc""")
def read_matrix(spark, d):
    path = new_path(spark, "matrix")
    S.write_table(_wide(spark, d).drop("taxonomy").withColumnRenamed("OTU", "id"), path, "tsv")
    return S.read_matrix(spark, path, "id", id_type="int", value_type="int")


@case("tag_runs", f"""WITH {t.LINES}, m AS (SELECT sample || '_' || method AS sample, feature, method, sum(reads) AS reads
 FROM lines GROUP BY ALL) SELECT sample, feature, method, CAST(reads AS BIGINT) AS reads FROM m""")
def tag_runs(spark, d):
    x = t.lines(spark, d)
    runs = {m: x.filter(F.col("method") == m).groupBy("sample", "feature").agg(F.sum("reads").alias("reads")) for m in "BG"}
    return S.tag_runs(runs, sample="sample")


@case("write_table", f"WITH {t.CLEAN} SELECT sample, CAST(sum(reads) AS BIGINT) AS depth FROM clean GROUP BY 1")
def write_table(spark, d):
    path = new_path(spark, "depths")
    S.write_table(C.library_size(t.clean(spark, d)), path, "tsv")
    return S.read_delimited(spark, path, "sample string, depth long")


@case("load_or_compute", f"WITH {t.CLEAN} SELECT feature, CAST(sum(reads) AS BIGINT) AS total FROM clean GROUP BY 1")
def load_or_compute(spark, d):
    path = new_path(spark, "totals")
    S.load_or_compute(spark, path, lambda: C.feature_totals(t.clean(spark, d)))
    return S.load_or_compute(spark, path, lambda: 1 / 0)


# ------------------------------------------------------------------ ids and filters


@case("select_by_name", f"WITH {t.METHODS} SELECT * FROM mcounts WHERE sample LIKE 'BU%' AND sample LIKE '%\\_B' ESCAPE '\\' AND contains(sample, 'R1')")
def select_by_name(spark, d):
    return ids.select_by_name(t.method_counts(spark, d), prefix="BU", suffix="_B", contains="R1")


RAW = """raw AS (SELECT DISTINCT CASE WHEN s_acctbal < 1000 THEN 'T-' || s_nationkey || '_bracken_genuses' ELSE
 'OR-' || upper(substr(r_name,1,2)) || '-' || s_suppkey || '-R1_S' || l_linenumber || '_bracken_genuses' END AS raw
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
CLEAN_ID = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(raw,
 '_bracken_genuses$', ''), '^OR-', 'BU_'), '-', '_'), '_S\\d+', '', 'g'), '^T_(\\d)', 'CONT_BU_PCR_\\1'), 'BU_T_extr|^T_Ex', 'CONT_BU_ext'),
 '(BU_[A-Z]+_)(\\d)(_R\\d+)', '\\g<1>0\\2\\3')""".replace("\\g<1>0", "\\1" + "0")


def _raw_ids(spark, d):
    s, n, r = (t.table(spark, d, x) for x in ("supplier", "nation", "region"))
    li = t.table(spark, d, "lineitem")
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    tail = F.lit("_bracken_genuses")
    return j.select(F.when(F.col("s_acctbal") < 1000, F.concat(F.lit("T-"), "s_nationkey", tail)).otherwise(
        F.concat(F.lit("OR-"), F.upper(F.substring("r_name", 1, 2)), F.lit("-"), "s_suppkey", F.lit("-R1_S"), "l_linenumber", tail)
    ).alias("raw")).distinct()


@case("normalize_sample_id", f"WITH {RAW} SELECT raw, {CLEAN_ID} AS sample FROM raw")
def normalize_sample_id(spark, d):
    return _raw_ids(spark, d).withColumn("sample", ids.normalize_sample_id("raw"))


@case("parse_sample_id", f"""WITH {t.METHODS} SELECT DISTINCT sample, nullif(regexp_extract(sample, 'R\\d_[A-Z]'), '') AS replicate,
 nullif(regexp_extract(sample, 'BU_[A-Z]+_\\d+'), '') AS site, nullif(regexp_extract(sample, 'BU_([A-Z]+)', 1), '') AS locality FROM mcounts""")
def parse_sample_id(spark, d):
    return ids.parse_sample_id(t.method_counts(spark, d).select("sample").distinct())


RUNS = t.LINES + """, tagged AS (SELECT feature, CASE WHEN l_shipdate >= TIMESTAMP '1999-01-01' AND locality IN ('ASIA', 'EUROPE')
  THEN sample || '_S' ELSE sample END AS sample, reads FROM lines),
 resequenced AS (SELECT feature, sample, CAST(sum(reads) AS BIGINT) AS reads FROM tagged GROUP BY 1, 2)"""


def _resequenced(spark, d):
    again = (F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp")) & F.col("locality").isin("ASIA", "EUROPE")
    return (t.lines(spark, d).withColumn("sample", F.when(again, F.concat("sample", F.lit("_S"))).otherwise(F.col("sample")))
            .groupBy("feature", "sample").agg(F.sum("reads").alias("reads")))


@case("prefer_resequenced", f"""WITH {RUNS}, redone AS (SELECT DISTINCT regexp_replace(sample, '_S$', '') AS s FROM resequenced WHERE sample LIKE '%\\_S' ESCAPE '\\')
 SELECT feature, regexp_replace(sample, '_S$', '') AS sample, reads FROM resequenced
 WHERE sample LIKE '%\\_S' ESCAPE '\\' OR sample NOT IN (SELECT s FROM redone)""")
def prefer_resequenced(spark, d):
    return ids.prefer_resequenced(_resequenced(spark, d))


@case("split_lineage", """SELECT p_partkey AS feature, 'k__' || p_type AS kingdom, 'p__' || p_brand AS phylum,
 'c__' || replace(p_name, ' ', '_') AS class FROM part""")
def split_lineage(spark, d):
    text = t.table(spark, d, "part").select(
        F.col("p_partkey").alias("feature"), F.concat(
            F.lit("k__"), "p_type", F.lit("; p__"), "p_brand", F.lit("; c__"), F.regexp_replace("p_name", " ", "_"),
            F.lit("; f__"), "p_size").alias("lineage"))
    return L.split_lineage(text, ["kingdom", "phylum", "class"], sep="; ", drop_tail="; f__.+").drop("lineage")


REPAIR = """fixed AS (SELECT feature, regexp_replace(kingdom || '|' || phylum || '|' || class || '|' || "order", 'uncultured|\\*|Incertae_Sedis', 'unknown', 'g') AS x FROM lineage),
 parts AS (SELECT feature, string_split(x, '|') AS p FROM fixed),
 deep AS (SELECT feature, p, list_last(list_filter(p, lambda z: NOT contains(z, 'unknown'))) AS k FROM parts)"""


@case("repair_lineage_deepest", f"""WITH {t.LINEAGE}, {REPAIR} SELECT feature, array_to_string(list_transform(p, lambda z: CASE WHEN contains(z, 'unknown')
 THEN 'unknown__' || regexp_extract(k, '[^_]+$') || '_' || substr(k, 1, 1) ELSE z END), '|') AS lineage FROM deep""")
def repair_lineage_deepest(spark, d):
    return t.lineage_text(spark, d).select("feature", L.repair_lineage_deepest("lineage").alias("lineage"))


@case("repair_lineage_cascade", f"""WITH {t.LINEAGE}, a AS (SELECT feature, kingdom, phylum, replace(class, 'uncultured', 'unidentified') AS class,
 replace("order", '*', 'unidentified') AS "order" FROM lineage),
 b AS (SELECT feature, kingdom, phylum, CASE WHEN contains(class, 'unidentified') THEN 'unidentified_' || phylum ELSE class END AS class, "order" FROM a)
 SELECT feature, kingdom, phylum, class, regexp_replace(CASE WHEN contains("order", 'unidentified') THEN 'unidentified_' || class ELSE "order" END,
 '^(unidentified_)+', 'unidentified_') AS "order" FROM b""")
def repair_lineage_cascade(spark, d):
    return L.repair_lineage_cascade(t.lineage(spark, d), RANKS)


@case("strip_rank_prefix", f"""WITH {t.LINEAGE} SELECT feature, regexp_replace(kingdom, '^[kpcofgs]__', '') AS kingdom,
 regexp_replace("order", '^[kpcofgs]__', '') AS "order" FROM lineage""")
def strip_rank_prefix(spark, d):
    return t.lineage(spark, d).select("feature", L.strip_rank_prefix("kingdom").alias("kingdom"), L.strip_rank_prefix("order").alias("order"))


@case("filter_lineage", f"""WITH {t.LINEAGE}, x AS (SELECT *, kingdom || '|' || phylum || '|' || class || '|' || "order" AS lineage FROM lineage)
 SELECT feature, lineage FROM x WHERE regexp_matches(lineage, 'ECONOMY|SMALL|PROMO') AND "order" <> '*' AND class <> 'c__bolt'
 AND NOT regexp_matches(phylum, 'Brand#2')""")
def filter_lineage(spark, d):
    lin = t.lineage(spark, d).withColumn("lineage", F.concat_ws("|", *RANKS))
    return L.filter_lineage(lin, include="ECONOMY|SMALL|PROMO", exclude={"order": "*", "class": "c__bolt"},
                            exclude_like={"phylum": "Brand#2"}).select("feature", "lineage")


@case("known_only", f"""WITH {t.CLEAN}, {t.LINEAGE} SELECT c.feature, c.sample, c.reads FROM clean c
 WHERE feature IN (SELECT feature FROM lineage WHERE NOT contains(class, 'uncultured'))""")
def known_only(spark, d):
    return L.known_only(t.clean(spark, d), t.lineage(spark, d), "class", unknown="uncultured")


@case("filter_prevalence", f"""WITH {t.CLEAN} SELECT * FROM clean WHERE feature IN (SELECT feature FROM clean GROUP BY 1
 HAVING count(*) FILTER (reads > 0) > 5 AND sum(reads) > 600)""")
def filter_prevalence(spark, d):
    return C.filter_prevalence(t.clean(spark, d), 5, 600)


@case("drop_zero_features", f"WITH {t.CLEAN} SELECT * FROM clean WHERE feature IN (SELECT feature FROM clean GROUP BY 1 HAVING sum(reads) <> 0)")
def drop_zero_features(spark, d):
    return C.drop_zero_features(t.clean(spark, d))


@case("zero_features", f"""WITH {t.CLEAN}, m AS (SELECT feature, CASE WHEN reads < 45 THEN 0 ELSE reads END AS reads FROM clean)
 SELECT feature FROM m GROUP BY 1 HAVING sum(reads) = 0""")
def zero_features(spark, d):
    strict = t.clean(spark, d).withColumn("reads", F.when(F.col("reads") < 45, 0).otherwise(F.col("reads")))
    return C.zero_features(strict)


@case("drop_low_total", """WITH c AS (SELECT o_custkey AS feature, o_orderstatus AS sample, count(*) AS reads FROM orders GROUP BY 1, 2)
 SELECT * FROM c WHERE feature IN (SELECT feature FROM c GROUP BY 1 HAVING sum(reads) NOT IN (1, 2))""")
def drop_low_total(spark, d):
    c = t.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("feature"), F.col("o_orderstatus").alias("sample")).agg(
        F.count(F.lit(1)).alias("reads"))
    return C.drop_low_total(c)


@case("drop_samples", f"WITH {t.BRANDS} SELECT * FROM brands WHERE sample NOT IN ('BU_AF_0', 'BU_EU_3')")
def drop_samples(spark, d):
    return C.drop_samples(t.brand_counts(spark, d), ["BU_AF_0", "BU_EU_3"])


@case("keep_common_sites", """WITH s AS (SELECT DISTINCT o_custkey AS site, o_orderpriority AS method FROM orders)
 SELECT * FROM s WHERE site IN (SELECT site FROM s GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT method) FROM s))""")
def keep_common_sites(spark, d):
    return C.keep_common_sites(t.table(spark, d, "orders").select(
        F.col("o_custkey").alias("site"), F.col("o_orderpriority").alias("method")).distinct())


MISSING = """x AS (SELECT d.doc_id, lang, quality, CASE WHEN n_chars <= 2000 THEN n_chars END AS n_chars
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _missing(spark, d):
    doc, lab = t.table(spark, d, "documents"), t.table(spark, d, "labels")
    return C.null_outliers(doc.join(lab, "doc_id", "left").select("doc_id", "lang", "quality", "n_chars"), {"n_chars": 2000})


@case("complete_cases", f"WITH {MISSING} SELECT * FROM x WHERE quality IS NOT NULL AND n_chars IS NOT NULL")
def complete_cases(spark, d):
    return C.complete_cases(_missing(spark, d), ["quality", "n_chars"])


@case("null_outliers", f"WITH {MISSING} SELECT doc_id, n_chars FROM x")
def null_outliers(spark, d):
    return _missing(spark, d).select("doc_id", "n_chars")


@case("fill_missing", f"WITH {MISSING} SELECT doc_id, lang, coalesce(quality, 0) AS quality, coalesce(n_chars, 0) AS n_chars FROM x")
def fill_missing(spark, d):
    return C.fill_missing(_missing(spark, d), ["quality", "n_chars"])


@case("sparse_form", f"WITH {t.CLEAN} SELECT * FROM clean WHERE reads > 0")
def sparse_form(spark, d):
    return C.sparse_form(t.clean(spark, d))


@case("recode", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' ELSE o_orderpriority END AS kept,
 CASE o_orderstatus WHEN 'F' THEN 'closed' ELSE 'others' END AS status FROM orders""")
def recode(spark, d):
    return t.table(spark, d, "orders").select(
        "o_orderkey", ids.recode("o_orderpriority", {"1-URGENT": "high", "2-HIGH": "high"}).alias("kept"),
        ids.recode("o_orderstatus", {"F": "closed"}, "others").alias("status"))


@case("as_category", """SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_nationkey AS DOUBLE) AS c_nationkey_order FROM customer""")
def as_category(spark, d):
    return ids.as_category(t.table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey")


@case("coordinates_key", """SELECT s_suppkey, 'BU_' || upper(substr(r_name,1,2)) || '_' || CASE WHEN s_suppkey < 10 THEN '0' ELSE '' END || s_suppkey AS soil_code
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def coordinates_key(spark, d):
    s = t.sites(spark, d).withColumn("code", F.concat(F.upper(F.substring("locality", 1, 2)), F.col("s_suppkey")))
    return s.select("s_suppkey", ids.coordinates_key("code").alias("soil_code"))


# ------------------------------------------------------------------ count preparation


@case("decontaminate", f"WITH {t.CLEAN} SELECT * FROM clean")
def decontaminate(spark, d):
    return t.clean(spark, d)


@case("library_size", f"WITH {t.CLEAN} SELECT sample, CAST(sum(reads) AS BIGINT) AS depth FROM clean GROUP BY 1")
def library_size(spark, d):
    return C.library_size(t.clean(spark, d)).orderBy("depth", "sample")


@case("min_depth", f"WITH {t.CLEAN} SELECT CAST(min(n) AS BIGINT) AS min_depth FROM (SELECT sum(reads) AS n FROM clean GROUP BY sample)")
def min_depth(spark, d):
    return C.min_depth(t.clean(spark, d))


RARE = """depth AS (SELECT sample, sum(reads) AS n FROM clean GROUP BY 1),
 rare AS (SELECT c.feature, c.sample, CAST(CASE WHEN d.n <= m.d THEN c.reads ELSE round_even(c.reads * m.d / d.n, 0) END AS BIGINT) AS reads
  FROM clean c JOIN depth d USING (sample), (SELECT CAST(min(n) AS DOUBLE) AS d FROM depth) m)"""


@case("rarefy_expected", f"WITH {t.CLEAN}, {RARE} SELECT * FROM rare")
def rarefy_expected(spark, d):
    return C.rarefy_expected(t.clean(spark, d))


def _choose(n, k):
    return f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"


@case("rarefaction_curve", f"""WITH {t.CLEAN}, k AS (SELECT sample, reads, count(*) AS k FROM clean WHERE reads > 0 GROUP BY 1, 2),
 n AS (SELECT sample, CAST(sum(reads) AS BIGINT) AS n FROM clean GROUP BY 1),
 g AS (SELECT sample, n, unnest(list_distinct(list_append(range(1, n + 1, 20), n))) AS d FROM n),
 s AS (SELECT sample, d, sum(k * (1 - CASE WHEN d <= n - reads THEN exp({_choose('(n - reads)', 'd')} - {_choose('n', 'd')}) ELSE 0 END)) AS r
  FROM k JOIN g USING (sample) GROUP BY 1, 2) SELECT sample, d AS subsample, round(r, 2) AS richness FROM s""", digits=6)
def rarefaction_curve(spark, d):
    return C.rarefaction_curve(t.clean(spark, d))


SHARE = """share AS (SELECT feature, sample, reads, CASE WHEN sum(reads) OVER (PARTITION BY sample) > 0 THEN
 CAST(reads AS DOUBLE) / sum(reads) OVER (PARTITION BY sample) END AS share FROM clean)"""


@case("relative_abundance", f"WITH {t.CLEAN}, {SHARE} SELECT feature, sample, reads, round(share, 6) AS share FROM share")
def relative_abundance(spark, d):
    return C.relative_abundance(t.clean(spark, d))


@case("hellinger_by_sample", f"WITH {t.CLEAN}, {SHARE} SELECT feature, sample, round(sqrt(share), 6) AS value FROM share")
def hellinger_by_sample(spark, d):
    return C.hellinger(t.clean(spark, d), "sample")


@case("hellinger_by_feature", f"""WITH {t.CLEAN}, m AS (SELECT feature, CAST(sum(reads) AS DOUBLE) AS n FROM clean GROUP BY 1)
 SELECT feature, sample, round(sqrt(reads / nullif(n, 0)), 6) AS value FROM clean JOIN m USING (feature)""")
def hellinger_by_feature(spark, d):
    return C.hellinger(t.clean(spark, d), "feature")


@case("standardize", f"""WITH {t.SITES}, {t.COV} SELECT sample, round((balance - avg(balance) OVER ()) / stddev_samp(balance) OVER (), 6) AS balance,
 round((price - avg(price) OVER ()) / stddev_samp(price) OVER (), 6) AS price FROM cov""")
def standardize(spark, d):
    return C.standardize(t.covariates(spark, d), ["balance", "price"]).select("sample", "balance", "price")


@case("log_transform", """SELECT o_orderkey, round(log10(o_totalprice), 6) AS a, round(log2(o_totalprice), 6) AS b,
 round(ln(1 + o_totalprice), 6) AS c, round(sqrt(o_totalprice), 6) AS d FROM orders""")
def log_transform(spark, d):
    o = t.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    for kind, name in (("log10", "a"), ("log2", "b"), ("log1p", "c"), ("sqrt", "d")):
        o = C.log_transform(o, "o_totalprice", kind, name)
    return o.drop("o_totalprice")


@case("size_factor_median", f"""WITH {t.CLEAN}, n AS (SELECT sample, CAST(sum(reads) AS BIGINT) AS depth FROM clean GROUP BY 1)
 SELECT sample, depth, round(depth / (SELECT quantile_cont(depth, 0.5) FROM n), 6) AS size_factor FROM n""")
def size_factor_median(spark, d):
    return C.size_factor_median(t.clean(spark, d))


@case("aggregate_to_rank", f"WITH {t.CLEAN}, {t.LINEAGE} SELECT class, sample, CAST(sum(reads) AS BIGINT) AS reads FROM clean JOIN lineage USING (feature) GROUP BY 1, 2")
def aggregate_to_rank(spark, d):
    return C.aggregate_to_rank(t.clean(spark, d), t.lineage(spark, d), "class")


@case("functional_guilds", f"""WITH {t.CLEAN}, g(guild, member) AS (VALUES ('fasteners','bolt'),('fasteners','ring'),('machines','gear'),('rings','ring')),
 p AS (SELECT p_partkey AS feature, split_part(p_name,' ',2) AS genus FROM part)
 SELECT guild, sample, CAST(sum(reads) AS BIGINT) AS reads FROM clean JOIN p USING (feature) JOIN g ON member = genus GROUP BY 1, 2""")
def functional_guilds(spark, d):
    lin = t.table(spark, d, "part").select(F.col("p_partkey").alias("feature"), F.element_at(F.split("p_name", " "), 2).alias("genus"))
    return C.functional_guilds(t.clean(spark, d), lin, {"fasteners": ("bolt", "ring"), "machines": ("gear",), "rings": ("ring",)})


@case("merge_replicates", f"""WITH {t.METHODS} SELECT feature, regexp_replace(sample, '_R\\d', '') AS sample, CAST(sum(reads) AS BIGINT) AS reads FROM mcounts GROUP BY 1, 2""")
def merge_replicates(spark, d):
    return C.merge_replicates(t.method_counts(spark, d))
