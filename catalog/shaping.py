"""Queries for reshape, joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from countgrove.operators import aggregates as A
from countgrove.operators import counts as C
from countgrove.operators import joins as J
from countgrove.operators import lineage as L
from countgrove.operators import reshape as R
from countgrove.operators import windows as W

from . import tables as t
from .registry import case

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]

# ------------------------------------------------------------------ reshape


def _status_wide(spark, d):
    o = t.table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return R.to_wide(o, "o_custkey", "o_orderstatus", "n", STATUSES)


STATUS_WIDE = """SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
 count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1"""


@case("to_wide", STATUS_WIDE)
def to_wide(spark, d):
    return _status_wide(spark, d)


@case("to_long", f"""SELECT o_custkey, sample, reads FROM ({STATUS_WIDE}) UNPIVOT (reads FOR sample IN ("F", "O", "P"))""")
def to_long(spark, d):
    return R.to_long(_status_wide(spark, d), "o_custkey", STATUSES)


@case("transpose", f"WITH {t.CLEAN} SELECT feature AS sample, sample AS feature, reads FROM clean")
def transpose(spark, d):
    return R.transpose(t.clean(spark, d))


HOT = "hot AS (SELECT DISTINCT o_custkey, o_orderpriority AS level FROM orders)"


@case("one_hot_long", f"WITH {HOT} SELECT o_custkey, level, CAST(1 AS BIGINT) AS value FROM hot")
def one_hot_long(spark, d):
    return R.one_hot(t.table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@case("one_hot_wide", f"""WITH {HOT} SELECT o_custkey, """ + ", ".join(
    f"""count(*) FILTER (level = '{p}') AS "{p}" """ for p in PRIORITIES + ["6-NONE"]) + "FROM hot GROUP BY 1")
def one_hot_wide(spark, d):
    return R.one_hot(t.table(spark, d, "orders"), "o_custkey", "o_orderpriority", PRIORITIES + ["6-NONE"])


MIXTURE = {"1-URGENT": ["fast", "paid"], "2-HIGH": ["fast"], "3-MEDIUM": ["slow", "paid"]}
MULTI = """m(o, c) AS (VALUES ('1-URGENT','fast'),('1-URGENT','paid'),('2-HIGH','fast'),('3-MEDIUM','slow'),('3-MEDIUM','paid'),
 ('4-NOT SPECIFIED','4-NOT SPECIFIED'),('5-LOW','5-LOW')), multi AS (SELECT DISTINCT o_custkey, c AS level FROM orders JOIN m ON o = o_orderpriority)"""


def _multi(spark, d):
    return R.multi_hot(t.table(spark, d, "orders"), "o_custkey", "o_orderpriority", MIXTURE)


@case("multi_hot", f"WITH {MULTI} SELECT o_custkey, level, CAST(1 AS BIGINT) AS value FROM multi")
def multi_hot(spark, d):
    return _multi(spark, d)


UNITED = MULTI + """, united AS (SELECT o_custkey, concat_ws('_', max(level) FILTER (level = 'fast'), max(level) FILTER (level = 'paid'),
  max(level) FILTER (level = 'slow'), max(level) FILTER (level = '4-NOT SPECIFIED'), max(level) FILTER (level = '5-LOW')) AS combination
  FROM multi GROUP BY 1)"""


def _united(spark, d):
    return R.unite_present(_multi(spark, d), "o_custkey", ["fast", "paid", "slow", "4-NOT SPECIFIED", "5-LOW"])


@case("unite_present", f"WITH {UNITED} SELECT * FROM united")
def unite_present(spark, d):
    return _united(spark, d)


@case("sorted_combo", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_sort(list_filter([l_returnflag, l_linestatus,
 CASE WHEN l_discount > 0.05 THEN 'D' END], lambda x: x IS NOT NULL)), ' ') AS combo FROM lineitem""")
def sorted_combo(spark, d):
    li = t.table(spark, d, "lineitem").withColumn("third", F.when(F.col("l_discount") > 0.05, "D"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     R.sorted_combo(["l_returnflag", "l_linestatus", "third"]).alias("combo"))


PLACES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
TRADE = """trade AS (SELECT rs.r_name AS a, rc.r_name AS b, CAST(count(*) AS BIGINT) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation ns ON s_nationkey = ns.n_nationkey JOIN region rs ON ns.n_regionkey = rs.r_regionkey JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN nation nc ON c_nationkey = nc.n_nationkey JOIN region rc ON nc.n_regionkey = rc.r_regionkey GROUP BY 1, 2)"""


@case("matrix_to_pairs", f"WITH {TRADE} SELECT a AS s1, b AS s2, value FROM trade WHERE a < b")
def matrix_to_pairs(spark, d):
    s, o, c, n, r = (t.table(spark, d, x) for x in ("supplier", "orders", "customer", "nation", "region"))
    place = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")
    li = (t.table(spark, d, "lineitem").join(s, F.col("l_suppkey") == s.s_suppkey)
          .join(place.withColumnRenamed("r_name", "a"), F.col("s_nationkey") == F.col("n_nationkey")).drop("n_nationkey")
          .join(o, F.col("l_orderkey") == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey)
          .join(place.withColumnRenamed("r_name", "b"), F.col("c_nationkey") == F.col("n_nationkey")))
    wide = R.to_wide(li.groupBy("a", "b").agg(F.count(F.lit(1)).alias("value")), "a", "b", "value", PLACES, fill=None)
    return R.matrix_to_pairs(wide, "a", PLACES)


@case("long_beside", f"""WITH {t.CLEAN}, {t.COV}, n AS (SELECT sample, CAST(sum(reads) AS BIGINT) AS depth FROM clean GROUP BY 1), j AS (SELECT n.sample, depth, balance, price FROM n JOIN cov USING (sample))
 SELECT sample, depth, 'balance' AS covariate, round(balance, 6) AS x FROM j UNION ALL SELECT sample, depth, 'price', round(price, 6) FROM j""")
def long_beside(spark, d):
    j = C.library_size(t.clean(spark, d)).join(t.covariates(spark, d), "sample")
    return R.long_beside(j, "sample", "depth", ["balance", "price"])


@case("parse_parameter", """SELECT DISTINCT event_type || '[' || user_id || ']' AS parameter, event_type AS name, CAST(user_id AS BIGINT) AS idx FROM events""")
def parse_parameter(spark, d):
    e = t.table(spark, d, "events").select(F.concat("event_type", F.lit("["), "user_id", F.lit("]")).alias("parameter")).distinct()
    return R.parse_parameter(e)


# ------------------------------------------------------------------ joins


@case("left_cov", f"""WITH {t.CLEAN}, {t.COV} SELECT c.feature, c.sample, c.reads, v.locality, round(v.balance, 6) AS balance
 FROM clean c LEFT JOIN cov v ON c.sample = v.sample""")
def left_cov(spark, d):
    return J.left_cov(t.clean(spark, d), t.covariates(spark, d).select("sample", "locality", "balance"))


def _method_side(spark, d, m):
    x = t.lines(spark, d).filter(F.col("method") == m).groupBy("feature", "sample")
    return x.agg(F.sum("reads").alias(f"reads_{m.lower()}"))


@case("full_merge", f"""WITH {t.LINES}, b AS (SELECT feature, sample, sum(reads) AS r FROM lines WHERE method = 'B' GROUP BY 1, 2),
 g AS (SELECT feature, sample, sum(reads) AS r FROM lines WHERE method = 'G' GROUP BY 1, 2)
 SELECT coalesce(b.feature, g.feature) AS feature, coalesce(b.sample, g.sample) AS sample, CAST(coalesce(b.r, 0) AS BIGINT) AS reads_b,
 CAST(coalesce(g.r, 0) AS BIGINT) AS reads_g FROM b FULL JOIN g ON b.feature = g.feature AND b.sample = g.sample""")
def full_merge(spark, d):
    return J.full_merge(_method_side(spark, d, "B"), _method_side(spark, d, "G"), ["feature", "sample"], "reads_b", "reads_g")


LATE = "l_shipdate >= TIMESTAMP '1999-01-01' AND locality IN ('ASIA','EUROPE')"
RUNS = t.LINES + f""", run1 AS (SELECT feature, sample, CAST(sum(reads) AS BIGINT) AS reads FROM lines WHERE NOT ({LATE}) GROUP BY 1, 2),
 run2 AS (SELECT feature, sample, CAST(sum(reads) AS BIGINT) AS reads FROM lines WHERE {LATE} GROUP BY 1, 2)"""


def _runs(spark, d):
    """Two sequencing runs: late lines of two localities were sequenced again, all others once."""
    x = t.lines(spark, d)
    late = (F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp")) & F.col("locality").isin("ASIA", "EUROPE")
    agg = F.sum("reads").alias("reads")
    return (x.filter(~late).groupBy("feature", "sample").agg(agg), x.filter(late).groupBy("feature", "sample").agg(agg))


@case("merge_runs", f"WITH {RUNS} SELECT * FROM run1 WHERE sample NOT IN (SELECT sample FROM run2) UNION ALL SELECT * FROM run2")
def merge_runs(spark, d):
    return J.merge_runs(*_runs(spark, d))


@case("join_aggregate", f"""WITH {t.COUNTS}, k AS (SELECT feature, CAST(sum(reads) AS BIGINT) AS control_reads FROM counts WHERE sample LIKE 'CONT%' GROUP BY 1)
 SELECT c.feature, c.sample, c.reads, k.control_reads FROM counts c LEFT JOIN k ON c.feature = k.feature""")
def join_aggregate(spark, d):
    c = t.counts(spark, d)
    return J.join_aggregate(c, F.sum("reads"), "feature", "control_reads", source=c.filter(F.col("sample").startswith("CONT")))


PAIRS = t.LINES + """, pairs AS (SELECT DISTINCT least(a.sample, b.sample) AS s1, greatest(a.sample, b.sample) AS s2 FROM sites a JOIN sites b ON a.n_name = b.n_name AND a.s_suppkey < b.s_suppkey)"""


@case("decorate_pairs", f"""WITH {t.SITES}, {t.COV}, p AS (SELECT a.sample AS s1, b.sample AS s2 FROM cov a JOIN cov b ON a.sample < b.sample)
 SELECT p.s1, p.s2, x.locality AS locality_1, y.locality AS locality_2, round(x.balance, 6) AS balance_1, round(y.balance, 6) AS balance_2
 FROM p JOIN cov x ON p.s1 = x.sample JOIN cov y ON p.s2 = y.sample""")
def decorate_pairs(spark, d):
    from countgrove.plans.pair_blocks import row_pairs
    cov = t.covariates(spark, d).select("sample", "locality", "balance")
    return J.decorate_pairs(row_pairs(cov, "sample", []), cov)


@case("semi", """SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def semi(spark, d):
    return J.semi(t.table(spark, d, "documents").select("doc_id", "lang", "n_chars"), t.table(spark, d, "labels"), "doc_id")


@case("anti_append", f"WITH {RUNS} SELECT * FROM run2 UNION ALL SELECT * FROM run1 WHERE feature NOT IN (SELECT feature FROM run2)")
def anti_append(spark, d):
    one, two = _runs(spark, d)
    return J.anti_append(two, one, "feature")


@case("side_by_side", f"""WITH {RUNS}, a AS (SELECT sample, CAST(sum(reads) AS BIGINT) AS r FROM run1 GROUP BY 1), b AS (SELECT sample, CAST(sum(reads) AS BIGINT) AS r FROM run2 GROUP BY 1)
 SELECT a.sample, a.r AS depth_first, b.r AS depth_second FROM a JOIN b ON a.sample = b.sample""")
def side_by_side(spark, d):
    one, two = (C.library_size(x) for x in _runs(spark, d))
    return J.side_by_side(one, two, "sample", ("_first", "_second"))


@case("with_grid", f"""WITH {t.CLEAN} SELECT sample, CAST(sum(reads) AS BIGINT) AS depth, eta FROM clean, (VALUES (-2.5), (0.0), (2.5)) g(eta0),
 LATERAL (SELECT CAST(eta0 AS DOUBLE) AS eta) GROUP BY sample, eta""")
def with_grid(spark, d):
    return J.with_grid(C.library_size(t.clean(spark, d)), [-2.5, 0.0, 2.5], "eta")


@case("cross_tables", f"""WITH {t.CLEAN} SELECT sample, CAST(sum(reads) AS BIGINT) AS depth, n_nationkey AS nation FROM clean, nation GROUP BY 1, 3""")
def cross_tables(spark, d):
    nations = t.table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"))
    return J.cross_tables(C.library_size(t.clean(spark, d)), nations)


@case("bind", f"""WITH {t.CLEAN}, n AS (SELECT sample, CAST(sum(reads) AS BIGINT) AS depth FROM clean GROUP BY 1)
 SELECT sample, depth, (SELECT min(depth) FROM n) AS min_depth FROM n""")
def bind(spark, d):
    c = t.clean(spark, d)
    return J.bind(C.library_size(c), C.min_depth(c))


@case("truth_vs_estimate", f"""WITH {t.DRAWS}, e AS (SELECT parameter, chain, avg(value) AS estimate FROM draws GROUP BY 1, 2), t AS (SELECT parameter, chain, quantile_cont(value, 0.5) AS truth FROM draws GROUP BY 1, 2)
 SELECT parameter, chain, round(estimate, 6) AS estimate, round(truth, 6) AS truth, round(estimate - truth, 6) AS error FROM e JOIN t USING (parameter, chain)""")
def truth_vs_estimate(spark, d):
    from countgrove.plans.ranking import median_of
    x = t.draws(spark, d)
    est = x.groupBy("parameter", "chain").agg(F.avg("value").alias("estimate"))
    return J.truth_vs_estimate(est, median_of(x, "value", ["parameter", "chain"], "truth"), ["parameter", "chain"])


# ------------------------------------------------------------------ aggregates

MOMENTS = """cells AS (SELECT method, count(DISTINCT site) AS n FROM mtaxa GROUP BY 1),
 mv AS (SELECT taxon, method, CAST(sum(reads) AS DOUBLE) / max(n) AS mean,
  CASE WHEN max(n) > 1 THEN (sum(CAST(reads AS DOUBLE) * reads) - CAST(sum(reads) AS DOUBLE) * sum(reads) / max(n)) / (max(n) - 1) END AS variance
  FROM mtaxa JOIN cells USING (method) GROUP BY 1, 2)"""


@case("mean_var_dense", f"WITH {t.MTAXA}, {MOMENTS} SELECT taxon, method, round(mean, 6) AS mean, round(variance, 6) AS variance FROM mv")
def mean_var_dense(spark, d):
    return A.mean_var(t.method_taxa(spark, d), ["taxon", "method"], dense_over="site", scope="method")


@case("mean_var_sd", """SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS variance,
 round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY 1, 2""")
def mean_var_sd(spark, d):
    return A.mean_var(t.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", sd=True, dense_over=None)


@case("log_var", f"WITH {t.MTAXA}, {MOMENTS} SELECT taxon, method, round(log10(variance + 1), 6) AS log_variance FROM mv")
def log_var(spark, d):
    return A.log_var(A.mean_var(t.method_taxa(spark, d), ["taxon", "method"], dense_over="site", scope="method")).select("taxon", "method", "log_variance")


@case("observed_features", f"WITH {t.CLEAN} SELECT sample, count(*) FILTER (reads > 0) AS observed FROM clean GROUP BY 1")
def observed_features(spark, d):
    return A.observed_features(t.clean(spark, d))


@case("share_mean_var", f"""WITH {t.CLEAN}, s AS (SELECT feature, CAST(reads AS DOUBLE) / sum(reads) OVER (PARTITION BY sample) AS p FROM clean)
 SELECT feature, round(avg(p), 8) AS mean_share, round(var_samp(p), 8) AS var_share FROM s GROUP BY 1""")
def share_mean_var(spark, d):
    return A.share_mean_var(t.clean(spark, d))


TREE = t.CLEAN + ", " + t.LINEAGE + """, leaf AS (SELECT kingdom, phylum, class, "order" AS o, sample, sum(reads) AS reads FROM clean JOIN lineage USING (feature) GROUP BY ALL),
 tree AS (SELECT taxon, depth, sample, CAST(sum(reads) AS BIGINT) AS reads FROM (
  SELECT kingdom AS taxon, 1 AS depth, sample, reads FROM leaf UNION ALL SELECT kingdom || '|' || phylum, 2, sample, reads FROM leaf
  UNION ALL SELECT kingdom || '|' || phylum || '|' || class, 3, sample, reads FROM leaf
  UNION ALL SELECT kingdom || '|' || phylum || '|' || class || '|' || o, 4, sample, reads FROM leaf) GROUP BY 1, 2, 3)"""
RANKS = ["kingdom", "phylum", "class", "order"]


@case("taxon_tree_sum", f"WITH {TREE} SELECT * FROM tree")
def taxon_tree_sum(spark, d):
    return L.taxon_tree_sum(t.clean(spark, d), t.lineage(spark, d), RANKS)


@case("taxon_tree_sum_by_method", f"""WITH {t.LINES}, {t.LINEAGE}, leaf AS (SELECT kingdom, phylum, class, "order" AS o, method, sum(reads) AS reads FROM lines JOIN lineage USING (feature) GROUP BY ALL)
 SELECT taxon, depth, method, CAST(sum(reads) AS BIGINT) AS reads FROM (SELECT kingdom AS taxon, 1 AS depth, method, reads FROM leaf UNION ALL
 SELECT kingdom || '|' || phylum, 2, method, reads FROM leaf UNION ALL SELECT kingdom || '|' || phylum || '|' || class, 3, method, reads FROM leaf
 UNION ALL SELECT kingdom || '|' || phylum || '|' || class || '|' || o, 4, method, reads FROM leaf) GROUP BY 1, 2, 3""")
def taxon_tree_sum_by_method(spark, d):
    x = t.lines(spark, d).select("feature", "method", "reads")
    return L.taxon_tree_sum(x, t.lineage(spark, d), RANKS, by=["method"])


@case("n_obs", f"""WITH {t.LINEAGE} SELECT taxon, depth, count(DISTINCT feature) AS n_obs FROM (SELECT kingdom AS taxon, 1 AS depth, feature FROM lineage
 UNION ALL SELECT kingdom || '|' || phylum, 2, feature FROM lineage UNION ALL SELECT kingdom || '|' || phylum || '|' || class, 3, feature FROM lineage) GROUP BY 1, 2""")
def n_obs(spark, d):
    return L.n_obs(t.lineage(spark, d), RANKS, keep_rank="class")


@case("n_samples", f"WITH {TREE} SELECT taxon, count(*) FILTER (reads > 0) AS n_samples FROM tree GROUP BY 1")
def n_samples(spark, d):
    return L.n_samples(L.taxon_tree_sum(t.clean(spark, d), t.lineage(spark, d), RANKS))


@case("tree_proportions", f"""WITH {TREE} SELECT taxon, depth, sample, reads, round(CAST(reads AS DOUBLE) / nullif(sum(reads) OVER (PARTITION BY sample, depth), 0), 6) AS share FROM tree""")
def tree_proportions(spark, d):
    return L.tree_proportions(L.taxon_tree_sum(t.clean(spark, d), t.lineage(spark, d), RANKS))


@case("tally", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2")
def tally(spark, d):
    return J.sort_result(A.tally(t.table(spark, d, "part"), ["p_brand", "p_type"]), ["n", "p_brand", "p_type"], descending="n")


@case("contingency", """SELECT lang, source, quality, toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2, 3, 4""")
def contingency(spark, d):
    x = t.table(spark, d, "documents").join(t.table(spark, d, "labels"), "doc_id")
    return A.contingency(x, ["lang", "source", "quality", "toxic"])


@case("lump_rare", f"""WITH {UNITED}, n AS (SELECT combination, count(*) AS n FROM united GROUP BY 1)
 SELECT o_custkey, CASE WHEN n < 60 THEN 'others' WHEN combination = 'fast_paid' THEN 'fast' ELSE combination END AS combination FROM united JOIN n USING (combination)""")
def lump_rare(spark, d):
    return A.lump_rare(_united(spark, d), "combination", 60, merges={"fast_paid": "fast"})


SBC = t.MTAXA + """, x AS (SELECT taxon, locality, reads FROM mtaxa JOIN sites ON site = sample)"""


def _by_locality(spark, d):
    s = t.sites(spark, d).select(F.col("sample").alias("site"), "locality")
    return t.method_taxa(spark, d).join(s, "site")


@case("share_by_condition", f"""WITH {SBC}, r AS (SELECT locality, CASE WHEN CAST(reads AS DOUBLE) / sum(reads) OVER (PARTITION BY locality) < 0.001 THEN '< 0.1%' ELSE taxon END AS taxon, reads FROM x),
 g AS (SELECT locality, taxon, CAST(sum(reads) AS BIGINT) AS reads FROM r GROUP BY 1, 2) SELECT locality, taxon, reads, round(CAST(reads AS DOUBLE) / sum(reads) OVER (PARTITION BY locality), 6) AS share FROM g""")
def share_by_condition(spark, d):
    return A.share_by_condition(_by_locality(spark, d), "locality", "taxon")


@case("share_by_condition_per_taxon", f"""WITH {SBC}, s AS (SELECT locality, taxon, sum(reads) AS reads FROM x GROUP BY 1, 2),
 r AS (SELECT locality, CASE WHEN CAST(reads AS DOUBLE) / sum(reads) OVER (PARTITION BY locality) < 0.005 THEN '< 0.1%' ELSE taxon END AS taxon, reads FROM s),
 g AS (SELECT locality, taxon, CAST(sum(reads) AS BIGINT) AS reads FROM r GROUP BY 1, 2) SELECT locality, taxon, reads, round(CAST(reads AS DOUBLE) / sum(reads) OVER (PARTITION BY locality), 6) AS share FROM g""")
def share_by_condition_per_taxon(spark, d):
    return A.share_by_condition(_by_locality(spark, d), "locality", "taxon", 0.005, per_label=True)


BINS = """r AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 20.0::DOUBLE AS w FROM orders),
 bins AS (SELECT CAST(trunc((o_totalprice - lo) / w) AS BIGINT) AS b, o_totalprice, w FROM orders, r)"""


@case("bin_equal", f"WITH {BINS} SELECT b, count(*) AS n, round(avg(o_totalprice), 4) AS mean_o_totalprice FROM bins GROUP BY 1")
def bin_equal(spark, d):
    return A.bin_equal(t.table(spark, d, "orders"), "o_totalprice", 20)


@case("binned_density", f"""WITH {BINS} SELECT b, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, round(max(w), 4) AS width,
 round(100000 * count(*) / (sum(count(*)) OVER ()) / max(w), 4) AS p FROM bins GROUP BY 1""")
def binned_density(spark, d):
    return A.binned_density(t.table(spark, d, "orders"), "o_totalprice", 20).withColumn("p", F.col("p") * 100000)


@case("weighted_density", """SELECT CAST(trunc(l_discount * 20) AS BIGINT) AS b, round(sum(l_quantity), 6) AS n, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS mean,
 round(avg(l_quantity), 6) AS mean_weight, round(sum(l_quantity) / (sum(sum(l_quantity)) OVER ()) * 20, 6) AS p FROM lineitem GROUP BY 1""")
def weighted_density(spark, d):
    return A.weighted_density(t.table(spark, d, "lineitem"), "l_discount", "l_quantity", 20)


@case("quantiles", f"""WITH {t.CLEAN}, n AS (SELECT sample, sum(reads) AS depth FROM clean GROUP BY 1)
 SELECT round(CAST(min(depth) AS DOUBLE), 6) AS q0, round(quantile_cont(depth, 0.05), 6) AS q05, round(quantile_cont(depth, 0.5), 6) AS q50, round(quantile_cont(depth, 0.9), 6) AS q90 FROM n""")
def quantiles(spark, d):
    return A.quantiles(C.library_size(t.clean(spark, d)), "depth", {"q0": 0.0, "q05": 0.05, "q50": 0.5, "q90": 0.9})


@case("quantiles_by_group", """SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.1), 6) AS q10, round(quantile_cont(l_extendedprice, 0.75), 6) AS q75 FROM lineitem GROUP BY 1""")
def quantiles_by_group(spark, d):
    return A.quantiles(t.table(spark, d, "lineitem"), "l_extendedprice", {"q10": 0.1, "q75": 0.75}, "l_suppkey")


@case("n_distinct", f"WITH {t.CLEAN} SELECT sample, count(DISTINCT feature) AS n_distinct FROM clean GROUP BY 1")
def n_distinct(spark, d):
    return A.n_distinct(t.clean(spark, d), "feature", "sample")


@case("sum_by", """SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_tax), 2) AS l_tax FROM lineitem GROUP BY 1""")
def sum_by(spark, d):
    return A.sum_by(t.table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_tax"])


GRID = """g AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS c_acctbal FROM customer GROUP BY 1, 2)"""


def _grid(spark, d):
    return A.mean_by(t.table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], "c_acctbal")


@case("mean_by", f"WITH {GRID} SELECT c_mktsegment, round(avg(c_acctbal), 6) AS c_acctbal FROM g GROUP BY 1")
def mean_by(spark, d):
    return A.mean_by(_grid(spark, d), "c_mktsegment", "c_acctbal")


@case("histogram", """WITH x AS (SELECT l_returnflag, log10(l_extendedprice) AS v FROM lineitem), r AS (SELECT l_returnflag, min(v) AS lo, (max(v) - min(v)) / 30.0::DOUBLE AS w FROM x GROUP BY 1)
 SELECT l_returnflag, CAST(trunc((v - lo) / w) AS BIGINT) AS b, count(*) AS n FROM x JOIN r USING (l_returnflag) GROUP BY 1, 2""")
def histogram(spark, d):
    x = C.log_transform(t.table(spark, d, "lineitem"), "l_extendedprice", "log10", "v")
    return A.histogram(x, "v", 30, "l_returnflag")


STRANDS = """s AS (SELECT feature, CAST(coalesce(sum(reads) FILTER (strand = 'R1'), 0) AS BIGINT) AS total_1, CAST(coalesce(sum(reads) FILTER (strand = 'R2'), 0) AS BIGINT) AS total_2 FROM lines GROUP BY 1)"""


@case("strand_difference", f"WITH {t.LINES}, {STRANDS} SELECT *, abs(total_1 - total_2) AS difference FROM s")
def strand_difference(spark, d):
    return A.strand_difference(t.lines(spark, d))


@case("max_by_group", f"""WITH {t.LINES}, {STRANDS}, {t.LINEAGE}, e AS (SELECT phylum, log2((total_1 + 1.0) / (total_2 + 1.0)) AS logfc FROM s JOIN lineage USING (feature))
 SELECT phylum, round(max(logfc), 6) AS max_logfc, round(pow(2, max(logfc)), 6) AS fold_change FROM e GROUP BY 1""")
def max_by_group(spark, d):
    s = A.strand_difference(t.lines(spark, d)).join(t.lineage(spark, d), "feature")
    return A.max_by_group(s.withColumn("logfc", F.log2((F.col("total_1") + 1) / (F.col("total_2") + 1))), "phylum", "logfc")


# ------------------------------------------------------------------ windows


@case("group_total", f"WITH {t.CLEAN} SELECT feature, sample, reads, CAST(sum(reads) OVER (PARTITION BY sample) AS BIGINT) AS total FROM clean")
def group_total(spark, d):
    return W.group_total(t.clean(spark, d), "sample")


@case("rank_avg", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS rank FROM lineitem""")
def rank_avg(spark, d):
    return W.rank_avg(t.table(spark, d, "lineitem"), "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "rank")


@case("rank_avg_by_group", f"""WITH {t.CLEAN} SELECT feature, sample, reads, rank() OVER (PARTITION BY sample ORDER BY reads) + (count(*) OVER (PARTITION BY sample, reads) - 1) / 2.0::DOUBLE AS rank FROM clean""")
def rank_avg_by_group(spark, d):
    return W.rank_avg(t.clean(spark, d), "reads", "sample")


RESCALE = """present AS (SELECT * FROM brands WHERE reads > 0), ls AS (SELECT feature, sample, ln(CAST(reads AS DOUBLE) / sum(reads) OVER (PARTITION BY sample)) AS log_share FROM present),
 fs AS (SELECT feature, avg(log_share) AS m, stddev_samp(log_share) AS s FROM ls GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT sample) FROM present)),
 rescaled AS (SELECT feature, sample, log_share, (log_share - m) / s AS rescaled FROM ls JOIN fs USING (feature))"""


@case("rescale_log_share", f"WITH {t.BRANDS}, {RESCALE} SELECT feature, sample, round(log_share, 6) AS log_share, round(rescaled, 6) AS rescaled FROM rescaled")
def rescale_log_share(spark, d):
    return W.rescale_log_share(t.brand_counts(spark, d))


@case("zscore_by", f"""WITH {GRID} SELECT c_nationkey, c_mktsegment, round((c_acctbal - avg(c_acctbal) OVER w) / nullif(stddev_samp(c_acctbal) OVER w, 0), 6) AS c_acctbal
 FROM g WINDOW w AS (PARTITION BY c_nationkey)""")
def zscore_by(spark, d):
    return W.zscore_by(_grid(spark, d), "c_acctbal", "c_nationkey").select("c_nationkey", "c_mktsegment", "c_acctbal")


@case("order_index", """SELECT vec_id, label, row_number() OVER (ORDER BY label, vec_id) AS position FROM embeddings""")
def order_index(spark, d):
    return W.order_index(t.table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id")


@case("first_of_group", """SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1""")
def first_of_group(spark, d):
    return W.first_of_group(t.table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id")


@case("distinct_keep_first", """SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def distinct_keep_first(spark, d):
    return W.distinct_keep_first(t.table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"),
                                 "o_custkey", ["o_orderdate", "o_orderkey"])


# ------------------------------------------------------------------ order, limits, sets


@case("head_tail", f"""WITH {t.LINES}, {STRANDS}, x AS (SELECT *, abs(total_1 - total_2) AS difference FROM s)
 (SELECT *, 'head' AS "end" FROM x ORDER BY difference, feature LIMIT 10) UNION ALL (SELECT *, 'tail' FROM x ORDER BY difference DESC, feature LIMIT 10)""")
def head_tail(spark, d):
    return J.head_tail(A.strand_difference(t.lines(spark, d)), "difference", 10, "feature")


@case("rank_above", f"""WITH {t.CLEAN}, n AS (SELECT feature, CAST(sum(reads) AS BIGINT) AS total FROM clean GROUP BY 1),
 r AS (SELECT feature, total, rank() OVER (ORDER BY total) + (count(*) OVER (PARTITION BY total) - 1) / 2.0::DOUBLE AS rank FROM n) SELECT * FROM r WHERE rank > 100""")
def rank_above(spark, d):
    return J.rank_above(C.feature_totals(t.clean(spark, d)), "total", 100)


@case("sort_result", "SELECT c_custkey, c_mktsegment, round(c_acctbal, 6) AS c_acctbal FROM customer")
def sort_result(spark, d):
    return J.sort_result(t.table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_acctbal", "c_custkey"], "c_acctbal")


@case("order_columns", "SELECT c_custkey, c_mktsegment, c_name, c_nationkey FROM customer")
def order_columns(spark, d):
    return J.order_columns(t.table(spark, d, "customer").drop("c_acctbal"), "c_name")


@case("append", """SELECT o_orderkey AS id, o_orderpriority AS text, NULL AS lang FROM orders UNION ALL SELECT doc_id, NULL, lang FROM documents""")
def append(spark, d):
    a = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"))
    return J.append(a, t.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"))


@case("append_runs", f"WITH {RUNS} SELECT *, CAST(1 AS BIGINT) AS rep FROM run1 UNION ALL SELECT *, 2 FROM run2")
def append_runs(spark, d):
    return J.append_runs(_runs(spark, d))


@case("distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct(spark, d):
    return J.distinct(t.table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@case("duplicates", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark, d):
    return J.duplicates(t.table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@case("frame_diff", f"""WITH {RUNS} SELECT *, 'left' AS side FROM (SELECT * FROM run1 EXCEPT ALL SELECT * FROM run2)
 UNION ALL SELECT *, 'right' FROM (SELECT * FROM run2 EXCEPT ALL SELECT * FROM run1)""")
def frame_diff(spark, d):
    return J.frame_diff(*_runs(spark, d))


@case("bootstrap_within")
def bootstrap_within(spark, d):
    c = t.brand_counts(spark, d)
    return W.bootstrap_within(c, "sample", ["sample", "feature"], "reads", 3, seed=7)


@case("shuffle")
def shuffle(spark, d):
    return W.shuffle(t.brand_counts(spark, d), ["sample", "feature"], "reads", 2, seed=7)
