import numpy as np
import pytest
from pyspark.sql import functions as F

from countgrove.operators import diversity as V
from countgrove.operators import inference as H
from countgrove.operators import resampling as X
from countgrove.plans import pair_blocks
from tests.helpers import avg_rank, frame, table


def beta(a, b, q):
    if q == 0:
        return ((a > 0) | (b > 0)).sum() / (((a > 0).sum() + (b > 0).sum()) / 2)
    p, r = a / a.sum(), b / b.sum()
    h = lambda x: -(x[x > 0] * np.log(x[x > 0])).sum()
    return np.exp(h((p + r) / 2) - (h(p) + h(r)) / 2)


@pytest.mark.parametrize("q", [0, 1])
def test_pairwise_beta_in_small_tiles(spark, monkeypatch, q):
    m = table(14, 7, seed=1, zeros=0.7)
    # Tiles of two rows and three features: several tiles and chunks.
    orig = pair_blocks.pair_sums
    monkeypatch.setattr(V, "pair_sums", lambda *a, **k: orig(*a, **k, block=2, chunk=3))
    rows = V.pairwise_beta(frame(spark, m), q).collect()
    assert len(rows) == 21
    for r in rows:
        want = beta(m[:, int(r["s1"][1:])], m[:, int(r["s2"][1:])], q)
        assert np.isclose(r["beta"], want) and 1 - 1e-9 <= r["beta"] <= 2 + 1e-9 and r["s1"] < r["s2"]


@pytest.mark.parametrize("q", [0, 1])
def test_samples_that_share_nothing_keep_their_pairs(spark, monkeypatch, q):
    orig = pair_blocks.pair_sums
    monkeypatch.setattr(V, "pair_sums", lambda *a, **k: orig(*a, **k, block=3, chunk=2))
    cells = [(f"f{i}", "wide", 1) for i in range(30)] + [(f"g{i}", f"s{i}", 2) for i in range(10)]
    df = spark.createDataFrame(cells, "feature string, sample string, reads long")
    rows = V.pairwise_beta(df, q).collect()
    assert len({(r["s1"], r["s2"]) for r in rows}) == len(rows) == 55
    assert all(np.isclose(r["beta"], 2.0) for r in rows)


def test_hill_order_and_one_feature(spark):
    rows = V.hill_numbers(frame(spark, table(20, 5, seed=3))).collect()
    assert all(r["hill_0"] >= r["hill_1"] >= r["hill_2"] for r in rows)
    one = spark.createDataFrame([("f", "s", 4)], "feature string, sample string, reads long")
    assert V.classic_indices(one).first()["pielou"] is None


def test_mean_phylo_distance(spark):
    m = table(6, 4, seed=5)
    rng = np.random.default_rng(1)
    d = rng.random((6, 6)); d = d + d.T; np.fill_diagonal(d, 0)
    dist = spark.createDataFrame([(f"f{i:02d}", f"f{j:02d}", float(d[i, j])) for i in range(6) for j in range(i + 1, 6)],
                                 "f1 string, f2 string, d double")
    p = m / m.sum(axis=0)
    for r in V.mean_phylo_distance(frame(spark, m), dist).collect():
        assert np.isclose(r["distance"], p[:, int(r["s1"][1:])] @ d @ p[:, int(r["s2"][1:])])


@pytest.mark.parametrize("block,chunk", [(512, 512), (3, 4), (1, 1), (50, 2)])
def test_triple_product_in_tiles(spark, block, chunk):
    rng = np.random.default_rng(2)
    x = rng.random((11, 9)) * (rng.random((11, 9)) < 0.4)
    x[:, 0] = x[3] = 0
    x[3, 5] = 1.0                     # a row of one key that has no distance
    d = np.triu(rng.random((9, 9)) * (rng.random((9, 9)) < 0.6), 1)
    d[5] = d[:, 5] = 0
    cells = [(f"s{i:02d}", f"f{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))] + [("s01", None, 9.0), (None, "f1", 9.0)]
    lines = [(f"f{j}", f"f{i}", float(d[i, j])) if (i + j) % 2 else (f"f{i}", f"f{j}", float(d[i, j]))
             for i, j in zip(*np.nonzero(d))] + [("f1", "absent", 3.0), ("f2", "f5", None)]
    got = pair_blocks.triple_sums(spark.createDataFrame(cells, "s string, f string, v double"),
                                  spark.createDataFrame(lines, "f1 string, f2 string, d double"), "s", "f", "v", block, chunk)
    rows = {(int(r["s1"][1:]), int(r["s2"][1:])): r["value"] for r in got.collect()}
    own = [i for i in range(11) if x[i].any() or i == 1]
    whole = x @ (d + d.T) @ x.T
    assert set(rows) == {(i, j) for i in own for j in own if i < j}
    assert all(np.isclose(v, whole[k]) for k, v in rows.items())


def test_null_models(spark):
    df = frame(spark, table(10, 5, seed=6, zeros=0.4))
    null = X.beta_null_permutation(df, 3, q=1, seed=2).collect()
    assert len(null) == 10 and all(1 <= r["null_mean"] <= 2 for r in null)
    pairs = V.pairwise_beta(df, 0)
    boot = X.beta_null_bootstrap(pairs, 5, seed=2).collect()
    by = {}
    for r in pairs.collect():
        by.setdefault(r["s1"], []).append(r["beta"])
    assert len(boot) == 10
    assert all(min(by[r["s1"]]) - 1e-9 <= r["null_mean"] <= max(by[r["s1"]]) + 1e-9 for r in boot)


@pytest.mark.parametrize("q", [0, 1])
@pytest.mark.parametrize("block,at_once", [(2048, 8), (3, 2)])
def test_spread_over_replicates(spark, q, block, at_once):
    frames = [frame(spark, table(9, 70, seed=k, zeros=0.6)).filter(f"sample != 's0{k}'").selectExpr("feature", "sample", "reads", f"{k}L rep") for k in range(1, 6)]
    df = frames[0].unionByName(frames[0].limit(0))
    for other in frames[1:]:
        df = df.unionByName(other)
    df = df.unionByName(spark.sql("SELECT 'f01' AS feature, 's99' AS sample, 3L AS reads, 2L AS rep"))
    kernel, finish, value = (pair_blocks.shared, V._beta_0, "reads") if q == 0 else (pair_blocks.shared_entropy, V._beta_1, "p")
    cells = V._shares(df, ["rep", "sample"])
    got = pair_blocks.pair_spread(cells, "sample", "feature", value, kernel, finish, "rep", 5, block=block, at_once=at_once)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert at_once < 5 or "stddev" not in plan and "HashAggregate" not in plan     # pairs are not grouped after their tile
    want = {}
    for r in V.pairwise_beta(df, q, within=["rep"]).collect():
        want.setdefault((r["s1"], r["s2"]), []).append(r["beta"])
    rows = {(r["s1"], r["s2"]): r for r in got.collect()}
    assert rows.keys() == want.keys() and got.count() == len(want) and ("s00", "s99") in rows
    for k, v in want.items():
        assert np.isclose(rows[k]["mean"], np.mean(v)) and (np.isclose(rows[k]["sd"], np.std(v, ddof=1)) if len(v) > 1 else rows[k]["sd"] is None)
    out = {(r["s1"], r["s2"]): r["m"] for r in V.pairwise_beta_spread(df, "rep", 5, q, "m", "d").collect()}
    assert out.keys() == want.keys() and all(np.isclose(out[k], np.mean(v)) for k, v in want.items())


@pytest.mark.parametrize("zeros", [0.0, 0.5])
def test_dense_entropy_equals_meetings(spark, monkeypatch, zeros):
    m = table(30, 70, seed=4, zeros=zeros) * (np.arange(70) != 5)
    m[:, 5] = 0
    m[29], m[29, 5] = 0, 3            # a sample that shares nothing
    found = []
    for gain in (0, 1e9):
        monkeypatch.setattr(pair_blocks, "DENSE_GAIN", gain)
        found.append({(r["s1"], r["s2"]): r["beta"] for r in V.pairwise_beta(frame(spark, m), 1).collect()})
    assert found[0].keys() == found[1].keys() and all(abs(v - found[1][k]) < 1e-12 for k, v in found[0].items())
    assert all(v == 2.0 for k, v in found[1].items() if "s05" in k)


def test_mantel_of_itself_is_one(spark):
    pairs = V.pairwise_beta(frame(spark, table(20, 7, seed=9)), 1).withColumnRenamed("beta", "value")
    r = H.mantel(pairs, pairs, n_perm=9, seed=3).first()
    assert np.isclose(r["r"], 1.0) and 0 < r["p"] <= 1


def test_row_correlation(spark):
    m = table(12, 5, seed=11)
    for method in ("pearson", "spearman"):
        x = m if method == "pearson" else np.apply_along_axis(avg_rank, 0, m)
        want = np.corrcoef(x.T)
        for r in H.row_correlation(frame(spark, m), method=method).collect():
            assert np.isclose(r["r"], want[int(r["s1"][1:]), int(r["s2"][1:])])


def test_permuted_cells_are_uniform(spark):
    cells = [(f"f{i}", f"s{j}", 1 + 4 * i + j) for i in range(3) for j in range(4)]
    df = spark.createDataFrame(cells, "feature string, sample string, reads long")
    rows = X.permute_cells(df, 3000, seed=4).collect()
    at = {}
    for r in rows:
        at.setdefault(r["rep"], {})[r["reads"]] = (r["feature"], r["sample"])
    assert all(sorted(v) == list(range(1, 13)) and len(set(v.values())) == 12 for v in at.values())
    places = {p: 0 for p in set(at[1].values())}
    for v in at.values():
        places[v[1]] += 1
    expected = len(at) / 12
    assert sum((n - expected) ** 2 / expected for n in places.values()) < 31.3   # 0.1 % point, 11 degrees
    same_feature = np.mean([v[1][0] == v[2][0] for v in at.values()])
    same_sample = np.mean([v[1][1] == v[5][1] for v in at.values()])
    assert abs(same_feature - 3 / 11) < 0.03 and abs(same_sample - 2 / 11) < 0.03


def test_shuffle_keeps_the_column(spark):
    from countgrove.operators.windows import shuffle

    df = spark.createDataFrame([(i, i % 7) for i in range(50)], "id long, v int")
    rows = shuffle(df, "id", "v", n_rep=2, seed=3).collect()
    for rep in (1, 2):
        own = [r for r in rows if r["rep"] == rep]
        assert sorted(r["shuffled"] for r in own) == sorted(i % 7 for i in range(50))
        assert [r["shuffled"] for r in sorted(own, key=lambda r: r["id"])] != [i % 7 for i in range(50)]


def test_group_means_need_no_pair_table(spark, monkeypatch):
    """Sums inside tiles equal those over the table of pairs, for one tile and for many tiles and chunks."""
    from countgrove.plans import pair_blocks

    df = frame(spark, table(30, 9, seed=12, zeros=0.6))
    groups = spark.createDataFrame([(f"s{i:02d}", "xyx"[i % 3] if i != 4 else None) for i in range(9)], "sample string, label string")
    real = pair_blocks.pair_moments
    for sizes in ({}, {"block": 2, "chunk": 4}):
        monkeypatch.setattr(V, "pair_moments", lambda *a, sizes=sizes, **k: real(*a, **k, **sizes))
        for q in (0, 1):
            pairs = V.pairwise_beta(df, q)
            want = {(r["group_1"], r["group_2"]): r for r in V.beta_by_group(pairs, groups.dropna(), "label").collect()}
            got = {(r["group_1"], r["group_2"]): r for r in V.beta_within_and_between(df, groups, "label", q).collect()}
            assert got.keys() == want.keys()
            for k, r in want.items():
                assert got[k]["n"] == r["n"] and got[k]["within"] == r["within"]
                assert np.isclose(got[k]["mean"], r["mean"])
                assert np.isclose(got[k]["sd"], r["sd"]) if r["n"] > 1 else got[k]["sd"] is None
            assert np.isclose(V.mean_pairwise_beta(df, q).first()[0], V.mean_beta(pairs).first()[0])
    keyed = df.withColumn("scenario", F.lit("a")).unionByName(df.filter("sample < 's05'").withColumn("scenario", F.lit("b")))
    rows = {r["scenario"]: r["mean_beta"] for r in V.mean_pairwise_beta(keyed, 0, ["scenario"]).collect()}
    want = {r["scenario"]: r["mean_beta"] for r in V.mean_beta(V.pairwise_beta(keyed, 0, ["scenario"]), ["scenario"]).collect()}
    assert rows.keys() == want.keys() and all(np.isclose(rows[k], want[k]) for k in want)


def test_draws_of_any_total():
    """Rejection agrees with the library's draw where both work, and holds its moments at 1e18 reads."""
    rng = np.random.default_rng(5)
    for good, bad, size in ((300_000_000, 600_000_000, 90_000_000), (40_000_000, 800_000_000, 500_000_000)):
        total = good + bad
        sd = np.sqrt(size * good / total * bad / total * (total - size) / (total - 1))
        mode = (size + 1) * (good + 1) // (total + 2)
        ours = np.sort([(X._rejected(rng, good, bad, size, mode, sd) - mode) / sd for _ in range(6000)])
        library = np.sort((rng.hypergeometric(good, bad, size, 6000) - mode) / sd)
        both = np.concatenate([ours, library])
        apart = np.abs(np.searchsorted(ours, both, side="right") - np.searchsorted(library, both, side="right")).max() / 6000
        assert apart < 1.95 * np.sqrt(2 / 6000)       # 0.1 % point of the two-sample test
    good, bad, size = 4 * 10 ** 17, 6 * 10 ** 17, 10 ** 17
    sd = np.sqrt(size * 0.4 * 0.6 * 0.9)
    drawn = [X._split(rng, good, bad, size) for _ in range(4000)]
    z = np.array([(v - size * 2 // 5) / sd for v in drawn])
    assert abs(z.mean()) < 4 / np.sqrt(4000) and abs(z.var() - 1) < 0.1 and len(set(drawn)) > 3990
    few = [X._split(rng, 20, 10 ** 18, 10 ** 17) for _ in range(4000)]     # narrow: 20 reads among 1e18
    assert abs(np.mean(few) - 2) < 0.1 and abs(np.var(few) - 1.8) < 0.2


def test_rarefaction_of_huge_samples(spark):
    reads = [6 * 10 ** 17, 3 * 10 ** 17, 10 ** 17, 5]
    df = spark.createDataFrame([(f"f{i}", "s", r) for i, r in enumerate(reads)], "feature string, sample string, reads long")
    got = {r["feature"]: r["reads"] for r in X.rarefy_draw(df, 10 ** 12, seed=3).collect()}
    assert sum(got.values()) == 10 ** 12 and abs(got["f0"] - 6 * 10 ** 11) < 5 * np.sqrt(10 ** 12 * 0.24)
    mean = {r["feature"]: r["reads"] for r in X.rarefy_average(df, 10 ** 12, 4, seed=3).collect()}
    assert abs(sum(mean.values()) - 10 ** 12) <= 4


@pytest.mark.parametrize("gain", [0, 10 ** 9])
def test_pair_tables_leave_their_tiles_finished(spark, monkeypatch, gain):
    """Met cells and matrix products agree with numpy, and no pair is shuffled or joined after its tile."""
    monkeypatch.setattr(pair_blocks, "DENSE_GAIN", gain)
    m = table(40, 11, seed=5, zeros=0.8)
    df = frame(spark, m).unionByName(spark.createDataFrame([(None, "s03", 7)], "feature string, sample string, reads long"))
    sums = pair_blocks.pair_sums(df, "sample", "feature", "reads", block=4)
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("FlatMapGroupsInArrow") and "Join" not in plan
    got = {(r["s1"], r["s2"]): r["value"] for r in sums.collect()}
    want = m.T.astype(float) @ m
    assert got == {(f"s{i:02d}", f"s{j:02d}"): want[i, j] for i in range(11) for j in range(i + 1, 11)}
    assert "Join" not in V.pairwise_beta(df, 0)._jdf.queryExecution().optimizedPlan().toString()


def test_bootstrap_moments_equal_those_of_the_draws(spark, monkeypatch):
    """No draw is written out, for one block of values a group and for many."""
    from countgrove.operators import windows as W

    rows = [("a", i, float(i * i)) for i in range(23)] + [("b", i, 2.0) for i in range(5)] + [("c", 0, 1.0), ("a", 99, None)]
    df = spark.createDataFrame(rows, "g string, i long, v double")
    want = {(r["g"], r["i"]): r for r in W.bootstrap_within(df, "g", ["g", "i"], "v", 40, seed=3).groupBy("g", "i").agg(
        F.avg("draw").alias("m"), F.stddev_samp("draw").alias("s")).collect()}
    for pool in (4, 4096):
        monkeypatch.setattr(W, "POOL", pool)
        out = W.bootstrap_spread(df, "g", ["g", "i"], "v", 40, 3)
        assert "transform" in out._jdf.queryExecution().optimizedPlan().toString() or "aggregate" in out._jdf.queryExecution().optimizedPlan().toString()
        got = {(r["g"], r["i"]): r for r in out.collect()}
        assert got.keys() == want.keys()
        assert all(np.isclose(got[k]["mean"], r["m"]) and np.isclose(got[k]["sd"], r["s"]) for k, r in want.items())


def test_lines_are_packed_without_loss():
    rng = np.random.default_rng(3)
    pos = rng.integers(0, 40, 900)
    for at, value in ((rng.integers(-1, 2 ** 40, 900), rng.standard_normal(900)), (np.arange(900) % 77, rng.integers(1, 9, 900) / 7),
                      (np.arange(900), np.where(np.arange(900) % 50, -0.5, np.nan))):
        data = pair_blocks._encoded(pos, at, value, 41)
        per_row, at_, value_ = pair_blocks._decoded(data)
        order = np.lexsort((at, pos))
        assert per_row.tolist() == np.bincount(pos, minlength=41).tolist() and (at_ == at[order]).all()
        assert np.array_equal(value_, value[order], equal_nan=True)
    whole = pair_blocks._encoded(np.repeat(np.arange(500), 100), np.tile(np.arange(100) * 9, 500), rng.integers(1, 50, 50_000).astype(float), 500)
    assert len(whole) < 50_000 * 4     # 20 bytes a cell before


@pytest.mark.parametrize("gain", [0, 1e9])
@pytest.mark.parametrize("kernel", [pair_blocks.dot, pair_blocks.shared, pair_blocks.shared_entropy])
def test_a_tile_is_added_up_in_strips(monkeypatch, gain, kernel):
    """No array of a whole tile is made: a strip of rows has PIECE pairs at most, eight times as many where cells are dense."""
    import pyarrow as pa

    for name, size in (("DENSE_GAIN", gain), ("PIECE", 60), ("MET", 50), ("SIDE", 5)):
        monkeypatch.setattr(pair_blocks, name, size)
    rng = np.random.default_rng(5)
    sides, full = [], []
    for n in (23, 17):
        m = rng.random((n, 40)) * (rng.random((n, 40)) < 0.3)
        r, c = np.nonzero(m)
        r, c, v = np.append(r, 0), np.append(c, -1), np.append(m[r, c], 3.0)     # one cell without an inner key
        line = {"_data": pair_blocks._encoded(r, c, v, n), "_rows": pa.array(range(n)), "_labels": pa.array([0] * n)}
        sides.append(pair_blocks._rows_of([line]))
        full.append(m)
    want = kernel(full[0][:, None, :], full[1][None, :, :])
    if kernel is pair_blocks.shared_entropy:
        want = np.where((full[0][:, None, :] > 0) & (full[1][None, :, :] > 0), want, 0.0)
    strips = list(pair_blocks._met(*sides, kernel, 7))
    assert len(strips) > 4 and all(s.size <= 480 for _, s in strips)
    assert [r.start for r, _ in strips] + [23] == [0] + [r.stop for r, _ in strips]
    assert np.allclose(np.vstack([s for _, s in strips]), want.sum(axis=2))


def test_null_of_samples_meets_pairs_where_they_are(spark):
    pairs = V.pairwise_beta(frame(spark, table(12, 40, seed=6)), 0)
    by = pairs.groupBy("s1").agg(F.avg("beta").alias("null_mean"), F.stddev_samp("beta").alias("null_sd"))
    same = pairs.select("s1", "s2").join(by, "s1")
    got, want = V.beta_nci(pairs, by, on="s1"), V.beta_nci(pairs, same)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (V.beta_nci(pairs, by, on="s1"), V.covariate_difference(pairs, by.withColumnRenamed("s1", "sample"), ["null_mean"])):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_draws_in_arrays_equal_those_of_spark(spark):
    """Hashes of many seeds at once, for texts of all lengths, whole numbers and NULL; other ids are hashed by Spark."""
    from countgrove.functions.hashing import chained
    from countgrove.operators import windows as W

    texts = ["", "a", "é😀", None, *("xyz0123456789" * 9)[:70].split("3"), *["q" * n for n in range(1, 70)]]
    rows = [(i, t, i - 40, i * 7 ** 17 - 2 ** 60) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i long, t string, n int, b long").withColumn("n", F.when(F.col("n") != 3, F.col("n"))).repartition(1)
    seeds = np.array([3, -5, 2 ** 62], dtype=np.int64)
    for column, kind in (("t", "string"), ("n", "int"), ("b", "bigint")):
        want = {r["i"]: r["h"] for r in df.select("i", F.array(*[F.xxhash64(F.lit(5), F.lit(int(s)), column) for s in seeds]).alias("h")).collect()}
        first = [r[0] for s in seeds for r in spark.range(1).select(F.xxhash64(F.lit(5), F.lit(int(s)))).collect()]
        got = chained([r[column] for r in df.orderBy("i").collect()], kind, np.array(first, dtype=np.int64).view(np.uint64))
        assert [list(r) for r in got.view(np.int64)] == [want[i] for i in range(len(texts))]
    # no lambda adds up draw by draw; ids of another type agree with the draws too
    data = spark.createDataFrame([("a", float(i), f"x{i}", float(i % 5)) for i in range(9)], "g string, i double, x string, v double")
    for ids in (["g", "x"], ["x", "g"], ["g", "i"]):
        out = W.bootstrap_spread(data, "g", ids, "v", 30, 3)
        assert "aggregate(sequence" not in out._jdf.queryExecution().optimizedPlan().toString()
        want = {tuple(r[k] for k in ids): r for r in W.bootstrap_within(data, "g", ids, "v", 30, seed=3).groupBy(*ids).agg(
            F.avg("draw").alias("m"), F.stddev_samp("draw").alias("s")).collect()}
        got = {tuple(r[k] for k in ids): r for r in out.collect()}
        assert got.keys() == want.keys() and all(np.isclose(got[k]["mean"], r["m"]) and np.isclose(got[k]["sd"], r["s"]) for k, r in want.items())


def test_products_of_three_leave_their_task_finished(spark):
    """No partial sum of a pair is added up after its task, and blocks of pairs of rows are large."""
    df = frame(spark, table(9, 70, seed=2, zeros=0.3))
    dist = spark.createDataFrame([(f"f{i:02d}", f"f{j:02d}", float(i + j)) for i in range(9) for j in range(i + 1, 9)], "f1 string, f2 string, d double")
    cells = df.withColumn("reads", F.col("reads").cast("double"))
    got = pair_blocks.triple_sums(cells, dist, "sample", "feature", "reads", chunk=4)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "CoGroup" not in plan and got.count() == 70 * 69 // 2
    rows = spark.range(6000).selectExpr("id AS k", "cast(id AS double) AS v")
    many = pair_blocks.row_pairs(rows, "k", "v")
    assert ", 36" in many._jdf.queryExecution().optimizedPlan().toString()     # pairs of 8 blocks, of 24 before
