import numpy as np
import pytest
from pyspark.sql import functions as F

from countgrove.operators import counts as C
from countgrove.operators import lineage as L
from countgrove.operators import resampling as X
from countgrove.sources import tables as S
from tests.helpers import frame, table


def test_decontaminate_cases(spark):
    df = spark.createDataFrame(
        [("a", "s", 7), ("b", "s", 7), ("b", "CONT_1", 5), ("c", "s", 7), ("c", "CONT_1", 7), ("d", "s", 7),
         ("d", "CONT_1", 4), ("d", "CONT_2", 5), ("e", "CONT_1", 3)], "feature string, sample string, reads long")
    got = {r["feature"]: r["reads"] for r in C.decontaminate(df, F.col("sample").startswith("CONT")).collect()}
    assert got == {"a": 7, "b": 2, "c": 0, "d": 0}


@pytest.mark.parametrize("text, want", [
    ("k__Bacteria|p__Firmicutes|unknown", "k__Bacteria|p__Firmicutes|unknown__Firmicutes_p"),
    ("k__Bacteria|unknown|c__Bacilli", "k__Bacteria|unknown__Bacilli_c|c__Bacilli"),
    ("k__Bacteria|p__X|c__Y", "k__Bacteria|p__X|c__Y"),
    ("Bacteria|uncultured|*", "Bacteria|unknown__Bacteria_B|unknown__Bacteria_B"),
    ("unknown|unknown", None)])
def test_repair_lineage_deepest(spark, text, want):
    df = spark.createDataFrame([(text,)], "lineage string")
    assert df.select(L.repair_lineage_deepest("lineage")).first()[0] == want


def test_cascade_collapses_prefixes(spark):
    df = spark.createDataFrame([("Fungi", None, "*", "Genus_sp")], "k string, p string, c string, s string")
    assert tuple(L.repair_lineage_cascade(df, ["k", "p", "c", "s"]).first()) == (
        "Fungi", "unidentified_Fungi", "unidentified_Fungi", "unidentified_Fungi")


def test_rarefy_draw_invariants_and_limit(spark):
    m = table(20, 4, seed=2, high=200)
    df = frame(spark, m)
    depth = 150
    a = {(r["feature"], r["sample"]): r["reads"] for r in X.rarefy_draw(df, depth, seed=5).collect()}
    b = {(r["feature"], r["sample"]): r["reads"] for r in X.rarefy_draw(df.repartition(3), depth, seed=5).collect()}
    assert a == b
    for j in range(4):
        assert sum(v for (f, s), v in a.items() if s == f"s{j:02d}") == min(depth, m[:, j].sum())
    assert all(v <= m[int(f[1:]), int(s[1:])] for (f, s), v in a.items())
    mean = {(r["feature"], r["sample"]): r["reads"] for r in X.rarefy_average(df, depth, 400, seed=6).collect()}
    exact = {(r["feature"], r["sample"]): r["reads"] for r in C.rarefy_expected(df, depth).collect()}
    assert max(abs(mean.get(k, 0) - v) for k, v in exact.items()) <= 1


def test_rarefaction_curve_ends_at_richness(spark):
    m = table(10, 3, seed=4)
    rows = C.rarefaction_curve(frame(spark, m), 20).collect()
    for j in range(3):
        mine = {r["subsample"]: r["richness"] for r in rows if r["sample"] == f"s{j:02d}"}
        assert np.isclose(mine[m[:, j].sum()], (m[:, j] > 0).sum()) and np.isclose(mine[1], 1)


def test_pseudocounts_fill_every_empty_group(spark):
    m = table(15, 6, seed=7, zeros=0.8)
    g = spark.createDataFrame([(f"s{j:02d}", "A" if j < 3 else "B") for j in range(6)], "sample string, group string")
    out = {(r["feature"], r["sample"]): r["reads"] for r in X.pseudocount_empty_groups(frame(spark, m), g).collect()}
    for i in range(15):
        for cols in (range(3), range(3, 6)):
            got = [out.get((f"f{i:02d}", f"s{j:02d}"), 0) for j in cols]
            want = m[i, list(cols)]
            assert list(want) == got if want.sum() else sum(got) == 1


def test_permuted_cells_keep_the_values(spark):
    m = table(9, 5, seed=8)
    rows = X.permute_cells(frame(spark, m), 3, seed=2).collect()
    for rep in (1, 2, 3):
        mine = [r for r in rows if r["rep"] == rep]
        assert len({(r["feature"], r["sample"]) for r in mine}) == (m > 0).sum()
        assert sorted(r["reads"] for r in mine) == sorted(m[m > 0])


def test_load_or_compute_runs_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "t")
    assert S.load_or_compute(spark, path, make).count() == S.load_or_compute(spark, path, make).count() == 3
    assert len(calls) == 1


def test_bad_arguments(spark):
    df = frame(spark, table())
    with pytest.raises(ValueError):
        C.hellinger(df, "row")
    with pytest.raises(ValueError):
        C.rarefaction_curve(df, 0)
    with pytest.raises(ValueError):
        X.rarefy_draw(df, 0)


def test_curve_blocks_and_deep_samples(spark, monkeypatch):
    """Blocks leave no depth out, and a deep sample is met block by block."""
    import math

    from countgrove.operators import counts as C

    reads = {"a": [3, 3, 9, 40], "b": [1], "c": [7, 2]}
    df = spark.createDataFrame([(f"f{i}", s, r) for s, v in reads.items() for i, r in enumerate(v)], "feature string, sample string, reads long")
    monkeypatch.setattr(C, "GRID", 4)
    got = {(r["sample"], r["subsample"]): r["richness"] for r in C.rarefaction_curve(df, 3).collect()}
    want = {}
    for s, v in reads.items():
        n = sum(v)
        for d in {*range(1, n + 1, 3), n}:
            want[s, d] = sum(1 - math.comb(n - r, d) / math.comb(n, d) for r in v)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    deep = spark.createDataFrame([("f0", "s", 999_000_000), ("f1", "s", 1_000_000)], "feature string, sample string, reads long")
    assert C.rarefaction_curve(deep, 20_000).count() == 50_001
