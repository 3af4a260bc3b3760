"""Relabelling tests of pair tables against plain loops over permutations."""

from itertools import combinations, permutations

import numpy as np
import pytest

from countgrove.operators import inference as H
from countgrove.plans import permuted_tiles as P

from .helpers import avg_rank


def distances(n, seed, decimals=1):
    points = np.random.default_rng(seed).random((n, 2)) * 4
    return np.round(np.linalg.norm(points[:, None] - points[None], axis=2), decimals)


def pairs(spark, m, drop=(), turn=False):
    rows = [(f"s{j}", f"s{i}", float(m[i, j])) if turn and (i + j) % 2 else (f"s{i}", f"s{j}", float(m[i, j]))
            for i, j in combinations(range(len(m)), 2) if (i, j) not in drop]
    return spark.createDataFrame(rows, "s1 string, s2 string, value double")


def mantel_by_loop(x, y, orders, method, drop=()):
    at = [p for p in combinations(range(len(x)), 2)]
    held = [p for p in at if p not in drop]
    rank = avg_rank if method == "spearman" else lambda v: v
    xv = dict(zip(held, rank([x[p] for p in held])))
    yv = dict(zip(at, rank([y[p] for p in at])))

    def r(order):
        moved = [yv[tuple(sorted((order[i], order[j])))] for i, j in held]
        return np.corrcoef([xv[p] for p in held], moved)[0, 1]

    observed = r(range(len(x)))
    hits = sum(r(o) >= observed - 1e-12 for o in orders)
    return observed, hits


@pytest.mark.parametrize("method", ["spearman", "pearson"])
@pytest.mark.parametrize("block", [2, 512])
def test_all_orders_of_five_samples_give_the_exact_p(spark, method, block):
    x, y = distances(5, 1), distances(5, 2)
    y = y + x / 2
    drop = ((0, 3),) if method == "pearson" else ()
    orders = list(permutations(range(5)))
    r, hits = mantel_by_loop(x, y, orders, method, drop)
    got = H.mantel(pairs(spark, x, drop, turn=True), pairs(spark, y), method, n_perm=9999, block=block).first()
    assert got["n_perm"] == 119 and np.isclose(got["r"], r) and np.isclose(got["p"], hits / 120)   # the identity counts itself


def test_tiles_and_replicates_agree_with_a_loop(spark):
    """Many tiles, samples that only one table has, and sampled relabellings."""
    x, y = distances(11, 3), distances(12, 4)
    n, times = 11, 200
    orders = P.relabelled(np.arange(n), n, np.arange(1, times + 1), 7)
    r, hits = mantel_by_loop(x, y[:n, :n], orders, "spearman")
    for block in (4, 512):
        got = H.mantel(pairs(spark, x), pairs(spark, y), n_perm=times, seed=7, block=block).first()
        # indexes follow the names' order, which differs from the numbers' (s10 before s2)
        assert got["n_perm"] == times and np.isclose(got["r"], r)
    names = sorted(range(n), key=lambda i: f"s{i}")
    r, hits = mantel_by_loop(x[np.ix_(names, names)], y[np.ix_(names, names)], orders, "spearman")
    assert np.isclose(got["p"], (hits + 1) / (times + 1))


def test_relabellings_are_one_to_one_and_even():
    for n in (1, 2, 5, 17, 64, 1000):
        maps = P.relabelled(np.arange(n), n, np.arange(5), 3)
        assert (np.sort(maps, axis=1) == np.arange(n)).all() and (maps[0] == np.arange(n)).all()
    part = P.relabelled(np.array([900, 3]), 1000, np.arange(5), 3)
    assert (part == maps[:, [900, 3]]).all()
    drawn = P.relabelled(np.arange(4), 4, np.arange(1, 24001), 5)
    seen = np.unique(drawn @ np.array([64, 16, 4, 1]), return_counts=True)[1]
    assert len(seen) == 24 and ((seen - 1000) ** 2 / 1000).sum() < 49.7   # 0.1 % point, 23 degrees
    listed = {tuple(o) for o in P.enumerated(np.arange(4), 4, np.arange(24))}
    assert listed == set(permutations(range(4)))


def test_class_p_of_all_orders(spark):
    x, g = distances(5, 8), distances(5, 9, 3)
    at = list(combinations(range(5), 2))
    rank = dict(zip(at, avg_rank([x[p] for p in at])))
    low, high = min(g[p] for p in at), max(g[p] for p in at)
    k = int(np.ceil(np.log2(len(at)) + 1))
    cls = {p: min(int((g[p] - low) / ((high - low) / k)), k - 1) for p in at}
    expected = {}
    for c in set(cls.values()):
        def r(o, c=c):
            moved = [cls[tuple(sorted((o[i], o[j])))] == c for i, j in at]
            return -np.corrcoef([rank[p] for p in at], moved)[0, 1]
        observed = r(range(5))
        expected[c] = observed, sum(np.sign(observed) * r(o) >= abs(observed) - 1e-12 for o in permutations(range(5))) / 120
    for block in (2, 512):
        got = {r["class"]: r for r in H.mantel_correlogram(pairs(spark, x), pairs(spark, g), n_perm=999, block=block).collect()}
        assert got.keys() == expected.keys()
        for c, (r, p) in expected.items():
            assert np.isclose(got[c]["r"], r) and np.isclose(got[c]["p"], p)
    order = sorted(expected)
    for m, c in enumerate(order):   # Holm's correction over the classes up to it
        family = sorted((expected[o][1], o) for o in order[:m + 1])
        worst = 0.0
        for i, (p, o) in enumerate(family):
            worst = max(worst, p * (m + 1 - i))
            if o == c:
                assert np.isclose(got[c]["p_adjusted"], min(1.0, worst))


def test_tables_without_pairs_or_variation(spark):
    flat = pairs(spark, np.ones((4, 4)))
    assert H.mantel(flat, flat).first()["r"] is None
    none = pairs(spark, np.ones((1, 1)))
    assert H.mantel(none, none).first()["p"] is None


@pytest.mark.parametrize("block", [4, 16])
@pytest.mark.parametrize("drop", [(), ((0, 3), (5, 9))])
def test_sums_of_strips_agree_with_a_loop(spark, block, drop):
    """Tables with every pair and with gaps; tiles hold the sums of their pairs, each pair once."""
    x, y = distances(11, 5) - 1.0, distances(11, 6) - 1.0
    at = list(combinations(range(11), 2))
    tables = [spark.createDataFrame([(i, j, float(m[i, j])) for i, j in at if (i, j) not in gone], "i long, j long, v double")
              for m, gone in ((x, drop), (y, drop[:1]))]
    tiles = P._tiles(tables[1], block, True).selectExpr("sum(held)", "sum(total)", "sum(squares)").first()
    held = [y[p] for p in at if p not in drop[:1]]
    assert np.allclose(tiles, [len(held), sum(held), np.dot(held, held)])
    got = {r["rep"]: r for r in P.permuted_sums(*tables, 11, 20, False, 3, block=block).collect()}
    orders = P.relabelled(np.arange(11), 11, np.arange(21), 3)
    assert sorted(got) == list(range(21))
    for rep, o in enumerate(orders):
        both = [(x[p], y[o[p[0]], o[p[1]]]) for p in at if p not in drop and tuple(sorted((o[p[0]], o[p[1]]))) not in drop[:1]]
        a, b = np.array(both).T
        assert np.allclose([got[rep][c] for c in ("n", "x", "y", "xx", "yy", "xy")], [len(a), a.sum(), b.sum(), a @ a, b @ b, a @ b])
