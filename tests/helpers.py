"""Small random count tables and brute-force references in numpy."""

import numpy as np


def table(n_features=12, n_samples=6, seed=0, zeros=0.5, high=60):
    rng = np.random.default_rng(seed)
    m = rng.integers(1, high, (n_features, n_samples)) * (rng.random((n_features, n_samples)) > zeros)
    m[0] = rng.integers(1, high, n_samples)
    m[:, 0] = np.maximum(m[:, 0], 1)
    return m


def frame(spark, m):
    rows = [(f"f{i:02d}", f"s{j:02d}", int(m[i, j])) for i, j in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "feature string, sample string, reads long")


def avg_rank(x):
    x = np.asarray(x, float)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
