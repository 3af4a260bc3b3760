"""Ordination and clustering.

One distributed aggregation builds a small cross-product matrix over the given columns;
only that matrix is decomposed on the driver, and scores are computed back on Spark.
Matrices of columns by columns reach the driver; rows and features do not.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import attach, dbl, names, ratio
from ..plans.low_rank import singular_triplets
from ..plans.pair_blocks import row_pairs
from ..plans.ranking import hashed_index
from ..plans.scratch import written


def _shifted_products(df: DataFrame, cols, weight: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums of products of [1, cols - shift] and the shift; rows with a NULL are left out.

    Each task adds up its own rows, shifted by the means of a first pass so that large means
    cost no digits; the driver receives one number per column pair, whatever the number of rows.
    """
    cols = names(cols)
    k = len(cols) + 1
    data = df.select(*[dbl(c).alias(f"x{i}") for i, c in enumerate(cols)],
                     (dbl(weight) if weight else F.lit(1.0)).alias("w")).dropna()
    first = data.agg(*[F.avg(f"x{i}") for i in range(len(cols))]).first()
    shift = np.array([v or 0.0 for v in first], dtype=float)

    def partial(batches):
        total = np.zeros((k, k))
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), pdf.iloc[:, :-1].to_numpy(float) - shift])
            total += (x * pdf["w"].to_numpy(float)[:, None]).T @ x
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    rows = data.mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((k, k))
    for r in rows:
        out[r["i"], r["j"]] = r["v"]
    return out, shift


def cross_products(df: DataFrame, cols, weight: str | None = None) -> np.ndarray:
    """Weighted sums of products of [1, cols]."""
    out, shift = _shifted_products(df, cols, weight)
    back = np.eye(len(out))
    back[1:, 0] = shift
    return back @ out @ back.T


def _moments(df: DataFrame, cols, weight: str | None = None):
    """n (or total weight), means and centred sums of products."""
    out, shift = _shifted_products(df, cols, weight)
    n = out[0, 0]
    if weight is None and n < 2:
        raise ValueError("fewer than two complete rows")
    off = out[0, 1:] / n
    return n, shift + off, out[1:, 1:] - n * np.outer(off, off)


def _eigen(m: np.ndarray, k: int):
    """Largest eigenpairs; the largest entry of each vector is positive."""
    val, vec = np.linalg.eigh((m + m.T) / 2)
    order = np.argsort(val)[::-1][:k]
    val, vec = np.maximum(val[order], 0.0), vec[:, order]
    sign = np.sign(vec[np.abs(vec).argmax(axis=0), range(vec.shape[1])])
    return val, vec * np.where(sign == 0, 1, sign)


def _axes_frame(spark, labels, matrix, label: str) -> DataFrame:
    rows = [(str(name), *map(float, row)) for name, row in zip(labels, matrix)]
    axes = ", ".join(f"axis_{i + 1} double" for i in range(matrix.shape[1]))
    return spark.createDataFrame(rows, f"{label} string, {axes}")


def _eigen_frame(spark, values, total: float) -> DataFrame:
    rows, run = [], 0.0
    for i, v in enumerate(values, start=1):
        run += v
        rows.append((i, float(v), float(v / total) if total else None, float(run / total) if total else None))
    return spark.createDataFrame(rows, "axis int, eigenvalue double, share double, cumulative double")


def _project(df: DataFrame, keep, cols, coef: np.ndarray, mean=None, scale=None) -> DataFrame:
    """keep columns and axis_<k> = sum over columns of (x - mean) / scale * coef."""
    mean = np.zeros(len(cols)) if mean is None else mean
    scale = np.ones(len(cols)) if scale is None else scale
    axes = []
    for a in range(coef.shape[1]):
        e = F.lit(0.0)
        for j, c in enumerate(cols):
            e = e + (dbl(c) - F.lit(float(mean[j]))) * F.lit(float(coef[j, a] / scale[j]))
        axes.append(e.alias(f"axis_{a + 1}"))
    return df.select(*names(keep), *axes)


def array_columns(df: DataFrame, key: str, col: str, size: int, prefix: str = "x") -> DataFrame:
    """A fixed-length array column as numeric columns."""
    return df.select(key, *[F.col(col)[i].cast("double").alias(f"{prefix}{i}") for i in range(size)])


def pca(df: DataFrame, key: str, cols, k: int = 2, standardise: bool = True) -> dict[str, DataFrame]:
    """Principal components: eigenvalues, loadings, scores."""
    cols = names(cols)
    n, mean, s = _moments(df, cols)
    sd = np.sqrt(np.diag(s) / (n - 1))
    scale = np.where(sd > 0, sd, 1.0) if standardise else np.ones(len(cols))
    c = s / (n - 1) / np.outer(scale, scale)
    val, vec = _eigen(c, k)
    spark = df.sparkSession
    return {"eigenvalues": _eigen_frame(spark, val, float(np.trace(c))),
            "loadings": _axes_frame(spark, cols, vec, "column"),
            "scores": _project(df.dropna(subset=cols), key, cols, vec, mean, scale)}


def truncated_svd(cells: DataFrame, k: int, row: str = "feature", column: str = "sample",
                  value: str = "value") -> dict[str, DataFrame]:
    """Largest singular values of a sparse matrix with L = U sqrt(D) and R = V sqrt(D).

    Rows and columns both stay on Spark (`plans/low_rank.py`). `singular_values` serves every rank up
    to k: share and running share of their sum over the k values, and their logarithm; `eigenvalues`
    are their squares with shares of the sum of squares of the whole matrix. An empty or zero matrix
    has no axes.
    """
    spark = cells.sparkSession
    x = written(cells.select(F.col(row).alias("row"), F.col(column).alias("column"), dbl(value).alias("x")).filter("x <> 0"), "matrix")
    total = x.agg(F.sum(F.col("x") * F.col("x"))).first()[0]
    if total is None:
        s, left, right = np.zeros(0), x.select("row"), x.select("column")
    else:
        s, left, right = singular_triplets(x, k)
    values = _eigen_frame(spark, s, float(s.sum())).select(
        "axis", F.col("eigenvalue").alias("singular_value"), "share", F.col("cumulative").alias("ratio"),
        F.log("eigenvalue").alias("log_value"))

    def scaled(df, key, name):
        return df.select(F.col(key).alias(name), *[(F.col(f"b{a}") * F.lit(float(np.sqrt(v)))).alias(f"axis_{a + 1}") for a, v in enumerate(s)])

    return {"singular_values": values, "eigenvalues": _eigen_frame(spark, s ** 2, float(total or 0.0)),
            "rows": scaled(left, "row", row), "columns": scaled(right, "column", column)}


def correspondence_analysis(counts: DataFrame, k: int = 2) -> dict[str, DataFrame]:
    """Correspondence analysis of a count table.

    The matrix p / sqrt(r c) has one trivial axis of singular value 1; the next axes are
    those of the chi-square residuals, so the table stays sparse.
    """
    x = written(counts.filter("reads > 0").select("feature", "sample", dbl("reads").alias("reads")), "counts")
    total = x.agg(F.sum("reads")).scalar()
    r = x.groupBy("feature").agg((F.sum("reads") / total).alias("_r"))
    c = x.groupBy("sample").agg((F.sum("reads") / total).alias("_c"))
    cells = x.join(r, "feature").join(c, "sample").select(
        "feature", "sample", (F.col("reads") / total / F.sqrt(F.col("_r") * F.col("_c"))).alias("value"))
    svd = truncated_svd(cells, k + 1)
    eig = svd["eigenvalues"].filter("axis > 1").select(
        (F.col("axis") - 1).alias("axis"), "eigenvalue",
        F.try_divide(F.col("eigenvalue"), F.col("eigenvalue") / F.col("share") - 1).alias("share"))

    def shifted(df, key, mass, m):
        # Standard coordinates: divide by the root of the mass.
        cols = [a for a in df.columns if a.startswith("axis_")][1:]
        return df.join(mass, key).select(key, *[
            (F.col(a) / F.sqrt(m)).alias(f"axis_{i}") for i, a in enumerate(cols, start=1)])

    return {"eigenvalues": eig, "features": shifted(svd["rows"], "feature", r, F.col("_r")),
            "samples": shifted(svd["columns"], "sample", c, F.col("_c"))}


# ------------------------------------------------------------------ constrained ordination


class Constrained:
    """Small matrices of one constrained ordination: every model on subsets of the
    covariates follows from them without another pass over the counts.

    s: weighted centred cross-products of the covariates; m: sum over features of
    b b' with b the covariate-by-feature products; total: inertia; n: samples.
    """

    def __init__(self, terms, s, m, total, n, mean, features, sites, weighted, levels=None, response=None):
        self.terms, self.s, self.m, self.total, self.n = terms, s, m, total, n
        self.cols = [c for own in terms.values() for c in own]
        self.mean, self.features, self.sites, self.weighted = mean, features, sites, weighted
        self.levels, self.response = levels or {}, response

    def _pick(self, cols):
        """Places of the columns of terms (a factor has one per level but the first)."""
        return [self.cols.index(c) for t in names(cols) for c in self.terms.get(t, [t])]

    def solve(self, x, condition=()):
        """Eigenvalues and covariate coefficients of Y ~ x, after removing `condition`."""
        ix, iz = self._pick(x), self._pick(condition)
        if iz:
            drop = self.s[np.ix_(ix, iz)] @ np.linalg.pinv(self.s[np.ix_(iz, iz)])
            s = self.s[np.ix_(ix, ix)] - drop @ self.s[np.ix_(iz, ix)]
            t = np.hstack([np.eye(len(ix)), -drop])
            m = t @ self.m[np.ix_(ix + iz, ix + iz)] @ t.T
        else:
            s, m = self.s[np.ix_(ix, ix)], self.m[np.ix_(ix, ix)]
        val, vec = np.linalg.eigh(s)
        keep = val > 1e-10 * max(val.max(), 1e-300)
        half = vec[:, keep] / np.sqrt(val[keep])
        lam, u = _eigen(half.T @ m @ half, int(keep.sum()))
        return lam, half @ u

    def r2(self, x, condition=()) -> float:
        return float(self.solve(x, condition)[0].sum() / self.total) if len(names(x)) else 0.0

    def adjusted(self, x, condition=()) -> float:
        """1 - (1 - R2)(n - 1)/(n - p - 1) with p columns; less that of the condition in a partial model.

        The same formula serves both methods; the permutation form for correspondence analysis
        differs from it by chance alone.
        """
        def of(terms):
            return 1 - (1 - self.r2(terms)) * (self.n - 1) / (self.n - len(self._pick(terms)) - 1)

        x, z = names(x), names(condition)
        return of(x + z) - of(z) if z else of(x)


def expand_terms(df: DataFrame, terms) -> tuple[DataFrame, dict[str, list[str]], dict[str, list[str]]]:
    """Factor columns (text or boolean) as indicators of their levels but the first.

    Returns the table, the columns of every term, and the levels of every factor. The levels
    of a factor are read once; a NULL stays NULL in its indicators.
    """
    kinds = dict(df.dtypes)
    columns, levels = {}, {}
    for term in names(terms):
        if kinds[term] not in ("string", "boolean"):
            columns[term] = [term]
            continue
        text = F.col(term).cast("string")
        levels[term] = sorted(r[0] for r in df.select(text).dropna().distinct().collect())
        columns[term] = [f"_{term}_{i}" for i in range(1, len(levels[term]))]
        df = df.withColumns({c: (text == v).cast("double") for c, v in zip(columns[term], levels[term][1:])})
    return df, columns, levels


def _constrained(cells: DataFrame, cov: DataFrame, cols, weighted: bool, reps: int = 0, seed: int = 1):
    cov, terms, levels = expand_terms(cov, cols)
    cols = [c for own in terms.values() for c in own]
    x = cov.select("sample", *[dbl(c).alias(c) for c in cols]).dropna()
    y = written(cells.select("feature", "sample", dbl("value").alias("value")).filter("value <> 0")
                .join(x.select("sample"), "sample", "left_semi"), "response")
    if weighted:
        total = y.agg(F.sum("value")).scalar()
        p = written(y.select("feature", "sample", (F.col("value") / total).alias("p")), "shares")
        mass = p.groupBy("sample").agg(F.sum("p").alias("_w"))
        sites = written(x.join(mass, "sample"), "sites")
        r = p.groupBy("feature").agg(F.sum("p").alias("_r"))
        resp = p.join(r, "feature").select("feature", "sample", (F.col("p") / F.sqrt("_r")).alias("y"))
        inertia = resp.join(mass, "sample").agg(F.sum(F.col("y") * F.col("y") / F.col("_w"))).first()[0] - 1.0
    else:
        n = y.select("sample").distinct().count()
        sites = written(x.join(y.select("sample").distinct(), "sample").withColumn("_w", F.lit(1.0)), "sites")
        resp = y.select("feature", "sample", F.col("value").alias("y"))
        per = resp.groupBy("feature").agg(F.sum("y").alias("_s"), F.sum(F.col("y") * F.col("y")).alias("_q"))
        inertia = per.agg(F.sum(F.col("_q") - F.col("_s") * F.col("_s") / n)).first()[0] / (n - 1)
    _, mean, s = _moments(sites, cols, "_w")
    centred = sites.select("sample", *[(F.col(c) - F.lit(float(mean[i]))).alias(f"_x{i}") for i, c in enumerate(cols)])
    resp = written(resp, "residuals")
    sums = [F.sum(F.col("y") * F.col(f"_x{i}")).alias(f"_b{i}") for i in range(len(cols))]
    features = written(resp.join(centred, "sample").groupBy("feature").agg(*sums), "products")
    scale = 1.0 if weighted else 1.0 / (sites.count() - 1)
    m = cross_products(features, [f"_b{i}" for i in range(len(cols))])[1:, 1:] * scale
    model = Constrained(terms, s, m, inertia, sites.count(), mean, features, sites, weighted, levels, resp)
    if not reps:
        return model
    # Permuted covariates: sample labels change places inside each replicate.
    rep = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(reps).cast("bigint")))
    seats = hashed_index(sites.select("sample"), "sample", name="_i", seed=seed)
    moved = hashed_index(sites.select("sample").withColumn("rep", rep), ["rep", "sample"], "rep", "_i", seed + 1)
    swap = moved.join(seats.withColumnRenamed("sample", "_from"), "_i").select("rep", "sample", "_from")
    perm = swap.join(sites.select(F.col("sample").alias("_from"), *cols), "_from").join(sites.select("sample", "_w"), "sample")
    means = perm.groupBy("rep").agg(*[(F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(f"_m{i}") for i, c in enumerate(cols)])
    px = attach(perm, means, "rep").select("rep", "sample", "_w", *[
        (F.col(c) - F.col(f"_m{i}")).alias(f"_x{i}") for i, c in enumerate(cols)])
    px = written(px, "permuted")
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]

    def small(df, a, weight):
        rows = df.groupBy("rep").agg(*[F.sum(weight * F.col(f"{a}{i}") * F.col(f"{a}{j}")).alias(f"v{i}_{j}") for i, j in pairs]).collect()
        out = {}
        for r in rows:
            mat = np.zeros((len(cols), len(cols)))
            for i, j in pairs:
                mat[i, j] = mat[j, i] = r[f"v{i}_{j}"]
            out[r["rep"]] = mat
        return out

    s_rep = small(px, "_x", F.col("_w"))
    b_rep = resp.join(px, "sample").groupBy("rep", "feature").agg(*sums)
    m_rep = small(b_rep, "_b", F.lit(scale))
    return model, [Constrained(terms, s_rep[q], m_rep[q], inertia, model.n, mean, None, None, weighted) for q in sorted(s_rep)]


def rda(cells: DataFrame, cov: DataFrame, cols) -> Constrained:
    """Redundancy analysis of (feature, sample, value) on sample covariates."""
    return _constrained(cells, cov, cols, weighted=False)


def cca(cells: DataFrame, cov: DataFrame, cols) -> Constrained:
    """Canonical correspondence analysis; partial models come from `solve(x, condition)`."""
    return _constrained(cells, cov, cols, weighted=True)


def model_table(spark, model: Constrained, models: dict[str, tuple]) -> DataFrame:
    """R2, adjusted R2 and constrained inertia of named models (x, condition)."""
    rows = []
    for name, (x, z) in models.items():
        rows.append((name, float(model.solve(x, z)[0].sum()), model.r2(x, z),
                     float(model.adjusted(x, z))))
    return spark.createDataFrame(rows, "model string, inertia double, r2 double, adjusted_r2 double")


def forward_select(cells: DataFrame, cov: DataFrame, cols, weighted: bool = True, n_perm: int = 99,
                   level: float = 0.05, seed: int = 1, condition=(), both: bool = False) -> DataFrame:
    """Add the term with the best adjusted R2 until the full model's adjusted R2 is passed or
    its permutation p exceeds the level; `both` also drops chosen terms that stop being significant.

    Terms of `condition` are in every model. A factor enters and leaves as a whole. All steps
    use one set of small matrices, and all permutations another. A dropped term is one row with
    `selected` false and its name behind a minus sign, and does not come back.
    """
    terms, given = names(cols), names(condition)
    model, perms = _constrained(cells, cov, [*terms, *given], weighted, n_perm, seed)
    full = model.adjusted(terms, given)
    chosen, gone, rows = [], [], []

    def p_value(term, others):
        gain = model.r2([term], others)
        return (1 + sum(q.r2([term], others) >= gain - 1e-12 for q in perms)) / (1 + len(perms))

    def row(name, kept, p, ok):
        rows.append((len(rows) + 1, name, float(model.r2(kept, given)), float(model.adjusted(kept, given)), float(p), bool(ok)))

    while open_ := [t for t in terms if t not in chosen + gone]:
        best = max(open_, key=lambda t: model.adjusted(chosen + [t], given))
        p = p_value(best, chosen + given)
        ok = model.adjusted(chosen + [best], given) <= full + 1e-12 and p <= level
        row(best, chosen + [best], p, ok)
        if not ok:
            break
        chosen.append(best)
        while both and len(chosen) > 1:
            worst, p = max(((t, p_value(t, [c for c in chosen if c != t] + given)) for t in chosen[:-1]), key=lambda v: v[1])
            if p <= level:
                break
            chosen.remove(worst)
            gone.append(worst)
            row("-" + worst, chosen, p, False)
    return cells.sparkSession.createDataFrame(
        rows, "step int, covariate string, r2 double, adjusted_r2 double, p double, selected boolean")


def variation_partition(model: Constrained, sets: dict[str, list[str]]) -> DataFrame:
    """Adjusted R2 fractions of two or three covariate sets by inclusion-exclusion."""
    labels = sorted(sets)
    if not 2 <= len(labels) <= 3:
        raise ValueError("two or three sets")

    def adj(group):
        cols = list(dict.fromkeys(c for g in group for c in sets[g]))
        return model.adjusted(cols) if cols else 0.0

    union = {frozenset(g): adj(g) for r in range(len(labels) + 1) for g in combinations(labels, r)}
    everything = frozenset(labels)
    rows = []
    for r in range(1, len(labels) + 1):
        for g in combinations(labels, r):
            rest = everything - set(g)
            # Part explained by all members of g and by nothing outside g.
            value = -sum((-1) ** len(sub) * union[frozenset(rest | set(sub))]
                         for q in range(len(g) + 1) for sub in combinations(g, q))
            rows.append(("&".join(g), float(value)))
    rows.append(("residual", float(1 - union[everything])))
    spark = model.features.sparkSession
    return spark.createDataFrame(rows, "fraction string, adjusted_r2 double")


def score_table(model: Constrained, x, k: int = 2, condition=()) -> dict[str, DataFrame]:
    """Axis shares, biplot arrows, feature scores, and sites as fitted and as weighted averages.

    `sites` are the fitted scores, `sites_averaged` the averages of the feature scores of a
    site; `centroids` has the mean fitted score of every factor level.
    """
    x = names(x)
    lam, coef = model.solve(x, condition)
    k = min(k, len(lam))
    lam, coef = lam[:k], coef[:, :k]
    spark, ix = model.features.sparkSession, model._pick(x)
    cols = [model.cols[i] for i in ix]
    sd = np.sqrt(np.diag(model.s))[ix]
    arrows = (model.s[np.ix_(ix, ix)] @ coef) / sd[:, None]
    iz = model._pick(condition)
    given = model.s[np.ix_(ix, iz)] @ np.linalg.pinv(model.s[np.ix_(iz, iz)]) if iz else np.zeros((len(ix), 0))
    whole = np.vstack([coef, -given.T @ coef])     # what the condition explains is taken out of a covariate
    every = cols + [model.cols[i] for i in iz]
    features = _project(model.features, "feature", [f"_b{i}" for i in [*ix, *iz]], whole)
    fitted = _project(model.sites, ["sample", "_w", *[c for t in x if t in model.levels for c in model.terms[t]]],
                      every, whole, model.mean[[*ix, *iz]])
    axes = [f"axis_{a + 1}" for a in range(k)]
    raw = (model.response.join(features, "feature").groupBy("sample")
           .agg(*[F.sum(F.col("y") * F.col(a)).alias(a) for a in axes])
           .join(model.sites.select("sample", "_w"), "sample"))
    mean = raw.agg(F.struct(*[(F.sum(a) / F.sum("_w")).alias(a) for a in axes])).scalar()
    scale = 1.0 if model.weighted else 1.0 / (model.n - 1)
    averaged = raw.select("sample", *[((F.col(a) / F.col("_w") - mean[a]) * F.lit(float(scale / v))).alias(a)
                                      for a, v in zip(axes, lam)])
    out = {"axes": _eigen_frame(spark, lam, model.total), "arrows": _axes_frame(spark, cols, arrows, "covariate"),
           "sites": fitted.select("sample", *axes), "sites_averaged": averaged, "features": features}
    centroids = None
    for t in (t for t in x if t in model.levels):
        label = F.lit(model.levels[t][0])
        for c, v in zip(model.terms[t], model.levels[t][1:]):
            label = F.when(F.col(c) == 1, F.lit(v)).otherwise(label)
        own = fitted.groupBy(F.lit(t).alias("term"), label.alias("level")).agg(*[
            (F.sum(F.col("_w") * F.col(a)) / F.sum("_w")).alias(a) for a in axes])
        centroids = own if centroids is None else centroids.unionByName(own)
    if centroids is not None:
        out["centroids"] = centroids
    return out


# ------------------------------------------------------------------ several tables


def coinertia(df: DataFrame, key: str, cols_1, cols_2, k: int = 2) -> dict[str, DataFrame]:
    """Cross-covariance axes of two column blocks of the same rows (standardised)."""
    a, b = names(cols_1), names(cols_2)
    n, mean, s = _moments(df, a + b)
    sd = np.sqrt(np.diag(s) / (n - 1))
    sd = np.where(sd > 0, sd, 1.0)
    c = s / (n - 1) / np.outer(sd, sd)
    u, d, vt = np.linalg.svd(c[:len(a), len(a):], full_matrices=False)
    k = min(k, len(d))
    sign = np.sign(u[np.abs(u).argmax(axis=0), range(u.shape[1])])
    u, v = (u * sign)[:, :k], (vt.T * sign)[:, :k]
    data = df.dropna(subset=a + b)
    rv = float((d ** 2).sum() / np.sqrt((c[:len(a), :len(a)] ** 2).sum() * (c[len(a):, len(a):] ** 2).sum()))
    spark = df.sparkSession
    return {"eigenvalues": _eigen_frame(spark, d[:k] ** 2, float((d ** 2).sum())),
            "first": _project(data, key, a, u, mean[:len(a)], sd[:len(a)]),
            "second": _project(data, key, b, v, mean[len(a):], sd[len(a):]),
            "rv": spark.createDataFrame([(rv,)], "rv double")}


def shift_distance(first: DataFrame, second: DataFrame, key: str, axes) -> DataFrame:
    """Distance of the two positions of each row."""
    j = first.join(second.withColumnsRenamed({a: f"{a}_b" for a in names(axes)}), key)
    total = F.lit(0.0)
    for a in names(axes):
        total = total + (F.col(a) - F.col(f"{a}_b")) * (F.col(a) - F.col(f"{a}_b"))
    return j.select(key, F.sqrt(total).alias("distance"))


def mfa(df: DataFrame, key: str, blocks: dict[str, list[str]], k: int = 2) -> dict[str, DataFrame]:
    """PCA after dividing each standardised block by its first singular value."""
    cols = [c for b in blocks.values() for c in b]
    n, mean, s = _moments(df, cols)
    sd = np.sqrt(np.diag(s) / (n - 1))
    scale, at = np.where(sd > 0, sd, 1.0), 0
    corr = s / (n - 1) / np.outer(scale, scale)
    for b in blocks.values():
        part = slice(at, at + len(b))
        scale[part] *= np.sqrt(_eigen(corr[part, part], 1)[0][0])
        at += len(b)
    c = s / (n - 1) / np.outer(scale, scale)
    val, vec = _eigen(c, k)
    spark = df.sparkSession
    return {"eigenvalues": _eigen_frame(spark, val, float(np.trace(c))), "loadings": _axes_frame(spark, cols, vec, "column"),
            "scores": _project(df.dropna(subset=cols), key, cols, vec, mean, scale)}


def famd(df: DataFrame, key: str, numeric, categorical: dict[str, list[str]], k: int = 2) -> dict[str, DataFrame]:
    """PCA of standardised numbers and indicators divided by the root of their share."""
    num = names(numeric)
    flags = [(f"{c}={v}", (F.col(c) == v).cast("double")) for c, levels in categorical.items() for v in levels]
    data = df.select(key, *[dbl(c).alias(c) for c in num], *[e.alias(n) for n, e in flags]).dropna()
    cols = num + [n for n, _ in flags]
    quoted = [f"`{c}`" for c in cols]
    n, mean, s = _moments(data, quoted)
    sd = np.sqrt(np.diag(s) / (n - 1))
    scale = np.concatenate([np.where(sd[:len(num)] > 0, sd[:len(num)], 1.0), np.sqrt(np.maximum(mean[len(num):], 1e-12))])
    c = s / (n - 1) / np.outer(scale, scale)
    val, vec = _eigen(c, k)
    spark = df.sparkSession
    return {"eigenvalues": _eigen_frame(spark, val, float(np.trace(c))), "loadings": _axes_frame(spark, cols, vec, "column"),
            "scores": _project(data, key, quoted, vec, mean, scale)}


# ------------------------------------------------------------------ clusters


def cluster_on_axes(scores: DataFrame, key: str, axes, k: int, seed: int = 1) -> DataFrame:
    """Divisive clusters on ordination axes."""
    data = scores.select(key, array_to_vector(F.array(*[dbl(a) for a in names(axes)])).alias("features"))
    model = BisectingKMeans(k=k, seed=seed).fit(data)
    return model.transform(data).select(key, (F.col("prediction") + 1).cast("bigint").alias("cluster"))


def profile_clusters(df: DataFrame, key: str, cols, k: int, seed: int = 1) -> DataFrame:
    """Clusters of rows with similar profiles (log1p of the given columns)."""
    data = df.select(key, array_to_vector(F.array(*[F.log1p(dbl(c)) for c in names(cols)])).alias("features"))
    model = KMeans(k=k, seed=seed).fit(data)
    return model.transform(data).select(key, (F.col("prediction") + 1).cast("bigint").alias("cluster"))


def column_clusters(cells: DataFrame, k: int, axes: int = 10, seed: int = 1, row: str = "feature",
                    column: str = "sample", value: str = "reads") -> DataFrame:
    """Clusters of columns with similar profiles over the rows, (column, cluster).

    A profile is the log1p of the column's cells, absent cells being 0. Columns are placed by their
    scores on the largest singular axes, which keep the distances of profiles as far as `axes` values
    hold the table, so no column has to carry all its rows.
    """
    logs = cells.select(row, column, F.log1p(dbl(value)).alias("value"))
    svd = truncated_svd(logs, axes, row, column)
    roots = [float(np.sqrt(r["singular_value"])) for r in svd["singular_values"].orderBy("axis").collect()]
    placed = written(svd["columns"].select(column, array_to_vector(F.array(*[
        F.col(f"axis_{i + 1}") * F.lit(v) for i, v in enumerate(roots)])).alias("features")), "profiles")
    model = KMeans(k=k, seed=seed).fit(placed)
    return model.transform(placed).select(column, (F.col("prediction") + 1).cast("bigint").alias("cluster"))


def block_summary(counts: DataFrame, row_cluster: DataFrame, col_cluster: DataFrame) -> DataFrame:
    """Mean reads of each (feature cluster, sample cluster) block, absent cells being 0."""
    cells = counts.join(row_cluster.select("feature", F.col("cluster").alias("row_cluster")), "feature").join(
        col_cluster.select("sample", F.col("cluster").alias("col_cluster")), "sample")
    rows = row_cluster.groupBy(F.col("cluster").alias("row_cluster")).agg(F.count(F.lit(1)).alias("_nr"))
    cols = col_cluster.groupBy(F.col("cluster").alias("col_cluster")).agg(F.count(F.lit(1)).alias("_nc"))
    return (cells.groupBy("row_cluster", "col_cluster").agg(F.sum("reads").alias("reads"))
            .join(rows, "row_cluster").join(cols, "col_cluster")
            .select("row_cluster", "col_cluster", "reads", ratio("reads", F.col("_nr") * F.col("_nc")).alias("mean")))


def cluster_table(labels: dict[str, DataFrame], key: str = "sample") -> DataFrame:
    """Clusters from several sources side by side, with the locality of the sample."""
    from .ids import LOCALITY, extract

    out = None
    for source, df in labels.items():
        part = df.select(key, F.col("cluster").alias(source))
        out = part if out is None else out.join(part, key, "full")
    return out.withColumn("locality", extract(key, LOCALITY))


def geo_distance(coord: DataFrame, key: str = "sample", x: str = "longitude", y: str = "latitude") -> DataFrame:
    """Euclidean distance of every pair of sites."""
    dx, dy = F.col(f"{x}_1") - F.col(f"{x}_2"), F.col(f"{y}_1") - F.col(f"{y}_2")
    return row_pairs(coord, key, [x, y]).select("s1", "s2", F.sqrt(dx * dx + dy * dy).alias("distance"))


# ------------------------------------------------------------------ linear models


def vif(df: DataFrame, cols) -> DataFrame:
    """Variance inflation factors: the diagonal of the inverse correlation matrix."""
    return vif_terms(df, cols).select(F.col("term").alias("covariate"), F.col("gvif").alias("vif"))


def vif_terms(df: DataFrame, terms) -> DataFrame:
    """Generalised variance inflation per term, (term, df, gvif, per_df).

    The determinant of a term's own correlations times that of the others over that of all;
    `per_df` is its root of order 2 df, comparable between terms of different size.
    """
    df, columns, _ = expand_terms(df, terms)
    cols = [c for own in columns.values() for c in own]
    _, _, s = _moments(df, cols)
    sd = np.sqrt(np.diag(s))
    r = s / np.outer(sd, sd)
    rows = []
    for term, own in columns.items():
        i = [cols.index(c) for c in own]
        j = [k for k in range(len(cols)) if k not in i]
        sign, log = zip(*(np.linalg.slogdet(r[np.ix_(k, k)]) for k in (i, j, list(range(len(cols))))))
        value = float(np.exp(log[0] + log[1] - log[2])) if all(x > 0 for x in sign) else float("inf")
        rows.append((term, len(i), value, value ** (1 / (2 * len(i)))))
    return df.sparkSession.createDataFrame(rows, "term string, df int, gvif double, per_df double")


def _centred_fit(gram: np.ndarray, x: list[int], y: int) -> tuple[np.ndarray, float]:
    """Coefficients and residual sum of squares on the given columns, from centred sums of products.

    Columns are scaled to one before solving; aliased columns share their coefficient.
    """
    total = float(gram[y, y])
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    if not x:
        return np.zeros(0), total
    unit = gram / np.outer(scale, scale)
    beta = np.linalg.lstsq(unit[np.ix_(x, x)], unit[x, y], rcond=1e-12)[0]
    return beta * scale[y] / scale[x], max(total * (1.0 - float(beta @ unit[x, y])) if total > 0 else 0.0, 0.0)


def glm_gaussian(df: DataFrame, y: str, x) -> DataFrame:
    """Least-squares fit: coefficient per term, deviance per degree of freedom, deviance R2.

    Solved from centred sums of products, so means far from 0 cost no digits.
    """
    x = names(x)
    n, mean, gram = _moments(df, [*x, y])
    beta, dev = _centred_fit(gram, list(range(len(x))), len(x))
    level = mean[-1] - beta @ mean[:-1]
    null, dof = float(gram[-1, -1]), n - len(x) - 1
    rows = [(t, float(b), float(dev / dof) if dof > 0 else None, float(1 - dev / null) if null > 0 else None)
            for t, b in zip(["(intercept)", *x], [level, *beta])]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, dispersion double, deviance_r2 double")


def _aicc(n: float, rss: float, terms: int) -> float:
    k = terms + 2
    if n - k - 1 <= 0:
        return float("inf")
    return n * np.log(rss / n) + n * (np.log(2 * np.pi) + 1) + 2 * k + 2 * k * (k + 1) / (n - k - 1)


SUBTREES = 8   # terms whose choices are dealt out: 2^8 subtrees of models


def all_subsets_aicc(df: DataFrame, y: str, x, delta: float = 2.0) -> DataFrame:
    """Every sub-model ranked by AICc, those within `delta` of the best: (model, df, aicc, delta).

    One pass over the rows gives the centred sums of products; the models are searched by branch and
    bound. A subtree fixes some terms in or out; no model in it has fewer residuals than the one with
    all its undecided terms, nor fewer terms than its fixed ones, so subtrees that cannot come within
    `delta` of the best model known are left. Terms are decided in order of what the full model
    loses without them. Subtrees of the first terms are dealt to tasks with the best model of the
    stepwise paths as the first bound. There is no limit to the number of terms.
    """
    x = names(x)
    n, _, gram = _moments(df, [*x, y])
    p, floor = len(x), float(gram[-1, -1]) * 1e-15 or 1e-300

    def rss(ix) -> float:
        return max(_centred_fit(gram, sorted(ix), p)[1], floor)

    full = list(range(p))
    loss = {v: rss([w for w in full if w != v]) for v in full}
    order = sorted(full, key=lambda v: -loss[v])
    paths, out, into = [full], list(full), []
    while out:
        out.remove(min(out, key=lambda v: rss([w for w in out if w != v])))
        paths.append(list(out))
    while len(into) < p:
        into.append(min((v for v in full if v not in into), key=lambda v: rss([*into, v])))
        paths.append(list(into))
    known = min(_aicc(n, rss(ix), len(ix)) for ix in paths)
    depth = min(p, SUBTREES)

    def search(batches):
        best = known
        for pdf in batches:
            for code in pdf["id"]:
                chosen = [v for i, v in enumerate(order[:depth]) if code >> i & 1]
                rest = order[depth:]
                stack, found = [(chosen, rest, rss([*chosen, *rest]))], []
                while stack:
                    inside, undecided, least = stack.pop()
                    bound = _aicc(n, least, len(inside))
                    if bound - best >= delta:
                        continue
                    if not undecided:
                        best = min(best, bound)
                        found.append(("+".join(x[v] for v in sorted(inside)) or "1", len(inside) + 2, float(bound)))
                        continue
                    first, later = undecided[0], undecided[1:]
                    stack.append((inside, later, rss([*inside, *later])))
                    stack.append(([*inside, first], later, least))
                yield pd.DataFrame(found, columns=["model", "df", "aicc"])

    models = written(df.sparkSession.range(0, 2 ** depth, 1, min(2 ** depth, 32)).mapInPandas(
        search, "model string, df int, aicc double"), "models")
    best = models.agg(F.min("aicc")).scalar()
    return models.withColumn("delta", F.col("aicc") - best).filter(F.col("delta") < delta).orderBy("delta", "model")
