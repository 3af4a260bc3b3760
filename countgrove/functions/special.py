"""Special functions as Column expressions, so they stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import dbl

# Published rational approximations of erf / erfc (double precision),
# highest power first.
ERF_NUM = (9.60497373987051638749e0, 9.00260197203842689217e1, 2.23200534594684319226e3,
           7.00332514112805075473e3, 5.55923013010394962768e4)
ERF_DEN = (1.0, 3.35617141647503099647e1, 5.21357949780152679795e2, 4.59432382970980127987e3,
           2.26290000613890934246e4, 4.92673942608635921086e4)
ERFC_NUM = (2.46196981473530512524e-10, 5.64189564831068821977e-1, 7.46321056442269912687e0,
            4.86371970985681366614e1, 1.96520832956077098242e2, 5.26445194995477358631e2,
            9.34528527171957607540e2, 1.02755188689515710272e3, 5.57535335369399327526e2)
ERFC_DEN = (1.0, 1.32281951154744992508e1, 8.67072140885989742329e1, 3.54937778887819891062e2,
            9.75708501743205489753e2, 1.82390916687909736289e3, 2.24633760818710981792e3,
            1.65666309194161350182e3, 5.57535340817727675546e2)
ERFC_FAR_NUM = (5.64189583547755073984e-1, 1.27536670759978104416e0, 5.01905042251180477414e0,
                6.16021097993053585195e0, 7.40974269950448939160e0, 2.97886665372100240670e0)
ERFC_FAR_DEN = (1.0, 2.26052863220117276590e0, 9.39603524938001434673e0,
                1.20489539808096656605e1, 1.70814450747565897222e1, 9.60896809063285878198e0,
                3.36907645100081516050e0)
# Published normal quantile coefficients (algorithm AS 241), lowest power first.
PPF_MID_NUM = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
               1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
               3.3430575583588128105e4, 2.5090809287301226727e3)
PPF_MID_DEN = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
               2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
               5.2264952788528545610e3)
PPF_NEAR_NUM = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
                3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
                2.27238449892691845833e-2, 7.74545014278341407640e-4)
PPF_NEAR_DEN = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0,
                6.89767334985100004550e-1, 1.48103976427480074590e-1,
                1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
PPF_FAR_NUM = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
               2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
               2.71155556874348757815e-5, 2.01033439929228813265e-7)
PPF_FAR_DEN = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1,
               1.48753612908506148525e-2, 7.86869131145613259100e-4,
               1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)
# Lanczos coefficients (g = 7).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
           -176.61502916214059, 12.507343278686905, -0.13857109526572012,
           9.9843695780195716e-6, 1.5056327351493116e-7)


def _horner(x: Column, high_first) -> Column:
    out = F.lit(high_first[0])
    for c in high_first[1:]:
        out = out * x + F.lit(c)
    return out


def _once(arg: Column, body) -> Column:
    """body(arg) with the argument evaluated once.

    A long formula names its argument many times; bound as a lambda variable it is not
    copied into each place when Catalyst merges projections.
    """
    return F.transform(F.array(arg), body)[0]


def _erfc(x: Column) -> Column:
    a = F.abs(x)
    near = F.lit(1.0) - x * _horner(x * x, ERF_NUM) / _horner(x * x, ERF_DEN)
    tail = F.exp(-a * a) * F.when(a < 8, _horner(a, ERFC_NUM) / _horner(a, ERFC_DEN)).otherwise(
        _horner(a, ERFC_FAR_NUM) / _horner(a, ERFC_FAR_DEN))
    return F.when(a < 1, near).when(x > 0, tail).when(x <= 0, F.lit(2.0) - tail)


def erfc(col) -> Column:
    """Complementary error function."""
    return _once(dbl(col), _erfc)


def erf(col) -> Column:
    return F.lit(1.0) - erfc(col)


def norm_cdf(col) -> Column:
    """Standard normal distribution function."""
    return erfc(-dbl(col) / F.lit(math.sqrt(2.0))) / 2


def norm_sf2(col) -> Column:
    """Two-sided normal tail probability of |z|."""
    return erfc(F.abs(dbl(col)) / F.lit(math.sqrt(2.0)))


def _norm_ppf(p: Column) -> Column:
    q = p - 0.5
    centre = F.lit(0.180625) - q * q
    mid = q * _horner(centre, PPF_MID_NUM[::-1]) / _horner(centre, PPF_MID_DEN[::-1])
    r = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    near, far = r - 1.6, r - 5.0
    side = F.when(r <= 5, _horner(near, PPF_NEAR_NUM[::-1]) / _horner(near, PPF_NEAR_DEN[::-1])
                  ).otherwise(_horner(far, PPF_FAR_NUM[::-1]) / _horner(far, PPF_FAR_DEN[::-1]))
    return F.when((p > 0) & (p < 1),
                  F.when(F.abs(q) <= 0.425, mid).when(q < 0, -side).otherwise(side))


def norm_ppf(col) -> Column:
    """Standard normal quantile; NULL outside (0, 1)."""
    return _once(dbl(col), _norm_ppf)


def lgamma(col) -> Column:
    """Log gamma for positive arguments."""
    z = dbl(col) - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        total = total + F.lit(c) / (z + i)
    t = z + 7.5
    value = F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(total)
    return F.when(dbl(col) > 0, value)


def gamma_density(x, shape, rate) -> Column:
    """Density of the gamma distribution; 0 below 0, NULL for parameters that are not positive."""
    x, a, b = dbl(x), dbl(shape), dbl(rate)
    inside = F.exp(a * F.log(b) + (a - 1) * F.log(x) - b * x - lgamma(a))
    at_zero = F.when(a < 1, F.lit(float("inf"))).when(a == 1, b).otherwise(F.lit(0.0))
    return F.when((a > 0) & (b > 0), F.when(x > 0, inside).when(x == 0, at_zero).when(x < 0, F.lit(0.0)))


def lognormal_density(x, mu, sigma) -> Column:
    """Density of the lognormal distribution; 0 at and below 0, NULL for a spread that is not positive."""
    x, m, s = dbl(x), dbl(mu), dbl(sigma)
    z = (F.log(x) - m) / s
    inside = F.exp(-z * z / 2) / (x * s * F.lit(math.sqrt(2 * math.pi)))
    return F.when(s > 0, F.when(x > 0, inside).when(x <= 0, F.lit(0.0)))


def log_choose(n, k) -> Column:
    """Log of the binomial coefficient; NULL where k > n."""
    n, k = dbl(n), dbl(k)
    return F.when(k <= n, lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1))


def chi2_sf(x, df) -> Column:
    """Upper tail of chi-square for integer degrees of freedom (finite sums)."""
    df = df.cast("int") if isinstance(df, Column) else F.lit(int(df))
    arg = F.struct((F.greatest(dbl(x), F.lit(0.0)) / 2).alias("half"), df.alias("df"))
    return _once(arg, lambda a: _chi2_sf(a["half"], a["df"]))


def _chi2_sf(half: Column, df: Column) -> Column:
    # Terms of the sum follow from one another: t_k = t_{k-1} * half / (k + offset).
    even = F.exp(-half) * F.aggregate(
        F.sequence(F.lit(1), F.greatest((df / 2).cast("int"), F.lit(1))),
        F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")),
        lambda acc, k: F.struct((acc["s"] + acc["t"]).alias("s"),
                                (acc["t"] * half / k).alias("t")))["s"]
    first = F.exp(-half) * F.sqrt(half) / F.lit(math.sqrt(math.pi) / 2)
    odd = erfc(F.sqrt(half)) + F.when(df == 1, F.lit(0.0)).otherwise(F.aggregate(
        F.sequence(F.lit(1), F.greatest(((df - 1) / 2).cast("int"), F.lit(1))),
        F.struct(F.lit(0.0).alias("s"), first.alias("t")),
        lambda acc, k: F.struct((acc["s"] + acc["t"]).alias("s"),
                                (acc["t"] * half / (k + 0.5)).alias("t")))["s"])
    return F.when(df < 1, F.lit(None).cast("double")).when(df % 2 == 0, even).otherwise(odd)


def student_sf2(t, df) -> Column:
    """Two-sided Student t tail for real degrees of freedom (vectorised helper)."""
    return _student_sf2(dbl(t), dbl(df))


def _student_sf2_np(t, v):
    """Regularised incomplete beta I_x(v/2, 1/2), x = v/(v+t^2), by continued fraction."""
    import numpy as np

    t, v = np.asarray(t, float), np.asarray(v, float)
    x = v / (v + t * t)
    a, b = v / 2, np.full_like(v, 0.5)
    flip = x > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    lg = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(all="ignore"):
        front = np.exp(lg(aa + bb) - lg(aa) - lg(bb) + aa * np.log(xx) + bb * np.log1p(-xx)) / aa
        tiny = 1e-300
        c = np.ones_like(xx)
        d = 1 - (aa + bb) * xx / (aa + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for num in (m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m)),
                        -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
        beta = np.where(xx <= 0, 0.0, front * h)
    return np.where(flip, 1 - beta, beta)


def _student_series(batches):
    import pandas as pd

    for t, v in batches:
        ok = (t.notna() & v.notna() & (v > 0)).to_numpy()
        out = pd.Series([None] * len(t), dtype="float64")
        if ok.any():
            out[ok] = _student_sf2_np(t.to_numpy()[ok], v.to_numpy()[ok])
        yield out


def _student_sf2(t: Column, v: Column) -> Column:
    return _typed_udf()(t, v)


def _typed_udf():
    """The helper as a pandas UDF; its types are resolved here, where pandas is loaded."""
    from collections.abc import Iterator

    import pandas as pd

    def tails(batches):
        yield from _student_series(batches)

    tails.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(tails, "double")
