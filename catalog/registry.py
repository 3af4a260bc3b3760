"""Collects the registered queries: name -> (Spark callable, SQL or None).

Results are compared at SIGNIFICANT digits: both sides round their doubles to that many
significant digits, so small shares and p-values keep their precision and only the last bits,
which depend on the order of a sum, are left out. Operators themselves never round.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNIFICANT = 8
NOTHING = 1e-12     # rounding errors of sums that cancel
NUDGE = 1 + 1e-13   # moves exact ties off the middle, which the two engines round differently
MOST = 1e20         # numbers from here on are written out and read again

CASES: dict[str, tuple] = {}

_ROUND = re.compile(r"\bround\(", re.IGNORECASE)


def significant(df: DataFrame, digits: int = SIGNIFICANT) -> DataFrame:
    """Every double column to so many significant digits."""
    def short(name):
        c = F.col(name)
        y = F.abs(c) * NUDGE
        power = F.pow(F.lit(10.0), F.abs(digits - 1 - F.floor(F.log10(y))))
        # whole numbers below 2^53 and powers of ten up to 22 are exact, so one division or product rounds as a parsed numeral does
        plain = (F.when(y < 10.0 ** (digits - 1), F.floor(y * power + 0.5) / power)
                 .otherwise(F.floor(y / power + 0.5) * power)) * F.signum(c)
        return F.when(F.abs(c) < NOTHING, F.lit(0.0)).when(y < MOST, plain).otherwise(
            F.format_string(f"%.{digits - 1}e", c * NUDGE).cast("double"))

    return df.select(*[F.when(F.col(n).isNotNull(), short(n)).alias(n) if kind == "double" else F.col(n)
                       for n, kind in df.dtypes])


def significant_sql(sql: str, digits: int = SIGNIFICANT) -> str:
    """SQL in which `round(x, k)`, k up to 8, stands for x at so many significant digits."""
    out, at = [], 0
    while m := _ROUND.search(sql, at):
        depth, comma, end = 1, None, m.end()
        while depth:
            c = sql[end]
            depth += (c == "(") - (c == ")")
            comma = end if c == "," and depth == 1 else comma
            end += 1
        if comma is None or sql[comma + 1:end - 1].strip() not in "23468":
            out.append(sql[at:m.end()])
            at = m.end()
            continue
        x = f"CAST({significant_sql(sql[m.end():comma], digits)} AS DOUBLE)"
        out.append(sql[at:m.start()])
        out.append(f"CASE WHEN abs({x}) < {NOTHING} THEN CAST(0 AS DOUBLE) "
                   f"ELSE CAST(printf('%.{digits - 1}e', {x} * CAST({NUDGE!r} AS DOUBLE)) AS DOUBLE) END")
        at = end
    return "".join(out) + sql[at:]


def case(name: str, sql: str | None = None, digits: int = SIGNIFICANT):
    """Register `fn(spark, sf_dir)` with its SQL; fewer digits where differences of large sums lose some."""
    def wrap(fn):
        if name in CASES:
            raise ValueError(f"duplicate query {name}")
        CASES[name] = (lambda spark, sf_dir: significant(fn(spark, sf_dir), digits),
                       sql and significant_sql(sql, digits))
        return fn
    return wrap
