"""SQL text of the special functions (DuckDB has no erf)."""

from __future__ import annotations

from countgrove.functions import special as sp


def horner(x: str, high_first) -> str:
    out = f"CAST({high_first[0]!r} AS DOUBLE)"
    for c in high_first[1:]:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def erfc(x: str) -> str:
    """`x` is a column name."""
    a, q = f"abs({x})", f"({x} * {x})"
    near = f"(1.0 - {x} * {horner(q, sp.ERF_NUM)} / {horner(q, sp.ERF_DEN)})"
    tail = (f"(exp(-{a} * {a}) * CASE WHEN {a} < 8 THEN {horner(a, sp.ERFC_NUM)} / {horner(a, sp.ERFC_DEN)} "
            f"ELSE {horner(a, sp.ERFC_FAR_NUM)} / {horner(a, sp.ERFC_FAR_DEN)} END)")
    return f"(CASE WHEN {a} < 1 THEN {near} WHEN {x} > 0 THEN {tail} ELSE 2.0 - {tail} END)"


def norm_ppf(p: str) -> str:
    """`p` is a column name."""
    q = f"({p} - 0.5)"
    c = f"(0.180625 - {q} * {q})"
    mid = f"{q} * {horner(c, sp.PPF_MID_NUM[::-1])} / {horner(c, sp.PPF_MID_DEN[::-1])}"
    r = f"sqrt(-ln(least({p}, 1.0 - {p})))"
    near, far = f"({r} - 1.6)", f"({r} - 5.0)"
    side = (f"CASE WHEN {r} <= 5 THEN {horner(near, sp.PPF_NEAR_NUM[::-1])} / {horner(near, sp.PPF_NEAR_DEN[::-1])} "
            f"ELSE {horner(far, sp.PPF_FAR_NUM[::-1])} / {horner(far, sp.PPF_FAR_DEN[::-1])} END")
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {mid} WHEN {q} < 0 THEN -({side}) ELSE {side} END)"
