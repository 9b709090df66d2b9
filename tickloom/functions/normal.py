"""The standard normal distribution function as a Column and as SQL, from exp and arithmetic alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A published rational approximation of the normal integral, highest power first, and its limits.
UPPER = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
LOWER = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
SWITCH, ROOT = 7.07106781186547, 2.506628274631


def _polynomial(x: str, coefficients: list[float]) -> str:
    out = f"{coefficients[0]!r}e0" if "e" not in repr(coefficients[0]) else repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}e0)"
    return out


def cdf_sql(x: str) -> str:
    """SQL of the distribution function at a double expression; the same text runs in Spark and in DuckDB."""
    z = f"abs({x})"
    body = f"exp(-{z} * {z} / 2e0) * {_polynomial(z, [float(c) for c in UPPER])} / {_polynomial(z, LOWER)}"
    tail = f"exp(-{z} * {z} / 2e0) / ({z} + 1e0 / ({z} + 2e0 / ({z} + 3e0 / ({z} + 4e0 / ({z} + 0.65e0))))) / {ROOT}e0"
    lower = f"(CASE WHEN {z} > 37e0 THEN 0e0 WHEN {z} < {SWITCH}e0 THEN {body} ELSE {tail} END)"
    return f"(CASE WHEN {x} > 0e0 THEN 1e0 - {lower} ELSE {lower} END)"


def cdf(name: str) -> Column:
    """The distribution function at a column of doubles."""
    return F.expr(cdf_sql(name))
