"""Column-expression helpers shared by every operator.

All helpers return ``pyspark.sql.Column`` objects so they stay inside
whole-stage codegen.  ``sql_*`` twins return the same expression as SQL text
that DuckDB accepts; they are used to write the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
LN2 = 0.6931471805599453

# Significant digits kept when results are compared across engines.
SIG_DIGITS = 9


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sig(c, digits: int = SIG_DIGITS) -> Column:
    """Round a double to ``digits`` significant digits (NaN/inf/null kept).

    The scale is an integer power of ten applied by multiplication for
    non-negative exponents and by division otherwise, so both engines use the
    same exactly representable constant.  The value is first nudged away from
    zero by a relative 1e-11 so that exact decimal ties (averages of short
    decimals) round the same way despite last-bit noise between engines.
    """
    c = col(c).cast("double") * F.lit(1.0 + 1e-11)
    k = (F.lit(digits - 1) - F.floor(F.log10(F.abs(c)))).cast("int")
    pos = F.round(c * F.pow(F.lit(10.0), k)) / F.pow(F.lit(10.0), k)
    neg = F.round(c / F.pow(F.lit(10.0), -k)) * F.pow(F.lit(10.0), -k)
    finite = ~(F.isnan(c) | (F.abs(c) == F.lit(INF)))
    return (
        F.when(c.isNull(), F.lit(None).cast("double"))
        .when(c == 0, F.lit(0.0))
        .when(finite & (k >= 0), pos)
        .when(finite, neg)
        .otherwise(c)
    )


def sql_sig(e: str, digits: int = SIG_DIGITS) -> str:
    """DuckDB twin of :func:`sig`."""
    x = f"(CAST(({e}) AS DOUBLE) * {1.0 + 1e-11!r})"
    k = f"CAST({digits - 1} - floor(log10(abs({x}))) AS INTEGER)"
    return (
        f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} = 0 THEN 0.0 "
        f"WHEN isnan({x}) OR isinf({x}) THEN {x} "
        f"WHEN {k} >= 0 THEN round({x} * power(10.0, {k})) / power(10.0, {k}) "
        f"ELSE round({x} / power(10.0, -{k})) * power(10.0, -{k}) END)"
    )


def safe_div(a, b) -> Column:
    """a / b with numpy semantics for doubles: x/0 -> +-inf, 0/0 -> NaN."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return (
        F.when(b != 0, a / b)
        .when(a > 0, F.lit(INF))
        .when(a < 0, F.lit(-INF))
        .otherwise(F.lit(float("nan")))
    )


def log2(c) -> Column:
    return F.log(2.0, col(c))


def xlog2x(c) -> Column:
    """p * log2(p) with the 0 * log 0 = 0 convention."""
    c = col(c)
    return F.when(c > 0, c * F.log(2.0, c)).otherwise(F.lit(0.0))


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)
