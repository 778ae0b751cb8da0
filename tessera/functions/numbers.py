"""Numeric coercion and integer-space percentage helpers (ANSI-safe: no raising casts)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c) -> Column:
    """Unparsable -> null (string or numeric input)."""
    return _c(c).cast("string").try_cast("double")


def _digits_only(c) -> Column:
    return F.regexp_replace(F.trim(_c(c).cast("string")), r"[^0-9.\-]", "")


def safe_float(c, numeric: bool = False) -> Column:
    """null -> 0.0; text keeps only [0-9.-] then parses; unparsable -> 0.0."""
    v = _c(c).cast("double") if numeric else _digits_only(c).try_cast("double")
    return F.coalesce(v, F.lit(0.0))


def safe_int(c, numeric: bool = False) -> Column:
    """Like ``safe_float`` then round half-to-even to a bigint; unparsable -> 0."""
    v = _c(c).cast("double") if numeric else _digits_only(c).try_cast("double")
    return F.coalesce(F.bround(v, 0).try_cast("bigint"), F.lit(0).cast("bigint"))


def idiv(a, b) -> Column:
    """Integer division truncating toward zero (SQL ``div``), exact on bigints."""
    return F.call_function("div", _c(a).cast("bigint"), _c(b).cast("bigint"))


def trunc_int(c) -> Column:
    """``int(float(v))``: parse, truncate toward zero; bad or null -> 0."""
    return F.coalesce(to_number(c).try_cast("bigint"), F.lit(0).cast("bigint"))


def clamp_month(c) -> Column:
    v = F.coalesce(to_number(c), F.lit(1.0))
    return F.greatest(F.lit(1.0), F.least(F.lit(12.0), v)).cast("int")


def safe_year(c) -> Column:
    return F.coalesce(to_number(c).try_cast("int"), F.lit(0))


def parse_decimal_comma(c) -> Column:
    return F.replace(F.trim(_c(c).cast("string")), F.lit(","), F.lit(".")).try_cast("double")


def clamp_nonneg(c) -> Column:
    """null and negatives -> 0."""
    return F.greatest(F.coalesce(_c(c), F.lit(0)), F.lit(0))


def pct_int(num, den, scale: int = 2) -> Column:
    """round(num / den * 100, scale) computed exactly in integer space, half away from zero;
    0 when den is 0 or null. Equal in Spark and DuckDB (no binary rounding drift).
    Column names (str) take the SQL-text path: one expression parsed by the JVM."""
    if isinstance(num, str) and isinstance(den, str):
        return pct_expr(f"`{num}`", f"`{den}`", scale)
    n, d = _c(num).cast("decimal(20,0)"), _c(den).cast("decimal(20,0)")  # products past bigint
    f = 100 * 10 ** scale
    q = F.call_function("div", F.abs(n) * (2 * f) + F.abs(d), 2 * F.abs(d))
    sign = (F.signum(n) * F.signum(d)).cast("bigint")  # integer sign: a zero result is +0.0
    return F.when(d.isNull() | (d == 0), F.lit(0.0)).otherwise((sign * q) / float(10 ** scale))


def pct_expr(num: str, den: str, scale: int = 2) -> Column:
    """``pct_int`` from Spark SQL text operands, parsed once by the JVM (one driver call
    instead of one per sub-expression; same exact integer arithmetic)."""
    f = 100 * 10 ** scale
    n, d = f"CAST(({num}) AS DECIMAL(20,0))", f"CAST(({den}) AS DECIMAL(20,0))"
    return F.expr(f"CASE WHEN {d} IS NULL OR {d} = 0 THEN 0.0D ELSE (CAST(signum({n}) * signum({d}) AS BIGINT) * "
                  f"((abs({n}) * {2 * f} + abs({d})) div (2 * abs({d})))) / {float(10 ** scale)}D END")


def pct_int_sql(num: str, den: str, scale: int = 2) -> str:
    """DuckDB twin of ``pct_int``."""
    f = 100 * 10 ** scale
    return (f"(CASE WHEN ({den}) IS NULL OR ({den}) = 0 THEN 0.0 ELSE "
            f"sign({num}) * sign({den}) * ((abs(CAST({num} AS HUGEINT)) * {2 * f} + abs(CAST({den} AS HUGEINT))) // (2 * abs(CAST({den} AS HUGEINT)))) / {float(10 ** scale)} END)")


def pct_change(v1, v2, scale: int = 2) -> Column:
    """Percent change v1 -> v2; 0 when v1 is 0."""
    return pct_int(_c(v2) - _c(v1), v1, scale)


def pct_change_floor1(v1, v2, scale: int = 2) -> Column:
    """Annual browser variant: divides by max(v1, 1)."""
    return pct_int(_c(v2) - _c(v1), F.greatest(_c(v1), F.lit(1)), scale)
