"""Period keys (year*100+month), labels and month names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish month names, January to December.
MONTH_NAMES = ("Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto",
               "Septiembre", "Octubre", "Noviembre", "Diciembre")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def period_key(year, month) -> Column:
    """year*100+month; two-digit years get +2000."""
    y = _c(year).cast("int")
    y = F.when(y < 100, y + 2000).otherwise(y)
    return y * 100 + _c(month).cast("int")


def period_key_lit(year: int, month: int) -> int:
    y = int(year)
    return (y + 2000 if y < 100 else y) * 100 + int(month)


def parse_period_key(pk) -> tuple[Column, Column]:
    """period_key -> (year, 'MM')."""
    k = _c(pk).cast("int")
    return (F.call_function("div", k, F.lit(100)).cast("int"),
            F.lpad((k % 100).cast("string"), 2, "0"))


def month_name(month) -> Column:
    """Name of month 1-12, else 'Mes n'."""
    m = _c(month).cast("int")
    names = F.array(*[F.lit(n) for n in MONTH_NAMES])
    return F.when(m.between(1, 12), F.element_at(names, m)).otherwise(
        F.concat(F.lit("Mes "), m.cast("string")))


def period_label(year, month) -> Column:
    """'Marzo 2024'; an unknown month shows as its two-digit text."""
    m = _c(month).cast("int")
    names = F.array(*[F.lit(n) for n in MONTH_NAMES])
    mm = F.lpad(m.cast("string"), 2, "0")
    return F.concat(F.when(m.between(1, 12), F.element_at(names, m)).otherwise(mm),
                    F.lit(" "), _c(year).cast("string"))


def month_name_sql(m: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(MONTH_NAMES, 1))
    return f"(CASE CAST({m} AS INTEGER) {whens} ELSE concat('Mes ', CAST(CAST({m} AS INTEGER) AS VARCHAR)) END)"


def period_label_sql(y: str, m: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(MONTH_NAMES, 1))
    return (f"concat(CASE CAST({m} AS INTEGER) {whens} ELSE lpad(CAST({m} AS VARCHAR), 2, '0') END, "
            f"' ', CAST({y} AS VARCHAR))")


def source_freshness(ts, reference_mode: bool = False) -> Column:
    """Modification time shown one month back ('dd/MM/yyyy'), day clamped to the target month.
    ``reference_mode`` leaves December unshifted, as the reference does [D12]."""
    d = F.to_date(_c(ts))
    back = F.add_months(d, -1)
    if reference_mode:
        back = F.when(F.month(d) == 12, d).otherwise(back)
    return F.date_format(back, "dd/MM/yyyy")


def is_stale(ts, as_of: str, days: int = 500) -> Column:
    return F.datediff(F.to_date(F.lit(as_of)), F.to_date(_c(ts))) > days
