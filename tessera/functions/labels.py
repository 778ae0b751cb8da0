"""Display labels computed as columns: sign classes, signed deltas, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Connectivity bands (upper bounds, %), labels.
CONNECTIVITY_BANDS = ((50, "low"), (70, "medium"))


def sign_class(v: Column) -> Column:
    return F.when(v > 0, "positive").when(v < 0, "negative").otherwise("neutral")


def delta_text(v: Column) -> Column:
    """'+1,234' / '-56' / '0' with thousands separators."""
    return F.concat(F.when(v > 0, F.lit("+")).otherwise(F.lit("")), F.format_number(v.cast("bigint"), 0))


def pct_text(p: Column, decimals: int = 2) -> Column:
    """'+12.34%'. ``p`` should already be rounded to ``decimals`` (exact integer-space
    percentages), so the text is the same in every engine."""
    return F.concat(F.when(p > 0, F.lit("+")).otherwise(F.lit("")), F.format_string(f"%.{decimals}f", p), F.lit("%"))


# Trend markers and texts for positive / negative / zero changes.
TREND_ICONS = ("📈", "📉", "➡️")
TREND_TEXTS = ("📈 Aumento", "📉 Disminución", "➡️ Sin cambio")


def trend_icon(v: Column) -> Column:
    return F.when(v > 0, TREND_ICONS[0]).when(v < 0, TREND_ICONS[1]).otherwise(TREND_ICONS[2])


def trend_text(v: Column) -> Column:
    return F.when(v > 0, TREND_TEXTS[0]).when(v < 0, TREND_TEXTS[1]).otherwise(TREND_TEXTS[2])


def connectivity_band(p: Column) -> Column:
    e = F.when(p < CONNECTIVITY_BANDS[0][0], CONNECTIVITY_BANDS[0][1])
    for t, n in CONNECTIVITY_BANDS[1:]:
        e = e.when(p < t, n)
    return e.otherwise("high")
