"""Two-period and two-year comparison, and the browser-side analytics derived from it.

Plan shape: one scan restricted to the two periods (partition pruning on ``period_key``),
one conditional hash aggregate per group (both periods side by side, so the "full outer"
alignment is free and an absent side is 0), then derived columns on <= #groups rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..binding import DEFAULT, Binding
from ..functions.numbers import pct_change, pct_expr, pct_int
from ..functions.text import norm_text, norm_text_lit
from ..operators.dims import dim_decode


def compare_by_group(df: DataFrame, p1: int, p2: int, dim: DataFrame, b: Binding = DEFAULT,
                     clamp_negative: bool = True, group_name: str | None = None,
                     period_col: str | None = None) -> DataFrame:
    """Per group: facilities in each period, operating (status) in period 2, and for each
    compare measure v1, v2, delta, pct (2 dec., 0 when v1 = 0). Optional group-name filter:
    an unknown name gives an empty result [D5]."""
    pc = period_col or b.period
    src = df.where(F.col(pc).isin(p1, p2) & F.col(b.group_id).isNotNull())
    # the conditional aggregates are written as SQL text: one driver call per column
    q = lambda c: f"`{c}`"
    in1, in2 = f"{q(pc)} = {int(p1)}", f"{q(pc)} = {int(p2)}"
    val = (lambda c: f"greatest(coalesce(CAST({q(c)} AS BIGINT), 0L), 0L)") if clamp_negative else \
        (lambda c: f"coalesce(CAST({q(c)} AS BIGINT), 0L)")
    aggs = [F.expr(f"CAST(count_if({in1}) AS BIGINT)").alias("facilities_p1"),
            F.expr(f"CAST(count_if({in2}) AS BIGINT)").alias("facilities_p2"),
            F.expr(f"CAST(count_if({in2} AND coalesce({q(b.status)} = {int(b.operating_code)}, false)) AS BIGINT)")
             .alias("operating_p2")]
    for o, c in b.compare_measures:
        aggs.append(F.expr(f"CAST(coalesce(sum(CASE WHEN {in1} THEN {val(c)} END), 0L) AS BIGINT)").alias(f"{o}_p1"))
        aggs.append(F.expr(f"CAST(coalesce(sum(CASE WHEN {in2} THEN {val(c)} END), 0L) AS BIGINT)").alias(f"{o}_p2"))
    g = src.groupBy(b.group_id).agg(*aggs)
    g = g.select("*", *_deltas(b))
    g = dim_decode(g, b.group_id, dim, "group_name", "Estado_")
    if group_name:
        g = g.where(norm_text("group_name") == F.lit(norm_text_lit(group_name)))
    return g


def _deltas(b: Binding) -> list[Column]:
    """Derived delta / % columns, built as one projection (no withColumn chains)."""
    out = [F.expr("facilities_p2 - facilities_p1").alias("facilities_delta")]
    for o, _ in b.compare_measures:
        out.append(F.expr(f"`{o}_p2` - `{o}_p1`").alias(f"{o}_delta"))
        out.append(pct_expr(f"`{o}_p2` - `{o}_p1`", f"`{o}_p1`").alias(f"{o}_pct"))
    return out


def compare_totals(per_group: DataFrame, b: Binding = DEFAULT) -> DataFrame:
    """National totals of the per-group comparison, with delta and % per measure."""
    cols = ["facilities_p1", "facilities_p2", "operating_p2"]
    for o, _ in b.compare_measures:
        cols += [f"{o}_p1", f"{o}_p2"]
    t = per_group.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in cols])
    return t.select("*", *_deltas(b))


def new_and_removed(df: DataFrame, p1: int, p2: int, b: Binding = DEFAULT, period_col: str | None = None) -> DataFrame:
    """|K2 - K1| and |K1 - K2| over distinct non-null keys of the two periods (one shuffle on
    the key, so the work spreads over all keys); if either set is empty, max(0, size diff).
    Not restricted by any group filter (as in the reference)."""
    pc = period_col or b.period
    k = (df.where(F.col(pc).isin(p1, p2) & F.col(b.facility).isNotNull())
         .groupBy(b.facility)
         .agg(F.max((F.col(pc) == p1).cast("int")).alias("in1"), F.max((F.col(pc) == p2).cast("int")).alias("in2")))
    s = k.agg(F.coalesce(F.sum("in1"), F.lit(0)).cast("bigint").alias("keys_p1"),
              F.coalesce(F.sum("in2"), F.lit(0)).cast("bigint").alias("keys_p2"),
              F.count_if((F.col("in2") == 1) & (F.col("in1") == 0)).cast("bigint").alias("n_new"),
              F.count_if((F.col("in1") == 1) & (F.col("in2") == 0)).cast("bigint").alias("n_removed"))
    both = (F.col("keys_p1") > 0) & (F.col("keys_p2") > 0)
    diff = F.col("keys_p2") - F.col("keys_p1")
    return s.select("keys_p1", "keys_p2",
                    F.when(both, F.col("n_new")).otherwise(F.greatest(diff, F.lit(0))).alias("new_facilities"),
                    F.when(both, F.col("n_removed")).otherwise(F.greatest(-diff, F.lit(0))).alias("removed_facilities"))


def compare_summary(per_group: DataFrame, nr: DataFrame, b: Binding = DEFAULT) -> DataFrame:
    """Headline row: facilities in both periods, new/removed, the cn_total change and its text."""
    t = compare_totals(per_group, b).select("facilities_p1", "facilities_p2", "cn_total_p1", "cn_total_p2",
                                            "cn_total_delta", "cn_total_pct")
    # both inputs are single-row aggregates: combine via scalar subqueries (no join needed)
    n_new = nr.select("new_facilities").scalar()
    n_rem = nr.select("removed_facilities").scalar()
    d = F.col("cn_total_delta")
    text = F.concat(F.lit("CN Total "), F.when(d >= 0, F.lit("+")).otherwise(F.lit("")),
                    F.format_number(d, 0))
    return t.select("*", n_new.alias("new_facilities"), n_rem.alias("removed_facilities"), text.alias("headline"))


def _dist(prefix: str, lv: list[str]) -> list[Column]:
    tot = sum((F.col(f"{c}_{prefix}") for c in lv), F.lit(0))
    den = F.when(tot == 0, F.lit(1)).otherwise(tot)
    return [pct_int(F.col(f"{c}_{prefix}"), den, 2).alias(f"share_{c}_{prefix}") for c in lv]


def compare_advanced(per_group: DataFrame, b: Binding = DEFAULT) -> DataFrame:
    """Growth rate, certificates per operating facility (period 2 total count, [D13]), the most
    dynamic group (max |delta cn_total| > 0, ties by name), level shares in each period (denominator
    1 when the sum is 0) and their change in points."""
    lv = [o for o, _ in b.compare_measures if o in ("cn_inicial", "cn_prim", "cn_sec")]
    t = compare_totals(per_group, b)
    # largest |change| first, ties by the smallest name
    best = per_group.agg(F.max(F.abs("cn_total_delta")).alias("m")).scalar()
    top = (per_group.where((F.abs("cn_total_delta") == best) & (best > 0))
           .agg(F.min("group_name").alias("g")).scalar())
    out = t.select(
        F.col("cn_total_pct").alias("growth_rate"),
        pct_int(F.col("cn_total_p2"), F.col("facilities_p2") * 100, 2).alias("efficiency"),
        F.coalesce(top, F.lit("N/A")).alias("most_dynamic_group"),
        F.when(best > 0, best).otherwise(F.lit(0)).cast("bigint").alias("most_dynamic_change"),
        *_dist("p1", lv), *_dist("p2", lv))
    return out.select("*", *[((F.round(F.col(f"share_{c}_p2") * 100).cast("bigint")
                                - F.round(F.col(f"share_{c}_p1") * 100).cast("bigint")) / 100.0).alias(f"share_{c}_delta")
                              for c in lv])


# Score weights/caps of the group ranking and class thresholds.
SCORE_CLASSES = ((8, "excellent"), (6, "good"), (4, "fair"))


def score_class(score: Column) -> Column:
    e = F.when(score >= SCORE_CLASSES[0][0], SCORE_CLASSES[0][1])
    for t, n in SCORE_CLASSES[1:]:
        e = e.when(score >= t, n)
    return e.otherwise("low")


def group_score(pct: Column, delta: Column, cn2: Column, n2: Column) -> Column:
    """min(pct/100,1)*4 + min(delta/1000,1)*3 + min((cn2/n2)/10,1)*3 rounded to 1 decimal,
    evaluated exactly on integers (pct carries 2 decimals)."""
    p = F.round(pct * 100).cast("bigint")
    n = F.greatest(n2.cast("bigint"), F.lit(1))
    eff = F.when(n2 > 0, F.least(cn2.cast("bigint"), n * 10)).otherwise(F.lit(0))
    num = F.least(p, F.lit(10000)) * 2 * n + F.least(delta.cast("bigint"), F.lit(1000)) * 15 * n + eff * 1500
    den = 500 * n
    return pct_int(num, den * 100, 0) / 10.0


def compare_ranking(per_group: DataFrame) -> DataFrame:
    """Groups scored and ranked by % change of cn_total (desc, ties by name)."""
    sc = group_score(F.col("cn_total_pct"), F.col("cn_total_delta"), F.col("cn_total_p2"), F.col("facilities_p2"))
    r = per_group.select("group_name", "cn_total_delta", "cn_total_pct", "facilities_p2",
                         pct_int(F.col("cn_total_p2"), F.col("facilities_p2") * 100, 2).alias("efficiency"),
                         sc.alias("score"))
    w = Window.orderBy(F.col("cn_total_pct").desc(), F.col("group_name"))
    # a single ordered window over <= #groups aggregated rows (not raw rows)
    return r.withColumn("score_class", score_class(F.col("score"))).withColumn("rank", F.row_number().over(w).cast("bigint"))


def compare_trends(per_group: DataFrame, totals: DataFrame, levels=("cn_inicial", "cn_prim", "cn_sec")) -> DataFrame:
    """Per level: the 3 groups with the highest % change, plus the national rate and its label."""
    parts = [F.struct(F.lit(l).alias("level"), F.col(f"{l}_pct").alias("pct"), F.col(f"{l}_delta").alias("delta"))
             for l in levels]
    long = per_group.select("group_name", F.explode(F.array(*parts)).alias("x")).select("group_name", "x.*")
    w = Window.partitionBy("level").orderBy(F.col("pct").desc(), F.col("group_name"))
    top = long.withColumn("pos", F.row_number().over(w).cast("bigint")).where("pos <= 3")
    nat = totals.select(F.explode(F.array(*[F.struct(F.lit(l).alias("level"), F.col(f"{l}_pct").alias("national_pct"))
                                            for l in levels])).alias("x")).select("x.*")
    lab = (F.when(F.col("national_pct") > 0, "growth").when(F.col("national_pct") < 0, "decline")
           .otherwise("stable"))
    return top.join(F.broadcast(nat), "level").withColumn("national_label", lab)  # nat: one row per level


# Executive-summary thresholds (growth %, share of growing groups %).
def compare_executive(per_group: DataFrame, totals: DataFrame) -> DataFrame:
    p = F.col("cn_total_pct")
    c = per_group.agg(F.count_if(p > 1).cast("bigint").alias("groups_growing"),
                      F.count_if(p < -1).cast("bigint").alias("groups_shrinking"),
                      F.count_if((p >= -1) & (p <= 1)).cast("bigint").alias("groups_stable"),
                      F.count(F.lit(1)).alias("groups"))
    t = totals.select("cn_total_pct").scalar()
    share = pct_int("groups_growing", "groups", 2)
    trend = (F.when(t > 5, "strongly positive").when(t > 0, "positive").when(t < -5, "strongly negative")
             .when(t < 0, "negative").otherwise("stable"))
    rec = (F.when((t > 10) & (share > 70), "excellent").when((t > 5) & (share > 50), "good")
           .when(t > 0, "moderate").when(t == 0, "stable").otherwise("negative"))
    return c.select("*", t.alias("growth_rate"), share.alias("pct_groups_growing"), trend.alias("trend"),
                    rec.alias("recommendation"))


def compare_group_card(per_group: DataFrame, group_name: str) -> DataFrame:
    cols = ["cn_total", "cn_inicial", "cn_prim", "cn_sec"]
    g = per_group.where(norm_text("group_name") == F.lit(norm_text_lit(group_name)))
    return g.select("group_name", "facilities_p1", "facilities_p2", "facilities_delta",
                    pct_change(F.col("facilities_p1"), F.col("facilities_p2")).alias("facilities_pct"),
                    *[F.col(f"{c}_{s}") for c in cols for s in ("p1", "p2", "delta", "pct")])


def compare_years(df: DataFrame, y1: int, y2: int, dim: DataFrame, b: Binding = DEFAULT,
                  current_year: int | None = None, clamp_negative: bool = False) -> DataFrame:
    """Two complete years (all 12 months present, or the current year): per group the sums of
    the monthly aggregates of each year, delta and %. Incomplete years give no rows."""
    from ..operators.aggregates import available_periods
    ok = available_periods(df, b, current_year).where(F.col("year").isin(y1, y2)).select("year")
    src = df.where(F.col(b.year).isin(y1, y2)).join(
        F.broadcast(ok.withColumnRenamed("year", "__y")), F.col(b.year) == F.col("__y"), "left_semi")
    return compare_by_group(src, y1, y2, dim, b, clamp_negative, period_col=b.year)


# Orderings of the group comparison table: criterion -> sort expression.
SORT_CRITERIA = {
    "name": None, "facilities": "facilities_p2", "cn": "cn_total_p2", "pct": "cn_total_pct",
    "inicial": "cn_inicial_pct", "primaria": "cn_prim_pct", "secundaria": "cn_sec_pct",
    "delta": "facilities_delta", "cnp1": "cn_total_p1", "cnabs": "abs_cn_total_p2",
}


def _sort_key(criterion: str) -> Column:
    if criterion == "name":
        name = F.col("group_name")
        return name.collate("UNICODE_CI_AI") if hasattr(Column, "collate") else F.lower(name)
    if criterion == "cnabs":
        return F.abs("cn_total_p2")
    return F.col(SORT_CRITERIA[criterion])


def order_group_comparison(per_group: DataFrame, criterion: str = "name", direction: str = "asc") -> DataFrame:
    """The comparison table sorted by one criterion (names compared ignoring case and
    accents); ties by name."""
    k = _sort_key(criterion)
    return per_group.orderBy(k.asc() if direction == "asc" else k.desc(), F.col("group_name"))


def sort_group_comparison(per_group: DataFrame, direction: str = "desc") -> DataFrame:
    """Position of each group under every ordering of the table (name ascending, the numeric
    criteria in ``direction``); windows over <= #groups aggregated rows."""
    cols = [F.row_number().over(Window.orderBy(_sort_key("name"), F.col("group_name"))).cast("bigint").alias("by_name")]
    for c in SORT_CRITERIA:
        if c == "name":
            continue
        k = _sort_key(c)
        cols.append(F.row_number().over(Window.orderBy(k.desc() if direction == "desc" else k.asc(),
                                                       F.col("group_name"))).cast("bigint").alias(f"by_{c}"))
    return per_group.select("group_name", "cn_total_pct", *cols)
