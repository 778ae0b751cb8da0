"""Invariants on the derived panel: totals, shares, key-set identity, symmetry."""

from pyspark.sql import functions as F

from tessera.binding import DEFAULT as B
from tessera.operators import aggregates as ag
from tessera.plans import compare as cp
from tessera.plans import testqueries as tq

SF = "/root/testdata/sf0.001"


def test_groups_sum_to_totals(spark):
    p = tq.panel(spark, SF)
    g = ag.group_measure_totals(p, B)
    total = p.agg(F.sum(F.col("cn_inicial") + F.col("cn_prim") + F.col("cn_sec"))).first()[0]
    assert g.agg(F.sum("sum_total")).first()[0] == total
    shares = g.agg(F.sum("pct_of_national")).first()[0]
    assert abs(shares - 100.0) <= 0.01 * g.count()


def test_new_minus_removed_is_size_difference(spark):
    p = tq.panel(spark, SF)
    r = cp.new_and_removed(p, 200007, 200107, B).first()
    assert r.new_facilities - r.removed_facilities == r.keys_p2 - r.keys_p1


def test_compare_totals_match_group_rows(spark):
    dim = tq._nation_dim(spark, SF)
    g = cp.compare_by_group(tq.panel(spark, SF), 200007, 200107, dim, B)
    t = cp.compare_totals(g, B).first()
    assert t.cn_total_p2 == g.agg(F.sum("cn_total_p2")).first()[0]
    assert t.facilities_delta == t.facilities_p2 - t.facilities_p1


def test_status_pivot_rows_add_up(spark):
    latest = tq._latest(spark, SF)
    pv = ag.status_pivot(latest, B)
    bad = pv.where(F.col("total") != sum(F.col(f"status_{c}") for c in ag.STATUS_CODES)).count()
    assert bad == 0
    assert pv.agg(F.sum("total")).first()[0] == latest.select("estado", "situacion", "clave").distinct().count()
