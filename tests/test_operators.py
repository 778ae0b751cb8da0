"""Operators on the small golden panel of FIXTURES.md §6 and plan-shape checks."""

import math
import pytest
from pyspark.sql import functions as F

from tessera.binding import DEFAULT as B
from tessera.operators import filters as flt
from tessera.operators.dims import as_dim
from tessera.plans import compare as cp

ROWS = [
    (2024, 12, "K1", 14, 1, "SI", 10, 20, 30, 5),
    (2024, 12, "K2", 14, 0, "no", 1, 2, 3, None),
    (2024, 12, "K3", 9, 1, None, 40, 0, 0, -4),
    (2025, 3, "K1", 14, 1, "Fibra", 12, 20, 40, 6),
    (2025, 3, "K4", 9, 1, "no", 50, None, 10, 7),
]


@pytest.fixture(scope="module")
def golden(spark):
    df = spark.createDataFrame(ROWS, "anio int, mes int, clave string, estado_id int, situacion int, conectividad string, "
                                     "cn_inicial long, cn_prim long, cn_sec long, inc_total long")
    return df.select("*", (F.col("anio") * 100 + F.col("mes")).alias("period_key"),
                     F.coalesce(F.col("cn_inicial"), F.lit(0)).alias("cn_total"), F.lit(0).cast("long").alias("aten_total"),
                     F.concat(F.lit("G"), F.col("estado_id").cast("string")).alias("estado"))


def test_latest_modes(spark, golden):
    assert flt.latest_period_filter(golden, B, mode="month").count() == 3
    assert flt.latest_period_filter(golden, B, mode="period").count() == 2


def test_compare_golden(spark, golden):
    dim = as_dim(golden.select("estado_id", "estado").distinct(), "estado_id", "estado")
    g = cp.compare_by_group(golden, 202412, 202503, dim, B, clamp_negative=True)
    t = cp.compare_totals(g, B).first()
    assert (t.facilities_p1, t.facilities_p2) == (3, 2)
    assert (t.cn_inicial_p1, t.cn_inicial_p2, t.cn_inicial_delta, t.cn_inicial_pct) == (51, 62, 11, 21.57)
    assert (t.inc_total_p1, t.inc_total_p2, t.inc_total_pct) == (5, 13, 160.0)
    u = cp.compare_totals(cp.compare_by_group(golden, 202412, 202503, dim, B, clamp_negative=False), B).first()
    assert (u.inc_total_p1, u.inc_total_pct) == (1, 1200.0)
    nr = cp.new_and_removed(golden, 202412, 202503, B).first()
    assert (nr.new_facilities, nr.removed_facilities) == (1, 2)


def test_compare_antisymmetric(spark, golden):
    dim = as_dim(golden.select("estado_id", "estado").distinct(), "estado_id", "estado")
    a = cp.compare_totals(cp.compare_by_group(golden, 202412, 202503, dim, B), B).first()
    b = cp.compare_totals(cp.compare_by_group(golden, 202503, 202412, dim, B), B).first()
    assert a.cn_total_delta == -b.cn_total_delta


def test_scores(spark):
    df = spark.createDataFrame([(25.0, 500, 8, 1), (150.0, 2000, 12, 1), (-10.0, -200, 1, 1)], "p double, d long, c long, n long")
    got = [r[0] for r in df.select(cp.group_score(F.col("p"), F.col("d"), F.col("c"), F.col("n"))).collect()]
    assert got == [4.9, 10.0, -0.7]


def test_group_totals_sum_to_national(spark, golden):
    from tessera.operators.aggregates import group_measure_totals
    g = group_measure_totals(golden, B).orderBy("estado_id").collect()
    assert [(r.estado_id, r.sum_total, r.pct_of_national) for r in g] == [(9, 100, 42.02), (14, 138, 57.98)]


def test_connectivity(spark, golden):
    from tessera.operators.aggregates import connected_per_group
    latest = flt.latest_period_filter(golden, B)
    got = {r.estado_id: (r.operating, r.connected, r.pct_connected) for r in connected_per_group(latest, B).collect()}
    assert got == {14: (1, 1, 100.0), 9: (1, 0, 0.0)}


def test_no_cartesian_or_python_udf(spark, golden):
    dim = as_dim(golden.select("estado_id", "estado").distinct(), "estado_id", "estado")
    plan = cp.compare_by_group(golden, 202412, 202503, dim, B)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def great_circle(a, b, c, d):
    """By the angle between two unit vectors."""
    def unit(lat, lng):
        la, lo = math.radians(lat), math.radians(lng)
        return math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)
    p, q = unit(a, b), unit(c, d)
    cross = math.dist((0, 0, 0), (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]))
    return 6371.0 * math.atan2(cross, sum(x * y for x, y in zip(p, q)))


def test_radius_join_matches_brute_force(spark):
    import random
    from tessera.operators.nearby import radius_join
    rnd = random.Random(7)
    fac = [(f"F{i}", 14.5 + rnd.random() * 18, -118 + rnd.random() * 30) for i in range(400)]
    pts = [(i, 14.5 + rnd.random() * 18, -118 + rnd.random() * 30) for i in range(30)]
    f = spark.createDataFrame(fac, "clave string, lat double, lng double")
    p = spark.createDataFrame(pts, "point_id int, lat double, lng double")
    got = {(r.point_id, r.facility) for r in radius_join(p, f, 300.0, B).collect()}
    want = {(i, k) for i, a, b in pts for k, c, d in fac if great_circle(a, b, c, d) <= 300.0}
    assert got == want


def test_radius_join_global_and_antimeridian(spark):
    import random
    from tessera.operators.nearby import radius_join
    rnd = random.Random(11)
    fac = [(f"F{i}", rnd.uniform(-89, 89), rnd.uniform(-180, 180)) for i in range(600)]
    fac += [("W", 10.0, 179.95), ("E", 10.0, -179.95), ("N", 88.5, 20.0), ("N2", 88.7, -160.0)]
    pts = [(i, rnd.uniform(-89, 89), rnd.uniform(-180, 180)) for i in range(40)] + [(100, 10.0, 179.99), (101, 88.6, 100.0)]
    f = spark.createDataFrame(fac, "clave string, lat double, lng double")
    p = spark.createDataFrame(pts, "point_id int, lat double, lng double")
    for r in (50.0, 800.0):
        got = {(x.point_id, x.facility) for x in radius_join(p, f, r, B).collect()}
        want = {(i, k) for i, a, b in pts for k, c, d in fac if great_circle(a, b, c, d) <= r}
        assert got == want, r
