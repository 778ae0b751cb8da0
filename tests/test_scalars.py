"""Golden rows for the scalar expressions (FIXTURES.md §2, §3, §6)."""

import math

from pyspark.sql import functions as F

from tessera.functions import geo, numbers as nb, period as pe, text as tx
from tessera.operators.clean import encode_status, reject_reason


def one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_safe_int_golden(spark):
    cases = [(None, 0), ("2.5", 2), ("3.5", 4), ("$ 1,234.50 mxn", 1234), ("-", 0), ("n/d", 0), ("--", 0)]
    for v, want in cases:
        assert one(spark, nb.safe_int("v"), v) == want, v


def test_safe_float_and_month(spark):
    assert one(spark, nb.safe_float("v"), "19.43°") == 19.43
    assert one(spark, nb.safe_float("v"), "abc") == 0.0
    for v, want in [(None, 1), ("0", 1), ("7", 7), ("13", 12), ("x", 1)]:
        assert one(spark, nb.clamp_month("v"), v) == want


def test_norm_text_and_status(spark):
    assert one(spark, tx.norm_text("v"), "  Querétaro Ñandú ") == "QUERETARO NANDU"
    assert one(spark, tx.norm_text("v"), None) == ""
    assert tx.norm_text_lit(" jalisco ") == "JALISCO"
    for v, want in [("En operación", 1), ("EN OPERACION", 0), ("SUSPENSIÓN TEMPORAL", 0), (None, 0)]:
        assert one(spark, encode_status("v"), v) == want


def test_period_key(spark):
    assert pe.period_key_lit(24, 3) == 202403 and pe.period_key_lit(2024, 12) == 202412
    df = spark.createDataFrame([(202403,)], "k int")
    y, m = pe.parse_period_key("k")
    r = df.select(y.alias("y"), m.alias("m"), pe.period_label(F.lit(2024), F.lit(3)).alias("l")).first()
    assert (r.y, r.m, r.l) == (2024, "03", "Marzo 2024")


def test_pct_int_rounding(spark):
    df = spark.createDataFrame([(51, 62), (5, 13), (1, 13), (0, 5), (-3, 3)], "a long, b long")
    got = [r[0] for r in df.select(nb.pct_change("a", "b")).collect()]
    assert got == [21.57, 160.0, 1200.0, 0.0, -200.0]


def test_haversine_and_travel(spark):
    df = spark.createDataFrame([(19.4326, -99.1332, 20.6597, -103.3496), (19.4326, -99.1332, 19.5, -99.2)],
                               "a double, b double, c double, d double")
    rows = df.select(geo.haversine_km("a", "b", "c", "d").alias("km")).select(
        "km", geo.travel_time_text(F.col("km")).alias("t")).collect()
    assert math.isclose(rows[0].km, 461.0673741723774, rel_tol=1e-9) and rows[0].t == "11h 31min"
    assert math.isclose(rows[1].km, 10.257354227756487, rel_tol=1e-9) and rows[1].t == "15 min"


def test_normalise_facility_key(spark):
    cases = [("MEXICO_I-15-086-02", "i-15-086-02"), ("I- 07-011-02", "i-07-011-02"), ("l-11-007-02", "i-11-007-02"),
             ("I-32-009-03_PEDREGOSO", "i-32-009-03"), ("I-19-001-17 (1)", "i-19-001-17"),
             ("I-07-49-02", "i-07-049-02"), ("I-021-001-16", "i-021-001-16"),
             ("PLAZA CROC MAZATLAN", "plaza croc mazatlan"), ("1-07-001", "1-07-001")]
    for v, want in cases:
        assert one(spark, tx.normalise_facility_key("v"), v) == want, v


def test_coordinate_reasons(spark):
    rows = [("19,4326", "-99.1332", None), ("abc", "-100", "not_numeric"), ("NaN", "-100", "nan"),
            ("inf", "-100", "infinite"), ("0", "-100", "zero"), ("40", "-100", "lat_out_of_range"),
            ("20", "-80", "lng_out_of_range"), ("21", "-101", None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "la string, lo string")
    got = [r[0] for r in df.select(reject_reason("la", "lo")).collect()]
    assert got == [w for _, _, w in rows]


def test_pct_int_matches_exact_fractions(spark):
    """Integer-space percentage == round-half-away-from-zero of the exact fraction."""
    from fractions import Fraction
    from hypothesis import given, settings, strategies as st

    pairs = []

    @settings(max_examples=200, deadline=None)
    @given(st.integers(-10**9, 10**9), st.integers(-10**6, 10**6))
    def collect(n, d):
        pairs.append((n, d))

    collect()
    df = spark.createDataFrame(pairs, "n long, d long")
    got = [r[0] for r in df.select(nb.pct_int(F.col("n"), F.col("d"), 2)).collect()]
    for (n, d), g in zip(pairs, got):
        if d == 0:
            assert g == 0.0
            continue
        x = Fraction(n * 100, d) * 100
        r = int(abs(x) + Fraction(1, 2)) * (1 if x >= 0 else -1)
        assert g == r / 100.0 and math.copysign(1, g) == (1 if r >= 0 else -1)
