"""The nearest facility through the cell hierarchy, against brute force and on uneven maps."""

import math
import random

from pyspark.sql import functions as F

from tessera.binding import DEFAULT as B
from tessera.operators.cells import FINEST, cell_counts, distance_bounds
from tessera.operators.nearby import candidate_cells, nearest_facility

FAC, PTS = "clave string, lat double, lng double", "point_id int, lat double, lng double"


def _km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    x = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 6371.0 * 2 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def _brute(points, facilities, max_km):
    out = {}
    for p, la, lo in points:
        d = [(round(_km(la, lo, fa, fo), 2), k) for k, fa, fo in facilities if None not in (la, lo, fa, fo) and _km(la, lo, fa, fo) <= max_km]
        if d:
            out[p] = min(d)
    return out


def _run(spark, points, facilities, max_km=30_000.0):
    df = nearest_facility(spark.createDataFrame(points, PTS), spark.createDataFrame(facilities, FAC), max_km, B)
    return {r.point_id: (r.distance_km, r.facility) for r in df.collect()}


def test_nearest_equals_brute_force_over_the_globe(spark):
    r = random.Random(5)
    anywhere = lambda: (math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180))
    edge = [(90.0, 10.0), (-90.0, 0.0), (89.99, 179.0), (0.0, 180.0), (0.0, -180.0), (12.0, 179.999), (12.0, -179.999), (-89.5, -120.0)]
    for n in (1, 7, 400):
        facilities = [(f"f{i:03d}", *anywhere()) for i in range(n)] + [(f"e{i}", *x) for i, x in enumerate(edge[::2])] * (n > 1)
        points = [(i, *anywhere()) for i in range(150)] + [(1000 + i, *x) for i, x in enumerate(edge)]
        for km in (30_000.0, 900.0):
            got, want = _run(spark, points, facilities, km), _brute(points, facilities, km)
            assert got.keys() == want.keys()
            assert all(abs(got[p][0] - want[p][0]) < 0.011 and (got[p] == want[p] or abs(got[p][0] - want[p][0]) > 0) for p in want)


def test_ties_nulls_and_empty_tables(spark):
    facilities = [("b", 20.0, -100.0), ("a", 20.0, -100.0), ("c", 20.00001, -100.0), ("n", None, -100.0), ("x", float("nan"), 1.0)]
    points = [(1, 20.0, -100.0), (2, None, 1.0), (3, float("nan"), 2.0), (4, 21.0, -100.0), (4, 21.0, -100.0)]
    got = _run(spark, points, facilities)
    assert got == {1: (0.0, "a"), 4: (got[4][0], got[4][1])} and got[4] == (111.19, "a")
    assert _run(spark, points, []) == {} and _run(spark, [], facilities) == {}


def test_a_dense_town_costs_its_nearest_edge_only(spark):
    # 40,000 facilities in one town, a few far apart: points see a small part of the town, and no ring is common to them
    r = random.Random(2)
    town = [(f"t{i:05d}", 20.0 + r.uniform(0, 0.2), -100.0 + r.uniform(0, 0.2)) for i in range(40_000)]
    rural = [(f"r{i:02d}", 25.0 + i / 2, -110.0 + i) for i in range(10)]
    points = [(1, 20.1, -99.9), (2, 19.99, -99.9), (3, 20.05, -99.95), (4, 31.0, -104.0), (5, 18.0, -101.0)]
    pts, fac = spark.createDataFrame(points, PTS), spark.createDataFrame(town + rural, FAC)
    seen = {x.point_id: x.n for x in candidate_cells(pts, fac, 5000.0, B).groupBy("point_id").agg(F.sum("n").alias("n")).collect()}
    assert all(seen[p] <= 1500 for p in seen) and seen[1] <= 100, seen
    assert _run(spark, points, town + rural) == _brute(points, town + rural, 30_000.0)


def test_jobs_do_not_grow_with_the_spread_of_the_points(spark):
    # one index, one table of candidate cells and one pass over the facilities, whether points are near or far
    fac = spark.createDataFrame([("a", 20.0, -100.0), ("b", 21.0, -101.0)], FAC)

    def jobs(points, group):
        spark.sparkContext.setJobGroup(group, group)
        nearest_facility(spark.createDataFrame(points, PTS), fac, 30_000.0, B).collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    near, far = [(1, 20.0, -100.0)], [(1, 20.0, -100.0), (2, 20.5, -100.5), (3, 40.0, -60.0), (4, -60.0, 80.0), (5, -20.0, 79.0)]
    assert jobs(near, "near") == jobs(far, "far")


def test_counts_of_parents_are_the_sums_of_their_children(spark):
    r = random.Random(1)
    fac = spark.createDataFrame([(f"f{i}", r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(500)], FAC)
    rows = cell_counts(fac, "lat", "lng").collect()
    level = {}
    for x in rows:
        level.setdefault(x.cell >> 40, []).append(x.n)
    assert sorted(level) == list(range(FINEST + 1)) and all(sum(v) == 500 for v in level.values())


def test_bounds_hold_for_random_cells(spark):
    r = random.Random(8)
    rows = []
    for _ in range(3000):
        l = r.randrange(0, 6)
        n, s = 4 ** l, 180 / 4 ** l
        band, col = r.randrange(n), r.randrange(2 * n)
        rows.append((r.uniform(-90, 90), r.uniform(-180, 180), (l << 40) + (band << 20) + col, band * s - 90 + r.uniform(0, s), col * s - 180 + r.uniform(0, s)))
    df = spark.createDataFrame(rows, "a double, b double, cell long, c double, d double")
    lo, hi = distance_bounds("a", "b", "cell")
    for x in df.select("*", lo.alias("lo"), hi.alias("hi")).collect():
        assert x.lo <= _km(x.a, x.b, x.c, x.d) <= x.hi
