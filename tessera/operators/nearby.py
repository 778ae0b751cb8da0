"""Distance joins: facilities within R km of query points, and the nearest facility.

Spatial index = an equi-join key. Both sides get a grid cell sized from R; each query point
is replicated into its 3x3 neighbourhood of cells, the join is an equi-join on the cell, and
the exact haversine distance filters the candidates. No candidate cap: every facility within
R is found (the cell size guarantees it), and nothing outside R survives the exact filter.
The query side is broadcast only if its estimated size is within a bound; otherwise both sides
shuffle on the cell key (AQE splits a hot cell).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..binding import DEFAULT, Binding
from ..functions.geo import EARTH_RADIUS_KM, haversine_km
from ..session import reliable_checkpoint
from ..sources.tables import plan_size_bytes
from .cells import FINEST, around, cell_counts, cells_of, children, covering, distance_bounds, level_of
from .ranking import top_k_per

KM_PER_DEG = math.pi * EARTH_RADIUS_KM / 180.0


def _band_width(cy: Column, dlat: float, radius_km: float) -> Column:
    """Longitude width (degrees) of the cells in latitude band ``cy``: wide enough that two
    points within ``radius_km`` whose bands differ by at most one fall in the same or adjacent
    cells. Both points lie in bands cy-1..cy+1, so |lat| <= max(|cy-2|, |cy+3|) * dlat, and the
    haversine formula gives sin(dlng/2) <= sin(R/2r) / cos(lat_max)."""
    phi = F.least(F.greatest(F.abs(cy - 2), F.abs(cy + 3)) * dlat, F.lit(89.9))
    s = math.sin(radius_km / (2 * EARTH_RADIUS_KM)) / F.cos(F.radians(phi))
    return F.when(s >= 1, F.lit(360.0)).otherwise(F.least(F.degrees(2 * F.asin(s)) * 1.000001, F.lit(360.0)))


def radius_join(points: DataFrame, facilities: DataFrame, radius_km: float, b: Binding = DEFAULT,
                limit_per_point: int | None = None) -> DataFrame:
    """(point_id, facility key, distance_km rounded to 2 dec.) for every facility within
    ``radius_km`` of each point; nearest first per point (ties by key), optionally the first n.
    ``points`` has columns point_id, lat, lng.

    Cells: latitude bands of R/111.2 km; within a band the longitude width follows the band's
    latitude (``_band_width``), so cells stay small near the equator and still exact near the
    poles. Each point probes the 3 neighbouring bands x 3 cells; only points within a cell of the
    antimeridian also probe the cells beyond it. No data-dependent parameter: no extra job."""
    dlat = radius_km / KM_PER_DEG * 1.000001
    fac = facilities.where(F.col(b.lat).isNotNull() & F.col(b.lng).isNotNull())
    fy = F.floor(F.col(b.lat) / dlat).cast("bigint")
    fcell = (fac.select(F.col(b.facility).alias("facility"), F.col(b.lat).alias("f_lat"),
                        F.col(b.lng).alias("f_lng"), fy.alias("cy"))
             .withColumn("cx", F.floor((F.col("f_lng") + 180.0) / _band_width(F.col("cy"), dlat, radius_km))
                         .cast("bigint")))
    probes = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    at = (points.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
          .select("point_id", F.col("lat").alias("q_lat"), F.col("lng").alias("q_lng"), F.floor(F.col("lat") / dlat).cast("bigint").alias("y")))
    widest = F.greatest(*[_band_width(F.col("y") + dy, dlat, radius_km) for dy in (-1, 0, 1)])
    beyond = F.array_compact(F.array(F.lit(0.0), F.when(F.col("q_lng") <= widest - 180.0, F.lit(360.0)),
                                     F.when(F.col("q_lng") >= 180.0 - widest, F.lit(-360.0))))
    q = (at.withColumn("sh", F.explode(beyond)).withColumn("o", F.explode(probes))
         .withColumn("cy", F.col("y") + F.col("o.dy")))
    w = _band_width(F.col("cy"), dlat, radius_km)
    q = (q.withColumn("cx", F.floor((F.col("q_lng") + F.col("sh") + 180.0) / w).cast("bigint") + F.col("o.dx"))
         .select("point_id", "q_lat", "q_lng", "cy", "cx").distinct())
    # a point becomes nine probe rows, or a few more: the bound is on the points
    est = plan_size_bytes(points)
    q = F.broadcast(q) if est is not None and est <= (1 << 20) else q
    j = fcell.join(q, ["cy", "cx"])
    d = haversine_km("q_lat", "q_lng", "f_lat", "f_lng")
    hits = (j.withColumn("distance_km_exact", d).where(F.col("distance_km_exact") <= F.lit(radius_km))
            .select("point_id", "facility", F.round("distance_km_exact", 2).alias("distance_km"),
                    "distance_km_exact"))
    # (point, cell) probes are distinct and a facility has one cell: each pair occurs once
    if limit_per_point is not None:
        hits = top_k_per(hits, "point_id", [F.col("distance_km"), F.col("facility")], limit_per_point, "pos")
    return hits


def candidate_cells(points: DataFrame, facilities: DataFrame, max_km: float, b: Binding = DEFAULT) -> DataFrame:
    """point_id, q_lat, q_lng, cell, n: the occupied cells that can hold a point's nearest facility.

    Each point starts at its own level: of all levels, the cells around it that are occupied bound its
    nearest distance from above, and the finest ones do so most tightly. The disc of that radius is
    covered with cells of a level that fits it; then, a few times, cells that hold many facilities give
    way to their occupied children, which tightens the bound, and cells beyond it fall away. Of a
    dense town, near or far, only the nearest edge so remains."""
    fac = facilities.where(F.col(b.lat).isNotNull() & F.col(b.lng).isNotNull() & ~F.isnan(b.lat) & ~F.isnan(b.lng))
    index = reliable_checkpoint(cell_counts(fac.select(b.lat, b.lng), b.lat, b.lng))
    q = points.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~F.isnan("lat") & ~F.isnan("lng")).select(
        "point_id", F.col("lat").alias("q_lat"), F.col("lng").alias("q_lng"))
    lat, lng, cell, me = F.col("q_lat"), F.col("q_lng"), F.col("cell"), ["point_id", "q_lat", "q_lng"]
    near = _probes(points, q.select(*me, F.explode(around(lat, lng, F.sequence(F.lit(0), F.lit(FINEST)))).alias("cell")))
    least, most = distance_bounds("q_lat", "q_lng", "cell")
    reach = index.join(near, "cell").groupBy(*me).agg(F.least(F.min(most), F.lit(max_km)).alias("reach"))
    crowded = index.where(F.col("n") > SPLIT_OVER).agg(F.max(level_of(cell))).first()[0]
    descents = 0 if crowded is None else min(crowded + 1, DESCENTS)  # none where no cell is crowded
    cells = reach.select(*me, F.explode(covering(lat, lng, F.col("reach") + ROUNDING_KM)).alias("cell"))
    for step in range(descents + 1):
        seen = index.join(_probes(points, cells), "cell").select(*me, F.struct("cell", "n", least.alias("least")).alias("c"), most.alias("most"))
        # ranks use the distance rounded to 2 dec.: cells where rounding can tie with the bound stay
        held = seen.groupBy(*me).agg(F.collect_list("c").alias("cells"), F.least(F.min("most"), F.lit(max_km)).alias("bound"))
        kept = held.select(*me, F.inline(F.filter("cells", lambda c: c["least"] <= F.col("bound") + ROUNDING_KM))).drop("least")
        if step < descents:
            deeper = (F.col("n") > SPLIT_OVER) & (level_of(cell) < FINEST)
            cells = kept.select(*me, F.explode(F.when(deeper, children(cell)).otherwise(F.array(cell))).alias("cell"))
    return kept


#: Cells that hold more than this give way to their children, so many times over at most.
SPLIT_OVER, DESCENTS = 64, 5
#: What rounding to 2 dec. can make equal.
ROUNDING_KM = 0.01


def _probes(points: DataFrame, probes: DataFrame) -> DataFrame:
    """Probe cells are broadcast where the points are few (a bound on their bytes); else AQE chooses."""
    est = plan_size_bytes(points)
    return F.broadcast(probes) if est is not None and est <= (1 << 18) else probes


def nearest_facility(points: DataFrame, facilities: DataFrame, max_km: float = 5000.0, b: Binding = DEFAULT) -> DataFrame:
    """Single closest facility per point within ``max_km`` (ranked on the distance rounded to 2 dec., then
    key [D9]).

    No ring search: ``candidate_cells`` gives each point the few cells of the hierarchy that matter, all
    facilities of those cells are measured, and the least goes to the point. The cell counts and the
    candidate cells are each checkpointed once, however far points and facilities are apart. A facility
    takes part once for each level that the candidates use. Coordinates are degrees; rows without them
    (null or NaN) take no part."""
    cand = reliable_checkpoint(candidate_cells(points, facilities, max_km, b))
    used = cand.select(F.collect_set(level_of(F.col("cell"))).alias("l")).scalar()  # ten levels at most
    fac = facilities.where(F.col(b.lat).isNotNull() & F.col(b.lng).isNotNull() & ~F.isnan(b.lat) & ~F.isnan(b.lng))
    placed = fac.select(F.col(b.facility).alias("facility"), F.col(b.lat).alias("f_lat"), F.col(b.lng).alias("f_lng"),
                        F.explode(cells_of(F.col(b.lat), F.col(b.lng), F.sequence(F.lit(0), F.lit(FINEST)))).alias("cell")
                        ).where(F.array_contains(used, level_of(F.col("cell"))))
    met = placed.join(_probes(points, cand.drop("n")), "cell").withColumn("exact", haversine_km("q_lat", "q_lng", "f_lat", "f_lng"))
    hits = met.where(F.col("exact") <= F.lit(max_km)).withColumn("distance_km", F.round("exact", 2))
    return hits.groupBy("point_id").agg(
        F.min_by(F.struct("facility", "distance_km"), F.struct("distance_km", "facility")).alias("n")).select(
        "point_id", "n.facility", "n.distance_km")
