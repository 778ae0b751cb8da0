"""Marker clustering re-aimed as grid aggregation per zoom level (Web-Mercator pixel cells)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..binding import DEFAULT, Binding
from ..functions.geo import web_mercator_cell

# Clustering radius in pixels and the zoom from which points are not clustered.
CLUSTER_PX = 70
NO_CLUSTER_ZOOM = 16


def geo_grid_cells(df: DataFrame, zooms=(4, 8, 12, 16), b: Binding = DEFAULT) -> DataFrame:
    """Per zoom: points and centroid per cell (count + mean), raw points at zoom >= 16.
    One scan: each point is replicated once per clustered zoom, then one hash aggregate."""
    cz = [z for z in zooms if z < NO_CLUSTER_ZOOM]
    def cell(z):
        cx, cy = web_mercator_cell(b.lat, b.lng, z, cell_px=CLUSTER_PX)
        return F.struct(F.lit(z).alias("zoom"), cx.alias("cx"), cy.alias("cy"))

    cells = F.array(*[cell(z) for z in cz])
    exploded = df.select(b.lat, b.lng, F.explode(cells).alias("c")).select("c.*", b.lat, b.lng)
    agg = (exploded.groupBy("zoom", "cx", "cy")
           .agg(F.count(F.lit(1)).alias("points"), F.round(F.avg(b.lat), 6).alias("lat"),
                F.round(F.avg(b.lng), 6).alias("lng")))
    out = agg
    for z in zooms:
        if z >= NO_CLUSTER_ZOOM:
            raw = df.select(F.lit(z).alias("zoom"), F.lit(None).cast("bigint").alias("cx"),
                            F.lit(None).cast("bigint").alias("cy"), F.lit(1).cast("bigint").alias("points"),
                            F.round(b.lat, 6).alias("lat"), F.round(b.lng, 6).alias("lng"))
            out = out.unionByName(raw)
    return out
