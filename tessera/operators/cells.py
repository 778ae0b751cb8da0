"""A hierarchy of grid cells over points: parents, children, counts, and bounds on distances.

Level 0 has two cells of 180 x 180 degrees; every cell has sixteen children of a quarter of its
height and width, down to level ``FINEST`` (about 76 m high). A cell is one long that holds its
level, band and column. The bounds between a point and a cell hold for the haversine distance
everywhere, at the poles and across the antimeridian too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_KM

FINEST = 9
#: Kilometres by which a bound gives way, for rounding at the edges of cells.
SLACK_KM = 1e-5
_LEVEL_AT, _BAND_AT = 40, 20


def size_deg(level: Column) -> Column:
    """Height and width of the cells of a level, in degrees."""
    return F.lit(180.0) / F.pow(F.lit(4.0), level)


def cells_across(level: Column) -> Column:
    """Number of bands of a level; it has twice as many columns."""
    return F.pow(F.lit(4.0), level).cast("bigint")


def cell_id(level: Column, band: Column, column: Column) -> Column:
    return (level.cast("bigint") * (1 << _LEVEL_AT) + band * (1 << _BAND_AT) + column).cast("bigint")


def level_of(cell: Column) -> Column:
    return F.shiftright(cell, _LEVEL_AT).cast("int")


def finest_position(lat: Column, lng: Column) -> tuple[Column, Column]:
    """(band, column) of a point at the finest level; longitudes wrap."""
    n = 4 ** FINEST
    band = F.least(F.greatest(F.floor((lat + 90.0) * (n / 180.0)), F.lit(0)), F.lit(n - 1)).cast("bigint")
    return band, F.pmod(F.floor((lng + 180.0) * (n / 180.0)), F.lit(2 * n)).cast("bigint")


def parent_position(position: Column, level: Column) -> Column:
    """A finest band or column, seen at a coarser level."""
    return F.floor(position / cells_across(F.lit(FINEST) - level)).cast("bigint")


def cells_of(lat: Column, lng: Column, levels: Column) -> Column:
    """The cells that hold a point, one for each level of the array ``levels``."""
    band, column = finest_position(lat, lng)
    return F.transform(levels, lambda l: cell_id(l, parent_position(band, l), parent_position(column, l)))


def children(cell: Column) -> Column:
    """The sixteen cells of the next level inside a cell."""
    mask = (1 << _BAND_AT) - 1
    level = level_of(cell) + 1
    band, column = F.shiftright(cell, _BAND_AT).bitwiseAND(F.lit(mask)) * 4, cell.bitwiseAND(F.lit(mask)) * 4
    return F.array(*[cell_id(level, band + i, column + j) for i in range(4) for j in range(4)])


def cell_counts(points: DataFrame, lat: str, lng: str) -> DataFrame:
    """cell, n: the occupied cells of every level with their points. Built bottom-up: points are counted
    into the finest cells, map-side first, and only those rows go up to their parents."""
    finest = points.select(cells_of(F.col(lat), F.col(lng), F.array(F.lit(FINEST)))[0].alias("c")).groupBy("c").agg(
        F.count(F.lit(1)).alias("n"))
    mask = (1 << _BAND_AT) - 1
    band, column = F.shiftright("c", _BAND_AT).bitwiseAND(F.lit(mask)), F.col("c").bitwiseAND(F.lit(mask))
    up = F.transform(F.sequence(F.lit(0), F.lit(FINEST)), lambda l: cell_id(l, parent_position(band, l), parent_position(column, l)))
    return finest.select(F.explode(up).alias("cell"), "n").groupBy("cell").agg(F.sum("n").alias("n"))


def distance_bounds(lat: str, lng: str, cell: str) -> tuple[Column, Column]:
    """(at least, at most): kilometres between a point and anything in the cell, from three columns.

    In sin^2(dlat/2) + cos(lat1) cos(lat2) sin^2(dlng/2), each factor takes its least or its greatest
    value over the cell."""
    mask = (1 << _BAND_AT) - 1
    s = f"(180.0D / pow(4.0D, shiftright({cell}, {_LEVEL_AT})))"
    south = f"((shiftright({cell}, {_BAND_AT}) & {mask}) * {s} - 90.0D)"
    turn = f"abs({lng} - (({cell} & {mask}) * {s} - 180.0D + {s} / 2)) % 360.0D"
    dlat, dlng = f"abs({lat} - {south} - {s} / 2)", f"least({turn}, 360.0D - {turn})"
    edges = f"greatest(cos(radians({south})), 0.0D), greatest(cos(radians({south} + {s})), 0.0D)"
    widest = f"if({south} <= 0 AND {south} + {s} >= 0, 1.0D, greatest({edges}))"

    def km(dphi: str, cos2: str, dlam: str) -> str:
        a = f"pow(sin(radians({dphi}) / 2), 2) + cos(radians({lat})) * {cos2} * pow(sin(radians({dlam}) / 2), 2)"
        return f"{2 * EARTH_RADIUS_KM}D * asin(sqrt(least({a}, 1.0D)))"

    least = km(f"greatest({dlat} - {s} / 2, 0.0D)", f"least({edges})", f"greatest({dlng} - {s} / 2, 0.0D)")
    most = km(f"least({dlat} + {s} / 2, 180.0D)", widest, f"least({dlng} + {s} / 2, 180.0D)")
    return F.expr(f"{least} - {SLACK_KM}D"), F.expr(f"{most} + {SLACK_KM}D")


def around(lat: Column, lng: Column, levels: Column) -> Column:
    """The cells of the given levels that hold a point or touch the one that does."""
    band, column = finest_position(lat, lng)

    def at(l: Column) -> Column:
        n, b, c = cells_across(l), parent_position(band, l), parent_position(column, l)
        bands = F.sequence(F.greatest(b - 1, F.lit(0)), F.least(b + 1, n - 1))
        return F.flatten(F.transform(bands, lambda y: F.transform(
            F.array(c - 1, c, c + 1), lambda x: cell_id(l, y, F.pmod(x, 2 * n)))))

    return F.flatten(F.transform(levels, at))


def covering(lat: Column, lng: Column, km: Column) -> Column:
    """The cells that a disc may touch, all of one level: the finest at which they are 10 x 10 at most."""
    reach = F.degrees(km / EARTH_RADIUS_KM)
    top = F.abs(lat) + reach
    s = F.sin(F.least(km / (2 * EARTH_RADIUS_KM), F.lit(1.57))) / F.cos(F.radians(F.least(top, F.lit(89.999))))
    wide = F.when((top >= 89.999) | (s >= 1), F.lit(180.0)).otherwise(F.degrees(2 * F.asin(F.least(s, F.lit(1.0)))))
    fits = F.floor(F.log(F.lit(720.0) / F.greatest(reach, wide, F.lit(1e-6))) / F.log(F.lit(4.0)))
    level = F.least(F.greatest(fits, F.lit(0)), F.lit(FINEST)).cast("int")
    n, size = cells_across(level), size_deg(level)
    clip = lambda y: F.least(F.greatest(F.floor((y + 90.0) / size), F.lit(0)), n - 1)
    bands = F.sequence(clip(lat - reach), clip(lat + reach))
    west, east = F.floor((lng + 180.0 - wide) / size), F.floor((lng + 180.0 + wide) / size)
    columns = F.when(east - west + 1 >= 2 * n, F.sequence(F.lit(0).cast("bigint"), 2 * n - 1)).otherwise(F.sequence(west, east))
    return F.flatten(F.transform(bands, lambda y: F.transform(columns, lambda x: cell_id(level, y, F.pmod(x, 2 * n)))))
