"""Distances, directions and grid cells as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radii that distances of different services were made with.
MILES_RADIUS = 3958.8
METRES_RADIUS = 6_371_000.0
#: Miles in a degree of latitude; planar miles for short ways.
MILES_PER_DEGREE = 69.172


def arc(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The angle between two points in radians. Null if any coordinate is."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # least() alone would pass over a null
    return F.when(h.isNotNull(), 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.lit(MILES_RADIUS) * arc(lat1, lon1, lat2, lon2)


def haversine_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.lit(METRES_RADIUS) * arc(lat1, lon1, lat2, lon2)


def reach(lat: Column, miles: Column | float) -> tuple[Column, Column]:
    """Degrees of latitude and longitude within which a circle lies; all longitudes if it holds a pole. A little is added for rounding."""
    south_north = (miles if isinstance(miles, Column) else F.lit(float(miles))) / 69.0
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.least(south_north, F.lit(90.0)))) / F.greatest(F.lit(1e-9), F.cos(F.radians(lat)))))) + 1e-9
    return south_north, F.when(F.abs(lat) + south_north >= 90.0, 180.0).otherwise(wide)


def in_box(lat: Column, lon: Column, lat0: float, lon0: float, miles: float) -> Column:
    """Whether a point is in the box around a circle: ranges on plain columns, which scans can use. Across 180 degrees there are two of longitude."""
    from math import asin, cos, degrees, radians, sin

    dlat = miles / 69.0
    rows = lat.between(lat0 - dlat, lat0 + dlat)
    if abs(lat0) + dlat >= 90.0:
        return rows
    dlon = degrees(asin(min(1.0, sin(radians(dlat)) / cos(radians(lat0))))) + 1e-9
    west, east = lon0 - dlon, lon0 + dlon
    if west < -180.0 or east > 180.0:
        return rows & ((lon >= (west + 180.0) % 360.0 - 180.0) | (lon <= (east + 180.0) % 360.0 - 180.0))
    return rows & lon.between(west, east)


def turned(degrees: Column) -> Column:
    """A difference of longitudes the short way round."""
    return F.when(degrees > 180.0, degrees - 360.0).when(degrees < -180.0, degrees + 360.0).otherwise(degrees)


def planar_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Miles east and north of a point, on a plane that touches there."""
    return turned(lon - lon0) * MILES_PER_DEGREE * F.cos(F.radians(lat0)), (lat - lat0) * MILES_PER_DEGREE


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar direction in degrees clockwise from north, 0 to 360."""
    x, y = planar_xy(lat2, lon2, lat1, lon1)
    return F.pmod(F.degrees(F.atan2(x, y)), F.lit(360.0))


def heading_vector(degrees: Column) -> tuple[Column, Column]:
    """Unit vector east and north of a heading."""
    return F.sin(F.radians(degrees)), F.cos(F.radians(degrees))


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("long")


#: Degrees of latitude from which on a row of cells is one cell.
CAP = 85.0


def ring(size: float) -> tuple[int, float]:
    """How many cells of about ``size`` degrees go round the earth, and their exact width."""
    n = max(1, round(360.0 / size))
    return n, 360.0 / n


def capped(cy: Column, size: float) -> Column:
    return (cy * F.lit(size) >= CAP) | ((cy + 1) * F.lit(size) <= -CAP)


def home_cell(lat: Column, lon: Column, size: float) -> tuple[Column, Column]:
    """The cell of a point: column round the earth from 180 degrees on, and row. Rows around the poles have one column."""
    (n, width), cy = ring(size), cell(lat, size)
    cx = F.least(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / width), F.lit(n - 1)).cast("long")
    return F.when(capped(cy, size), F.lit(0).cast("long")).otherwise(cx), cy


def box_cells(south: Column, north: Column, west: Column, east: Column, size: float) -> Column:
    """Array of the distinct cells (cx, cy) of a box, whose longitudes may run over 180 degrees to either side."""
    n, width = ring(size)
    at = lambda lon: F.floor((lon + 180.0) / width).cast("long")
    round_ = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    columns = F.when(east - west >= 360.0 - 2 * width, round_).otherwise(F.transform(F.sequence(at(west), at(east)), lambda x: F.pmod(x, F.lit(n).cast("long"))))
    pair = lambda x, y: F.struct(x.alias("cx"), y.alias("cy"))
    row = lambda y: F.when(capped(y, size), F.array(pair(F.lit(0).cast("long"), y))).otherwise(F.transform(columns, lambda x: pair(x, y)))
    return F.flatten(F.transform(F.sequence(cell(south, size), cell(north, size)), row))


def around(x: Column, y: Column, reach: int = 1) -> Column:
    """A cell and its neighbours: array of (cx, cy), to explode on the smaller side of an equi-join."""
    steps = range(-reach, reach + 1)
    return F.array(*(F.struct((x + i).alias("cx"), (y + j).alias("cy")) for i in steps for j in steps))
