"""Hexagon and web-mercator arithmetic, as Column expressions."""

import math

from pyspark.sql import Column, functions as F

# Grid of the density maps and the latitude limit of web mercator.
HEX_COLUMNS = 80
HEX_ROWS = int(HEX_COLUMNS / math.sqrt(3))
LON_RANGE = (-180.0, 180.0)
LAT_RANGE = (-90.0, 90.0)
MAX_MERCATOR_LAT = 85.0511287798066


def hex_cell(lon: Column, lat: Column, columns: int = HEX_COLUMNS) -> tuple[Column, Column]:
    """Twice the grid coordinates of the hexagon centre nearest to a point.

    Centres form two rectangular lattices, one shifted by half a cell (Carr et al. 1987): the
    point goes to the nearer of its two candidates, where a step in y weighs three in x.
    Doubling keeps both lattices in whole numbers: even = plain lattice, odd = shifted one.
    """
    rows = int(columns / math.sqrt(3))
    # The x range is widened by a hair so that a point on the right edge stays in the last cell.
    pad = 1e-9 * (LON_RANGE[1] - LON_RANGE[0])
    x = (lon - F.lit(LON_RANGE[0] - pad)) / F.lit((LON_RANGE[1] - LON_RANGE[0] + 2 * pad) / columns)
    y = (lat - F.lit(LAT_RANGE[0])) / F.lit((LAT_RANGE[1] - LAT_RANGE[0]) / rows)
    ax, ay = F.rint(x), F.rint(y)
    bx, by = F.floor(x), F.floor(y)
    near_plain = (x - ax) * (x - ax) + F.lit(3.0) * (y - ay) * (y - ay)
    bcx, bcy = bx + F.lit(0.5), by + F.lit(0.5)
    near_shifted = (x - bcx) * (x - bcx) + F.lit(3.0) * (y - bcy) * (y - bcy)
    plain = near_plain < near_shifted
    hx = F.when(plain, ax * 2).otherwise(bx * 2 + 1).cast("int")
    hy = F.when(plain, ay * 2).otherwise(by * 2 + 1).cast("int")
    return hx, hy


def hex_centre(hx: Column, hy: Column, columns: int = HEX_COLUMNS) -> tuple[Column, Column]:
    rows = int(columns / math.sqrt(3))
    lon = hx / F.lit(2.0) * F.lit((LON_RANGE[1] - LON_RANGE[0]) / columns) + F.lit(LON_RANGE[0])
    lat = hy / F.lit(2.0) * F.lit((LAT_RANGE[1] - LAT_RANGE[0]) / rows) + F.lit(LAT_RANGE[0])
    return lon, lat


def _clamp_tile(t: Column, zoom: int) -> Column:
    return F.least(F.greatest(t, F.lit(0)), F.lit(2**zoom - 1)).cast("int")


def tile_x(lon: Column, zoom: int) -> Column:
    return _clamp_tile(F.floor((lon + F.lit(180.0)) / F.lit(360.0) * F.lit(2**zoom)), zoom)


def tile_y(lat: Column, zoom: int) -> Column:
    clipped = F.least(F.greatest(lat, F.lit(-MAX_MERCATOR_LAT)), F.lit(MAX_MERCATOR_LAT))
    s = F.sin(F.radians(clipped))
    unit = F.lit(0.5) - F.ln((F.lit(1.0) + s) / (F.lit(1.0) - s)) / F.lit(4 * math.pi)
    return _clamp_tile(F.floor(unit * F.lit(2**zoom)), zoom)
