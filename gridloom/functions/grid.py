"""Transverse Mercator coordinates and the squares of the military grid, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid, the scale on the central meridian, the grid's letters.
AXIS, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996
BANDS = "CDEFGHJKLMNPQRSTUVWX"
COLUMNS = ("ABCDEFGH", "JKLMNPQR", "STUVWXYZ")
ROWS = "ABCDEFGHJKLMNPQRSTUV"

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_SERIES = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_ECC = 2 * math.sqrt(_N) / (1 + _N)


def _mercator(lib, phi, dlam):
    """Metres east and north of the equator on the central meridian; lib is math or pyspark.sql.functions, the
    angles are in radians. The series to the third order is right to a millimetre within a zone."""
    s = lib.sin(phi)
    t = lib.sinh(lib.atanh(s) - _ECC * lib.atanh(_ECC * s))
    xi, eta = lib.atan2(t, lib.cos(dlam)), lib.atanh(lib.sin(dlam) / lib.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_SERIES, 1):
        east = east + a * lib.cos(2 * j * xi) * lib.sinh(2 * j * eta)
        north = north + a * lib.sin(2 * j * xi) * lib.cosh(2 * j * eta)
    return SCALE * _RADIUS * east, SCALE * _RADIUS * north


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def utm_zone(lon, lat) -> Column:
    """1 to 60, with the wider zones of south-west Norway and Svalbard."""
    lon, lat = _c(lon), _c(lat)
    plain = F.pmod(F.floor((lon + 180.0) / 6.0), F.lit(60)) + 1
    arctic = lat.between(72.0, 84.0) & (lon >= 0.0) & (lon < 42.0)
    wide = F.when(lon < 9.0, 31).when(lon < 21.0, 33).when(lon < 33.0, 35).otherwise(37)
    norway = (lat >= 56.0) & (lat < 64.0) & (lon >= 3.0) & (lon < 12.0)
    return F.when(arctic, wide).when(norway, 32).otherwise(plain).cast("int")


def utm(lon, lat) -> tuple[Column, Column, Column]:
    """Zone, easting and northing in metres (northings south of the equator count from 10,000 km)."""
    lon, lat = _c(lon), _c(lat)
    zone = utm_zone(lon, lat)
    east, north = _mercator(F, F.radians(lat), F.radians(lon - (zone * 6.0 - 183.0)))
    return zone, east + 500000.0, F.when(lat < 0.0, north + 1e7).otherwise(north)


def _letter(letters: str, at: Column) -> Column:
    return F.substring(F.lit(letters), (at + 1).cast("int"), F.lit(1))


def mgrs_square(lon, lat) -> Column:
    """The 100 km square, such as 32UPU; null outside 80 degrees south to 84 north and for null places."""
    zone, east, north = utm(lon, lat)
    band = _letter(BANDS, F.least(F.lit(19), F.floor((_c(lat) + 80.0) / 8.0)))
    column = F.floor(east / 100000.0) - 1
    names = F.when(zone % 3 == 1, _letter(COLUMNS[0], column)).when(zone % 3 == 2, _letter(COLUMNS[1], column)).otherwise(_letter(COLUMNS[2], column))
    # rows start at A in odd zones and at F in even ones, and come round every 2,000 km
    row = _letter(ROWS, F.pmod(F.floor(north / 100000.0) + F.when(zone % 2 == 0, 5).otherwise(0), F.lit(20)))
    return F.when(_c(lat).between(-80.0, 84.0), F.concat(F.format_string("%02d", zone), band, names, row))


def _band_floor(k: int) -> int:
    """The least northing of a band, in 100 km: on the central meridian in the north, at a zone's edge in the south."""
    lat = -80 + 8 * k
    north = _mercator(math, math.radians(lat), 0.0 if lat >= 0 else math.radians(3.0))[1]
    return math.floor((north if lat >= 0 else north + 1e7) / 1e5)


def square_bounds(code) -> tuple[Column, Column]:
    """Easting and northing of the south-west corner of a 100 km square."""
    code = _c(code)
    zone = F.substring(code, 1, 2).cast("int")
    column = F.lit(0)
    for letters in COLUMNS:
        column = F.greatest(column, F.instr(F.lit(letters), F.substring(code, 4, 1)))
    row = F.instr(F.lit(ROWS), F.substring(code, 5, 1)) - 1 - F.when(zone % 2 == 0, 5).otherwise(0)
    low = F.element_at(F.array(*[F.lit(_band_floor(k)) for k in range(20)]), F.instr(F.lit(BANDS), F.substring(code, 3, 1)))
    return column * 100000.0, (low + F.pmod(row - low, F.lit(20))) * 100000.0
