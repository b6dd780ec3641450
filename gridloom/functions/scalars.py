"""Scalar expressions: quality rules, angles, indices, calendar, text. All are built-in Column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def finite(x) -> Column:
    """True for a number that is neither null, NaN nor infinite; never null."""
    x = _c(x)
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(INF)), F.lit(False))


def all_finite(*cols) -> Column:
    return reduce(lambda a, b: a & b, [finite(c) for c in cols])


def any_true(*conds: Column) -> Column:
    return reduce(lambda a, b: a | b, conds)


def finite_or_null(x) -> Column:
    return F.when(finite(x), _c(x))


def two_band_target(a, b) -> Column:
    """Mean of the first band and 1.5 times the second."""
    return (_c(a) + F.lit(1.5) * _c(b)) / F.lit(2.0)


def two_band_error(sa, sb) -> Column:
    return F.lit(0.5) * F.sqrt(_c(sa) * _c(sa) + F.lit(2.25) * _c(sb) * _c(sb))


def sigma_class(value, sigma) -> Column:
    """accept above two sigmas below zero, questionable down to three, reject beneath."""
    value, sigma = _c(value), _c(sigma)
    return F.when(value >= -2.0 * sigma, "accept").when(value >= -3.0 * sigma, "questionable").when(value < -3.0 * sigma, "reject")


def final_flag(value, low: float, high: float, check) -> Column:
    """accept if the value lies in [low, high) and the sigma check did not reject."""
    return F.when((_c(value) >= low) & (_c(value) < high) & (_c(check) != "reject"), "accept").otherwise("reject")


def wrap180(x) -> Column:
    """Degrees wrapped to [-180, 180): the remainder is floored, as it must be for negative angles."""
    return F.pmod(_c(x) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def phase_angle(sza, vza, azimuth) -> Column:
    """Angle between sun and view directions; the cosine is clamped before the arc cosine."""
    s, v, a = F.radians(_c(sza)), F.radians(_c(vza)), F.radians(_c(azimuth))
    cosine = F.cos(s) * F.cos(v) + F.sin(s) * F.sin(v) * F.cos(a)
    return F.degrees(F.acos(clamp(cosine, -1.0, 1.0)))


def clamp(x, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(x)))


def cyclic_month(month) -> tuple[Column, Column]:
    angle = F.lit(2.0 * math.pi / 12.0) * _c(month)
    return F.sin(angle), F.cos(angle)


def ratio(a, b, least: float = 0.0) -> Column:
    """a / b where |b| > least, else null."""
    return F.when(F.abs(_c(b)) > least, _c(a) / _c(b))


def normalized_difference(a, b, least: float = 0.0) -> Column:
    a, b = _c(a), _c(b)
    return ratio(a - b, a + b, least)


def masked(x, low: float, high: float) -> Column:
    """The value where it lies in the range, else null (a mask, not a clip)."""
    return F.when(_c(x).between(low, high), _c(x))


def evi(blue, red, nir) -> Column:
    return masked(ratio(F.lit(2.5) * (_c(nir) - _c(red)), _c(nir) + 6.0 * _c(red) - 7.5 * _c(blue) + 1.0, 1e-6), -1.0, 1.0)


def spectral_indices(b: dict) -> dict[str, Column]:
    """Vegetation and moisture indices of the bands blue..swir2; a zero denominator gives null."""
    r = {k: _c(v) for k, v in b.items()}
    ndvi = normalized_difference(r["nir"], r["red"])
    return {
        "ndvi": ndvi,
        "ndre": normalized_difference(r["nir"], r["edge1"]),
        "ndre8a": normalized_difference(r["narrow"], r["edge1"]),
        "psri": ratio(r["red"] - r["green"], r["edge2"]),
        "osavi": ratio(F.lit(1.16) * (r["nir"] - r["red"]), r["nir"] + r["red"] + 0.16),
        "ndwi": normalized_difference(r["green"], r["nir"]),
        "nirv": ndvi * r["nir"],
        "tcari": F.lit(3.0) * ((r["edge1"] - r["red"]) - 0.2 * (r["edge1"] - r["green"]) * ratio(r["edge1"], r["red"])),
        "ndmi": normalized_difference(r["nir"], r["swir1"]),
        "msi": ratio(r["swir1"], r["nir"]),
        "ndmi_swir2": normalized_difference(r["nir"], r["swir2"]),
        "msi_swir2": ratio(r["swir2"], r["nir"]),
        "nmdi": ratio(r["nir"] - (r["swir1"] - r["swir2"]), r["nir"] + (r["swir1"] - r["swir2"])),
    }


def cut_bins(x, edges: list[float], labels: list[str], right_closed: bool = False) -> Column:
    """Bin by fixed edges: [a, b) with the top bin closed, or (a, b]; outside is null."""
    x, out = _c(x), F.lit(None).cast("string")
    for k in reversed(range(len(labels))):
        lo, hi = edges[k], edges[k + 1]
        if right_closed:
            cond = (x > lo) & (x <= hi)
        else:
            cond = (x >= lo) & ((x <= hi) if k == len(labels) - 1 else (x < hi))
        out = F.when(cond, labels[k]).otherwise(out)
    return out


def bin_floor(x, width: float) -> Column:
    return F.floor(_c(x) / width).cast("double") * width


def composite_day(doy, step: int = 8) -> Column:
    """First day of the composite that holds a day of the year; composites start anew each year."""
    return (F.lit(1) + step * F.floor((_c(doy) - 1) / step)).cast("bigint")


def nearest_composite(doy, first: int, last: int, step: int = 8) -> Column:
    """Nearest start among first, first + step, ..., last; the earlier one on a tie."""
    days = F.array(*[F.lit(d) for d in range(first, last + 1, step)])
    pairs = F.transform(days, lambda d: F.struct(F.abs(d - _c(doy)).alias("gap"), d.alias("day")))
    return F.array_min(pairs)["day"].cast("bigint")


def day_of_year_date(year, doy) -> Column:
    return F.date_add(F.make_date(_c(year).cast("int"), F.lit(1), F.lit(1)), (_c(doy) - 1).cast("int"))


def composites_in_month(year, month, first: int = 1, last: int = 361, step: int = 8) -> Column:
    """Composite days that start in a month."""
    days = F.sequence(F.lit(first), F.lit(last), F.lit(step))
    return F.filter(days, lambda d: F.month(day_of_year_date(year, d)) == _c(month))


def epoch_1990(seconds) -> Column:
    return F.timestamp_add("SECOND", _c(seconds).cast("bigint"), F.lit("1990-01-01 00:00:00").cast("timestamp_ntz"))


def validity_interval(date, low, mid, high) -> Column:
    """Product date less the first known offset of low, mid, high (the fallback chain)."""
    return F.date_sub(_c(date), F.coalesce(_c(low), _c(mid), _c(high)).cast("int"))


def slug(x) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(x))), "[^a-z0-9]+", "_"), "^_|_$", "")


def truthy(x, words=("true", "t", "1", "yes")) -> Column:
    return F.lower(F.trim(_c(x))).isin(*words)


def float16_guard(x) -> Column:
    return F.when(finite(x) & (F.abs(_c(x)) <= 65504.0), _c(x))


def stretch(x, low, high) -> Column:
    """Percentile stretch to 0..255; a constant layer gives 0."""
    low, high = _c(low), _c(high)
    return F.when(high > low, clamp((_c(x) - low) / (high - low), 0.0, 1.0) * 255.0).otherwise(0.0)


def pack_rgb(r, g, b) -> Column:
    return F.shiftleft(_c(r), 16) + F.shiftleft(_c(g), 8) + _c(b)


def keyword_score(x, weights: dict[str, int]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.contains(F.lower(_c(x)), F.lit(w)), k).otherwise(0) for w, k in weights.items()])


def date_token_class(date, target) -> Column:
    gap = F.datediff(_c(date), _c(target))
    return F.when(gap.isNull(), "unparsed").when(gap == 0, "target").when(gap == -1, "previous").when(gap == 1, "next").otherwise("other")


def centroid(lons: list, lats: list, eps: float = 1e-14) -> tuple[Column, Column]:
    """Planar centroid of a quadrilateral by the shoelace formula, the corners' mean where the area vanishes."""
    x, y = [_c(v) for v in lons], [_c(v) for v in lats]
    cross = [x[i] * y[(i + 1) % 4] - x[(i + 1) % 4] * y[i] for i in range(4)]
    twice = reduce(lambda a, b: a + b, cross)
    part = lambda v: reduce(lambda a, b: a + b, [(v[i] + v[(i + 1) % 4]) * cross[i] for i in range(4)]) / (3.0 * twice)
    mean = lambda v: reduce(lambda a, b: a + b, v) / 4.0
    flat = F.abs(twice) < eps
    return F.when(flat, mean(x)).otherwise(part(x)), F.when(flat, mean(y)).otherwise(part(y))


def shoelace_area(lons: list, lats: list) -> Column:
    x, y = [_c(v) for v in lons], [_c(v) for v in lats]
    n = len(x)
    return F.abs(reduce(lambda a, b: a + b, [x[i] * y[(i + 1) % n] - x[(i + 1) % n] * y[i] for i in range(n)])) / 2.0


def in_polygon(px, py, ring: list[tuple[float, float]]) -> Column:
    """Even-odd ray casting against a fixed ring."""
    px, py = _c(px), _c(py)
    hits = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 == y2:
            continue
        across = (py >= min(y1, y2)) & (py < max(y1, y2)) & (px < (py - y1) * ((x2 - x1) / (y2 - y1)) + x1)
        hits = hits + F.when(across, 1).otherwise(0)
    return hits % 2 == 1


def sinusoidal(lon, lat, radius: float = 6371007.181) -> tuple[Column, Column]:
    """Degrees to the sinusoidal equal-area projection."""
    return radius * F.radians(_c(lon)) * F.cos(F.radians(_c(lat))), radius * F.radians(_c(lat))


def laea(lon, lat, lon0: float = 10.0, lat0: float = 52.0, radius: float = 6371007.181) -> tuple[Column, Column]:
    """Spherical Lambert azimuthal equal-area about (lon0, lat0)."""
    lam, phi, p0 = F.radians(_c(lon) - lon0), F.radians(_c(lat)), math.radians(lat0)
    c = math.sin(p0) * F.sin(phi) + math.cos(p0) * F.cos(phi) * F.cos(lam)
    k = radius * F.sqrt(2.0 / (1.0 + c))
    return k * F.cos(phi) * F.sin(lam), k * (math.cos(p0) * F.sin(phi) - math.sin(p0) * F.cos(phi) * F.cos(lam))
