"""Distances, bearings, polylines and display units as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params

METRES_PER_DEG_LON = 111_320.0
METRES_PER_DEG_LAT = 110_574.0


def col(c: Column | str | float | int) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(float(c))


def haversine(lon1, lat1, lon2, lat2, radius: float = params.EARTH_M) -> Column:
    """Great-circle metres."""
    lon1, lat1, lon2, lat2 = (col(c) for c in (lon1, lat1, lon2, lat2))
    a = F.sin(F.radians(lat2 - lat1) / 2.0)
    b = F.sin(F.radians(lon2 - lon1) / 2.0)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return F.asin(F.sqrt(h)) * (2.0 * radius)


def across(dlon: Column) -> Column:
    """A difference of longitudes by the shorter way around the globe."""
    return F.when(F.abs(dlon) > 180.0, dlon - 360.0 * F.signum(dlon)).otherwise(dlon)


def flat_distance(lon0, lat0, lon, lat) -> Column:
    """Metres on a plane scaled at the first point's latitude."""
    lon0, lat0, lon, lat = (col(c) for c in (lon0, lat0, lon, lat))
    dx = F.radians(across(lon - lon0)) * F.cos(F.radians(lat0)) * params.EARTH_M
    dy = F.radians(lat - lat0) * params.EARTH_M
    return F.sqrt(dx * dx + dy * dy)


def bearing(lon1, lat1, lon2, lat2) -> Column:
    """Initial bearing in [0, 360)."""
    lon1, lat1, lon2, lat2 = (col(c) for c in (lon1, lat1, lon2, lat2))
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def turn_angle(before, after) -> Column:
    """Signed turn, -180 to 180; right is positive."""
    return F.pmod(col(after) - col(before) + 540.0, F.lit(360.0)) - 180.0


def undirected_gap(a, b) -> Column:
    """Smallest angle between two bearings."""
    d = F.pmod(F.abs(col(a) - col(b)), F.lit(360.0))
    return F.least(d, 360.0 - d)


def flat_bearing(ax, ay, bx, by) -> Column:
    return F.pmod(F.degrees(F.atan2(col(bx) - col(ax), col(by) - col(ay))), F.lit(360.0))


COMPASS = ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")


def cardinal(deg) -> Column:
    """Nearest of eight compass names."""
    eighth = F.pmod(F.floor(F.pmod(col(deg), F.lit(360.0)) / 45.0 + 0.5), F.lit(8)).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in COMPASS]), eighth + 1)


def inside(lon, lat, box: tuple[float, float, float, float]) -> Column:
    west, south, east, north = box
    return col(lon).between(west, east) & col(lat).between(south, north)


def in_service_area(lon, lat) -> Column:
    return inside(lon, lat, params.SERVICE_BOX)


def rounded_to(value, places: int) -> Column:
    """A double rounded to decimal places by its exact value, ties to even.
    Rounding by the shortest decimal text would move values that only look
    like ties."""
    return F.call_function("format_number", col(value), F.lit("0." + "0" * places)).cast("double")


# -- polylines: array<struct<lon, lat>> -------------------------------------

def legs(line: Column) -> Column:
    """Consecutive point pairs as array<struct<a, b>>."""
    n = F.size(line)
    return F.when(n < 2, F.array().cast("array<struct<a:struct<lon:double,lat:double>,b:struct<lon:double,lat:double>>>")).otherwise(
        F.zip_with(F.slice(line, 1, F.greatest(n - 1, F.lit(1))), F.slice(line, 2, F.greatest(n - 1, F.lit(1))),
                   lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def leg_lengths(line: Column, metric=haversine) -> Column:
    return F.transform(legs(line), lambda p: metric(p["a"]["lon"], p["a"]["lat"], p["b"]["lon"], p["b"]["lat"]))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def line_length(line: Column) -> Column:
    return total(leg_lengths(line))


def running(values: Column) -> Column:
    """Cumulative sums, starting with 0; one longer than the input."""
    return F.aggregate(values, F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def blend(a: Column, b: Column, t: Column) -> Column:
    return F.struct((a["lon"] + (b["lon"] - a["lon"]) * t).alias("lon"), (a["lat"] + (b["lat"] - a["lat"]) * t).alias("lat"))


def point_at(line: Column, cum: Column, t: Column) -> Column:
    """The point a fraction of the way along, given running(leg_lengths)."""
    want = t * F.element_at(cum, -1)
    # first leg whose end lies at or beyond the wanted distance
    leg = F.aggregate(
        F.sequence(F.lit(1), F.size(line) - 1), F.lit(0),
        lambda acc, i: F.when((acc == 0) & ((F.element_at(cum, i + 1) >= want) | (i == F.size(line) - 1)), i).otherwise(acc))
    a, b = F.element_at(line, leg), F.element_at(line, leg + 1)
    size = F.element_at(cum, leg + 1) - F.element_at(cum, leg)
    share = F.when(size == 0, F.lit(0.0)).otherwise((want - F.element_at(cum, leg)) / size)
    return (F.when((t <= 0) | (F.size(line) < 2), F.element_at(line, 1))
            .when(t >= 1, F.element_at(line, -1))
            .otherwise(blend(a, b, share)))


def without_repeats(line: Column) -> Column:
    """The points of a line but those equal to the one before; linear in the line."""
    pairs = F.zip_with(line, F.concat(F.array(F.lit(None)), line), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    return F.transform(F.filter(pairs, lambda x: x["p"].isNotNull() & ~x["p"].eqNullSafe(x["q"])), lambda x: x["p"])


def stretch(line: Column, cum: Column, t0: Column, t1: Column) -> Column:
    """The part of a line between two length fractions. `cum` is its
    running(leg_lengths): pass a column, it is used many times over."""
    size = F.element_at(cum, -1)
    middle = F.filter(line, lambda p, i: (F.get(cum, i) > t0 * size) & (F.get(cum, i) < t1 * size))
    cut = without_repeats(F.concat(F.array(point_at(line, cum, t0)), middle, F.array(point_at(line, cum, t1))))
    return F.when((t0 <= 0) & (t1 >= 1), line).when(t1 < t0, F.slice(line, 1, 0)).otherwise(cut)


def local_metric(lat0: Column):
    """A flat metric scaled at one latitude, for cutting and projecting."""
    kx = F.cos(F.radians(lat0)) * METRES_PER_DEG_LON

    def metric(lon1, lat1, lon2, lat2):
        dx, dy = (lon2 - lon1) * kx, (lat2 - lat1) * METRES_PER_DEG_LAT
        return F.sqrt(dx * dx + dy * dy)

    return metric


def project_on_leg(lon, lat, alon, alat, blon, blat) -> Column:
    """struct(dist_m, t, leg_m): nearest point of one leg to a point, on a
    plane scaled at the point's latitude."""
    lon, lat, alon, alat, blon, blat = (col(c) for c in (lon, lat, alon, alat, blon, blat))
    kx, ky = F.cos(F.radians(lat)) * METRES_PER_DEG_LON, F.lit(METRES_PER_DEG_LAT)
    dx, dy = (blon - alon) * kx, (blat - alat) * ky
    px, py = (lon - alon) * kx, (lat - alat) * ky
    len2 = dx * dx + dy * dy
    t = F.when(len2 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / len2)))
    ex, ey = px - t * dx, py - t * dy
    return F.struct(F.sqrt(ex * ex + ey * ey).alias("dist_m"), t.alias("t"), F.sqrt(len2).alias("leg_m"))


def project(line: Column, lon, lat) -> Column:
    """struct(dist_m, along): distance to a line and the length fraction of
    its nearest point; the first leg wins a tie."""
    lon, lat = col(lon), col(lat)
    hits = F.transform(legs(line), lambda p, i: F.struct(
        project_on_leg(lon, lat, p["a"]["lon"], p["a"]["lat"], p["b"]["lon"], p["b"]["lat"]).alias("hit"), i.alias("i")))
    cum = running(leg_lengths(line, local_metric(lat)))
    best = F.array_min(F.transform(hits, lambda h: F.struct(h["hit"]["dist_m"].alias("dist_m"), h["i"].alias("i"), h["hit"]["t"].alias("t"))))
    return F.struct(best["dist_m"].alias("dist_m"), share_along(cum, best["i"], best["t"]).alias("along"))


def share_along(cum: Column, leg: Column, t: Column) -> Column:
    """The length fraction of a line at the share t of a leg (from 0), given running(leg_lengths)."""
    size = F.element_at(cum, -1)
    at = F.get(cum, leg) + t * (F.get(cum, leg + 1) - F.get(cum, leg))
    return F.when(size > 0, at / size).otherwise(0.0)


def rounded(line: Column, places: int) -> Column:
    return F.transform(line, lambda p: F.struct(rounded_to(p["lon"], places).alias("lon"), rounded_to(p["lat"], places).alias("lat")))


# -- raster ------------------------------------------------------------------

def mercator_pixel(lon, lat, zoom: int, tile_px: int = 256) -> tuple[Column, Column]:
    """Fractional web-mercator pixel coordinates."""
    lon, lat = col(lon), col(lat)
    size = float(tile_px * 2**zoom)
    x = (lon + 180.0) / 360.0 * size
    r = F.radians(lat)
    y = (1.0 - F.ln(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * size
    return x, y


def terrain_metres(red, green, blue) -> Column:
    """Height coded in three bytes."""
    return col(red) * 256.0 + col(green) + col(blue) / 256.0 - 32768.0


# -- text for distances and times -------------------------------------------

def distance_text(m, half_up: bool = False) -> Column:
    """Feet below a tenth of a mile, else miles to one decimal. Ties round to
    even, or up where the rider's screen does so."""
    m = col(m)
    feet = m * params.FEET_PER_M
    step = F.when(feet < 97.5, F.lit(5.0)).otherwise(F.lit(10.0))
    n = F.floor(feet / step + 0.5) if half_up else F.rint(feet / step)
    return F.when(m < 0.1 * params.MILE_M, F.concat((n * step).cast("bigint").cast("string"), F.lit(" ft"))).otherwise(
        F.concat(F.call_function("format_number", m / params.MILE_M, F.lit("0.0")), F.lit(" mi")))


def minutes_text(seconds) -> Column:
    n = F.greatest(F.lit(1), F.floor(col(seconds) / 60.0 + 0.5).cast("int"))
    return F.concat(n.cast("string"), F.lit(" min"))


def spoken_distance(m) -> Column:
    m = col(m)
    feet = m * params.FEET_PER_M
    near = F.greatest(F.lit(50), (F.floor(feet / 50.0 + 0.5) * 50).cast("int"))
    return F.when(feet < 1000, F.concat(near.cast("string"), F.lit(" feet"))).otherwise(
        F.concat(F.call_function("format_number", m / params.MILE_M, F.lit("0.0")), F.lit(" miles")))
