"""Joins in space, as equi-joins on map cells.

Cells stand in rows of one height in degrees. A row has as many cells around
the globe as fit if each is, in metres, as wide as high at the end of the rows
beside it that lies further from the equator. So two points closer than a
cell's height always lie in the same or in neighbouring rows and columns,
columns counting around the globe: nine cells are looked up, at any latitude.
Points at one place are joined once: duplicates are folded
together before the shuffle and put back after it. Nearest joins start with
small cells and only carry the points that found nothing on to larger ones,
so a crowded cell is met with a small neighbourhood.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import geo
from ..session import Workspace

M_PER_DEG = math.pi * params.EARTH_M / 180.0


def dealt(df: DataFrame) -> DataFrame:
    """For a join that deals both sides out by their keys. Left to itself the planner may copy a side to all workers, by way
    of the driver: it judges its size by packed files, and not by what is exploded from them."""
    return df.hint("merge")


def columns(cy: Column, deg: float) -> Column:
    """Cells around the globe in a row."""
    far = F.least(F.greatest(F.abs(cy - 1), F.abs(cy + 2)) * deg, F.lit(90.0))
    return F.greatest(F.floor(360.0 * F.cos(F.radians(far)) / deg), F.lit(1)).cast("long")


def _column(lon: Column, world: Column) -> Column:
    return F.floor(lon * world / 360.0)


def cell(lon, lat, deg: float) -> Column:
    """Column and row of the map cell a point lies in."""
    cy = F.floor(geo.col(lat) / deg)
    world = columns(cy, deg)
    return F.struct(F.pmod(_column(geo.col(lon), world), world).alias("cx"), cy.alias("cy"))


def around(lon, lat, deg: float) -> Column:
    """The cells around a point that hold all points within a cell's height, as an array to explode."""
    rows = []
    for j in (-1, 0, 1):
        cy = F.floor(geo.col(lat) / deg) + j
        world = columns(cy, deg)
        cx = _column(geo.col(lon), world)
        rows.append(F.array_distinct(F.array(*[F.struct(F.pmod(cx + i, world).alias("cx"), cy.alias("cy")) for i in (-1, 0, 1)])))
    return F.concat(*rows)


def covering(west: Column, east: Column, south: Column, north: Column, deg: float) -> Column:
    """The cells that a box touches, as an array to explode."""
    def row(cy: Column) -> Column:
        world = columns(cy, deg)
        return F.transform(F.sequence(_column(west, world), _column(east, world)), lambda x: F.struct(F.pmod(x, world).alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(F.sequence(F.floor(south / deg), F.floor(north / deg)), row))


def whole_deg(deg: float) -> float:
    """The next cell height of which a whole number goes around the globe."""
    return 360.0 / max(1, math.floor(360.0 / deg))


def cell_deg(radius_m: float) -> float:
    """A cell at least `radius_m` high."""
    return whole_deg(radius_m / M_PER_DEG)


def pairs_within(left: DataFrame, right: DataFrame, radius_m: float, keep_left: list[str], keep_right: list[str]) -> DataFrame:
    """All (left, right) pairs within a radius of each other, with dist_m. For
    use where few rows lie within the radius; see nearest_within otherwise."""
    deg = cell_deg(radius_m)
    a = left.select(F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), *keep_left, F.explode(around("lon", "lat", deg)).alias("cell"))
    b = right.select("lon", "lat", *keep_right, cell("lon", "lat", deg).alias("cell"))
    return (
        a.join(dealt(b), "cell").withColumn("dist_m", geo.flat_distance("lon0", "lat0", "lon", "lat")).where(F.col("dist_m") <= radius_m)
        .select(*keep_left, *keep_right, "dist_m")
    )


def nearest_within(points: DataFrame, sites: DataFrame, radius_m: float, ws: Workspace, by: list[str] | None = None,
                   metric=geo.flat_distance, order: str = "row_id", carry: list[str] | None = None) -> DataFrame:
    """Per distinct point (lon, lat, and `by`), the nearest site within a
    radius: (*by, plon, plat, dist_m, site struct). Equal distances go to the
    smaller `order`. `by` columns must be equal on both sides.
    """
    by = by or []
    carry = carry or [c for c in sites.columns if c not in (*by, "lon", "lat")]
    here = points.select(*by, F.col("lon").alias("plon"), F.col("lat").alias("plat")).distinct()
    # one site per place: the first in order answers for the others
    there = sites.groupBy(*by, "lon", "lat").agg(F.min_by(F.struct(*carry), F.col(order)).alias("site"))
    there = ws.write(there, "near-sites")
    pending = ws.write(here, "near-points-0")
    found = []
    # widths from a sixteenth of the radius up; the last covers the radius
    shares = (1 / 16, 1 / 4, 1.0)
    for level, share in enumerate(shares):
        deg, last = cell_deg(radius_m * share), level == len(shares) - 1
        a = pending.withColumn("cell", F.explode(around("plon", "plat", deg)))
        b = there.withColumn("cell", cell("lon", "lat", deg))
        hits = a.join(dealt(b), [*by, "cell"]).withColumn("dist_m", metric("plon", "plat", "lon", "lat"))
        reach = radius_m * (1.0 if last else share)
        best = hits.where(F.col("dist_m") <= reach).groupBy(*by, "plon", "plat").agg(
            F.min(F.struct(F.round("dist_m", 6).alias("d"), F.col(f"site.{order}").alias("o"), "dist_m", "site", "lon", "lat")).alias("best"))
        best = ws.write(best.select(*by, "plon", "plat", F.col("best.dist_m").alias("dist_m"), F.col("best.site").alias("site"),
                                    F.col("best.lon").alias("slon"), F.col("best.lat").alias("slat")), f"near-found-{level}")
        found.append(best)
        if not last:
            pending = ws.write(pending.join(dealt(best), [*by, "plon", "plat"], "left_anti"), f"near-points-{level + 1}")
            if pending.isEmpty():
                break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _flat() -> Column:
    """How far a site (lon, lat) is from a point (plon, plat), on a plane scaled at the point's latitude."""
    dx, dy = geo.across(F.col("lon") - F.col("plon")) * F.cos(F.radians(F.col("plat"))), F.col("lat") - F.col("plat")
    return F.round(F.sqrt(dx * dx + dy * dy), 12)


def nearest_k(points: DataFrame, sites: DataFrame, k: int, ws: Workspace, order: str = "row_id", first_deg: float = 0.004) -> DataFrame:
    """Per distinct point (lon, lat), its k nearest sites: (plon, plat, rank,
    site columns, dist_m). Ranked on a plane scaled at the point's latitude,
    measured as great circles.

    There is no radius, so cells double until the kth site is closer
    than anything outside the neighbourhood can be. Only points still open
    move on.
    """
    from pyspark.sql import Window

    here = points.select(F.col("lon").alias("plon"), F.col("lat").alias("plat")).distinct()
    # beyond the first k at one place, no site can be among anyone's k
    at_place = Window.partitionBy("lon", "lat").orderBy(order)
    there = ws.write(sites.withColumn("nth", F.row_number().over(at_place)).where(F.col("nth") <= k).drop("nth"), "knn-sites")
    total = there.count()
    pending, found, level, deg = ws.write(here, "knn-points-0"), [], 0, whole_deg(first_deg)
    ranked = Window.partitionBy("plon", "plat").orderBy("flat", order)
    while True:
        whole = deg >= 360.0
        a = pending.withColumn("cell", F.explode(around("plon", "plat", deg)))
        b = there.withColumn("cell", cell("lon", "lat", deg))
        top = (
            a.join(dealt(b), "cell").withColumn("flat", _flat())
            .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        )
        sure = F.lit(whole) | ((F.count("*").over(Window.partitionBy("plon", "plat")) >= min(k, total))
                               & (F.max("flat").over(Window.partitionBy("plon", "plat")) <= deg))
        top = ws.write(top.withColumn("sure", sure).drop("cell"), f"knn-found-{level}")
        found.append(top.where("sure").drop("sure"))
        level += 1
        pending = ws.write(pending.join(dealt(found[-1].select("plon", "plat").distinct()), ["plon", "plat"], "left_anti"), f"knn-points-{level}")
        if whole or pending.isEmpty():
            break
        deg = whole_deg(2 * deg) if deg < 180.0 else 360.0
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumn("dist_m", geo.haversine("plon", "plat", "lon", "lat")).drop("flat")


def among_nearest(asked: DataFrame, sites: DataFrame, k: int, ws: Workspace, order: str = "row_id", first_deg: float = 0.004) -> DataFrame:
    """Of pairs of a point and a site (lon, lat, `order`), those whose site is among the point's k nearest: (plon, plat, `order`).

    The sites up to the farthest one asked for are counted, in tasks, and none is carried on. Only points with more
    than k of them, or that ask for one further off than a cell is high, are ranked as nearest_k does it.
    """
    known = asked.select(F.col("lon").alias("plon"), F.col("lat").alias("plat"), order).distinct().join(dealt(sites.select(order, "lon", "lat")), order)
    known = ws.write(known.select("plon", "plat", order, _flat().alias("flat")).where("flat is not null"), "among-asked")
    deg = whole_deg(first_deg)
    far = known.groupBy("plon", "plat").agg(F.max(F.struct("flat", order)).alias("far")).where(F.col("far.flat") <= deg)
    met = far.withColumn("cell", F.explode(around("plon", "plat", deg))).join(dealt(sites.select(order, "lon", "lat", cell("lon", "lat", deg).alias("cell"))), "cell")
    met = met.where(F.struct(_flat().alias("flat"), order) <= F.col("far"))
    few = ws.write(met.groupBy("plon", "plat").agg(F.count("*").alias("n")).where(F.col("n") <= k).select("plon", "plat"), "among-few")
    settled = known.join(dealt(few), ["plon", "plat"], "left_semi").select("plon", "plat", order)
    rest = ws.write(known.join(dealt(few), ["plon", "plat"], "left_anti"), "among-rest")
    if rest.isEmpty():
        return settled
    ranked = nearest_k(rest.select(F.col("plon").alias("lon"), F.col("plat").alias("lat")), sites, k, ws, order, first_deg)
    return settled.unionByName(rest.join(dealt(ranked.select("plon", "plat", order)), ["plon", "plat", order], "left_semi").select("plon", "plat", order))


def grid_clusters(points: DataFrame, zooms: range, radius_px: float = 55.0) -> DataFrame:
    """Pins counted per screen bucket and zoom. Counting is done at the finest
    zoom first; coarser zooms add up those counts' buckets' own pins."""
    x, y = geo.mercator_pixel("lon", "lat", max(zooms), tile_px=512)
    fine = points.select("lon", "lat", x.alias("px"), y.alias("py")).groupBy("lon", "lat", "px", "py").agg(F.count("*").alias("pins"))
    per_zoom = fine.withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in zooms])))
    scale = F.pow(F.lit(2.0), F.col("zoom") - F.lit(max(zooms)))
    return (
        per_zoom.select("zoom", F.floor(F.col("px") * scale / radius_px).alias("bx"), F.floor(F.col("py") * scale / radius_px).alias("by"), "pins", "lon", "lat")
        .groupBy("zoom", "bx", "by").agg(F.sum("pins").alias("pins"), (F.sum(F.col("lon") * F.col("pins")) / F.sum("pins")).alias("lon"),
                                         (F.sum(F.col("lat") * F.col("pins")) / F.sum("pins")).alias("lat"))
    )
