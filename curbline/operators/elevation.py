"""Ground height from a raster held as a pixel table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def decoded(pixels: DataFrame) -> DataFrame:
    """(px, py, elev) from colour-coded pixels, in single precision."""
    return pixels.select("px", "py", geo.terrain_metres("red", "green", "blue").cast("float").cast("double").alias("elev"))


def origin(lon, lat, zoom: int) -> tuple[Column, Column]:
    """Whole pixel coordinates of a mosaic's north-west corner."""
    x, y = geo.mercator_pixel(lon, lat, zoom)
    return F.floor(x), F.floor(y)


def sample(points: DataFrame, pixels: DataFrame, key: str, zoom: int, x0: Column, y0: Column) -> DataFrame:
    """(key, elev): bilinear height at each point, NULL outside the mosaic or
    where a pixel is missing, and never below sea level.

    A point becomes its four pixels and their weights; they meet the raster
    by equality and are summed up again. Points in one pixel square at one
    spot are looked up once.
    """
    x, y = geo.mercator_pixel("lon", "lat", zoom)
    edge = pixels.agg(F.max("px").alias("mx"), F.max("py").alias("my"))
    spots = points.select("lon", "lat").distinct().select("lon", "lat", (x - x0 - 0.5).alias("fx"), (y - y0 - 0.5).alias("fy"))
    spots = spots.withColumn("mx", edge.select("mx").scalar()).withColumn("my", edge.select("my").scalar())
    spots = spots.where("fx >= 0 and fy >= 0 and fx <= mx and fy <= my").selectExpr(
        "lon", "lat", "floor(fx) as c0", "floor(fy) as r0", "least(floor(fx) + 1, mx) as c1", "least(floor(fy) + 1, my) as r1", "fx - floor(fx) as u", "fy - floor(fy) as v")
    corners = spots.selectExpr("lon", "lat", """inline(array(
        named_struct('px', c0, 'py', r0, 'w', (1 - u) * (1 - v)), named_struct('px', c1, 'py', r0, 'w', u * (1 - v)),
        named_struct('px', c0, 'py', r1, 'w', (1 - u) * v), named_struct('px', c1, 'py', r1, 'w', u * v)))""")
    heights = (
        corners.join(pixels, ["px", "py"]).groupBy("lon", "lat").agg(F.sum(F.col("w") * F.col("elev")).alias("elev"), F.count("elev").alias("n"))
        .where("n = 4").select("lon", "lat", F.greatest("elev", F.lit(0.0)).alias("elev"))
    )
    return points.join(heights, ["lon", "lat"], "left").select(key, "elev")
