"""Surveyed bikeways: cleaning the records and matching them to streets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import geo
from ..functions.policy import lookup
from .spatial import cell, covering, dealt, whole_deg

CLASS_NAMES = {"CLASS I": 1, "CLASS II": 2, "CLASS III": 3, "CLASS IV": 4}
COMPASS_DEG = {"N": 0.0, "E": 90.0, "S": 180.0, "W": 270.0}
SAFER = {3: 1, 2: 2, 1: 3, 4: 4}
PIECE_DEG = whole_deg(0.0005)


def records(raw: DataFrame) -> DataFrame:
    """Survey rows (facility_t, streetname, dir, contraflow, geometry_type,
    geometry) as class code, street, direction of travel and line."""
    def tidy(c):
        return F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))

    return (
        raw.withColumn("cls", lookup(tidy("facility_t"), CLASS_NAMES))
        .where(F.col("cls").isNotNull() & (F.col("geometry_type") == "LineString") & (F.size("geometry") >= 2))
        .select("line_id", "cls", F.nullif(F.trim("streetname"), F.lit("")).alias("street"),
                F.when(tidy("dir").isin(*COMPASS_DEG), tidy("dir")).alias("dir"), (tidy("contraflow") == "YES").alias("contraflow"),
                geo.rounded(F.col("geometry"), 6).alias("geometry"))
    )


def shown(lines: DataFrame) -> DataFrame:
    """What a map draws: signed routes in traffic are left off."""
    return lines.where("cls <> 3")


def _flat_metric(kx: Column):
    def metric(lon1, lat1, lon2, lat2):
        dx, dy = (lon2 - lon1) * kx, (lat2 - lat1) * geo.METRES_PER_DEG_LAT
        return F.sqrt(dx * dx + dy * dy)

    return metric


def _samples(segments: DataFrame) -> DataFrame:
    """Segments × points a quarter, half and three quarters along (only half
    way on a short line), each with the bearing of its leg, on a plane scaled at the line's start. Built up column
    by column: a nested expression would be worked out again at every use."""
    cum = geo.running(geo.leg_lengths(F.col("geometry"), _flat_metric(F.col("kx"))))
    thirds = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    leg = F.aggregate(F.sequence(F.lit(1), F.size("geometry") - 1), F.lit(0), lambda acc, i: F.when(
        (acc == 0) & (F.get("cum", i) > F.get("cum", i - 1)) & (F.get("cum", i) >= F.col("want")), i).otherwise(acc))
    return (
        segments.select("seg_id", "class", "geometry").withColumn("kx", F.cos(F.radians(F.get("geometry", 0)["lat"])) * geo.METRES_PER_DEG_LON).withColumn("cum", cum)
        .withColumn("size_m", F.element_at("cum", -1)).where("size_m > 0")
        .withColumn("need", F.when(F.col("size_m") >= params.SHORT_LINE_M, 2).otherwise(1))
        .select("*", F.posexplode(thirds).alias("i", "f")).where("need = 2 or f = 0.5")
        .withColumn("want", F.col("f") * F.col("size_m")).withColumn("leg", leg)
        .withColumn("a", F.get("geometry", F.col("leg") - 1)).withColumn("b", F.get("geometry", F.col("leg")))
        .withColumn("t", (F.col("want") - F.get("cum", F.col("leg") - 1)) / (F.get("cum", F.col("leg")) - F.get("cum", F.col("leg") - 1)))
        .withColumn("p", geo.blend(F.col("a"), F.col("b"), F.col("t")))
        .select("seg_id", "class", "need", "i", "kx", "p.lon", "p.lat",
                geo.flat_bearing(F.col("a.lon") * F.col("kx"), F.col("a.lat") * geo.METRES_PER_DEG_LAT,
                                 F.col("b.lon") * F.col("kx"), F.col("b.lat") * geo.METRES_PER_DEG_LAT).alias("brg"))
    )


def match(segments: DataFrame, lines: DataFrame) -> DataFrame:
    """(seg_id, fwd, bwd, opened): the bikeway class on a street per heading
    (0 none), and the headings a contraflow lane opens to bicycles.

    Samples along the streets, each in its own small map cell, meet the line
    pieces filed under every cell within reach of them, of which there are far
    fewer. Votes are counted per street, heading and class, and the safest class
    with enough votes wins.
    """
    ky = geo.METRES_PER_DEG_LAT
    # a row of cells has a plane of its own, scaled at its middle
    kx = F.cos(F.radians((F.col("cell.cy") + 0.5) * PIECE_DEG)) * geo.METRES_PER_DEG_LON
    pieces = lines.select("cls", "dir", "contraflow", F.explode(geo.legs(F.col("geometry"))).alias("g")).where("g.a <> g.b")
    lo = lambda c: F.least(F.col(f"g.a.{c}"), F.col(f"g.b.{c}"))
    hi = lambda c: F.greatest(F.col(f"g.a.{c}"), F.col(f"g.b.{c}"))
    up = F.lit((params.MATCH_M + 1.0) / ky)
    aside = F.least(up / F.cos(F.radians(F.least(F.greatest(F.abs(lo("lat")), F.abs(hi("lat"))) + up, F.lit(90.0)))), F.lit(180.0))
    pieces = (
        pieces.withColumn("up", up).withColumn("aside", aside)
        .withColumn("cell", F.explode(covering(lo("lon") - F.col("aside"), hi("lon") + F.col("aside"), lo("lat") - F.col("up"), hi("lat") + F.col("up"), PIECE_DEG))).withColumn("kx", kx)
        .select("cell", "cls", "dir", "contraflow", (F.col("g.a.lon") * F.col("kx")).alias("ax"), (F.col("g.a.lat") * ky).alias("ay"),
                (F.col("g.b.lon") * F.col("kx")).alias("bx"), (F.col("g.b.lat") * ky).alias("by"))
        .withColumn("line_brg", geo.flat_bearing("ax", "ay", "bx", "by"))
    )
    points = _samples(segments).withColumn("cell", cell("lon", "lat", PIECE_DEG)).withColumn("kx", kx).select(
        "seg_id", "class", "need", "i", "brg", "cell", (F.col("lon") * F.col("kx")).alias("px"), (F.col("lat") * ky).alias("py"))
    allowed = (F.when(F.col("class") == "footway", F.col("cls") == 1)
               .when(F.col("class").isin(*params.PATHLIKE_CLASSES), F.col("cls").isin(1, 4)).otherwise(F.col("cls").isin(2, 3, 4)))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("px") - F.col("ax")) * dx + (F.col("py") - F.col("ay")) * dy) / (dx * dx + dy * dy)))
    ex, ey = F.col("px") - F.col("ax") - t * dx, F.col("py") - F.col("ay") - t * dy
    hits = points.join(dealt(pieces), "cell").where(
        allowed & (geo.undirected_gap(F.pmod("line_brg", F.lit(180.0)), F.pmod("brg", F.lit(180.0))) <= params.MATCH_DEG)
        & (F.sqrt(ex * ex + ey * ey) <= params.MATCH_M))
    facing = hits.withColumn("h", F.explode(F.array(F.lit(0), F.lit(1))))
    travel = F.pmod(F.col("brg") + 180.0 * F.col("h"), F.lit(360.0))
    facing = facing.where(F.col("dir").isNull() | (geo.undirected_gap(lookup(F.col("dir"), COMPASS_DEG), travel) < 90.0))
    lane = F.col("contraflow") & F.col("dir").isNotNull() & F.col("cls").isin(1, 2, 4)
    # three samples at most: a bit per sample counts each once, with partial sums
    votes = facing.groupBy("seg_id", "h", "cls").agg(
        F.bit_or(F.expr("shiftleft(1, i)")).alias("seen"),
        F.bit_or(F.when(lane, F.expr("shiftleft(1, i)")).otherwise(0)).alias("lanes"), F.max("need").alias("need"))
    won = F.bit_count("seen") >= F.col("need")
    best = votes.groupBy("seg_id", "h").agg(
        F.max_by(F.when(won, F.col("cls")), F.when(won, lookup(F.col("cls"), SAFER)).otherwise(0)).alias("cls"),
        F.bit_or("lanes").alias("lanes"), F.max("need").alias("need"))
    best = best.where("cls is not null").withColumn(
        "opened", F.when((F.bit_count("lanes") >= F.col("need")) & F.col("cls").isin(1, 2, 4), F.col("h") + 1).otherwise(0))
    return best.groupBy("seg_id").agg(
        F.max(F.when(F.col("h") == 0, F.col("cls")).otherwise(0)).alias("fwd"), F.max(F.when(F.col("h") == 1, F.col("cls")).otherwise(0)).alias("bwd"),
        F.bit_or("opened").alias("opened"))
