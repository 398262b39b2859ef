"""Parking: sites, layers, kinds that fit a vehicle, nearest to a goal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import geo, policy, text
from ..session import Workspace
from .spatial import nearest_within


def motorcycle_sites(spaces: DataFrame, box=params.EXTRACT_BOX) -> DataFrame:
    """Motorcycle spaces gathered into sites by block face and street side.

    The mean position needs one aggregate and the space nearest to it a
    second one; both combine before they shuffle. Equal distances go to the
    smaller space id.
    """
    kept = spaces.where((F.coalesce("flag", F.lit("")) != "L") & geo.inside("lon", "lat", box))
    near = lambda c: F.call_function("format_number", F.col(c), F.lit("0.0000"))
    kept = kept.select(
        "space_id", "lon", "lat", "flag", F.trim(F.coalesce("street_num", F.lit(""))).alias("num"), F.coalesce("street_name", F.lit("")).alias("street"),
        F.coalesce("onoff", F.lit("")).alias("onoff"), F.coalesce(F.nullif("blockface_id", F.lit("")), F.concat(near("lon"), F.lit(","), near("lat"))).alias("site"))
    key = ["site", "street", "onoff"]
    middle = kept.groupBy(*key).agg(F.avg("lon").alias("mlon"), F.avg("lat").alias("mlat"), F.count("*").alias("spaces"),
                                    F.count_if(F.col("flag").isin("M", "P")).alias("metered"))
    dx, dy = F.col("lon") - F.col("mlon"), F.col("lat") - F.col("mlat")
    nearest = kept.join(middle.select(*key, "mlon", "mlat"), key).groupBy(*key).agg(
        F.min_by("num", F.struct(F.round(dx * dx + dy * dy, 15), F.col("space_id"), F.col("num"))).alias("num"))
    name = text.blockface_street("street")
    street = F.when(F.col("street") != "", name)
    return middle.join(nearest, key).select(
        F.concat(F.lit("moto-"), F.col("site"), F.lit("-"), F.lower("onoff")).alias("id"), F.coalesce(street, F.lit("Motorcycle parking")).alias("name"),
        F.when((F.col("num") != "") & (F.col("num") != "0"), F.trim(F.concat(F.col("num"), F.lit(" "), F.coalesce(street, F.lit(""))))).otherwise(street).alias("address"),
        "spaces", "metered", (F.col("onoff") == "OFF").alias("offstreet"), geo.rounded_to("mlon", 5).alias("lon"), geo.rounded_to("mlat", 5).alias("lat"))


def all_parking(stations: DataFrame, lockers: DataFrame, racks: DataFrame, moto: DataFrame) -> DataFrame:
    """The four layers as one, each row with its kind."""
    tagged = [df.withColumn("kind", F.lit(kind)) for df, kind in ((stations, "charger"), (lockers, "locker"), (racks, "rack"), (moto, "moto"))]
    out = tagged[0]
    for more in tagged[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def parking_label(kind, name) -> Column:
    k, n = geo.col(kind), F.nullif(geo.col(name), F.lit(""))
    dotted = lambda head: F.when(n.isNull(), F.lit(head)).otherwise(F.concat(F.lit(head + " · "), n))
    return (F.when(k == "charger", F.coalesce(n, F.lit("Charging station"))).when(k == "locker", F.coalesce(n, F.lit("BikeLink locker")))
            .when(k == "moto", dotted("Motorcycle parking")).otherwise(dotted("Bike rack")))


def pins(pois: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Pins by the vehicles whose map shows their kind."""
    shown = vehicles.select("vehicle", F.explode(policy.per_vehicle("vehicle", params.PIN_KINDS)).alias("kind"))
    return pois.join(F.broadcast(shown), "kind")


def nearest_parking(goals: DataFrame, pois: DataFrame, ws: Workspace, key: str = "point_id") -> DataFrame:
    """Per goal and kind its vehicle may use, the nearest in-city parking
    within a mile: (key, kind, id, name, label, lon, lat, dist_m)."""
    wanted = goals.withColumn("kind", F.explode(policy.per_vehicle("vehicle", params.PARKING_KINDS)))
    metric = lambda a, b, c, d: geo.haversine(a, b, c, d, params.PARKING_EARTH_M)
    best = nearest_within(wanted, pois.where(geo.in_service_area("lon", "lat")).select("row_id", "id", "name", "kind", "lon", "lat"),
                          params.PARKING_MAX_M, ws, by=["kind"], metric=metric)
    return (
        wanted.select(key, "vehicle", "kind", F.col("lon").alias("plon"), F.col("lat").alias("plat")).join(best, ["kind", "plon", "plat"])
        .select(key, "vehicle", "kind", F.col("site.id").alias("id"), F.col("site.name").alias("name"), parking_label("kind", "site.name").alias("label"),
                F.col("slon").alias("lon"), F.col("slat").alias("lat"), "dist_m")
    )
